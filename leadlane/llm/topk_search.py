"""Exact top-k search by inner product, reading sorted lists without random access.

Vectors are integers: floor(scale * x) for each component x. Equal vectors travel once, with the k + 1 smallest ids that
have them. The distinct queries and the distinct vectors form a grid of cells, each with a bounded number of queries
and of vectors; a cell is one group of a shuffle and streams its vectors in segments. A segment becomes one list for
each dimension, sorted by component, to be read from its top or from its bottom as the query's component is positive
or negative. All lists of a query are read in step, down to a common contribution. A vector's lower bound is what was read of it
plus the worst value of every list it was not yet met in, its upper bound has the lists' last-read values in their
place. Vectors whose upper bound lies below the k-th lower bound, or below the k-th score of the segments before, are
outsiders; reading stops when few others are left. Their final scores are then resolved, and cells hand on their best
k + 1, from which Spark takes each query's best.

Every query meets every vector in one cell: queries are a stated set, and the work is queries x vectors by definition.

Defined results: vectors that are null or hold a null or non-finite component take no part; vectors meet only those of
their own length (an empty one only empty ones, with score 0); a row is no candidate of itself, but a repeated row is
one of the other; a null vec_id is never a query and stands last among equal scores; components and scores beyond 64
bits are held at the limits of a long; extra columns are ignored; a query without candidates has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import table

K, SCALE, EVERY = 5, 256, 50
#: Queries and vectors of a cell at most (on average); queries that a cell of its own is worth making for.
QUERIES, CELL, FEW = 4096, 1 << 16, 256
#: Vectors in a cell's first and largest segments: they double, as the first ones are read for a score to beat.
FIRST, SEGMENT = 256, 4096
#: How far below the score to beat the unmet are bounded when bounds are compared, as a share of the way to the worst.
SHARES = (1 / 8, 1 / 4, 1 / 2, 1)
MOST = (1 << 63) - 1


def integers(x: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) within the limits of a long, as doubles: exact below 2^53."""
    return np.clip(np.floor(x * scale), -(2.0 ** 63), 2.0 ** 63)


class Lists:
    """One sorted list for each dimension of a segment, readable from both ends."""

    def __init__(self, x: np.ndarray):
        self.x, (self.n, self.dim) = x, x.shape
        self.most = float(np.abs(x).max(initial=0))
        up = np.argsort(x, axis=0, kind="stable").T
        self.order = np.concatenate([up, up[:, ::-1]])  # ascending lists, then descending ones
        self.value = np.take_along_axis(np.concatenate([x.T, x.T]), self.order, axis=1)
        self.above = self.value - self.value[:, -1:]  # what an entry has more than the list's last one
        # All ascending lists as one ascending array, to find places in many lists at once.
        self.apart = 2 * self.most + 2
        self.places = (self.value[:self.dim] + np.arange(self.dim)[:, None] * self.apart).ravel()

    def depths(self, rows: np.ndarray, weight: np.ndarray, level: float) -> np.ndarray:
        """How many entries of each list contribute ``level`` or more; each list is read once at least."""
        at = np.clip(level / weight, -self.most - 1, self.most + 1) + rows * self.apart
        low, high = (np.searchsorted(self.places, at, side) - rows * self.n for side in ("left", "right"))
        return np.clip(np.where(weight > 0, self.n - low, high), 1, self.n)

    @staticmethod
    def _read(lists: np.ndarray, which: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return np.concatenate([lists[r, a:z] for r, a, z in zip(which.tolist(), start.tolist(), end.tolist())])

    def qualifying(self, q: np.ndarray, need: int, floor: float) -> np.ndarray:
        """Vectors that no bound rules out: all whose score can reach ``floor`` and the ``need``-th best of the segment."""
        rows = np.flatnonzero(q)
        if not len(rows):
            return np.arange(self.n)
        weight = q[rows]
        lists = rows + self.dim * (weight > 0)
        best, worst = weight * self.value[lists, 0], weight * self.value[lists, -1]
        lower, depth = np.full(self.n, worst.sum()), np.zeros(len(rows), np.int64)
        for share in SHARES if floor > worst.sum() else SHARES[-1:]:
            # The level at which a vector not met in any list is bounded by so much less than the floor.
            goal = floor - share * (floor - worst.sum()) if share < 1 else 0.0
            lo, hi = worst.min(), best.max()
            for _ in range(10):
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if np.minimum(np.maximum(worst, mid), best).sum() < goal else (lo, mid)
            to = np.maximum(depth, self.depths(rows, weight, lo)) if share < 1 else np.full(len(rows), self.n)
            ids = self._read(self.order, lists, depth, to)
            gain = self._read(self.above, lists, depth, to)
            gain *= np.repeat(weight, to - depth)
            lower += np.bincount(ids, gain, self.n)
            # What a vector has that was not yet met in a list is at most the list's last-read value.
            last = weight * self.value[lists, to - 1] - worst
            met = np.bincount(self._read(self.order, lists, 0 * to, to) if depth.any() else ids, np.repeat(last, to), self.n)
            depth = to
            if self.n > need:
                floor = max(floor, np.partition(lower, self.n - need)[self.n - need])
            left = np.flatnonzero(lower + (last.sum() - met) >= floor)
            if len(left) * 4 <= self.n:
                break
        return left


def best_of(lists: Lists, q: np.ndarray, need: int, floor: float, ids: list) -> list[tuple[int, int, int]]:
    """The segment's best ``need`` rows for one query as (-score, id is null, id), ascending; ids: those of each vector."""
    size = lists.most * np.abs(q).max(initial=0) * max(1, lists.dim)
    if size < 2 ** 51:
        left = lists.qualifying(q, need, floor)
        score = lists.x[left] @ q
        ok = score >= floor
        left, score = left[ok], score[ok].astype(np.int64).tolist()
    else:  # beyond the exact range of doubles: unbounded integers, all scores resolved
        left, own = np.arange(lists.n), [_long(x) for x in q.tolist()]
        score = [max(-MOST, min(MOST, sum(a * b for a, b in zip(own, map(_long, v))))) for v in lists.x.tolist()]
    got = sorted((-s, *ids[i][0], i) for s, i in zip(score, left.tolist()))[:need]
    return sorted((s, *x) for s, _, _, i in got for x in ids[i])[:need]


def _long(x: float) -> int:
    return max(-MOST - 1, min(MOST, int(x)))


_FOUND = "h1 long, h2 long, own long, down long, none boolean, vec_id long"


def _search(k: int, scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, queries, best = None, [], []
        vectors: list[np.ndarray] = []
        ids: list = []
        size = FIRST

        def segment():
            nonlocal size
            size = min(2 * size, SEGMENT)
            if ids and queries:
                lists = Lists(np.concatenate(vectors))
                for j, (_, _, q) in enumerate(queries):
                    top = best[j]
                    floor = -top[-1][0] if len(top) > k else -np.inf
                    best[j] = sorted(top + best_of(lists, q, k + 1, floor, ids))[:k + 1]
            vectors.clear()
            ids.clear()

        def cell():
            nonlocal size
            segment()
            size = FIRST
            rows = [(h1, h2, max(-MOST, min(MOST, sum(_long(x) ** 2 for x in q.tolist()))), *top) for (h1, h2, q), tops in zip(queries, best) for top in tops]
            queries.clear()
            best.clear()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.bool_() if i == 4 else pa.int64()) for i in range(6)],
                                                 names=["h1", "h2", "own", "down", "none", "vec_id"])

        for b in batches:
            dim, cb, qb, is_query, h1, h2 = (b.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            flat = integers(b.column(6).flatten().to_numpy(zero_copy_only=False).astype(np.float64), scale)
            start = np.r_[0, np.cumsum(dim)]
            ends = np.r_[0, np.flatnonzero((dim[1:] != dim[:-1]) | (cb[1:] != cb[:-1]) | (qb[1:] != qb[:-1]) | (is_query[1:] != is_query[:-1])) + 1, len(dim)]
            for x, y in zip(ends[:-1].tolist(), ends[1:].tolist()):
                if x == y:
                    continue
                if key != (now := (dim[x], cb[x], qb[x])):
                    yield from cell()
                    key = now
                v = flat[start[x]:start[y]].reshape(y - x, int(dim[x]))
                if is_query[x]:  # a cell's queries come first
                    queries.extend(zip(h1[x:y].tolist(), h2[x:y].tolist(), v))
                    best.extend([] for _ in range(y - x))
                    continue
                at = 0
                while at < y - x:
                    n = min(size - len(ids), y - x - at)
                    vectors.append(v[at:at + n])
                    ids.extend([(i["none"], i["vec_id"] or 0) for i in own] for own in b.column(7).slice(x + at, n).to_pylist())
                    at += n
                    if len(ids) >= size:
                        segment()
        yield from cell()

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = K, scale: float = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score) of each row of ``vectors`` (vec_id, embedding) for which ``is_query`` holds,
    against all other rows."""
    kind = dict(vectors.dtypes)["embedding"]
    kind = kind if kind == "array<float>" else "array<double>"  # floats travel as floats; all arithmetic is exact
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), is_query.alias("q"), F.col("embedding").cast(kind).alias("e"))
    rows = rows.where(F.col("e").isNotNull() & F.coalesce(F.forall("e", finite), F.lit(False)))
    whole = F.transform("e", lambda x: F.floor(x.cast("double") * scale))
    rows = cut_lineage(rows.withColumns({"h1": F.xxhash64(whole), "h2": F.xxhash64(F.lit("second half"), whole)}))
    # Of equal vectors only k + 1 ids can matter; the limit works before the shuffle too, so a hot vector is no hot task.
    few = rows.withColumn("r", F.row_number().over(Window.partitionBy("h1", "h2").orderBy(F.col("vec_id").asc_nulls_last()))).where(F.col("r") <= k + 1)
    cand = cut_lineage(few.groupBy("h1", "h2").agg(F.first("e").alias("e"), F.sort_array(F.collect_list(F.struct(F.col("vec_id").isNull().alias("none"), "vec_id"))).alias("ids")))
    asked = rows.where("q and vec_id is not null").select("vec_id", "h1", "h2")
    query = cut_lineage(cand.join(asked.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi").drop("ids"))
    n, m = cand.count(), query.count()
    # Where blocks of full size would leave partitions without work, the queries are cut finer.
    nc = max(-(-n // CELL), 1)
    nq = max(-(-m // QUERIES), min(-(-m // FEW), int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")) // nc), 1)
    numbers = lambda c: F.explode(F.sequence(F.lit(0), F.lit(c - 1)))
    block = lambda h, c: F.pmod(F.col(h), F.lit(c)).cast("int")
    cells = query.select(numbers(nc).alias("cb"), block("h2", nq).alias("qb"), F.lit(True).alias("is_query"), "h1", "h2", "e", F.lit(None).cast(dict(cand.dtypes)["ids"]).alias("ids")).unionByName(
        cand.select(block("h1", nc).alias("cb"), numbers(nq).alias("qb"), F.lit(False).alias("is_query"), "h1", "h2", "e", "ids"))
    cells = cells.select(F.size("e").alias("dim"), "cb", "qb", "is_query", "h1", "h2", "e", "ids").repartition(nc * nq, "dim", "cb", "qb")
    found = cut_lineage(cells.sortWithinPartitions("dim", "cb", "qb", F.desc("is_query")).mapInArrow(_search(k, scale), _FOUND))
    order = [F.col("down"), F.col("none"), F.col("vec_id")]
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("h1", "h2").orderBy(*order))).where(F.col("r") <= k + 1)
    best = best.groupBy("h1", "h2").agg(F.first("own").alias("own"), F.sort_array(F.collect_list(F.struct("down", "none", "vec_id"))).alias("top"))
    # The query's own row is one entry of its vector's best, or is not among them.
    me = F.array_position("top", F.struct((-F.col("own")).alias("down"), F.lit(False).alias("none"), F.col("query_id").alias("vec_id")))
    out = asked.withColumnRenamed("vec_id", "query_id").join(cut_lineage(best), ["h1", "h2"]).withColumn("me", me)
    others = F.slice(F.when(F.col("me") > 0, F.concat(F.slice("top", F.lit(1), F.col("me").cast("int") - 1), F.slice("top", F.col("me").cast("int") + 1, F.lit(k + 1)))).otherwise(F.col("top")), 1, k)
    out = out.select("query_id", F.posexplode(others).alias("p", "x"))
    return out.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.when(~F.col("x.none"), F.col("x.vec_id")).alias("vec_id"), (-F.col("x.down")).alias("score"))


def topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: the five best of all other vectors for each vec_id divisible by 50."""
    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % EVERY == 0)


TOPK_SQL = """
with usable as (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (select q.r, q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score
  from usable q join usable c on q.r <> c.r and len(q.v) = len(c.v) where q.vec_id % 50 = 0),
ranked as (select *, row_number() over (partition by r order by score desc, vec_id nulls last) as k from scored)
select query_id, cast(k as int) as rank, vec_id, score from ranked where k <= 5
"""
