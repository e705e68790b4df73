"""Near-duplicate embeddings by spherical-cap filters.

A structured random code has a codeword for every combination of one short random vector from each block of
(rotated) dimensions. A codeword is a filter: the cap of directions whose inner product with it exceeds a height.
Each vector is list-decoded to all filters that it exceeds, without trying them one by one: block by
block, only the words that can still reach the height go on. Two vectors are compared if they share a
filter, and in double precision. The height is set on random pairs at exactly the wanted cosine, from a fixed seed, so
that at least ``recall`` of them share a filter; nearer pairs share one far more surely. The number of filters follows
the number of vectors; the code has two blocks at every size, so that a vector's list grows slowly with the table (for 64
dimensions 137 filters at 5,000 vectors, 218 at a million, 278 at three, 313 at ten million).

Equal vectors travel once, with their number. A filter with more than ``limit`` vectors is split into blocks, and each
pair of blocks is a group of its own, so no task gathers a filter; a group emits no pairs but, for each vector, the number of its
links and one link to a representative. A link found under several filters counts under the smallest only. Members that
also share one smaller filter met there, so a group compares only the others with all: a cluster whose vectors lie under
the same filters is compared about once, not once for each. Groups are compared in tiles, which bounds a task's memory.

Defined results: vectors that are null, empty, zero or hold a null or non-finite component link with nothing and stand
for themselves; vectors of different lengths never link; rows with equal vectors are linked; a null vec_id never names
a component; repeated rows are vectors of their own; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import components, table

COSINE, RECALL, LIMIT, SEED = 0.9, 0.99, 2048, 20240229
#: Random pairs on which a height is set, and filters for each vector of the table.
TRIALS, FILTERS_PER_VECTOR = 1000, 2048
#: Members and other members compared at once, and inner products held at once.
TILE, HELD = (256, 512), 1 << 22


class Code:
    """The filters for vectors of one length."""

    def __init__(self, dim: int, parts: int, size: int):
        rng = np.random.default_rng([SEED, dim])
        self.turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        self.blocks = np.array_split(np.arange(dim), min(parts, dim))
        self.size, self.words = size, []
        for b in self.blocks:
            w = rng.standard_normal((size, len(b)))
            self.words.append(w / np.linalg.norm(w, axis=1, keepdims=True))

    def products(self, unit: np.ndarray) -> list[np.ndarray]:
        """Inner products of each vector with each block's words."""
        x = unit @ self.turn
        return [x[:, b] @ w.T for b, w in zip(self.blocks, self.words)]

    def decode(self, unit: np.ndarray, height: float) -> list[np.ndarray]:
        """All filters of each vector, ascending: block by block, only what can still reach the height goes on."""
        out = []
        step = max(1, min(64, HELD // self.size))
        for at in range(0, len(unit), step):
            for xs in zip(*self.products(unit[at:at + step])):
                rest = sum(x.max() for x in xs)
                ids, got = np.zeros(1, np.int64), np.zeros(1)
                for x in xs:
                    rest -= x.max()
                    j = np.flatnonzero(x >= height - rest - got.max(initial=-np.inf))
                    p, q = np.nonzero(got[:, None] + x[j][None, :] >= height - rest)
                    ids, got = ids[p] * self.size + j[q], got[p] + x[j[q]]
                out.append(np.sort(ids))
        return out


def shape_for(dim: int, n: int) -> tuple[int, int]:
    """(blocks, words a block) for ``n`` vectors."""
    filters = max(64, FILTERS_PER_VECTOR * n)
    parts = min(dim, 2)
    return parts, int(np.ceil(filters ** (1 / parts))) if parts > 1 else 2


@lru_cache(maxsize=64)
def code_for(dim: int, parts: int, size: int) -> Code:
    return Code(dim, parts, size)


def _top(x: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest."""
    return np.argpartition(-x, k)[:k] if len(x) > k else np.arange(len(x))


def height_for(code: Code, dim: int, cosine: float, recall: float) -> float:
    """A height at which at least ``recall`` of random pairs at ``cosine`` share a filter."""
    rng = np.random.default_rng([SEED, dim, 1])
    u = rng.standard_normal((TRIALS, dim))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    w = rng.standard_normal((TRIALS, dim))
    if dim == 1:
        return -1.0  # two directions; all vectors of one are equal in angle
    w -= (w * u).sum(1, keepdims=True) * u
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    v = cosine * u + np.sqrt(1 - cosine * cosine) * w
    best = []
    step = max(1, min(50, HELD // code.size))
    for at in range(0, TRIALS, step):
        for xs, ys in zip(zip(*code.products(u[at:at + step])), zip(*code.products(v[at:at + step]))):
            # Of the codewords near the top of the pair's mean, the one whose smaller product is largest.
            a, b = np.zeros(1), np.zeros(1)
            for x, y in zip(xs, ys):
                near = _top(x + y, 64)
                a, b = ((s[:, None] + t[near][None, :]).ravel() for s, t in ((a, x), (b, y)))
                near = _top(np.minimum(a, b), 256)
                a, b = a[near], b[near]
            best.append(np.minimum(a, b).max())
    return float(np.quantile(best, 1 - recall))


def valid(e) -> F.Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return e.isNotNull() & (F.size(e) > 0) & F.coalesce(F.forall(e, finite), F.lit(False)) & F.exists(e, lambda x: x != 0)


def _units(col: pa.Array) -> np.ndarray:
    x = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # else squares could overflow or vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Shared:
    """The filters smaller than ``now`` of a group's members."""

    def __init__(self, flat: np.ndarray, offsets: np.ndarray, now: int):
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        early = flat < now
        row = row[early]
        _, at, n = np.unique(flat[early], return_inverse=True, return_counts=True)
        met = n[at] > 1
        self.row, self.at = row[met], (np.cumsum(n > 1) - 1)[at[met]]
        self.count = n[n > 1]
        self.first = np.searchsorted(self.row, np.arange(len(offsets)))  # of each member, and the end

    def apart(self, rows: int) -> np.ndarray:
        """Members that haven't all met under the one filter that most of them share."""
        out = np.ones(rows, bool)
        if len(self.count):
            out[self.row[self.at == self.count.argmax()]] = False
        return np.flatnonzero(out)

    def met(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which of the members ``a`` share a filter with which of the members ``b``."""
        ids = np.unique(np.concatenate([self.at[self.first[i]:self.first[i + 1]] for i in a]))
        marks = []
        for side in (a, b):
            k = np.concatenate([self.at[self.first[i]:self.first[i + 1]] for i in side])
            r = np.repeat(np.arange(len(side)), self.first[side + 1] - self.first[side])
            p = np.searchsorted(ids, k)
            ok = np.isin(k, ids)
            m = np.zeros((len(side), len(ids)), np.float32)
            m[r[ok], p[ok]] = 1
            marks.append(m)
        return marks[0] @ marks[1].T > 0


def tiles(units: np.ndarray, block: np.ndarray, across: bool, shared: Shared, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(members, others, whether new) of links; pairs that met under the filter that most members share are left out.
    ``across``: only links between two blocks."""
    apart = shared.apart(len(units))
    for i in range(0, len(apart), TILE[0]):
        a = apart[i:i + TILE[0]]
        for lo in range(0, len(units), TILE[1]):
            hi = min(lo + TILE[1], len(units))
            link = units[a] @ units[lo:hi].T >= cosine
            link &= block[a][:, None] != block[None, lo:hi] if across else a[:, None] != np.arange(lo, hi)[None, :]
            if link.any():
                x, y = np.nonzero(link)
                (some, at), (other, to) = np.unique(x, return_inverse=True), np.unique(y, return_inverse=True)
                yield a[x], y + lo, ~shared.met(a[some], other + lo)[at, to]


def join(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``label`` (of each place the least place of its component) after the links (x, y)."""
    while True:
        p, q = label[x], label[y]
        d = p != q
        if not d.any():
            return label
        to = np.arange(len(label))
        np.minimum.at(to, np.maximum(p, q)[d], np.minimum(p, q)[d])
        while (to[to] != to).any():
            to = to[to]
        label = to[label]


_LINKS = "node long, n long, root long"


def compare(now: int, across: bool, block, node, copies, units, flat, offsets, cosine: float) -> list[np.ndarray] | None:
    """(node, its new links, the least node it reaches) of the members of one group that link with another."""
    if len(node) <= TILE[1]:  # most groups are small and hold no link
        link = units @ units.T >= cosine
        np.fill_diagonal(link, False)
        if not link.any():
            return None
    shared = Shared(flat, offsets, now)
    n, on, label = np.zeros(len(node), np.int64), np.zeros(len(node), bool), np.arange(len(node))
    apart = np.zeros(len(node), bool)
    apart[shared.apart(len(node))] = True
    for x, y, new in tiles(units, block, across, shared, cosine):
        on[x] = on[y] = True
        np.add.at(n, x[new], copies[y[new]])
        back = new & ~apart[y]  # a pair of two members apart is seen from both
        np.add.at(n, y[back], copies[x[back]])
        label = join(label, x, y)
    low = np.full(len(node), np.iinfo(np.int64).max)
    np.minimum.at(low, label, node)  # the least node of each component
    return [node[on], n[on], low[label][on]] if on.any() else None


def _verify(cosine: float):
    def groups(t: pa.Table) -> Iterator[list[np.ndarray]]:
        """The links of a run of whole groups; columns are turned into arrays once for all of them."""
        t = t.combine_chunks()
        dim, now, bi, bj, block, node, copies = (t.column(c).to_numpy() for c in ("dim", "filter", "bi", "bj", "block", "node", "copies"))
        e, f = (pa.concat_arrays(t.column(c).chunks) for c in ("e", "filters"))
        flat, at = f.flatten().to_numpy(), np.r_[0, np.cumsum(np.diff(f.offsets.to_numpy()))]
        ends = np.flatnonzero(_changes(t))
        ends = np.r_[ends, t.num_rows]
        lo = units = None
        for x, y in zip(ends[:-1], ends[1:]):
            if y - x == 1:
                continue
            if lo is None or dim[lo] != dim[x]:  # rows are sorted by dim first
                lo = x
                units = _units(e.slice(lo, np.searchsorted(dim, dim[x], "right") - lo))
            got = compare(now[x], bi[x] != bj[x], block[x:y], node[x:y], copies[x:y], units[x - lo:y - lo], flat[at[x]:at[y]], at[x:y + 1] - at[x], cosine)
            if got:
                yield got

    def links(t: pa.Table) -> Iterator[pa.RecordBatch]:
        if found := list(groups(t)):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=["node", "n", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = t if rest is None else pa.concat_tables([rest, t])
            last = int(np.flatnonzero(_changes(t))[-1])  # the last group may go on in the next batch
            rest = t.slice(last)
            if last:
                yield from links(t.slice(0, last))
        if rest is not None:
            yield from links(rest)

    return run


def _changes(t: pa.Table) -> np.ndarray:
    """Whether a row begins a group."""
    k = np.stack([t.column(c).to_numpy() for c in ("dim", "filter", "bi", "bj")], axis=1)
    return np.r_[True, (k[1:] != k[:-1]).any(axis=1)]


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL, limit: int = LIMIT) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``vectors`` (vec_id, embedding)."""
    kind = dict(vectors.dtypes)["embedding"]
    kind = kind if kind == "array<float>" else "array<double>"  # floats travel as floats; all arithmetic is in doubles
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("e"))
    rows = rows.withColumn("ok", valid(F.col("e"))).withColumns({
        "h1": F.when(F.col("ok"), F.xxhash64("e")), "h2": F.when(F.col("ok"), F.xxhash64(F.lit("second half"), "e"))})
    reps = cut_lineage(rows.where("ok").groupBy("h1", "h2").agg(F.first("e").alias("e"), F.count("*").alias("copies"), F.min("vec_id").alias("least"))
                       .withColumn("node", F.monotonically_increasing_id()))
    # One row for each length of vectors; a table has one or a few.
    sizes = {r.dim: r.n for r in reps.groupBy(F.size("e").alias("dim")).agg(F.count("*").alias("n")).collect()}
    how = {}
    for dim, n in sizes.items():
        shape = shape_for(dim, n)
        how[dim] = (*shape, height_for(code_for(dim, *shape), dim, cosine, recall))

    def decode(batches):
        for b in batches:
            lens = np.diff(b.column(1).offsets.to_numpy())
            out: list = [None] * len(lens)
            for dim in np.unique(lens).tolist():
                parts, size, height = how[dim]
                at = np.flatnonzero(lens == dim)
                for i, f in zip(at.tolist(), code_for(dim, parts, size).decode(_units(b.column(1).take(pa.array(at))), height)):
                    out[i] = f
            offsets = np.r_[0, np.cumsum([len(f) for f in out])].astype(np.int32)
            flat = np.concatenate(out) if out else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int64()))],
                                             names=["node", "e", "copies", "filters"])

    coded = cut_lineage(reps.select("node", "e", "copies").mapInArrow(decode, f"node long, e {kind}, copies long, filters array<long>"))
    each = coded.select("node", F.size("e").alias("dim"), F.explode("filters").alias("filter"))
    full = cut_lineage(each.groupBy("dim", "filter").agg(F.count("*").alias("m")).where("m > 1"))
    blocks = F.ceil(F.col("m") / limit).cast("int")
    # Of a vector's filters only those that it shares go on, a few of all.
    met = cut_lineage(each.join(full, ["dim", "filter"]))
    lists = met.groupBy("node").agg(F.sort_array(F.collect_list("filter")).alias("filters"))
    coded = coded.drop("filters").join(lists, "node")
    member = met.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    member = member.select("dim", "filter", "node", "block", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("o"))
    member = member.select("dim", "filter", "node", "block", F.least("block", "o").alias("bi"), F.greatest("block", "o").alias("bj"))
    groups = member.join(coded, "node").select("dim", "filter", "bi", "bj", "block", "node", "copies", "e", "filters")
    groups = groups.repartition("dim", "filter", "bi", "bj").sortWithinPartitions("dim", "filter", "bi", "bj")
    found = cut_lineage(groups.mapInArrow(_verify(cosine), _LINKS))
    links = found.groupBy("node").agg(F.sum("n").alias("n"))
    comp = components(found.select("node", "root"), "node", "root").withColumnRenamed("component", "comp")
    named = reps.select("h1", "h2", "node", "copies", "least").join(links, "node", "left").join(comp, "node", "left")
    named = cut_lineage(named.select("h1", "h2", "least", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("comp", "node").alias("comp")))
    named = named.join(named.groupBy("comp").agg(F.min("least").alias("component_id")), "comp").select("h1", "h2", "n_links", "component_id")
    out = rows.select("vec_id", "h1", "h2").join(cut_lineage(named), ["h1", "h2"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("h1").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: links and component of every vector."""
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))

