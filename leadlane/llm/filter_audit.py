"""What each order of a chain of filters removes, keeps and makes redundant.

Documents are measured once in the scan; what travels from there is a row of a few numbers, never a text. Each
document ends up with a mask of the filters that it fails, and all further work is on the counts of documents by part
and mask: at most 2^F rows for a part, combined before the shuffle.

The rank at which an order removes a mask is a min-plus product: the mask matrix (0 for a failed filter, infinity for
any other) and the inverse permutations (the step at which each filter stands in an order) are added and the minimum is
taken over the filters. The counts are then scattered to the steps that the ranks name, weighted by documents, good
ones and toxic ones. A document that fails the filter of a step and has a smaller rank is redundant there.

Defined results: a null text is empty, a null part the empty string; a document with a null doc_id is never a copy,
nor the first of copies; repeated rows count each time and are no copies of themselves; several labels of one doc_id
count as good (toxic) if one of them says so; extra columns are ignored; an empty table has no parts and gives no rows.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import UPPER, table

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_UPPER, SYMBOLS = 50, 65, 5, b"#$%&*|"
_UPPER, _INNER_BYTES = UPPER.encode(), bytes(range(0x80, 0xC0))
_COUNTS = ["n", "good", "toxic"]


def text_mask(text: bytes) -> int:
    """The filters A to D that a text (UTF-8) fails, as bits 0 to 3."""
    w = text.split()  # bytes split at the contract's separators and no others
    chars = len(text) - len(text.translate(None, _INNER_BYTES)) if not text.isascii() else 0
    chars, upper = len(text) - chars, len(text) - len(text.translate(None, _UPPER))
    return ((len(w) < MIN_WORDS) | (100 * len(set(w)) < MIN_DISTINCT * len(w)) << 1 | (100 * upper > MAX_UPPER * chars) << 2
            | (len(text.translate(None, SYMBOLS)) < len(text)) << 3)


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, h1, h2) per row of ``docs`` (doc_id, source, text); h1 and h2: 128 bits of the text."""

    def run(batches):
        for b in batches:
            mask, h = np.empty(b.num_rows, np.int32), np.empty((b.num_rows, 2), "<i8")
            for i, t in enumerate(b.column(2)):
                t = t.as_py()
                mask[i], h[i] = text_mask(t), np.frombuffer(xxhash.xxh3_128_digest(t), "<i8")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(mask), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())],
                                             names=["doc_id", "part", "mask", "h1", "h2"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
                    F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    return d.mapInArrow(run, "doc_id long, part string, mask int, h1 long, h2 long")


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by the filters that they fail; bit 4 is a copy of a smaller doc_id."""
    t = cut_lineage(measured(docs))
    # The first holder of a text is met under (text, doc_id), so the copies of one text spread over all tasks.
    first = t.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null").withColumn("first", F.lit(True))
    rows = t.groupBy("h1", "h2", "doc_id", "part", "mask").agg(F.count("*").alias("n")).join(first, ["h1", "h2", "doc_id"], "left")
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    # Null ids have no label; their own salt keeps them from meeting in one task.
    rows = rows.select("doc_id", F.when(F.col("doc_id").isNull(), F.col("h1")).otherwise(F.lit(0)).alias("salt"), "part", "n",
                       (F.col("mask") + F.when(copy, 16).otherwise(0)).alias("mask"))
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("salt")).agg(
        *[F.coalesce(F.max((F.col(c) == 1).cast("long")), F.lit(0)).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))])
    weighed = lambda c: F.sum(F.col("n") * F.coalesce(F.col(c), F.lit(0))).alias(c)
    return rows.join(marks, ["doc_id", "salt"], "left").groupBy("part", "mask").agg(weighed("good"), weighed("toxic"), F.sum("n").alias("n"))


@lru_cache(maxsize=8)
def ranks(filters: str = FILTERS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """All orders; which filter stands at each step (orders x steps); the step that removes a mask (masks x orders)."""
    n = len(filters)
    at = np.array(list(permutations(range(n))))
    position = np.argsort(at, axis=1) + 1.0  # the inverse permutations
    failed = np.arange(1 << n)[:, None] >> np.arange(n) & 1
    mask = np.where(failed == 1, 0.0, np.inf)
    rank = (mask[:, None, :] + position[None, :, :]).min(axis=2)
    return ["".join(filters[i] for i in o) for o in at], at, np.where(np.isinf(rank), n + 1, rank).astype(int)


def scattered(counts: np.ndarray, filters: str = FILTERS) -> dict[str, np.ndarray]:
    """counts: parts x masks x (n, good, toxic). Each column of the audit as parts x orders x steps."""
    n = len(filters)
    _, at, rank = ranks(filters)
    orders = np.arange(len(at))
    removed = np.zeros((*counts.shape[::2], len(at), n + 2), np.int64)  # parts x counts x orders x steps
    for m in range(1 << n):
        removed[:, :, orders, rank[m]] += counts[:, m, :, None]
    removed = removed[..., 1:n + 1]
    fails = np.stack([counts[:, (np.arange(1 << n) >> f & 1) == 1, 0].sum(axis=1) for f in range(n)], axis=1)
    alone = counts[:, 1 << np.arange(n), 0]
    shapley = np.zeros((len(counts), n), np.int64)
    for f in range(n):
        shapley[:, f] = removed[:, 0][:, at == f].sum(axis=1)
    return {"kept": counts[:, :, 0].sum(axis=1)[:, None, None] - removed[:, 0].cumsum(axis=2), "removed": removed[:, 0],
            "redundant": fails[:, at] - removed[:, 0], "unique_fails": alone[:, at], "good_lost": removed[:, 1], "toxic_lost": removed[:, 2], "shapley": shapley[:, at]}


def audit(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part, filter_order, step, kept, removed, ...) from ``mask_counts``: a row for each part, order and step.

    All F! orders of F filters come out, so F is a handful. A part's counts are at most 2^F rows, whatever its size.
    """
    n = len(filters)
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]

    def run(batches):
        orders, at, _ = ranks(filters)
        for whole in batches:
            for k in range(0, whole.num_rows, 64):
                b = whole.slice(k, 64)
                w = np.zeros((b.num_rows, 1 << n, len(_COUNTS)), np.int64)
                for p, got in enumerate(b.column(1).to_pylist()):
                    for x in got:
                        w[p, x["mask"]] = [x[c] for c in _COUNTS]
                out = scattered(w, filters)
                part = b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), at.size)))
                order = pa.array(orders).take(pa.array(np.tile(np.repeat(np.arange(len(at)), n), b.num_rows)))
                step = pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), b.num_rows * len(at)))
                yield pa.RecordBatch.from_arrays([part, order, step, *(pa.array(np.ascontiguousarray(out[c]).ravel()) for c in names)],
                                                 names=["part", "filter_order", "step", *names])

    by = counts.groupBy("part").agg(F.collect_list(F.struct("mask", *_COUNTS)).alias("masks"))
    return by.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in names))


def filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: five filters in all 120 orders, for each source of the documents."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "source", "text"), table(spark, sf_dir, "labels")
    return audit(mask_counts(docs, labels))


AUDIT_SQL = r"""
with labelled as (select doc_id, coalesce(max(case when quality = 1 then 1 else 0 end), 0) as good, coalesce(max(case when toxic = 1 then 1 else 0 end), 0) as toxic from labels group by doc_id),
docs as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
failing as (select part, doc_id, len(w) < 50 as a, 100 * len(list_distinct(w)) < 65 * len(w) as b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) as c,
  regexp_matches(t, '[#$%&*|]') as d, coalesce(doc_id > min(doc_id) over (partition by t), false) as e from docs),
masks as (select part, a, b, c, d, e, count(*) as n, sum(coalesce(good, 0)) as good, sum(coalesce(toxic, 0)) as toxic from failing left join labelled using (doc_id) group by all),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
orders as (select v.x || w.x || x.x || y.x || z.x as o from letters v, letters w, letters x, letters y, letters z where len(list_distinct([v.x, w.x, x.x, y.x, z.x])) = 5),
ranked as (select *, least(case when a then strpos(o, 'A') else 6 end, case when b then strpos(o, 'B') else 6 end, case when c then strpos(o, 'C') else 6 end,
  case when d then strpos(o, 'D') else 6 end, case when e then strpos(o, 'E') else 6 end) as r from masks, orders),
stepped as (select part, o, s, substr(o, s, 1) as f, n, good, toxic, r,
  case substr(o, s, 1) when 'A' then a when 'B' then b when 'C' then c when 'D' then d else e end as fails, cast(a as int) + cast(b as int) + cast(c as int) + cast(d as int) + cast(e as int) as k
  from ranked, (select unnest([1, 2, 3, 4, 5]) as s)),
counted as (select part, o, s, f, sum(case when r > s then n else 0 end) as kept, sum(case when r = s then n else 0 end) as removed, sum(case when fails and r < s then n else 0 end) as redundant,
  sum(case when fails and k = 1 then n else 0 end) as unique_fails, sum(case when r = s then good else 0 end) as good_lost, sum(case when r = s then toxic else 0 end) as toxic_lost from stepped group by part, o, s, f)
select part, o as filter_order, cast(s as int) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails,
  cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost, cast(sum(removed) over (partition by part, f) as bigint) as shapley from counted
"""
