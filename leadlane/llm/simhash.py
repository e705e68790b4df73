"""SimHash near-duplicates with a bit-sliced comparison.

Every whole text becomes one 64-bit fingerprint in the scan. From then on only distinct fingerprints travel. Two that
differ in at most ``radius`` bits agree on two of ``radius + 2`` bands, so they meet under one of the band pairs' keys.
A key that more than ``limit`` fingerprints share is refined: their still free bits are split into bands again, and so
on until a key cannot hold more than ``limit`` distinct fingerprints; nothing is skipped, and no task gets a larger
group. Inside a task the fingerprints of many keys lie in one block as 64 vertical bit planes. Shifting the planes by s
lanes compares every fingerprint with the s-th next one at once: the planes' differences are added up by carry-save
adders into bitwise counters, and a block is abandoned as soon as each of its lanes has exceeded the radius. A block
emits a spanning tree of its links, and connected components join those.

Defined results: a text without words (null, empty, blank) has fingerprint zero and links like any other; a null
doc_id never names a component (a component without any other id has a null component_id); repeated rows are linked
rows; extra columns are kept by ``one_of_each`` and ignored elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations, islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import components, table, text_tag, words

SHINGLE, RADIUS, LIMIT, SEED, BLOCK = 3, 2, 512, 42, 8192
FULL = (1 << 64) - 1


def fingerprint(text: str | None, shingle: int = SHINGLE, piece: int = 1 << 16) -> int:
    """Bits set in over half of the shingles' XXH64 values; the shingles are hashed in bounded pieces."""
    w = words(text)
    if not w:
        return 0
    grams = zip(*(islice(w, i, None) for i in range(shingle))) if len(w) >= shingle else [w]
    n, ones = max(1, len(w) - shingle + 1), np.zeros(64, np.int64)
    hashed = map(xxhash.xxh64_intdigest, map(b" ".join, grams), repeat(SEED))
    while (h := np.fromiter(islice(hashed, piece), np.uint64)).size:
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist()))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, tag, fp as signed long) per row."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in b.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp)], names=["doc_id", "tag", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_tag("text").alias("tag"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, tag binary, fp long")


def band_masks(fixed: int, radius: int) -> list[int]:
    """``fixed`` with two of the radius + 2 bands of its free bits added, for each two."""
    free = [i for i in range(64) if not fixed >> i & 1]
    n = radius + 2
    bands = [sum(1 << i for i in free[k * len(free) // n:(k + 1) * len(free) // n]) for k in range(n)]
    return [fixed | a | b for a, b in combinations(bands, 2)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def carry_save(planes: Iterable[int], alive: int, radius: int) -> int:
    """Lanes of ``alive`` in which at most ``radius`` of the planes have a bit.

    Three planes at a time pass a full adder; its sum and carry go into vertical counters, and lanes that exceed the
    radius leave. Ends early when none is left.
    """
    counters = [0] * radius.bit_length()

    def add(x: int, at: int) -> int:
        for i in range(at, len(counters)):
            counters[i], x = counters[i] ^ x, counters[i] & x
        return x  # lanes that have run over

    it = iter(planes)
    while alive and (three := tuple(islice(it, 3))):
        a, b, c = (*three, 0, 0)[:3]
        over = add(a ^ b ^ c, 0)
        over |= add(a & b | c & (a ^ b), 1) if len(counters) > 1 else a & b | c & (a ^ b)
        above, equal = 0, FULL_LANES
        for i in reversed(range(len(counters))):
            if radius >> i & 1:
                equal &= counters[i]
            else:
                above |= equal & counters[i]
                equal &= ~counters[i]
        alive &= ~(over | above)
    return alive


FULL_LANES = -1  # all lanes: Python's integers are as wide as needed


def spanning_links(fps: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(lane, lane of its tree's root) for lanes linked inside their group; lanes of a group lie together."""
    n = len(fps)
    bits = np.unpackbits(np.ascontiguousarray(fps).astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    planes = [int.from_bytes(np.packbits(bits[:, i], bitorder="little").tobytes(), "little") for i in range(64) if bits[:, i].any() and not bits[:, i].all()]
    root = np.arange(n)
    longest = np.diff(np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])).max()
    for s in range(1, longest):
        alive = int.from_bytes(np.packbits(group[:-s] == group[s:], bitorder="little").tobytes(), "little")
        alive = carry_save((p ^ p >> s for p in planes), alive, radius)
        if not alive:
            continue
        lane = np.flatnonzero(np.unpackbits(np.frombuffer(alive.to_bytes((n + 7) // 8, "little"), np.uint8), bitorder="little"))
        lane = lane[root[lane] != root[lane + s]]
        for i in lane.tolist():
            a, b = i, i + s
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            root[max(a, b)] = min(a, b)
        while lane.size and (root != root[root]).any():
            root = root[root]
    at = np.flatnonzero(root != np.arange(n))
    return at, root[at]


def _compare(radius: int):
    def links(mask, val, fp) -> pa.RecordBatch:
        group = np.cumsum(np.r_[0, (mask[1:] != mask[:-1]) | (val[1:] != val[:-1])])
        a, b = spanning_links(fp.view(np.uint64), group, radius)
        return pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.empty(0, np.int64)] * 3
        for x in batches:
            held = [np.r_[h, x.column(i).to_numpy(zero_copy_only=False)] for i, h in enumerate(held)]
            while len(held[0]) >= BLOCK:
                # A block ends where a key ends; a key has at most the limit of fingerprints.
                ends = np.flatnonzero((held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1])) + 1
                cut = ends[np.searchsorted(ends, BLOCK, "right") - 1] if ends.size and ends[0] <= BLOCK else (ends[0] if ends.size else 0)
                if not cut:
                    break
                yield links(*(h[:cut] for h in held))
                held = [h[cut:] for h in held]
        if len(held[0]):
            yield links(*held)

    return run


def fingerprint_links(fps: DataFrame, radius: int = RADIUS, limit: int = LIMIT) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints at most ``radius`` bits apart. fps: one column, fp."""
    with_masks = lambda ms: F.array(*[F.lit(signed(m)) for m in ms])
    masks = band_masks(0, radius)
    rows = fps.select("fp", F.explode(with_masks(masks)).alias("mask"))
    links = None
    while True:
        rows = rows.withColumn("val", F.col("fp").bitwiseAND(F.col("mask")))
        shared = cut_lineage(rows.groupBy("mask", "val").agg(F.count("*").alias("n")).where("n > 1"))
        joined = rows.join(shared, ["mask", "val"])
        last = all(1 << 64 - m.bit_count() <= limit for m in masks)
        near = joined if last else joined.where(F.col("n") <= limit)
        found = near.select("mask", "val", "fp").repartition("mask", "val").sortWithinPartitions("mask", "val", "fp").mapInArrow(_compare(radius), "a long, b long")
        links = found if links is None else links.unionAll(found)
        if last or not shared.where(F.col("n") > limit).head(1):
            return links
        # Hot keys: fix two bands more of what is free under the key's mask.
        deeper = {m: band_masks(m, radius) for m in masks}
        pick = F.create_map(*[x for m, ms in deeper.items() for x in (F.lit(signed(m)), with_masks(ms))])
        rows = cut_lineage(joined.where(F.col("n") > limit).select("fp", F.explode(F.element_at(pick, F.col("mask"))).alias("mask")).distinct())
        masks = sorted({x for ms in deeper.values() for x in ms})


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, limit: int = LIMIT) -> DataFrame:
    """(doc_id, tag, fingerprint, component_id, group) per row of ``docs``; group: a fingerprint that names the component."""
    d = cut_lineage(fingerprints(docs, shingle))
    ids = cut_lineage(d.groupBy("fp").agg(F.min("doc_id").alias("least")))
    comp = components(fingerprint_links(ids.select("fp"), radius, limit))
    named = cut_lineage(ids.join(comp.withColumnRenamed("node", "fp"), "fp", "left")
                        .select("fp", "least", F.coalesce("component", "fp").alias("group")))
    named = cut_lineage(named.join(named.groupBy("group").agg(F.min("least").alias("component_id")), "group").drop("least"))
    return d.join(named, "fp").select("doc_id", "tag", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "group")


def simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: fingerprint and component of every document."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "fingerprint", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id (null ids last), then of the smaller tag."""
    one = near_duplicates(docs.select("doc_id", "text")).groupBy("group").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag")).alias("one"))
    one = cut_lineage(one.select(F.col("one.doc_id").alias("_o_id"), F.col("one.tag").alias("_o_tag")))
    d = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("_d_id"), text_tag("text").alias("_d_tag"))
    stays = d.join(one, F.col("_d_id").eqNullSafe(F.col("_o_id")) & (F.col("_d_tag") == F.col("_o_tag")), "left_semi")
    return stays.dropDuplicates(["_d_id", "_d_tag"]).select("row.*")
