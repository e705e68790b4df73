"""Passages that several documents share, by sparse suffix arrays.

A passage is a run of ``length`` words or more (A-Z lower-cased, split at ASCII white space) that stands in at least
two documents. Only suffixes at minimisers are retained: of every window of ``length`` words, the position whose first
``gram`` words hash lowest. Equal windows choose equal positions, so each window belongs to exactly one retained suffix
and no shared passage can be missed. Suffixes whose first ``gram`` words one document only has (nearly all) leave at
once. The others, those with equal surroundings once, are range-partitioned and sorted by their first words and then
word by word, so a very common gram spreads over many partitions, and each is compared with its neighbours: no other
suffix agrees with it over more words to the right than one of these two does. That bounds how far right a match can
reach; only windows within it are extended to the left, by a 64-bit hash of the whole window, and equal hashes meet in
a combining aggregate that finds the smallest holder. Neighbouring windows of a document join into maximal passages.
Groups of all sizes go this one way.

The smallest doc_id that holds a window keeps it; every other holder's copy is removable. Defined results: null, empty
and short texts hold no passage; a null doc_id is one document, smaller than all others; rows that repeat a doc_id are
one document and share nothing with each other; extra columns are kept by ``drop_passages`` and ignored elsewhere.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import table, text_tag, words

LENGTH, GRAM = 50, 16
NO_ID = -(1 << 63)
_BASE = 0x9E3779B97F4A7C15
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers 0..n-1 and their inverses, modulo 2^64."""
    if len(_powers[0]) < n:
        for k, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            x = np.full(max(n, 1 << 16), b, np.uint64)
            x[0] = 1
            _powers[k] = np.cumprod(x, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ x >> np.uint64(33)


def runs_of(word_hashes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every run of ``size`` words."""
    n = len(word_hashes)
    up, down = _power(n + 1)
    sums = np.r_[np.uint64(0), np.cumsum(word_hashes * up[:n], dtype=np.uint64)]
    return _mix((sums[size:] - sums[:-size]) * down[:n - size + 1])


def word_hashes(text: str | None) -> np.ndarray:
    w = words(text)
    return np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w))


def suffixes(text: str | None, length: int = LENGTH, gram: int = GRAM, h: np.ndarray | None = None):
    """(position, hash of its first words, first and last window that chose it) of the retained suffixes; all windows' hashes."""
    w = h = word_hashes(text) if h is None else h
    if len(w) < length:
        return None
    grams = runs_of(h, gram)
    wide = length - gram + 1
    chosen = np.lib.stride_tricks.sliding_window_view(grams, wide).argmin(axis=1) + np.arange(len(w) - length + 1)
    first = np.flatnonzero(np.r_[True, chosen[1:] != chosen[:-1]])
    last = np.r_[first[1:], len(chosen)] - 1
    return chosen[first], grams[chosen[first]], first, last, runs_of(h, length)


def _identified(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), text_tag("text").alias("tag"), F.col("text").cast("string").alias("text"))


def passages(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc, tag, start, end, first): word spans that other documents share, and the smallest holder of their windows.

    doc: the doc_id, or NO_ID for null. The spans of a document text may overlap and touch.
    """
    d = _identified(docs)

    def retain(batches):
        for b in batches:
            row, first_words, pos = [], [], []
            for i, t in enumerate(b.column(2)):
                if (s := suffixes(t.as_py(), length, gram)) is not None:
                    row.append(np.full(len(s[0]), i))
                    first_words.append(s[1].view(np.int64))
                    pos.append(s[0].astype(np.int32))
            if row:
                at = pa.array(np.concatenate(row))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(first_words)), b.column(0).take(at), b.column(1).take(at), pa.array(np.concatenate(pos))],
                                                 names=["g", "doc", "tag", "pos"])

    # Python runs on texts that can hold a window at all.
    sparse = cut_lineage(d.where(F.char_length("text") >= 2 * length - 1).mapInArrow(retain, "g long, doc long, tag binary, pos int"))
    shared = cut_lineage(sparse.groupBy("g").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a < b").select("g"))
    cand = sparse.join(shared, "g").groupBy("doc", "tag").agg(F.collect_set("pos").alias("pos"))

    def extend(batches):
        for b in batches:
            g, row, start, reach, right, ext = [], [], [], [], [], []
            for i, (t, want) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
                h = word_hashes(t)
                pos, first_words, lo, hi, windows = suffixes(t, length, gram, h)
                follow = (h >> np.uint64(32)).astype(">u4").tobytes()
                for k in np.flatnonzero(np.isin(pos, want)).tolist():
                    g.append(int(first_words[k].view(np.int64)))
                    row.append(i)
                    start.append(int(lo[k]))
                    reach.append(length - int(pos[k] - lo[k]))  # words from the suffix's start to its first window's end
                    right.append(follow[4 * pos[k]:4 * (hi[k] + length)])
                    ext.append(windows[lo[k]:hi[k] + 1].view(np.int64))
            if row:
                at, offsets = pa.array(row), np.r_[0, np.cumsum([len(x) for x in ext])].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(g), b.column(0).take(at), b.column(1).take(at), pa.array(start, pa.int32()), pa.array(reach, pa.int32()),
                                                  pa.array(right, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ext)))],
                                                 names=["g", "doc", "tag", "lo", "reach", "right", "ext"])

    j = d.where(F.char_length("text") >= 2 * length - 1).join(cand, ["doc", "tag"]).select("doc", "tag", "text", "pos")
    rows = cut_lineage(j.mapInArrow(extend, "g long, doc long, tag binary, lo int, reach int, right binary, ext array<long>").withColumns(
        {"e1": F.xxhash64("ext"), "e2": F.xxhash64(F.lit("second half"), "ext")}))
    # Suffixes with the same extensions (those of copies, and all within a common passage) are compared once.
    kinds = rows.groupBy("g", "e1", "e2").agg(*[F.first(c).alias(c) for c in ("reach", "right", "ext")], F.min("doc").alias("least"), F.max("doc").alias("most"))
    kinds = cut_lineage(kinds.select("g", "right", "e1", "e2", "reach", "ext", "least", "most"))
    near = cut_lineage(kinds.repartitionByRange("g", "right").sortWithinPartitions("g", "right").mapInArrow(
        _neighbours, "g long, x long, e1 long, e2 long, a int, least long, most long"))
    first = near.groupBy("g", "x").agg(F.min("least").alias("first"), F.max("most").alias("b")).where("first < b").drop("b")
    found = near.select("g", "x", "e1", "e2", "a").join(first, ["g", "x"]).groupBy("g", "e1", "e2").agg(
        F.sort_array(F.collect_list(F.struct("a", "first"))).alias("windows")).mapInArrow(_maximal, "g long, e1 long, e2 long, runs array<struct<a:int,z:int,first:long>>")
    at = rows.select("g", "e1", "e2", "doc", "tag", "lo").join(cut_lineage(found), ["g", "e1", "e2"])
    return at.select("doc", "tag", "lo", F.explode("runs").alias("r")).select(
        "doc", "tag", (F.col("lo") + F.col("r.a")).alias("start"), (F.col("lo") + F.col("r.z") + (length - 1)).alias("end"), F.col("r.first").alias("first"))


def _words_in_common(g: np.ndarray, right: pa.Array) -> np.ndarray:
    """Of sorted suffixes, how many words each shares with the one after it."""
    size = np.diff(right.offsets_numpy) // 4
    inside = np.arange(size.max(initial=1))[None, :] < size[:, None]
    word = np.zeros(inside.shape, ">u4")
    word[inside] = right.flat
    same = (word[1:] == word[:-1]) & inside[1:] & inside[:-1] & (g[1:] == g[:-1])[:, None]
    return np.where(same.all(axis=1), same.shape[1], same.argmin(axis=1))


class _Binary:
    """Offsets and content of a binary array."""

    def __init__(self, x: pa.Array):
        self.offsets_numpy = np.frombuffer(x.buffers()[1], np.int32)[x.offset:x.offset + len(x) + 1]
        data = np.frombuffer(x.buffers()[2] or b"", np.uint8)
        self.flat = data[self.offsets_numpy[0]:self.offsets_numpy[-1]].view(">u4")


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted suffixes: each one's windows that end within the words it has in common with a neighbour, as rows.

    A partition's first and last suffix have a neighbour elsewhere and keep all windows; so do suffixes that several
    documents have. Memory: one batch and the suffix before it."""
    held = None
    names = ["g", "x", "e1", "e2", "a", "least", "most"]

    def windows(t: pa.Table, before: np.ndarray, after: np.ndarray) -> pa.RecordBatch:
        g, e1, e2, reach, least, most = (t.column(c).to_numpy() for c in ("g", "e1", "e2", "reach", "least", "most"))
        ext = t.column("ext").chunk(0)
        start, size = ext.offsets.to_numpy()[:-1], np.diff(ext.offsets.to_numpy())
        common = np.where(least < most, 1 << 30, np.maximum(before, after))
        n = np.clip(common - reach + 1, 0, size)
        row = np.repeat(np.arange(len(n)), n)
        a = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        x = ext.values.to_numpy()[start[row] + a]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (g[row], x, e1[row], e2[row], a.astype(np.int32), least[row], most[row])], names=names)

    edge = np.array([1 << 30])
    came = edge  # what the held suffix has in common with the one before it
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        t = t.combine_chunks()
        common = _words_in_common(t.column("g").to_numpy(), _Binary(t.column("right").chunk(0)))
        if len(common):
            yield windows(t.slice(0, t.num_rows - 1).combine_chunks(), np.r_[came, common[:-1]], common)
            came = common[-1:]
        held = t.slice(t.num_rows - 1).combine_chunks()
    if held is not None:
        yield windows(held, came, edge)


def _maximal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Consecutive windows with the same smallest holder as one run [a, z)."""
    kind = pa.list_(pa.struct([("a", pa.int32()), ("z", pa.int32()), ("first", pa.int64())]))
    for b in batches:
        out = []
        for ws in b.column(3).to_pylist():
            runs: list[dict] = []
            for w in ws:
                if runs and runs[-1]["z"] == w["a"] and runs[-1]["first"] == w["first"]:
                    runs[-1]["z"] += 1
                else:
                    runs.append({"a": w["a"], "z": w["a"] + 1, "first": w["first"]})
            out.append(runs)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out, kind)], names=["g", "e1", "e2", "runs"])


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def shared_spans(docs: DataFrame, **how) -> DataFrame:
    """(doc, tag, spans) per document text that shares a passage; spans: (start, end, first), merged for each first."""
    s = passages(docs, **how).groupBy("doc", "tag").agg(F.collect_set(F.struct("start", "end", "first")).alias("s"))

    def merge(batches):
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("first", pa.int64())]))
        for b in batches:
            out = []
            for spans in b.column(2).to_pylist():
                by: dict[int, list] = {}
                for x in spans:
                    by.setdefault(x["first"], []).append((x["start"], x["end"]))
                out.append(sorted(({"start": a, "end": z, "first": f} for f, v in by.items() for a, z in union(v)), key=lambda x: (x["start"], x["end"], x["first"])))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, kind)], names=["doc", "tag", "spans"])

    return s.mapInArrow(merge, "doc long, tag binary, spans array<struct<start:int,end:int,first:long>>")


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of the spans and the white space after each removed word."""
    at = [m.start() for m in _WORD.finditer(text)] + [len(text)]
    out, done = [], 0
    for a, b in union(spans):
        out.append(text[done:at[a]])
        done = at[b]
    return "".join([*out, text[done:]])


def drop_passages(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with its columns, less the passages that a smaller doc_id holds; texts left without a word go."""
    at, names = docs.columns.index("text"), docs.columns
    s = shared_spans(docs, **how).select(F.col("doc").alias("_s_doc"), F.col("tag").alias("_s_tag"),
                                         F.filter("spans", lambda x: x["first"] != F.col("doc")).alias("spans")).where(F.size("spans") > 0)
    d = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_doc"), text_tag("text").alias("_tag"))
    j = d.join(s, (F.col("_doc") == F.col("_s_doc")) & (F.col("_tag") == F.col("_s_tag")), "left").select("row", "spans")

    def apply(batches):
        for b in batches:
            mask = pc.is_valid(b.column(1))
            changed = b.filter(mask)
            new = [without(t, [(x["start"], x["end"]) for x in s]) for t, s in zip(changed.column(0).field(at).to_pylist(), changed.column(1).to_pylist())]
            cols = b.column(0).flatten()
            cols[at] = pc.replace_with_mask(cols[at], mask, pa.array(new, cols[at].type))
            gone = np.zeros(b.num_rows, bool)
            gone[np.flatnonzero(mask.to_numpy(zero_copy_only=False))] = [not _WORD.search(x) for x in new]
            yield pa.RecordBatch.from_arrays(cols, names=names).filter(pa.array(~gone))

    return j.mapInArrow(apply, docs.schema)


def suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: every document that shares a passage of 50 words, its spans in words, and their smallest holders."""
    s = shared_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    real = lambda c: F.when(c != NO_ID, c)
    out = s.select(real(F.col("doc")).alias("doc_id"), F.posexplode("spans").alias("k", "x"))
    return out.select("doc_id", F.col("x.start").cast("long").alias("start_word"), F.col("x.end").cast("long").alias("end_word"),
                      real(F.col("x.first")).alias("first_doc_id"), (~F.col("doc_id").eqNullSafe(real(F.col("x.first")))).alias("removable"))
