"""Exact line deduplication across documents.

A line's key is the line without ASCII white space at either end and with A-Z lower-cased. Keys shorter than
``min_chars`` code points never count. Of the others, every line goes that is not in the smallest doc_id holding its key.

Keys travel as 128 bits of hash. The rows (hash, doc_id, tag, place) are range-partitioned on all of their columns, so that
a key held by a third of all documents spreads over many tasks, and sorted inside each partition; one streaming pass
then meets the first holder of each key before its later ones. Only a partition's leading key can have begun in an
earlier partition: rows that depend on this are emitted as open questions, at most one document's lines a partition,
and settled from the partitions' summaries. The verdicts are gathered into one compressed bitmap per changed document.
Texts are read twice, but travel once, when the bitmaps are applied.

Defined results: a null or empty text is one empty line; a null doc_id counts as a document smaller than all others;
rows that repeat a doc_id are one document, and each is filtered by the lines of its own text (128 bits of it tell it
apart); extra columns are kept
by ``dedup_lines`` and ignored elsewhere.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import ASCII_SPACE, LOWER, UPPER, table, text_tag

MIN_CHARS = 10
_SALT = "\x00second half"


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1, h2, doc_id, tag, place) of every line whose key is long enough; tag: 128 bits of the text, place: its line."""
    key = F.btrim(F.translate("line", UPPER, LOWER), F.lit(ASCII_SPACE))
    # The tag is an array element that is exploded with the lines: beside the explode it would be worked out for each line.
    whole = docs.select("doc_id", F.explode(F.array(F.struct(text_tag("text").alias("tag"), F.split("text", "\n").alias("lines")))).alias("t"))
    lines = whole.select("doc_id", "t.tag", F.posexplode("t.lines").alias("place", "line"))
    return (lines.select("doc_id", "tag", "place", key.alias("k")).where(F.char_length("k") >= min_chars)
            .select(F.xxhash64("k").alias("h1"), F.xxhash64(F.lit(_SALT), "k").alias("h2"), "doc_id", "tag", "place"))


#: kind 0: this line goes. 1: the partition's first holder of its leading key, line by line (the open questions).
#: 2: the partition's first holder of its last key.
_OUT = "kind int, h1 long, h2 long, doc_id long, tag binary, place int"
_ARROW = pa.schema([("kind", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("tag", pa.binary()), ("place", pa.int32())])


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One partition in order; memory: one batch and the key that runs into the next one."""
    leading = last = None  # keys as (h1, h2); last also has the first holder and one of its lines
    for b in batches:
        if not b.num_rows:
            continue
        h1, h2 = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        doc_null = b.column(2).is_null().to_numpy(zero_copy_only=False)
        doc = b.column(2).fill_null(0).to_numpy(zero_copy_only=False)
        new = np.ones(len(h1), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        if last is not None:
            new[0] = (h1[0], h2[0]) != last[0]
        if leading is None:
            leading = (h1[0], h2[0])
        at = np.maximum.accumulate(np.where(new, np.arange(len(h1)), -1))
        first = np.where(at >= 0, doc[at], last[1] if last else 0)
        first_null = np.where(at >= 0, doc_null[at], last[2] if last else False)
        late = (doc != first) | (doc_null != first_null)
        lead = (h1 == leading[0]) & (h2 == leading[1]) & ~late
        pick = late | lead
        if pick.any():
            picked = b.filter(pa.array(pick))
            yield _rows(np.where(lead, 1, 0)[pick], h1[pick], h2[pick], doc[pick], doc_null[pick], picked.column(3), picked.column(4))
        last = ((h1[-1], h2[-1]), first[-1], first_null[-1])
    if last is not None:
        yield _rows(*(np.array([x]) for x in (2, *last[0], last[1], last[2])), pa.array([b""], pa.binary()), pa.array([0], pa.int32()))


def _rows(kind, h1, h2, doc, doc_null, tag: pa.Array, place: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()),
                                       pa.array(doc, pa.int64(), mask=np.asarray(doc_null, bool)), tag, place], schema=_ARROW)


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, tag, place) of every line that goes."""
    keys = line_keys(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), min_chars)
    order = ["h1", "h2", F.asc_nulls_first("doc_id"), "tag", "place"]
    ranged = keys.repartitionByRange(*order).sortWithinPartitions(*order)
    # Written once: boundaries are sampled, so two evaluations could differ.
    out = cut_lineage(ranged.mapInArrow(_stream, _OUT))
    # An open question's key goes to the least holder that any partition has named; null is least.
    least = (out.where("kind > 0").groupBy("h1", "h2")
             .agg(F.max(F.col("doc_id").isNull()).alias("has_null"), F.min("doc_id").alias("least")))
    held = out.where("kind = 1").join(least, ["h1", "h2"]).where(
        F.when(F.col("has_null"), F.col("doc_id").isNotNull()).otherwise(F.col("doc_id") != F.col("least")))
    return out.where("kind = 0").select("doc_id", "tag", "place").unionAll(held.select("doc_id", "tag", "place"))


def pack_bitmap(dropped, n_lines: int) -> bytes:
    """zlib-compressed bits, line 0 in the lowest bit of the first byte; 1: the line stays."""
    keep = np.ones(n_lines, np.uint8)
    keep[np.asarray(dropped, np.int64)] = 0
    return zlib.compress(np.packbits(keep, bitorder="little").tobytes())


def unpack_bitmap(bits: bytes, n_lines: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bits), np.uint8), count=n_lines, bitorder="little").astype(bool)


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, tag, n_marked, bitmap) of each document text that loses a line; n_marked: lines up to the last lost one.

    A text's own dropped places meet in one task, as its lines do in its row.
    """
    lost = dropped_lines(docs, min_chars).groupBy("doc_id", "tag").agg(F.collect_set("place").alias("lost"))

    def pack(batches):
        for b in batches:
            lost = b.column(2).to_pylist()
            n = [max(x) + 1 for x in lost]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int32()), pa.array([pack_bitmap(x, k) for x, k in zip(lost, n)], pa.binary())],
                                             names=["doc_id", "tag", "n_marked", "bitmap"])

    return lost.mapInArrow(pack, "doc_id long, tag binary, n_marked int, bitmap binary")


def kept_lines(text: str | None, n_marked: int | None, bitmap: bytes | None) -> tuple[str, int, int]:
    """(remaining text, lines before, lines dropped)."""
    lines = (text or "").split("\n")
    if bitmap is None:
        return text or "", len(lines), 0
    keep = unpack_bitmap(bitmap, n_marked)
    rest = [x for x, k in zip(lines, keep) if k] + lines[n_marked:]
    return "\n".join(rest), len(lines), len(lines) - len(rest)


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` (one struct column ``row`` holding the columns) with the bitmap of its text, null where all lines stay."""
    b = bitmaps.select(F.col("doc_id").alias("_b_id"), F.col("tag").alias("_b_tag"), "n_marked", "bitmap")
    d = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("_d_id"), text_tag("text").alias("_d_tag"))
    return d.join(b, F.col("_d_id").eqNullSafe(F.col("_b_id")) & (F.col("_d_tag") == F.col("_b_tag")), "left").select("row", "n_marked", "bitmap")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with its columns; changed texts have their remaining lines, all other texts are untouched."""
    at = docs.columns.index("text")

    def apply(batches):
        for b in batches:
            cols = b.column(0).flatten()
            mask = pc.is_valid(b.column(2))
            changed = b.filter(mask)
            new = [kept_lines(*x)[0] for x in zip(changed.column(0).field(at).to_pylist(), changed.column(1).to_pylist(), changed.column(2).to_pylist())]
            cols[at] = pc.replace_with_mask(cols[at], mask, pa.array(new, cols[at].type))
            yield pa.RecordBatch.from_arrays(cols, names=docs_columns)

    docs_columns = docs.columns
    return with_bitmaps(docs, keep_bitmaps(docs, min_chars)).mapInArrow(apply, docs.schema)


def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: per document the number of lines, of dropped lines, and the hash of the rest."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")

    def digest(batches):
        for b in batches:
            out = [kept_lines(*x) for x in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64()),
                 pa.array([hashlib.sha256(x[0].encode()).hexdigest() for x in out], pa.string())],
                names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    j = with_bitmaps(docs, keep_bitmaps(docs)).select("row.doc_id", "row.text", "n_marked", "bitmap")
    return j.mapInArrow(digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


#: Rows of a doc_id are one document; each row is filtered by its own lines.
LINE_SQL = r"""
with src as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
lines as (select r, doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from src),
keyed as (select *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as k from lines),
firsts as (select k, min(doc_id) as first_doc from keyed where length(k) >= 10 group by k),
marked as (select r, doc_id, pos, line, coalesce(doc_id <> first_doc, false) as gone from keyed left join firsts using (k))
select min(doc_id) as doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from marked group by r
"""
