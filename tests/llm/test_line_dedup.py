import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from leadlane.llm import line_dedup as L


def brute(rows):
    strip = lambda x: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x)
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), strip(x))
    small = lambda i: (i is not None, i or 0)
    first = defaultdict(lambda: (True, 1 << 62))
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                first[key(x)] = min(first[key(x)], small(i))
    for i, t in rows:
        lines = (t or "").split("\n")
        rest = [x for x in lines if len(key(x)) < 10 or first[key(x)] == small(i)]
        yield i, len(lines), len(lines) - len(rest), hashlib.sha256("\n".join(rest).encode()).hexdigest()


def run(spark, df, tmp_path):
    df.write.parquet(str(tmp_path / "documents.parquet"))
    out = L.line_dedup(spark, str(tmp_path))
    none = lambda r: tuple(-9 if x is None else x for x in r)
    assert sorted(map(none, out.collect())) == sorted(map(none, brute([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])))


@pytest.mark.parametrize("partitions", [1, 40])
def test_hot_line_over_many_partitions(spark, tmp_path, partitions):
    """One line in all documents, which spans most range partitions; lines that repeat inside a document; ties."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(3000, 0, -1).select(
            F.col("id").alias("doc_id"),
            F.concat_ws("\n", F.lit("  A very COMMON line\t"), F.concat(F.lit("line number "), F.col("id") % 700), F.lit("short"),
                        F.concat(F.lit("own line "), F.col("id")), F.lit("a very common line"),
                        F.concat(F.lit("own line "), F.col("id"))).alias("text"))
        run(spark, df, tmp_path)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_odd_rows(spark, odd_docs, tmp_path):
    extra = spark.createDataFrame([(None, "The same long line"), (2, "the same long line\nx"), (2, "the same LONG line\ny"),
                                   (1, "the same long line"), (50, "ÀÉ same long line\nàé same long line")], "doc_id long, text string")
    run(spark, odd_docs.unionByName(extra, allowMissingColumns=True), tmp_path)


def test_empty(spark, odd_docs, tmp_path):
    run(spark, odd_docs.limit(0), tmp_path)


def test_dedup_lines_keeps_columns(spark, odd_docs):
    out = L.dedup_lines(odd_docs.unionByName(spark.createDataFrame(
        [(100, "one long line here\nand this"), (101, "x\none long line here")], "doc_id long, text string"), allowMissingColumns=True))
    assert out.columns == odd_docs.columns
    got = {r.doc_id: r.text for r in out.where("doc_id >= 100").collect()}
    assert got == {100: "one long line here\nand this", 101: "x"}
    assert out.where("doc_id = 0").first().text is None


def test_texts_of_one_id_are_told_apart_by_128_bits(spark, tmp_path):
    """Two texts of one doc_id whose 31-bit tags agree: only the one that holds the other document's line loses it."""
    from .test_simhash import texts_with_equal_31_bits

    x, y = texts_with_equal_31_bits()
    assert min(len(x), len(y)) >= L.MIN_CHARS
    df = spark.createDataFrame([(1, x), (7, x), (7, y)], "doc_id long, text string")
    assert sorted(tuple(r) for r in L.dedup_lines(df).collect()) == sorted([(1, x), (7, ""), (7, y)])
    run(spark, df, tmp_path)


def test_bitmap_rows_hold_the_whole_tag(spark):
    df = spark.createDataFrame([(1, "a line that repeats"), (2, "a line that repeats\nmore")], "doc_id long, text string")
    (r,) = L.keep_bitmaps(df).collect()
    assert (r.doc_id, bytes(r.tag), r.n_marked) == (2, hashlib.md5(b"a line that repeats\nmore").digest(), 1)
    assert L.unpack_bitmap(bytes(r.bitmap), 1).tolist() == [False]
