import re
from collections import Counter

from pyspark.sql import functions as F

from leadlane.llm import quality_rules as Q
from tests.conftest import SMOKE


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    covered = {i + j for i, g in enumerate(grams) if n[g] > 1 for j in range(3)}
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_measures_match_brute_force(spark, odd_docs):
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet").select("doc_id", "text").unionByName(
        odd_docs.select((F.col("doc_id") + 10**9).alias("doc_id"), "text"))
    got = sorted(tuple(r) for r in Q.text_features(docs, ["doc_id"]).na.fill(-1).select("doc_id", *Q.MEASURES[:5]).collect())
    want = sorted((r.doc_id if r.doc_id is not None else -1, *brute(r.text)) for r in docs.collect())
    assert got == want


def test_rules_separate_held_out_rows(spark):
    """Learned from three quarters of the labels, measured on the last: on rows that the base rule, which is given, lets pass."""
    d = "/root/testdata/sf0.01"
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    labels = spark.read.parquet(f"{d}/labels.parquet")
    f = Q.text_features(spark.read.parquet(f"{d}/documents.parquet"), ["doc_id"]).cache()
    out = Q.apply_rules(f, Q.learn_rules(Q.labelled(f, labels.where(~held))))
    got = {(r.quality, r.kept): r["count"] for r in out.where("not base_failed").join(labels.where(held), "doc_id").groupBy("quality", "kept").count().collect()}
    f.unpersist()
    low, good = (got.get((q, True), 0) + got.get((q, False), 0) for q in (0, 1))
    assert low >= 10 and good >= 50
    assert got.get((0, False), 0) > 0.9 * low and got.get((1, True), 0) > 0.9 * good


def test_rules_of_the_query_fit_its_labels(spark):
    import duckdb
    d = "/root/testdata/sf0.01"
    out = Q.quality_rules(spark, d).select("doc_id", "kept").toPandas()
    lab = duckdb.sql(f"select doc_id, quality from '{d}/labels.parquet'").df().merge(out, on="doc_id")
    assert ((lab.quality == 1) == lab.kept)[lab.quality == 0].mean() > 0.95
    assert lab.kept[lab.quality == 1].mean() > 0.9


def test_covering_learns_a_conjunction(spark):
    rows = spark.range(3000).select(
        ((F.col("id") * 7919) % 101 / 101.0).alias("a"), ((F.col("id") * 104729) % 97 / 97.0).alias("b"),
        (F.col("id") % 3).alias("fold"))
    data = rows.select(*[F.lit(0.0).alias(n) for n in Q.RATIOS if n not in ("symbol_share", "repeat_share")],
                       F.col("a").alias("symbol_share"), F.col("b").alias("repeat_share"), "fold",
                       ((F.col("a") > 0.5) & (F.col("b") <= 0.25)).cast("int").alias("y"))
    rules = Q.learn_rules(data, bins=40)
    assert {t.feature for t in rules[0]} == {"symbol_share", "repeat_share"} and len(rules) <= 3


def test_odd_rows_empty_tables_and_clashing_columns(spark, odd_docs, tmp_path):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    odd_docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = Q.quality_rules(spark, str(tmp_path))
    assert out.count() == odd_docs.count() and out.where("kept").count() == 0
    kept = Q.quality_stage(spark, odd_docs.limit(0), str(tmp_path))
    assert kept.columns == odd_docs.columns and kept.count() == 0
