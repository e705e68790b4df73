"""Extracts, sinks, scoring pipeline pieces and hot-key distribution."""

import datetime as dt

from pyspark.sql import functions as F

from leadlane.operators import enrich as E
from leadlane.operators import scoring as SCO
from leadlane.operators.scale import running_totals
from leadlane.sinks import writers as K
from leadlane.sources import extracts as X


def test_capacity_as_of_and_order_extract(spark):
    cap = spark.createDataFrame([("P1", "L1", dt.date(2024, 1, 1), dt.date(2024, 6, 30)),
                                 ("P1", "L1", dt.date(2024, 7, 1), dt.date(2024, 12, 31)),
                                 ("P2", "L1", dt.date(2024, 1, 1), dt.date(2024, 12, 31))],
                                "plant string, line string, valid_from date, valid_to date")
    assert X.capacity_as_of(cap, "P1", "2024-06-30").count() == 1
    o = spark.createDataFrame([(i, dt.date(2024, 1, i + 1), None if i == 2 else dt.date(2024, 2, 1)) for i in range(5)],
                              "production_number long, actual_start_date date, actual_finish_date date")
    got = [r.production_number for r in X.order_extract(o, "2024-01-01", "2024-01-31", top=2, skip=1).collect()]
    assert got == [3, 1]


def test_history_and_shortage_semi_joins(spark):
    orders = spark.createDataFrame([(1, "A", dt.date(2024, 1, 5)), (2, "B", dt.date(2024, 1, 5)),
                                    (3, "A", dt.date(2023, 1, 5))], "production_number long, material string, created_date date")
    texts = spark.createDataFrame([("A", "E", "alpha"), ("A", "D", "alpha-de")], "material string, language string, txt string")
    fg = spark.createDataFrame([("A",)], "material string")
    h = X.history_extract(orders, texts, fg, "2024-01-01", "2024-12-31")
    assert [(r.production_number, r.txt) for r in h.collect()] == [(1, "alpha")]
    comp = spark.createDataFrame([(1, "P1", "C"), (2, "P1", "C"), (1, "P2", "C")], "production_number long, plant string, c string")
    assert X.shortage_extract(comp, h, "P1").count() == 1


def test_transforms(spark):
    rec = spark.createDataFrame([("000123", "/Date(1711238400000)/", "5"), ("", "/Date(1711238400000)/", "x")],
                                "AUFNR string, GSTRP string, GAMNG string")
    out = X.transform_odata_orders(rec, {"AUFNR": "production_number", "GSTRP": "planned_start_date",
                                         "GAMNG": "order_quantity"}, ["order_quantity"], ["planned_start_date"]).collect()
    assert len(out) == 1 and out[0].production_number == "123" and out[0].order_quantity == 5.0
    assert str(out[0].planned_start_date) == "2024-03-24"
    assert X.rejected_odata_orders(rec, "AUFNR").count() == 1
    s = spark.createDataFrame([("10", "12")], "required_qty string, withdrawn_qty string")
    assert X.transform_shortage_extract(s).first().shortage_qty == -2.0


def test_versioned_sink_latest(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0)], "k int, v double")
    K.write_versioned(df, str(tmp_path / "runs"), "20260101_000000")
    K.write_versioned(df.withColumn("v", F.lit(3.0)), str(tmp_path / "runs"), "20260102_000000")
    latest = K.read_latest(spark, str(tmp_path / "runs")).collect()
    assert [r.v for r in latest] == [3.0]
    inv = K.file_inventory(spark, str(tmp_path / "runs" / "run_id=20260101_000000"), "*.parquet").collect()
    assert inv and inv[0].type == "parquet"


def test_prediction_export_headers(spark):
    df = spark.createDataFrame([(1, dt.date(2026, 3, 24), 0.3795)], "production_number long, planned_start_date date, delay_probability double")
    r = K.prediction_export(df).first().asDict()
    assert r["生产订单"] == 1 and r["计划开始日期"] == "2026-03-24" and r["延迟概率(%)"] == 38.0


def test_union_with_history_flags_new_rows(spark):
    h = spark.createDataFrame([(1, "A")], "production_number long, material string")
    n = spark.createDataFrame([(2,)], "production_number long")
    u = SCO.with_history(h, n).orderBy("production_number").collect()
    assert [(r.is_new, r.material) for r in u] == [(False, "A"), (True, None)]


def test_complete_rows_gate(spark):
    df = spark.createDataFrame([(1.0,), (None,)], "x double")
    assert E.complete_rows(df, ["x"], min_rows=1).count() == 1
    try:
        E.complete_rows(df, ["x"], min_rows=5)
        raise AssertionError("gate did not fire")
    except ValueError:
        pass


def test_hot_key_spans_many_tasks(spark):
    """A key holding 90 % of rows is spread over several range partitions."""
    df = spark.range(0, 20000).select(F.col("id").alias("pn"),
                                      F.when(F.col("id") % 10 == 0, "cold").otherwise("HOT").alias("k"),
                                      (F.col("id") % 365).alias("day"))
    rt = running_totals(df, ["pn"], ["day", "pn"], {"n": F.lit(1)}, keys=["k"], partitions=8)
    assert rt.filter(F.col("n") == 18000).count() == 1  # exact running count of the hot key
    ranged = df.repartitionByRange(8, "k", "day", "pn").withColumn("p", F.spark_partition_id())
    per_task = [r["count"] for r in ranged.filter(F.col("k") == "HOT").groupBy("p").count().collect()]
    assert len(per_task) >= 6 and max(per_task) < 0.3 * 18000


def test_release_lineage_tables(spark, tmp_path):
    from leadlane.session import cut_lineage, lineage_tables, release_lineage_tables
    df = cut_lineage(spark.range(10))
    assert df.count() == 10
    path = lineage_tables()[-1]
    assert release_lineage_tables(spark, [path]) == 1 and path not in lineage_tables()
