"""Steps that must not be run again for every reader, nor grow with a single task."""

import os
import uuid

from pyspark.sql import functions as F

from leadlane import session
from leadlane.operators import rollups as R
from leadlane.operators import scoring as SCO
from leadlane.operators.scale import quantiles_of_counts, running_totals
from leadlane.plans import q_io, q_ml, q_rollups
from leadlane.sources.fixtures import Views, history_view


def _plan(df, kind="formatted"):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), kind)


def _orders(spark, n=400):
    return spark.range(n).select(F.col("id").alias("production_number"), F.concat(F.lit("M"), (F.col("id") % 7).cast("string")).alias("material"),
                                 (F.col("id") * 13 % 160 / 10).alias("predicted"), (F.col("id") % 12).cast("double").alias("actual"))


def test_running_totals_shuffle_no_rows_for_offsets(spark):
    """A key over several ranges, null keys, and a broadcast of at most one row a range."""
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, F.lit("hot")).when(F.col("id") % 5 > 0, F.col("id").cast("string")).alias("k"))
    rt = running_totals(rows, ["id", "k"], ["id"], {"s": F.col("id"), "n": F.lit(1).cast("long")}, keys=["k"], partitions=9)
    assert "SortMergeJoin" not in _plan(rt) and "BroadcastHashJoin" in _plan(rt)
    sums: dict = {}
    for r in rt.orderBy("id").collect():
        s, n = sums.get(r.k, (0, 0))
        sums[r.k] = (s + r.id, n + 1)
        assert (r.s, r.n) == sums[r.k]
    assert sum(n for _, n in sums.values()) == 3000


def test_history_view_groups_and_joins_on_one_exchange(spark, tmp_path):
    spark.range(1, 50).select(F.col("id").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.col("id").alias("l_partkey"), F.lit(2.0).alias("l_quantity")) \
        .write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(1, 50).select(F.col("id").alias("o_orderkey"), F.lit("1995-01-01").cast("date").alias("o_orderdate"), F.lit("F").alias("o_orderstatus")) \
        .write.parquet(f"{tmp_path}/orders.parquet")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = history_view(spark, str(tmp_path))
        assert _plan(df, "simple").count("Exchange ") <= 2  # one of the lines, one of the orders
        assert df.count() == 49
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_error_by_days_filters_on_the_days(spark):
    errs = R.prediction_errors(_orders(spark).withColumn("actual", F.when(F.col("production_number") > 5, F.col("actual") * 100).otherwise(F.lit(None))))
    df = R.error_by_days(errs.unionByName(errs.withColumn("actual", F.lit(-1.0))).unionByName(errs.limit(1).withColumn("actual", F.lit(float("nan")))))
    assert all("CASE WHEN" not in x or "days_bucket" not in x for x in _plan(df, "extended").split("\n") if "Filter" in x)
    assert {r.days_bucket for r in df.collect()} == {"0-1", "10+"}


def test_counted_quantiles_and_ranks_read_their_source_once(spark):
    def files(df):
        return all(f.startswith("file:") and "/tables/" in f for f in df.inputFiles())

    q = quantiles_of_counts(_orders(spark).groupBy(F.col("predicted").alias("_x")).agg(F.count(F.lit(1)).alias("_c")), [0.5], ["m"])
    assert "Range (" not in _plan(q, "extended") and files(q)
    trend = R.rank_trend(_orders(spark))
    assert "Range (" not in _plan(trend, "extended") and trend.count() == 400


def test_state_and_model_inputs_are_written_once(spark, monkeypatch):
    base = _orders(spark).select("*", F.lit("L1").alias("production_line"), F.lit("1995-01-01").cast("date").alias("created_date"),
                                 F.lit("1995-01-03").cast("date").alias("planned_start_date"), F.lit("1995-01-09").cast("date").alias("actual_finish_date"),
                                 F.lit(3.0).alias("order_quantity"))
    state = SCO.build_state(base)
    assert all("Range (" not in _plan(t, "extended") for t in state.tables.values())
    assert state.tables["labelled"].count() == 400
    monkeypatch.setattr(q_ml, "enriched", lambda v: None)
    monkeypatch.setattr(q_ml.FT, "features_v4", lambda e: base.withColumn("actual_production_days", F.lit(2.0)))
    df, feats = q_ml._v4(spark, "")
    assert "Range (" not in _plan(df, "extended") and feats == ["order_quantity"]
    assert df.columns == ["production_number", "material", "created_date", "actual_production_days", "order_quantity"]


def test_tpt_rows_and_table_are_written_once(spark, monkeypatch):
    rows = _orders(spark).select("*", F.lit("d").alias("material_description"), F.lit("L1").alias("production_line"))
    monkeypatch.setattr(q_rollups, "scored_enriched", lambda v: rows)
    v = Views(spark, "")
    v._cache["fg"] = spark.createDataFrame([("M1", "L1", 2.0)], "material string, production_line string, total_production_time double")
    assert "Range (" not in _plan(q_rollups.tpt_rows(v), "extended")
    table = q_rollups.tpt_table(v)
    assert "Join" not in _plan(table, "extended") and table.count() == 7


def test_an_extract_lands_as_more_than_one_file(spark):
    folder = f"{session.ensure_checkpoint_dir(spark).rstrip('/')}/landing-{uuid.uuid4().hex}"
    q_io.land(_orders(spark).repartition(4), folder)
    assert len([f for f in os.listdir(folder.removeprefix("file:")) if f.endswith(".parquet")]) == 4
    assert spark.read.parquet(folder).count() == 400
