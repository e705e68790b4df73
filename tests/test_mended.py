"""Cases that earlier rounds got wrong: each is held against its plain definition."""

import datetime as dt
import os

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from leadlane import session as S
from leadlane.operators import classic as CL
from leadlane.operators import evaluate as EV
from leadlane.operators import features as FT
from leadlane.operators import rollups as R
from leadlane.operators.scale import running_totals
from leadlane.sinks import writers as K
from leadlane.streaming import ingest as I


@pytest.mark.parametrize("reuse", ["true", "false"])
@pytest.mark.parametrize("keys", [[], ["k"]])
def test_running_totals_on_more_rows_than_are_sampled(spark, reuse, keys):
    """The row key is no part of the order, and one key holds nine tenths of the rows."""
    spark.conf.set("spark.sql.exchange.reuse", reuse)
    try:
        df = spark.range(400000).select("id", F.when(F.col("id") % 10 < 9, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("k"),
                                        F.hash("id", F.lit(1)).alias("u"), F.hash("id", F.lit(2)).alias("u2"), (F.col("id") % 13).alias("v"))
        got = running_totals(df, ["id"], ["u", "u2"], {"s": F.col("v"), "n": F.lit(1).cast("long")}, keys=keys)
        w = Window.partitionBy(*keys).orderBy("u", "u2").rowsBetween(Window.unboundedPreceding, 0)
        want = df.select("id", F.sum("v").over(w).alias("s"), F.count("*").over(w).alias("n"))
        assert got.count() == 400000
        assert got.join(want.withColumnsRenamed({"s": "ws", "n": "wn"}), "id").where("s != ws or n != wn").count() == 0
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")


def test_auc_of_one_class_and_of_huge_counts(spark):
    one = spark.createDataFrame([(1, 0.5), (1, 0.7)], "is_delayed int, delay_probability double")
    assert EV.exact_auc(one).first().auc is None
    expr = F.try_divide(F.lit(4e18), F.sum(F.lit(4_000_000_000).cast("double")) * F.sum(F.lit(4_000_000_000).cast("double")))
    assert spark.range(1).agg(expr.alias("x")).first().x == 0.25
    mixed = spark.createDataFrame([(1, 0.9), (0, 0.1), (1, 0.1)], "is_delayed int, delay_probability double")
    assert EV.exact_auc(mixed).first().auc == 0.75


def test_kpis_and_bands_without_rows(spark):
    kinds = "order_id long, planned_finish timestamp, actual_finish timestamp"
    t = dt.datetime
    k = R.order_kpis(spark.createDataFrame([(1, t(2024, 1, 1), None)], kinds)).first()
    assert (k.total, k.completed, k.on_time_pct) == (1, 0, None)
    late = R.order_kpis(spark.createDataFrame([(1, t(2024, 1, 1, 8), t(2024, 1, 2, 7)), (2, t(2024, 1, 1, 8), t(2024, 1, 3, 9))], kinds)).first()
    assert (late.delayed, late.on_time, late.mean_delay_of_delayed) == (1, 1, 2.0)
    empty = spark.createDataFrame([], "actual double, predicted double, abs_error double")
    assert {r.pct for r in R.error_bands(empty).collect()} == {0.0}


def test_quarter_end_with_a_time_of_day(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 3, 31, 10), 6, 3), (dt.datetime(2024, 4, 30, 0), 1, 4), (dt.datetime(2024, 6, 30, 0), 6, 6)],
                               "planned_start_date timestamp, planned_start_weekday int, planned_start_month int")
    for c in ("order_quantity", "total_production_time"):
        df = df.withColumn(c, F.lit(1.0))
    out = CL.v1_static_features(df.withColumn("material", F.lit("M"))).select("is_quarter_end").collect()
    assert [r[0] for r in out] == [1, 0, 1]


def test_registry_row_with_missing_values(spark, tmp_path):
    p = str(tmp_path / "reg")
    K.register_model(spark, p, {"name": "a", "rmse": None, "is_active": True, "more": 3}, ["name", "rmse", "is_active"], {"rmse": "double"})
    K.register_model(spark, p, {"name": "b", "rmse": 1.5}, ["name", "rmse", "is_active"], {"is_active": "boolean"})
    rows = sorted(spark.read.parquet(p).collect(), key=lambda r: r.name)
    assert [(r.name, r.rmse, r.is_active) for r in rows] == [("a", None, True), ("b", 1.5, None)]


def test_a_failing_read_stops_the_upsert(spark, tmp_path):
    table = str(tmp_path / "t")
    rows = spark.range(100).select(F.col("id").alias("production_number"), F.lit(1).alias("ingest_seq"), F.lit("old").alias("v"))
    write = I.upsert_batch_writer(table, buckets=4)
    write(rows, 0)
    for d, _, names in os.walk(table):
        for n in names:
            if n.startswith("part-") and n.endswith(".parquet"):
                victim, whole = os.path.join(d, n), open(os.path.join(d, n), "rb").read()
    os.remove(os.path.join(os.path.dirname(victim), "." + os.path.basename(victim) + ".crc"))
    with open(victim, "wb") as f:
        f.write(whole[:-9])
    with pytest.raises(Exception):
        write(spark.range(100).select(F.col("id").alias("production_number"), F.lit(2).alias("ingest_seq"), F.lit("new").alias("v")), 1)
    with open(victim, "wb") as f:
        f.write(whole)
    assert I.read_table(spark, table).where("v = 'old'").count() == 100


def test_stream_of_csv_extracts(spark, tmp_path):
    rows = spark.range(30).select((F.col("id") % 10).alias("production_number"), F.floor(F.col("id") / 10).alias("ingest_seq"))
    rows.write.option("header", True).csv(str(tmp_path / "landing"))
    I.run_incremental(spark, str(tmp_path / "landing"), rows.schema, str(tmp_path / "table"), str(tmp_path / "ck"), fmt="csv", options={"header": "true"})
    assert sorted(tuple(r) for r in I.read_table(spark, str(tmp_path / "table")).select("production_number", "ingest_seq").collect()) == [(i, 2) for i in range(10)]


def test_gate_counts_like_a_window(spark):
    df = spark.range(2000).select(F.col("id").alias("k"), ((F.col("id") * 7919) % 400).alias("_ov"), F.when(F.col("id") % 3 == 0, 1.0).alias("y"))
    got = {r._ov: r._g90 for r in FT.labelled_gate(df, F.col("y"), 1, 90).collect()}
    day = df.groupBy("_ov").agg(F.count("y").alias("g"))
    w = Window.orderBy("_ov").rangeBetween(-90, -1)
    want = {r._ov: r.g or 0 for r in day.select("_ov", F.sum("g").over(w).alias("g")).collect()}
    assert {k: v or 0 for k, v in got.items()} == want


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        S.ensure_checkpoint_dir(Session())


def test_scratch_is_released(spark):
    t = S.cut_lineage(spark.range(5))
    assert t.count() == 5 and S.lineage_tables()
    path = S.lineage_tables()[-1]
    S.release_lineage_tables(spark)
    assert not S.path_exists(spark, path) and not S.lineage_tables()


def test_random_search_query_runs_the_default_trials(monkeypatch):
    """The registered query draws as many points as the library's default."""
    import inspect

    from leadlane.plans import q_ml as Q

    signature = inspect.signature(Q.ML.random_search)
    default, seen = signature.parameters["n_trials"].default, []

    def search(*args, **options):
        call = signature.bind(*args, **options)
        call.apply_defaults()
        seen.append(call.arguments["n_trials"])
        return None, "trials"

    monkeypatch.setattr(Q, "_v4", lambda spark, sf: (None, []))
    monkeypatch.setattr(Q.ML, "random_search", search)
    assert Q.q_random_search(None, None) == "trials" and seen == [default] and default >= 5
