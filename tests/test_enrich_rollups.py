import datetime as dt

import pytest
from pyspark.sql import functions as F

from leadlane.operators import enrich as E
from leadlane.operators import evaluate as EV
from leadlane.operators import rollups as R


def test_shortage_absent_emits_zero_columns(spark):
    o = spark.createDataFrame([(1,)], "production_number long")
    row = E.join_shortage(o, None).first().asDict()
    assert all(row[c] == 0 for c in E.SHORTAGE_COLUMNS)


def test_shortage_rollup_counts_rows_vs_distinct(spark):
    s = spark.createDataFrame([(1, "A", 10.0, -2.0), (1, "A", 5.0, 1.0), (1, "B", 5.0, 0.0)],
                              "production_number long, component_material string, required_qty double, shortage_qty double")
    r = E.shortage_rollup(s).first()
    assert r.shortage_component_count == 2 and r.has_shortage == 1
    assert r.shortage_component_ratio == pytest.approx(2 / (2 + 1e-6))
    assert r.total_shortage_qty == 3.0 and r.max_shortage_pct == pytest.approx(2 / (10 + 1e-6))


def test_fg_fanout_and_dedupe(spark):
    o = spark.createDataFrame([(1, "M")], "production_number long, material string")
    fg = spark.createDataFrame([("M", "L2", 5.0, 1.0, 2.0), ("M", "L1", 5.0, 1.0, 3.0)],
                               "material string, production_line string, constraint_factor double, "
                               "earliest_start_days double, total_production_time double")
    assert E.join_fg(o, fg).count() == 2
    d = E.join_fg(o, fg, dedupe=True).collect()
    assert len(d) == 1 and d[0].production_line == "L1"


def test_zero_capacity_gives_null_ratio_and_legacy_capacity(spark):
    o = spark.createDataFrame([(1, "L1", 4.0, 2.0, dt.date(2024, 1, 1), None)],
                              "production_number long, production_line string, order_quantity double, "
                              "total_production_time double, planned_start_date date, production_supervisor string")
    cap = spark.createDataFrame([("L1", 0.0)], "production_line string, line_capacity double")
    r = E.basic_features(E.join_capacity(o, cap)).first()
    assert r.qty_capacity_ratio is None and r.has_supervisor == 0


def test_target_null_stays_null_and_floor_one(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 6), dt.datetime(2024, 1, 1, 8)),
                                (dt.datetime(2024, 1, 1), None)], "created_date timestamp, actual_finish_date timestamp")
    got = [r.actual_production_days for r in E.lead_time_target(df).collect()]
    assert got == [1.0, None]


def test_floor_days_is_floor_not_datediff(spark):
    from leadlane.functions.dates import floor_days
    df = spark.createDataFrame([(dt.datetime(2024, 1, 2, 6), dt.datetime(2024, 1, 2, 0))], "a timestamp, b timestamp")
    assert df.select(floor_days("a", "b").alias("d")).first().d == -1


def test_golden_prediction_error_row(spark):
    df = spark.createDataFrame([(13.0, 6.457)], "actual double, predicted double")
    r = R.prediction_errors(df).first()
    assert r.abs_error == pytest.approx(6.543) and round(r.pct_error, 2) == 50.33


def test_risk_bands(spark):
    df = spark.createDataFrame([(0.0,), (0.3795,), (0.7,), (0.71,)], "p double")
    got = [(r.a, r.b) for r in df.select(EV.risk_band_a(F.col("p")).alias("a"),
                                         EV.risk_band_b(F.col("p")).alias("b")).collect()]
    assert got == [(None, "low"), ("medium", "low"), ("medium", "high"), ("high", "high")]
    assert df.select(F.round(F.col("p") * 100, 1).alias("x")).collect()[1].x == 38.0


def test_error_bands_report_every_band(spark):
    df = spark.createDataFrame([(0.0,), (0.1,), (3.0,)], "abs_error double")
    got = {r.band: (r.orders, r.pct) for r in R.error_bands(df).collect()}
    assert len(got) == 5 and got["lt_0.25"] == (1, 33.3) and got["gt_2"] == (1, 33.3) and got["1-2"] == (0, 0.0)


def test_rank_trend_even_window(spark):
    import pandas as pd
    vals = [float(v) for v in range(1, 21)]
    df = spark.createDataFrame([(i, "M", v) for i, v in enumerate(vals)], "production_number long, material string, predicted double")
    got = [r.trend for r in R.rank_trend(df).orderBy("rank").collect()]
    expect = pd.Series(vals).rolling(4, center=True, min_periods=1).mean().tolist()
    assert got == pytest.approx(expect)




def test_auc_matches_rank_formula(spark):
    y = [1, 0, 1, 0, 1, 0, 0]
    s = [0.9, 0.9, 0.4, 0.3, 0.8, 0.1, 0.4]
    df = spark.createDataFrame(list(zip(y, s)), "is_delayed int, delay_probability double")
    pos = [b for a, b in zip(y, s) if a == 1]
    neg = [b for a, b in zip(y, s) if a == 0]
    expect = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert EV.exact_auc(df).first().auc == pytest.approx(expect)
