"""What feature queries write and join: orders meet their master data once, rows look statistics up with few columns."""

import datetime as dt

from pyspark.sql import functions as F

from leadlane.operators import classic as CL
from leadlane.operators import enrich as E
from leadlane.operators import features as FT
from leadlane.operators.scale import repeated, trailing_frames
from leadlane.plans.q_classic import q_v1_delay_rates
from leadlane.plans.registry import TIMED_READ, train_rows
from leadlane.session import lineage_tables
from leadlane.sources.fixtures import Views

from .conftest import SMOKE


def _rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def _orders(spark, n=40):
    day = dt.date(2024, 1, 1)
    at = lambda k: day + dt.timedelta(days=k)
    data = [(i, f"M{i % 5}" if i % 7 else None, f"L{i % 3}" if i % 11 else None, at(i * 5 % 60), at(i * 5 % 60 + i % 6), at(i * 5 % 60 + i % 6 + 2),
             at(i * 5 % 60 + 1), at(i * 5 % 60 + 4 + i % 9) if i % 4 else None, float(i % 13), 2.0, 5.0, "CVC", 10.0, 1.0, 2.0, 3.0, 4.0, 5.0, 1, 2.0, 0.5, 0.25)
            for i in range(1, n + 1)]
    types = ["long", "string", "string", *["date"] * 5, "double", "double", "double", "string", *["double"] * 6, "int", "double", "double", "double"]
    return spark.createDataFrame(data, ", ".join(f"{c} {t}" for c, t in zip(FT.FEATURES_READ, types, strict=True)))


def test_master_joins_orders_once_with_the_same_rows(spark):
    orders = spark.createDataFrame([(1, "A"), (2, "B"), (3, None), (4, "X")], "production_number long, material string")
    fg = spark.createDataFrame([("A", "L1", 5.0, 1.0, 2.0, "one"), ("A", "L2", 5.0, 1.0, 3.0, "two"), ("B", None, 30.0, 1.0, 2.0, "b"), (None, "L1", 1.0, 1.0, 1.0, "n")],
                               "material string, production_line string, constraint_factor double, earliest_start_days double, total_production_time double, material_description string")
    capacity = spark.createDataFrame([("L1", 10.0), ("L1", 20.0), (None, 5.0)], "production_line string, line_capacity double")
    old = E.join_capacity(E.join_fg(orders, fg), capacity)
    new = E.join_master(orders, fg, capacity)
    assert new.columns == old.columns
    assert _rows(new) == _rows(old)
    described = E.join_master(orders, fg, capacity, also=("material_description",))
    assert _rows(described) == _rows(old.join(fg.select("material", "material_description"), "material", "left"))


def test_features_of_some_rows_take_statistics_of_all(spark):
    both = _orders(spark).withColumn("is_new", F.col("actual_finish_date").isNull())
    some = FT.features_v4(both, training=False, rows=F.col("is_new"))
    assert _rows(some) == _rows(FT.features_v4(both, training=False).where("is_new"))
    assert some.count() == 10


def test_rows_are_looked_up_without_an_exchange_for_days(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = FT.features_v4(_orders(spark), training=False)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not [x for x in plan.splitlines() if "SortMergeJoin [planned_start_date#" in x or "SortMergeJoin [_ov#" in x]


def test_training_rows_are_written_with_what_is_read(spark):
    before = set(lineage_tables())
    rows = train_rows(Views(spark, SMOKE), TIMED_READ)
    assert set(rows.columns) == set(TIMED_READ)
    wide = [t for t in set(lineage_tables()) - before if "production_number" in spark.read.parquet(t).columns]
    assert len(wide) == 1


def test_delay_rates_read_the_joins_behind_them_once(spark):
    assert not [f for f in q_v1_delay_rates(spark, SMOKE).inputFiles() if "/tables/" not in f]


def _years_of_orders(spark, n=600):
    """A material with a third of all orders, null keys and days, days over three years on both sides of 1970."""
    day = dt.date(1969, 6, 1)
    at = lambda k: day + dt.timedelta(days=k)
    data = [(i, None if i % 29 == 0 else "HOT" if i % 3 == 0 else f"M{i % 9}", f"L{i % 4}" if i % 13 else None, at(i * i % 1100) if i % 31 else None,
             at(i * i % 1100 + i % 9) if i % 37 else None, float(i % 7) if i % 5 else None, float(i % 11) if i % 17 else None) for i in range(1, n + 1)]
    return spark.createDataFrame(data, "production_number long, material string, production_line string, created_date date, planned_start_date date, "
                                       "actual_production_days double, order_quantity double")


def test_windows_over_days_give_what_the_tables_do(spark):
    rows = _years_of_orders(spark)
    stats = FT.SourceStatistics(rows)
    old = FT.history_stats(FT.forward_load(rows, stats=stats), stats=stats)
    old = old.join(stats.line_orders(), "production_line", "left").join(stats.material_quantity(), "material", "left")
    new = FT.windowed_days(rows, stats)
    cols = sorted(set(old.columns) & set(new.columns))
    assert len(cols) == len(old.columns) - 2  # without both days
    assert _rows(new.select([F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in new.select(cols).dtypes])) \
        == _rows(old.select([F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in old.select(cols).dtypes]))


def test_rows_are_dealt_once_a_key_for_windows(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = FT.features_v4(_orders(spark))._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not [x for x in plan if "SortMergeJoin" in x and "_ov#" in x]
    assert len([x for x in plan if "REPARTITION_BY_COL" in x and "_slice#" in x]) == 2


def test_shortage_rows_are_dealt_once(spark):
    rows = spark.createDataFrame([(1, 7, 4.0, -2.0), (1, 7, 4.0, 1.0), (1, 8, None, 0.0), (None, 7, 1.0, 1.0)],
                                 "production_number long, component_material long, required_qty double, shortage_qty double")
    out = E.shortage_rollup(rows)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    r = out.collect()
    assert len(r) == 1 and (r[0].shortage_component_count, r[0].total_shortage_qty, r[0].max_shortage_qty) == (2, 3.0, 2.0)
    assert abs(r[0].shortage_component_ratio - 1) < 1e-5 and abs(r[0].shortage_qty_ratio - 3 / 8) < 1e-5


def test_trailing_frames_look_over_ranges_without_a_join_by_place(spark):
    """A key over several ranges, short groups, null keys and values, and rows that come twice."""
    n = 900
    key = lambda i: None if i % 50 == 0 else "hot" if i % 3 else f"k{i % 40}"
    data = [(i, key(i), i * 7919 % n, None if i % 11 == 0 else float(i % 4)) for i in range(n)]
    data += [d for d in data if d[0] % 100 == 7]
    df = spark.createDataFrame(data, "pn long, k string, t long, y double").repartition(6)
    was = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = trailing_frames(df, ["pn"], ["k"], ["t", "pn"], {"a": (F.col("y"), 30, 5), "b": (F.col("y") * 2, 7, 3)}, "at")
        assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
        rows = [tuple(r) for r in repeated(got, "pn", "a", "b", "at").collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was)
    want = []
    for k in {d[1] for d in data}:
        own = sorted((d for d in data if d[1] == k), key=lambda d: (d[2], d[0]))
        for at, d in enumerate(own):
            mean = lambda m, least: (lambda v: sum(v) / len(v) if len(v) >= least else None)([x[3] for x in own[max(0, at - m):at] if x[3] is not None])  # noqa: B023, E731
            a, b = mean(30, 5), mean(7, 3)
            want += [(d[0], a, b and 2 * b, at)] * own.count(d)
    near = lambda rs: sorted(str([None if v is None else round(float(v), 9) for v in r]) for r in rs)
    assert near(rows) == near(want)


def test_what_rows_give_themselves_is_not_carried_through_joins(spark):
    rows = spark.createDataFrame([(1, "MAT001", None, "L1", dt.date(2024, 1, 1), 1, 2, *[1.0] * 13)],
                                 "production_number long, material string, material_description string, production_line string, planned_start_date date, "
                                 "is_delayed int, delay_days int, " + ", ".join(f"{c} double" for c in CL.V1_FEATURES[:13]))
    before = set(lineage_tables())
    CL.features_v1(rows)
    tables = [spark.read.parquet(t).columns for t in set(lineage_tables()) - before]
    assert not [t for t in tables if "week_of_year" in t] and [t for t in tables if "is_vsc" in t]
