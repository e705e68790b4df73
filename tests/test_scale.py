"""Scale forms equal their naive definitions (random data with a hot key)."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from leadlane.operators.scale import (category_codes, exact_quantiles, forward_table, range_table, running_totals, sliced_frames,
                                      trailing_rows_stats)


def _rows(n=400, seed=7):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        key = "HOT" if rng.random() < 0.4 else rng.choice(["A", "B", "C", None])
        out.append((i, key, rng.randint(0, 60), rng.choice([None, float(rng.randint(1, 9))])))
    return out


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(_rows(), "pn long, k string, day int, y double")


@pytest.mark.parametrize("inclusive", [True, False])
def test_running_totals_match_window(spark, df, inclusive):
    rt = running_totals(df, ["pn"], ["day", "pn"], {"s": F.col("y"), "n": F.lit(1)}, keys=["k"],
                        inclusive=inclusive, partitions=5)
    w = Window.partitionBy("k").orderBy("day", "pn").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    naive = df.select("pn", F.coalesce(F.sum("y").over(w), F.lit(0.0)).alias("s"),
                      F.coalesce(F.count(F.lit(1)).over(w), F.lit(0)).alias("n"))
    a = {r.pn: (r.s, r.n) for r in rt.collect()}
    b = {r.pn: (r.s, r.n) for r in naive.collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert a[k][0] == pytest.approx(b[k][0]) and a[k][1] == b[k][1]


def test_global_running_totals(spark, df):
    rt = running_totals(df, ["pn"], ["day", "pn"], {"n": F.lit(1)}, partitions=7)
    pdf = df.toPandas().sort_values(["day", "pn"]).reset_index(drop=True)
    expect = dict(zip(pdf.pn, range(1, len(pdf) + 1)))
    assert {r.pn: r.n for r in rt.collect()} == expect


def test_range_table_matches_naive(spark, df):
    t = range_table(df.withColumn("_ov", F.col("day").cast("long")), ["k"], "_ov", 1, -10,
                    {"_n": F.count("y"), "_s": F.sum("y")}, {"n": ("sum", "_n"), "s": ("sum", "_s")})
    got = {(r.k, r._ov): (r.n, r.s) for r in t.collect()}
    pdf = df.toPandas()
    for (k, d), (n, s) in got.items():
        m = pdf[(pdf.k == k) & (pdf.day >= d - 10) & (pdf.day < d) & pdf.y.notna()]
        assert (n or 0) == len(m)
        if len(m):
            assert s == pytest.approx(m.y.sum())


def test_forward_table_matches_naive(spark):
    rows = [(i, random.Random(i).choice(["L1", "L2", "HOT", "HOT"]), i % 30, (i * 7) % 40, float(i % 5))
            for i in range(300)]
    df = spark.createDataFrame(rows, "pn long, k string, c long, ps long, q double")
    t = forward_table(df, "k", "c", "ps", "q", 1, {"f": 7})
    got = {(r.k, r.c): (r.f_n, r.f_q) for r in t.collect()}
    pdf = pd.DataFrame(rows, columns=["pn", "k", "c", "ps", "q"])
    for (k, c), (n, q) in got.items():
        m = pdf[(pdf.k == k) & (pdf.ps > c) & (pdf.ps <= c + 7)]
        assert (n or 0) == len(m)
        assert (q or 0.0) == pytest.approx(m.q.sum())


def test_trailing_rows_match_pandas_rolling(spark, df):
    t = trailing_rows_stats(df, ["pn"], ["k"], ["day", "pn"], F.col("y"), {"m": (5, 2)})
    got = {r.pn: r.m for r in t.collect()}
    pdf = df.toPandas().sort_values(["day", "pn"])
    pdf["kk"] = pdf.k.fillna("<null>")
    pdf["m"] = pdf.groupby("kk")["y"].transform(lambda s: s.rolling(5, min_periods=2).mean().shift(1))
    for pn, m in zip(pdf.pn, pdf.m):
        if np.isnan(m):
            assert got[pn] is None
        else:
            assert got[pn] == pytest.approx(m)


def test_exact_quantiles_match_numpy(spark):
    vals = [float(v) for v in np.random.default_rng(3).integers(0, 50, 333)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    r = exact_quantiles(df, "x", [0.01, 0.5, 0.95, 0.99], ["a", "b", "c", "d"]).first()
    assert [r.a, r.b, r.c, r.d] == pytest.approx(list(np.percentile(vals, [1, 50, 95, 99])))


def test_category_codes_like_pandas(spark):
    vals = ["b", "a", None, "c", "a"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, v string")
    got = [r.code for r in category_codes(df, "v", "code").orderBy("i").collect()]
    assert got == list(pd.Categorical(vals).codes)


def test_forward_load_timestamps_match_naive(spark):
    """Micro-second order values: exact (t, t + 7 d] bounds on timestamps."""
    import datetime as dt
    from leadlane.operators.features import forward_load
    rng = random.Random(11)
    base = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(250):
        c = base + dt.timedelta(hours=rng.randint(0, 24 * 40))
        ps = c + dt.timedelta(hours=rng.randint(-48, 24 * 12)) if i % 9 else None
        rows.append((i, rng.choice(["L1", "HOT", "HOT", None]), rng.choice(["M1", "M2"]), c, ps, float(i % 7)))
    df = spark.createDataFrame(rows, "production_number long, production_line string, material string, "
                                     "created_date timestamp, planned_start_date timestamp, order_quantity double")
    got = {r.production_number: (r.forward_7d_line_orders, r.forward_7d_line_qty, r.forward_7d_material_orders)
           for r in forward_load(df).collect()}
    pdf = pd.DataFrame(rows, columns=["pn", "line", "mat", "c", "ps", "q"])
    for r in pdf.itertuples():
        win = pdf[(pdf.pn != r.pn) & (pdf.ps > r.c) & (pdf.ps <= r.c + pd.Timedelta(days=7))]
        line = win[win.line == r.line] if r.line is not None else win.iloc[0:0]
        mat = win[win.mat == r.mat]
        assert got[r.pn][0] == len(line) and got[r.pn][1] == pytest.approx(line.q.sum())
        assert got[r.pn][2] == len(mat)


def test_history_stats_timestamps_match_naive(spark):
    import datetime as dt
    from leadlane.operators.features import history_stats
    rng = random.Random(5)
    base = dt.datetime(2024, 1, 1)
    rows = [(i, rng.choice(["M1", "HOT", "HOT"]), rng.choice(["L1", "L2"]),
             base + dt.timedelta(hours=rng.randint(0, 24 * 200)), float(rng.randint(1, 20))) for i in range(300)]
    df = spark.createDataFrame(rows, "production_number long, material string, production_line string, "
                                     "created_date timestamp, actual_production_days double")
    got = {r.production_number: (r.material_avg_production_time_90d, r.material_max_production_time_90d,
                                 r.line_avg_production_time_90d, r.material_order_count_30d)
           for r in history_stats(df).collect()}
    pdf = pd.DataFrame(rows, columns=["pn", "mat", "line", "c", "y"])
    for r in pdf.itertuples():
        h = pdf[(pdf.c < r.c) & (pdf.c >= r.c - pd.Timedelta(days=90))]
        m, ln = h[h.mat == r.mat], h[h.line == r.line]
        c30 = pdf[(pdf.c < r.c) & (pdf.c >= r.c - pd.Timedelta(days=30)) & (pdf.mat == r.mat)]
        avg, mx, lavg, cnt = got[r.pn]
        assert (avg is None) == m.empty and (m.empty or avg == pytest.approx(m.y.mean()))
        assert m.empty or mx == m.y.max()
        assert (lavg is None) == ln.empty and (ln.empty or lavg == pytest.approx(ln.y.mean()))
        assert cnt == (len(c30) if len(h) else 0)


def test_sliced_frames_match_naive(spark):
    """Integer values on and beside slice edges, sums and maxima (of structs too), frames behind and ahead of the probe."""
    rng = random.Random(9)
    rows = [(rng.choice(["HOT", "HOT", "HOT", "A", None]), rng.choice([rng.randint(-90, 90), 8 * rng.randint(-10, 10)]), rng.choice([None, rng.randint(1, 9)])) for _ in range(300)]
    df = spark.createDataFrame(rows, "k string, v long, x long").withColumn("m", F.struct("v", "x"))
    frames = {"back": (-48, 0), "short": (-16, 0), "ahead": (1, 33)}
    got = {(r.k, r.v): r for r in sliced_frames(df, df, ["k"], "v", frames, {"s": ("sum", "x"), "m": ("max", "m")}).collect()}
    assert set(got) == {(k, v) for k, v, _ in rows if k}
    for (k, v), r in got.items():
        for f, (lo, hi) in frames.items():
            inside = [(w, x) for j, w, x in rows if j == k and v + lo <= w < v + hi]
            xs = [x for _, x in inside if x is not None]
            assert r[f"{f}_s"] == (sum(xs) if xs else None)
            assert (None if r[f"{f}_m"] is None else tuple(r[f"{f}_m"])) == max(inside, key=lambda y: (y[0], y[1] or 0), default=None)


def test_hot_key_on_timestamps_spreads(spark):
    """One material with nine tenths of all orders, each at its own time: the windows' largest task stays near the median."""
    from leadlane.operators.features import history_stats
    n, minutes = 6000, 60
    df = spark.range(n).select(
        F.col("id").alias("production_number"), F.when(F.col("id") % 10 == 0, F.concat(F.lit("M"), F.col("id") % 7)).otherwise("HOT").alias("material"),
        F.lit("L").alias("production_line"), F.timestamp_micros((F.lit(1_700_000_000) + F.col("id") * 60 * minutes) * 1_000_000).alias("created_date"),
        (F.col("id") % 13).cast("double").alias("actual_production_days"))
    events = df.select("material", F.unix_micros("created_date").alias("v"), F.lit(1).cast("long").alias("c"))
    plan = sliced_frames(events, events, ["material"], "v", {"f": (-90 * 86_400_000_000, 0)}, {"c": ("sum", "c")})
    hot = {r.v: r.f_c for r in plan.where("material = 'HOT'").collect()}
    times = sorted(hot)
    assert all((hot[t] or 0) == sum(t - 90 * 86_400_000_000 <= u < t for u in times) for t in times[::97])
    # The same slices as the window's groups, dealt over eight tasks.
    length = 90 * 86_400_000_000 // 8
    sizes = [r["count"] for r in events.withColumn("s", F.col("v") - F.pmod("v", F.lit(length))).repartition(8, "material", "s").groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 3 * sorted(sizes)[len(sizes) // 2] and max(sizes) < n / 3
    assert history_stats(df).where("material = 'HOT' and line_avg_production_time_90d is not null").count() > 5000
