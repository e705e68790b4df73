"""Robust regression (M4) and the search over boosted trees (M7)."""

import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadlane.operators import ml as ML
from leadlane.operators import robust as RB
from leadlane.operators.evaluate import regression_metrics


def planted(spark, n=1500, outliers=0.12, seed=1):
    """A linear target with gross errors in some training rows, none in the last fifth; f3 is noise, f4 constant, f5 often null."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 4)) * [1, 5, 0.2, 1]
    y = 8 + 2 * x[:, 0] - 0.6 * x[:, 1] + 9 * x[:, 2] + 0.3 * rng.standard_normal(n)
    bad = (rng.random(n) < outliers) & (np.arange(n) < 0.8 * n)
    y = np.where(bad, y + rng.choice([40.0, 60.0], n), y)
    rows = [(i, *map(float, x[i]), 3.0, None if i % 2 else 1.0, float(y[i])) for i in range(n)]
    cols = "production_number long, f0 double, f1 double, f2 double, f3 double, f4 double, f5 double, actual_production_days double"
    return spark.createDataFrame(rows, cols).withColumn("created_date", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("production_number") / 10).cast("int")))


FEATURES = ["f0", "f1", "f2", "f3", "f4", "f5"]


def test_outliers_hurt_squares_and_not_the_robust_fit(spark):
    df = planted(spark)
    train, test = df.where("production_number < 1200"), df.where("production_number >= 1200")
    robust = RB.fit_huber(train, FEATURES)
    square = RB.fit_huber(train, FEATURES, delta=1e6)  # all weights are 1: least squares with the same penalties
    mae = [regression_metrics(m.predict(test), ML.LABEL, "predicted").first().mae for m in (robust, square)]
    assert mae[0] < 0.5 and mae[1] > 4
    assert all(b <= a + 1e-9 * abs(a) for a, b in zip(robust.objective, robust.objective[1:]))


@pytest.mark.parametrize("alpha, lam", [(1.0, 5.0), (0.0, 0.0), (400.0, 0.0), (30.0, 200.0)])
def test_the_fit_is_the_minimum(spark, alpha, lam):
    """At the minimum each coefficient's slope is what the penalties allow."""
    df = planted(spark, n=600)
    m = RB.fit_huber(df, FEATURES, reg_alpha=alpha, reg_lambda=lam, max_rounds=200, tol=1e-12)
    p = df.fillna(0).toPandas()
    x, y = p[FEATURES].to_numpy(float), p[ML.LABEL].to_numpy(float)
    sd = x.std(axis=0, ddof=1)
    w = np.array(m.coefficients) * sd
    z = np.divide(x, sd, out=np.zeros_like(x), where=sd > 0)
    r = y - z @ w - m.intercept
    slope = -z.T @ (r / np.sqrt(1 + (r / 2) ** 2))
    near = 1e-3 * len(y)
    assert abs((r / np.sqrt(1 + (r / 2) ** 2)).sum()) < near
    for j in range(len(w)):
        if abs(w[j]) > 1e-9:
            assert abs(slope[j] + lam * w[j] + alpha * np.sign(w[j])) < near
        else:
            assert abs(slope[j]) <= alpha + near
    assert w[4] == 0 and (alpha < 400 or (w[3] == 0 and w[5] == 0))


def test_model_survives_saving_and_odd_rows(spark, tmp_path):
    df = planted(spark, n=300)
    m = RB.fit_huber(df.withColumn(ML.LABEL, F.when(F.col("production_number") % 7 != 0, F.greatest(F.col(ML.LABEL), F.lit(1.0)))), FEATURES, log_target=True)
    m.save(str(tmp_path / "m"))
    again = RB.HuberModel.load(spark, str(tmp_path / "m"))
    assert again == m and [k for k, _ in m.importance()][:3] == [k for k, _ in again.importance()][:3]
    new = df.drop("f2").limit(5).withColumn("f0", F.lit(None).cast("double"))
    assert all(r.predicted is not None and r.predicted >= 0 for r in again.predict(new).collect())
    with pytest.raises(ValueError):
        RB.fit_huber(df.limit(0), FEATURES)


SMALL = {"maxIter": ("int", 2, 5), "maxDepth": ("int", 2, 3), "stepSize": ("log", 0.1, 0.3)}


def test_search_returns_all_trials_and_the_best(spark):
    df = planted(spark, n=400, outliers=0)
    best, trials = ML.random_search(df, FEATURES, n_trials=4, n_splits=2, space=SMALL, parallelism=4)
    rows = trials.collect()
    assert [r.trial for r in rows] == [0, 1, 2, 3] and best == json.loads(min(rows, key=lambda r: r.rmse_mean).params)
    alone = ML.random_search(df, FEATURES, n_trials=4, n_splits=2, space=SMALL, parallelism=1)[1].collect()
    assert [r.rmse_mean for r in alone] == pytest.approx([r.rmse_mean for r in rows])


def test_search_stops_at_its_deadline(spark):
    """Of one quick and several endless trials only the quick one comes back; nothing goes on running."""
    start = time.time()

    def slow():
        return spark.range(2).repartition(2).select(F.expr("reflect('java.lang.Thread', 'sleep', 60000L)")).collect()

    got = ML.run_all(spark, {"quick": lambda: 1, "a": slow, "b": slow, "c": slow}, parallelism=2, timeout=4)
    assert got == {"quick": 1} and time.time() - start < 30
    with pytest.raises(ZeroDivisionError):
        ML.run_all(spark, {"x": lambda: 1 / 0, "y": lambda: 2}, parallelism=1)


def test_ranges_are_not_narrower_than_the_sources():
    s = ML.PARAM_SPACE
    assert len(s) == 10 and s["maxIter"][1:] == (100, 800) and s["maxDepth"][1:] == (3, 9) and s["stepSize"][1:] == (0.01, 0.3)
