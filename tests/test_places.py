"""Splits and folds by comparison with the row at a place: what the join with every row's place gives."""

import datetime as dt

from pyspark.sql import functions as F

from leadlane.operators import evaluate as EV
from leadlane.operators import ml as ML


def _orders(spark, n=97, twice=()):
    data = [(i, dt.date(2024, 1, 1) + dt.timedelta(days=i * i % 11), float(i % 5)) for i in range(n)]
    return spark.createDataFrame(data + [data[i] for i in twice], "production_number long, created_date date, actual_production_days double")


def _by_number(df, col):
    return sorted((r.production_number, r[col]) for r in df.collect())


def test_split_by_the_row_at_a_place_needs_no_join(spark):
    df = _orders(spark)
    new = EV.split_in_time(df, 0.3, 0.1)
    old = EV.chronological_split(df, 0.3)
    assert _by_number(new, "split") == _by_number(old, "split")
    n = old.where("split = 'train'").count()
    assert _by_number(new, "_is_val") == sorted((r.production_number, r.row_index >= int(n * 0.9)) for r in old.collect())
    assert "Join" not in new._jdf.queryExecution().executedPlan().toString()


def test_folds_by_the_row_at_a_place(spark):
    for n, k in ((97, 5), (6, 5), (4, 5), (0, 3)):
        new, old = EV.folds_in_time(_orders(spark, n), k), EV.cv_fold_assignment(_orders(spark, n), k)
        assert {r.production_number: r.test_fold for r in new.collect()} == {r.production_number: r.test_fold for r in old.collect()}
        assert "Join" not in new._jdf.queryExecution().executedPlan().toString()


def test_repeated_numbers_and_nulls_take_their_places_by_join(spark):
    for df in (_orders(spark, 40, twice=[3, 9]), _orders(spark, 40).withColumn("created_date", F.when(F.col("production_number") != 7, F.col("created_date")))):
        assert EV.before_places(df, lambda n: [n // 2]) is None
        new, old = EV.split_in_time(df), EV.chronological_split(df)
        assert sorted((r.production_number, r.row_index, r.split) for r in new.collect()) == sorted((r.production_number, r.row_index, r.split) for r in old.collect())
        assert sorted(str(r.test_fold) for r in EV.folds_in_time(df, 3).collect()) == sorted(str(r.test_fold) for r in EV.cv_fold_assignment(df, 3).collect())


def test_fold_vectors_are_put_together_as_they_are_read(spark):
    folds = ML.fold_vectors(_orders(spark).withColumn("x", F.col("production_number").cast("double")), ["x"], 4)
    assert folds.folds == [1, 2, 3, 4] and folds.data.where("test_fold = 4").count() == 97 // 5
    assert folds.data.where("test_fold is null").count() == 97 - 4 * (97 // 5)
