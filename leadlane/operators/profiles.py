"""A standing distribution profile (A23): quantile sketches stored by day, merged when read.

Each stored row has a key's and day's count, mean, sum of squared deviations, least and greatest value, and a KLL
sketch. All of them merge, so a profile over any days and keys reads small rows, never the orders again. A sketch's
quantile has a rank within ``rank_error(k)`` of the one asked for; the exact form is ``rollups.percentile_profile``.
Null, NaN values and null days are left out; a key without values has no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .rollups import PERCENTILES

#: Sketch size; the rank error is about 0.0021.
SKETCH_K = 4096


def rank_error(k: int = SKETCH_K) -> float:
    """Stated rank error of a sketch of size ``k``: three times the published 99 % bound of one quantile."""
    return 3 * 2.296 / k ** 0.9723


def daily_sketches(df: DataFrame, col: str, day: str, keys: list[str] = (), k: int = SKETCH_K) -> DataFrame:
    """(keys, day, n, mean, m2, min, max, sketch): one row for each key and day, by a map-side combining aggregate.

    ``m2`` is the sum of squared deviations from the mean.
    """
    x = F.col(col).cast("double")
    d = df.select(*keys, F.to_date(day).alias("day"), x.alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x") & F.col("day").isNotNull())
    return d.groupBy(*keys, "day").agg(
        F.count("_x").alias("n"), F.avg("_x").alias("mean"), (F.var_pop("_x") * F.count("_x")).alias("m2"),
        F.min("_x").alias("min"), F.max("_x").alias("max"), F.kll_sketch_agg_double("_x", F.lit(k)).alias("sketch"))


def append_days(sketches: DataFrame, path: str, batch_id: str) -> None:
    """Adds one batch to the standing table. A batch that is written again replaces itself and no other."""
    (sketches.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("batch_id").parquet(path))


def stored_days(spark: SparkSession, path: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Rows of the standing table for the days asked for, both ends included; a day may have several (late batches)."""
    df = spark.read.parquet(path)
    if first:
        df = df.where(F.col("day") >= F.lit(first).cast("date"))
    return df.where(F.col("day") <= F.lit(last).cast("date")) if last else df


def merged(sketches: DataFrame, keys: list[str] = ()) -> DataFrame:
    """One row for each value of ``keys`` (one in all without): the same columns, merged over days and other keys.

    Deviations are merged around a mean that each row is compared with, so large values do not cancel.
    """
    base = sketches.select(*keys, "n", "mean", "m2", "min", "max", "sketch")
    # A shift near the mean: the deviations of the rows' means from it are small, and so are their squares.
    shift = base.groupBy(*keys).agg((F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("_shift"))
    if keys:
        named = shift.withColumnsRenamed({c: f"_k_{c}" for c in keys})
        on: Column = F.lit(True)
        for c in keys:
            on = on & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
        both = base.join(named, on)
    else:
        both = base.join(F.broadcast(shift), F.lit(True))  # one row
    off = F.col("mean") - F.col("_shift")
    out = both.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.first("_shift").alias("_s"), F.sum(off * F.col("n")).alias("_d"),
        F.sum(F.col("m2") + off * off * F.col("n")).alias("_q"), F.min("min").alias("min"), F.max("max").alias("max"),
        F.kll_merge_agg_double("sketch").alias("sketch"))
    if not keys:
        out = out.where(F.col("n").isNotNull())
    return out.select(*keys, "n", (F.col("_s") + F.col("_d") / F.col("n")).alias("mean"),
                      (F.col("_q") - F.col("_d") * F.col("_d") / F.col("n")).alias("m2"), "min", "max", "sketch")


def sketch_profile(sketches: DataFrame, keys: list[str] = ()) -> DataFrame:
    """A23 from stored sketches: n, mean, median, std, min, max and P10..P99 for each value of ``keys``."""
    m = merged(sketches, keys)
    ps = [F.kll_sketch_get_quantile_double("sketch", F.lit(p / 100)).alias(f"p{p}") for p in PERCENTILES]
    return m.select(*keys, "n", "mean", F.kll_sketch_get_quantile_double("sketch", F.lit(0.5)).alias("median"),
                    F.when(F.col("n") > 1, F.sqrt(F.greatest(F.col("m2"), F.lit(0.0)) / (F.col("n") - 1))).alias("std"),
                    "min", "max", *ps)
