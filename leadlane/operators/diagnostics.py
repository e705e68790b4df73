"""Master-data diagnostics: how production times, constraints and complexity are spread, ranked and used per order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scale import running_totals

#: Metrics of a finished-goods row: the implied daily capacity is what the time per piece allows.
MASTER_METRICS = {
    "total_production_time": F.col,
    "constraint_factor": F.col,
    "implied_daily_capacity": lambda _: F.try_divide(F.lit(1.0), "total_production_time"),
    "production_complexity": lambda _: F.col("total_production_time") * F.col("constraint_factor"),
}


def stacked(df: DataFrame, keys: list[str], metrics: dict[str, Column]) -> DataFrame:
    """Long form ``(keys, metric, value)``; metrics without a value are left out."""
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), c.cast("double").alias("value")) for n, c in metrics.items()])
    return df.select(*keys, F.explode(pairs).alias("_m")).select(*keys, "_m.metric", "_m.value").where("value is not null")


def master_metrics(fg: DataFrame, keys: list[str]) -> DataFrame:
    return stacked(fg, keys, {n: make(n) for n, make in MASTER_METRICS.items()})


def master_profile(fg: DataFrame) -> DataFrame:
    """One row a metric: rows, distinct values, minimum, maximum, mean, and the mean as a multiple of the implied capacity's."""
    by = master_metrics(fg, []).groupBy("metric").agg(
        F.count("*").alias("n"), F.countDistinct("value").alias("n_distinct"), F.min("value").alias("min_value"),
        F.max("value").alias("max_value"), F.avg("value").alias("mean_value"))
    implied = by.where("metric = 'implied_daily_capacity'").select(F.col("mean_value").alias("_implied"))
    # one row against a row for each metric
    return by.join(F.broadcast(implied), how="left").withColumn("times_implied", F.try_divide("mean_value", "_implied")).drop("_implied")


def master_ranks(fg: DataFrame) -> DataFrame:
    """Every material's rank in every metric, the greatest first, equal values alike: metrics are stacked as rows, counted
    per value, and ranked by one running total."""
    long = master_metrics(fg, ["material", "production_line"])
    counts = long.groupBy("metric", "value").agg(F.count("*").alias("_c")).withColumn("_down", -F.col("value"))
    rt = running_totals(counts, ["metric", "value"], ["_down"], {"_above": F.col("_c")}, keys=["metric"], inclusive=False)
    total = counts.groupBy("metric").agg(F.sum("_c").alias("n"))
    return long.join(rt.join(F.broadcast(total), "metric"), ["metric", "value"]).select(
        "material", "production_line", "metric", "value", (F.col("_above") + 1).alias("rank"), "n")


def order_drilldown(orders: DataFrame) -> DataFrame:
    """Per order in long form: its inputs, and the expected days by each way of reckoning them."""
    q, tpt, con, cap = (F.col(c) for c in ("order_quantity", "total_production_time", "constraint_factor", "line_capacity"))
    plain = {c: F.col(c) for c in ("order_quantity", "total_production_time", "constraint_factor", "line_capacity", "qty_capacity_ratio", "expected_production_days")}
    return stacked(orders, ["production_number", "material"], plain | {
        "production_complexity": tpt * con, "days_by_line_capacity": F.when(cap > 0, q * tpt / cap), "days_by_time": q * tpt,
        "days_by_constraint": F.when(con > 0, q / con)})
