"""Naive forms kept only as benchmark and test references for the scale forms:
a range self-join for forward load and a single-partition window for the
expanding mean. Not used by any operator."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources.fixtures import Views
from .registry import train_rows


def forward_load_line_range_join(spark, sf):
    t = train_rows(Views(spark, sf)).select("production_number", "production_line", "created_date",
                                            "planned_start_date", "order_quantity")
    a, b = t.alias("a"), t.alias("b")
    cond = ((F.col("a.production_line") == F.col("b.production_line"))
            & (F.col("a.production_number") != F.col("b.production_number"))
            & (F.col("b.planned_start_date") > F.col("a.created_date"))
            & (F.col("b.planned_start_date") <= F.date_add(F.col("a.created_date"), 7)))
    return a.join(b, cond, "left").groupBy(F.col("a.production_number").alias("production_number")).agg(
        F.count("b.production_number").cast("double").alias("forward_7d_line_orders"),
        F.coalesce(F.sum("b.order_quantity"), F.lit(0.0)).alias("forward_7d_line_qty"))


def expanding_mean_single_partition(spark, sf):
    t = train_rows(Views(spark, sf))
    w = Window.orderBy("created_date", "production_number").rowsBetween(Window.unboundedPreceding, 0)
    return t.select("production_number", F.avg("actual_production_days").over(w).alias("expanding_mean"))


NAIVE = {"forward_load_line": forward_load_line_range_join, "expanding_fill": expanding_mean_single_partition}
