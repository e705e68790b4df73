"""Data-quality checks as one long report.

Every check is an aggregate (one pass per table); the report has one row per
rule: ``(table_name, rule, column_name, violations, total, severity)``.
Schema checks (required columns) only read metadata.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import parse_timestamp

REPORT_SCHEMA = "table_name string, rule string, column_name string, violations bigint, total bigint, severity string"


def _rows(agg_df: DataFrame, table: str, specs: list[tuple[str, str, str, str]]) -> DataFrame:
    """Unpivot one aggregate row: specs = (rule, column, agg column name, severity)."""
    structs = [F.struct(F.lit(table).alias("table_name"), F.lit(rule).alias("rule"),
                        F.lit(col).cast("string").alias("column_name"),
                        F.col(a).cast("long").alias("violations"), F.col("_total").cast("long").alias("total"),
                        F.lit(sev).alias("severity")) for rule, col, a, sev in specs]
    return agg_df.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def schema_rules(df: DataFrame, table: str, required: list[str]) -> DataFrame:
    """Q1/Q2/Q3: one row per required column; violation when it is absent."""
    spark = df.sparkSession
    present = set(df.columns)
    return spark.createDataFrame([(table, "required_column", c, 0 if c in present else 1, 1, "error")
                                  for c in required], REPORT_SCHEMA)


def table_rules(df: DataFrame, table: str, not_null: dict[str, str] | None = None,
                positive: list[str] | None = None, label: str | None = None,
                ordered_dates: list[tuple[str, str]] | None = None,
                extra: dict[str, tuple[Column, str, str | None]] | None = None) -> DataFrame:
    """Q1-Q4 in one aggregate: empty table, nulls per column (severity per column),
    non-positive quantities, all-null label, end-before-start counts, plus
    ``extra`` custom counts ``name -> (boolean violation expr, severity, column)``."""
    not_null, positive, ordered_dates, extra = not_null or {}, positive or [], ordered_dates or [], extra or {}
    aggs, specs = [F.count(F.lit(1)).alias("_total")], []
    aggs.append(F.when(F.count(F.lit(1)) == 0, 1).otherwise(0).alias("_empty"))
    specs.append(("non_empty", None, "_empty", "error"))
    for i, (c, sev) in enumerate(not_null.items()):
        aggs.append(F.count_if(F.col(c).isNull()).alias(f"_n{i}"))
        specs.append(("not_null", c, f"_n{i}", sev))
    for i, c in enumerate(positive):
        aggs.append(F.count_if(F.col(c) <= 0).alias(f"_p{i}"))
        specs.append(("positive", c, f"_p{i}", "warn"))
    if label is not None:
        aggs.append(F.when(F.count(label) == 0, 1).otherwise(0).alias("_lab"))
        specs.append(("label_not_all_null", label, "_lab", "error"))
    for i, (start, end) in enumerate(ordered_dates):
        aggs.append(F.count_if(F.col(end) < F.col(start)).alias(f"_o{i}"))
        specs.append(("end_not_before_start", f"{start}<={end}", f"_o{i}", "warn"))
    for i, (name, (expr, sev, col)) in enumerate(extra.items()):
        aggs.append(F.count_if(expr).alias(f"_x{i}"))
        specs.append((name, col, f"_x{i}", sev))
    return _rows(df.agg(*aggs), table, specs)


#: Columns that an extract must have, by kind of table.
REQUIRED = {
    "history": ["production_number", "material", "planned_start_date", "planned_finish_date", "actual_finish_date"],
    "material": ["material", "production_line", "total_production_time"],
    "capacity": ["production_line", "line_capacity"],
}


def type_rules(df: DataFrame, kind: str, table: str | None = None) -> DataFrame:
    """Q3: an extract of one kind: it must hold rows and its kind's columns (errors); nulls in those are only warned of.
    A kind without required columns is only checked for rows."""
    required = REQUIRED.get(kind, [])
    present = [c for c in required if c in df.columns]
    return schema_rules(df, table or kind, required).unionByName(table_rules(df, table or kind, not_null={c: "warn" for c in present}))


def date_rules(df: DataFrame, table: str, dates: dict[str, str | None]) -> DataFrame:
    """Q4: text that is no date in its column's format (None: ISO). Nulls and blanks are no dates, but not malformed."""
    aggs, specs = [F.count(F.lit(1)).alias("_total")], []
    for i, (c, fmt) in enumerate(dates.items()):
        text = F.trim(F.col(c).cast("string"))
        aggs.append(F.count_if(F.coalesce(text != "", F.lit(False)) & parse_timestamp(text, fmt).isNull()).alias(f"_d{i}"))
        specs.append(("valid_date", c, f"_d{i}", "warn"))
    return _rows(df.agg(*aggs), table, specs)


def label_rules(df: DataFrame, table: str, label: str) -> DataFrame:
    """Q5: one row for each value of a label (null is one) with its count; an empty table gives none."""
    counts = df.groupBy(F.col(label).cast("string").alias("_v")).agg(F.count(F.lit(1)).alias("violations"))
    total = counts.agg(F.sum("violations").alias("total"))  # one row
    return counts.crossJoin(F.broadcast(total)).select(
        F.lit(table).alias("table_name"), F.lit("label_count").alias("rule"),
        F.concat(F.lit(f"{label}="), F.coalesce("_v", F.lit("null"))).alias("column_name"),
        "violations", "total", F.lit("info").alias("severity"))


def match_rules(orders: DataFrame, fg: DataFrame, shortage: DataFrame | None = None) -> DataFrame:
    """Q5: orders without finished-goods master data and orders with shortage rows."""
    fg_keys = fg.select("material").filter(F.col("material").isNotNull()).distinct()
    missing = orders.join(fg_keys, "material", "left_anti").agg(F.count(F.lit(1)).alias("v"))
    total = orders.agg(F.count(F.lit(1)).alias("_total"))
    out = missing.crossJoin(total).select(F.lit("history").alias("table_name"), F.lit("fg_match").alias("rule"),
                                          F.lit("material").alias("column_name"), F.col("v").cast("long").alias("violations"),
                                          F.col("_total").cast("long").alias("total"), F.lit("warn").alias("severity"))
    if shortage is not None:
        keys = shortage.select("production_number").filter(F.col("production_number").isNotNull()).distinct()
        matched = orders.join(keys, "production_number", "left_semi").agg(F.count(F.lit(1)).alias("v"))
        out = out.unionByName(matched.crossJoin(total).select(
            F.lit("history").alias("table_name"), F.lit("orders_with_shortage").alias("rule"),
            F.lit("production_number").alias("column_name"), F.col("v").cast("long").alias("violations"),
            F.col("_total").cast("long").alias("total"), F.lit("info").alias("severity")))
    return out


def quality_report(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def key_overlap_audit(left: DataFrame, right: DataFrame, key: str, trim: bool = False) -> DataFrame:
    """Distinct keys on each side, their intersection, and how many left rows
    find a match (inner) - semi/anti joins, no key lists on the driver."""
    lk = F.trim(F.col(key).cast("string")) if trim else F.col(key).cast("string")
    l = left.select(lk.alias("k")).filter(F.col("k").isNotNull())
    r = right.select(lk.alias("k")).filter(F.col("k").isNotNull())
    ld, rd = l.distinct(), r.distinct()
    stats = [ld.agg(F.count(F.lit(1)).alias("left_keys")), rd.agg(F.count(F.lit(1)).alias("right_keys")),
             ld.intersect(rd).agg(F.count(F.lit(1)).alias("common_keys")),
             l.join(rd, "k", "left_semi").agg(F.count(F.lit(1)).alias("left_rows_matched")),
             left.agg(F.count(F.lit(1)).alias("left_rows"))]
    return reduce(lambda a, b: a.crossJoin(b), stats)
