"""Cleaning functions for ERP extracts.

All functions return Spark ``Column`` expressions or apply schema-level
changes through the DataFrame API; none runs Python per row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dates import _c


# --- C1 / C2 / C14 / C19: schema-level helpers ---------------------------------

def rename_existing(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rename only the columns that exist (absent names are ignored)."""
    present = {k: v for k, v in mapping.items() if k in df.columns}
    return df.withColumnsRenamed(present) if present else df


def strip_headers(df: DataFrame) -> DataFrame:
    """Trim whitespace (and a UTF-8 byte-order mark) from column names."""
    return df.toDF(*[c.replace("﻿", "").strip() for c in df.columns])


def first_alias_rename(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """C14: for each target absent from ``df``, rename the first alias present."""
    out = df
    for target, candidates in aliases.items():
        if target in out.columns:
            continue
        for cand in candidates:
            if cand in out.columns:
                out = out.withColumnRenamed(cand, target)
                break
    return out


def project_contract(df: DataFrame, columns: list[str], types: dict[str, str] | None = None) -> DataFrame:
    """Project to a fixed column list; absent columns become typed nulls."""
    types = types or {}
    exprs = []
    for c in columns:
        if c in df.columns:
            exprs.append(F.col(c))
        else:
            exprs.append(F.lit(None).cast(types.get(c, "string")).alias(c))
    return df.select(*exprs)


def first_existing(df: DataFrame, candidates: list[str], alias: str) -> Column:
    """First *column* that exists (schema choice, not per-row coalesce)."""
    for c in candidates:
        if c in df.columns:
            return F.col(c).alias(alias)
    return F.lit(None).alias(alias)


def columns_containing(df: DataFrame, needles: list[str]) -> list[str]:
    """C17: column names containing any needle, case-insensitive."""
    return [c for c in df.columns if any(n.lower() in c.lower() for n in needles)]


# --- C3 / C4 / C18: parsing -------------------------------------------------------

def parse_timestamp(x, fmt: str | None = None) -> Column:
    """Timestamp parse, bad input -> null."""
    s = _c(x).cast("string")
    return F.try_to_timestamp(s, F.lit(fmt)) if fmt else F.try_to_timestamp(s)


def parse_date(x, fmt: str | None = None) -> Column:
    """Date parse, bad input -> null."""
    return parse_timestamp(x, fmt).cast("date")


def parse_number(x, default: float | None = None) -> Column:
    """C4: numeric parse, bad input -> null (or ``default``). ANSI-safe (no throw)."""
    v = F.trim(_c(x).cast("string")).try_cast("double")
    return F.coalesce(v, F.lit(float(default))) if default is not None else v


def dotted_date(x) -> Column:
    """Dotted or dashed dates -> 'yyyy-MM-dd' text (null when unparsable).

    Year-first text is read as y-m-d, day-first dotted text ('24.03.2026') as
    d-m-y, slashed text as M/d/yyyy. Explicit formats replace pandas' guess."""
    s = F.translate(F.trim(_c(x).cast("string")), ".", "-")
    parsed = (F.when(s.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), F.try_to_timestamp(s, F.lit("yyyy-M-d")))
              .when(s.rlike(r"^\d{1,2}-\d{1,2}-\d{4}$"), F.try_to_timestamp(s, F.lit("d-M-yyyy")))
              .when(s.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_timestamp(s, F.lit("M/d/yyyy"))))
    return F.date_format(parsed, "yyyy-MM-dd")


# --- C5 / C6 / C7 / C8: ERP encodings -------------------------------------------

def strip_leading_zeros_opensql(x) -> Column:
    """C5 (OpenSQL): null -> '', trim, strip leading zeros; all-zero or empty -> '0'."""
    t = F.trim(F.coalesce(_c(x).cast("string"), F.lit("")))
    stripped = F.regexp_replace(t, r"^0+", "")
    return F.when(stripped == "", F.lit("0")).otherwise(stripped)


def strip_leading_zeros_odata(x) -> Column:
    """C5 (OData): empty/null stays as is, no trim; all zeros -> '0'."""
    s = _c(x).cast("string")
    stripped = F.regexp_replace(s, r"^0+", "")
    return F.when(s.isNull() | (s == ""), s) \
        .when(stripped == "", F.lit("0")).otherwise(stripped)


def dats_to_iso(x) -> Column:
    """ERP DATS text -> 'yyyy-MM-dd'. null / '' / '00000000' -> ''; ISO kept; other kept."""
    s = F.trim(_c(x).cast("string"))
    return (F.when(s.isNull() | (s == "") | (s == "00000000"), F.lit(""))
            .when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), s)
            .when(s.rlike(r"^\d{8}$"),
                  F.concat_ws("-", F.substring(s, 1, 4), F.substring(s, 5, 2), F.substring(s, 7, 2)))
            .otherwise(s))


def dats_to_short(x) -> Column:
    """ERP DATS -> 'M/d/yyyy' (null when not a valid date)."""
    iso = dats_to_iso(x)
    return F.date_format(F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")), "M/d/yyyy")


def odata_date(x) -> Column:
    """C8: '/Date(ms)/' -> 'yyyy-MM-dd' in UTC; negative ms -> null; other text parsed generically."""
    s = _c(x).cast("string")
    ms = F.regexp_extract(s, r"^/Date\((\d+)\)/$", 1)
    from_ms = F.date_format(F.timestamp_millis(ms.cast("long")), "yyyy-MM-dd")
    generic = F.date_format(F.try_to_timestamp(s), "yyyy-MM-dd")
    return (F.when(s.isNull(), F.lit(None).cast("string"))
            .when(s.startswith("/Date("), F.when(ms != "", from_ms))
            .otherwise(generic))


# --- C13 / C16 / C20 / C21: string surgery --------------------------------------

def paren_inner(x) -> Column:
    """Text inside the first parentheses, e.g. 'L1(SUP3)' -> 'SUP3' ('' when none)."""
    return F.regexp_extract(_c(x).cast("string"), r"\(([^)]*)\)", 1)


def paren_outer(x) -> Column:
    """Text before the first '(' with whitespace trimmed."""
    return F.trim(F.regexp_replace(_c(x).cast("string"), r"\(.*$", ""))


def line_code(x) -> Column:
    """Token before the first '_'. Null stays null."""
    return F.substring_index(_c(x).cast("string"), "_", 1)


def strip_float_suffix(x) -> Column:
    """C20: '123.0' -> '123' for ids that went through a float."""
    return F.regexp_replace(_c(x).cast("string"), r"\.0$", "")


def _blank_to_null(c: Column) -> Column:
    t = F.trim(c.cast("string"))
    return F.when(t.isNull() | (t == "") | (F.lower(t) == "nan"), F.lit(None)).otherwise(t)


def backfill_order_key(order, sales_doc, item) -> Column:
    """Keep order; else '<so>_<item>'; else '<so>'; blanks and 'nan' count as missing."""
    o = _blank_to_null(strip_float_suffix(order))
    so = _blank_to_null(strip_float_suffix(sales_doc))
    it = _blank_to_null(strip_float_suffix(item))
    return F.coalesce(o, F.when(so.isNotNull() & it.isNotNull(), F.concat_ws("_", so, it)), so)


# --- C23 / C24: capacity ---------------------------------------------------------

WEEKDAY_CAPACITY_COLUMNS = ["cap_mo", "cap_tu", "cap_we", "cap_th", "cap_fr"]


def day_capacity(weekday_col, caps: list[str] = WEEKDAY_CAPACITY_COLUMNS) -> Column:
    """Mon-Fri capacity by weekday (Mon = 0); weekend and null weekday use Monday."""
    wd = _c(weekday_col)
    expr = F.col(caps[0])
    for i in range(len(caps) - 1, 0, -1):
        expr = F.when(wd == i, F.col(caps[i])).otherwise(expr)
    return expr.cast("double")


def row_mean(cols: list[str]) -> Column:
    """Mean of the non-null values of ``cols`` (null when all null)."""
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols])
    count = reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in cols])
    return F.when(count > 0, total / count)


def any_null(cols: list[str]) -> Column:
    """true when any of ``cols`` is null."""
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols])
