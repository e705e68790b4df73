"""Typed file scans.

Every CSV is read as all-string columns (no inference, S6), headers are
trimmed (C2) and renamed where present (C1), then values are parsed with
ANSI-safe ``try_*`` functions (C3/C4): bad values become null instead of
failing the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import schemas as SC
from ..functions.clean import parse_number, parse_timestamp, rename_existing, strip_headers


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


#: Characters that windows-1252 has where ISO-8859-1 has control characters; Spark's readers know only the latter.
_CONTROLS = "".join(chr(b) for b in range(0x80, 0xA0))
_CP1252 = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(0x80, 0xA0))


def canonical_encoding(encoding: str) -> str:
    """The charset to give Spark's reader for ``encoding``."""
    e = encoding.lower().replace("_", "-")
    return "ISO-8859-1" if e in ("cp1252", "windows-1252", "latin1", "latin-1", "iso-8859-1") else encoding


def fix_cp1252(x: Column, encoding: str) -> Column:
    """Text that was read as ISO-8859-1 with the characters of windows-1252, where that is the encoding."""
    return F.translate(x, _CONTROLS, _CP1252) if encoding.lower() in ("cp1252", "windows-1252") else x


def read_strings(spark: SparkSession, path: str, encoding: str = "UTF-8", sep: str = ",") -> DataFrame:
    """Header CSV with every column as string; encoding chosen per source (UTF-8, windows-1252 or ISO-8859-1)."""
    df = (spark.read.option("header", True).option("inferSchema", False).option("encoding", canonical_encoding(encoding))
          .option("sep", sep).option("multiLine", False).csv(path))
    if encoding.lower() in ("cp1252", "windows-1252"):
        table = str.maketrans(_CONTROLS, _CP1252)
        df = df.select(*[fix_cp1252(F.col(f"`{c}`"), encoding).alias(c.translate(table)) for c in df.columns])
    return strip_headers(df)


def empty(spark: SparkSession, schema: StructType) -> DataFrame:
    """A typed empty table for an optional source that is absent."""
    return spark.createDataFrame([], schema)


def conform(df: DataFrame, schema: StructType, date_fmt: str | None = None) -> DataFrame:
    """Project to ``schema``: parse typed columns, absent columns become typed nulls."""
    exprs = []
    for f in schema.fields:
        t = f.dataType.simpleString()
        if f.name not in df.columns:
            exprs.append(F.lit(None).cast(t).alias(f.name))
        elif t in ("double", "float", "int", "bigint"):
            exprs.append(parse_number(f.name).cast(t).alias(f.name))
        elif t in ("timestamp", "date"):
            exprs.append(parse_timestamp(f.name, date_fmt).cast(t).alias(f.name))
        else:
            exprs.append(F.trim(F.col(f.name).cast("string")).alias(f.name))
    return df.select(*exprs)


def load_history(spark: SparkSession, path: str, encoding: str = "UTF-8", date_fmt: str | None = None) -> DataFrame:
    """S1 (required): work-order history with canonical names and types."""
    return conform(rename_existing(read_strings(spark, path, encoding), SC.HISTORY_HEADERS), SC.HISTORY, date_fmt)


def load_fg(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """S1 (required): finished-goods master data."""
    return conform(rename_existing(read_strings(spark, path, encoding), SC.FG_HEADERS), SC.FG)


def load_capacity(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """S1 (required): line capacity, weekday or legacy single-column form."""
    raw = rename_existing(read_strings(spark, path, encoding), SC.CAPACITY_HEADERS)
    if "line_capacity" in raw.columns and "cap_mo" not in raw.columns:
        return raw.select(F.trim("production_line").alias("production_line"),
                          parse_number("line_capacity").alias("line_capacity"))
    return conform(raw, SC.CAPACITY)


def load_shortage(spark: SparkSession, path: str | None, encoding: str = "UTF-8") -> DataFrame | None:
    """Shortage rows in either header dialect (None when there is no file).
    Quantities: bad -> 0; dates ISO or the ERP's M/d/yyyy."""
    if not path or not _exists(spark, path):
        return None
    return shortage_numbers(conform(shortage_dates(rename_existing(read_strings(spark, path, encoding), SC.SHORTAGE_HEADERS)), SC.SHORTAGE))


def shortage_dates(raw: DataFrame) -> DataFrame:
    """Requirement dates as ISO text, from ISO or the ERP's M/d/yyyy."""
    if "requirement_date" not in raw.columns:
        return raw
    txt = F.trim(F.col("requirement_date").cast("string"))
    return raw.withColumn("requirement_date", F.date_format(
        F.coalesce(F.try_to_timestamp(txt, F.lit("yyyy-MM-dd")), F.try_to_timestamp(txt, F.lit("M/d/yyyy"))), "yyyy-MM-dd"))


def shortage_numbers(df: DataFrame) -> DataFrame:
    """Missing or bad quantities count as 0."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("required_qty", "shortage_qty")})


def load_shortage_batches(spark: SparkSession, path: str, fallback: str = "windows-1252", keep_source: bool = False) -> DataFrame:
    """Shortage rows of all files in a folder, each in its own header dialect and encoding."""
    from .batches import load_batches
    return shortage_numbers(load_batches(spark, path, SC.SHORTAGE_HEADERS, SC.SHORTAGE, fallback, prepare=shortage_dates, keep_source=keep_source))


def load_production_orders(spark: SparkSession, path: str) -> DataFrame:
    """v0 order scan (UTF-8 with byte-order mark), three dates coerced."""
    return conform(read_strings(spark, path, "UTF-8"), SC.PRODUCTION_ORDERS)


def load_optional(spark: SparkSession, path: str | None, schema: StructType, renames: dict | None = None,
                  encoding: str = "UTF-8") -> DataFrame:
    """Optional source; a typed empty table when the file is absent."""
    if not path or not _exists(spark, path):
        return empty(spark, schema)
    return conform(rename_existing(read_strings(spark, path, encoding), renames or {}), schema)


def load_all(spark: SparkSession, folder: str, encoding: str = "UTF-8") -> dict[str, DataFrame | None]:
    """The sources of a landed folder. FG, capacity and history must be there; shortage is None where absent, the
    optional order and planning files (not used further on) are typed empty tables then."""
    f = folder.rstrip("/")
    return {"order": load_optional(spark, f"{f}/Order.csv", SC.HISTORY, SC.HISTORY_HEADERS, encoding),
            "aps": load_optional(spark, f"{f}/APS.csv", SC.HISTORY, SC.HISTORY_HEADERS, encoding),
            "history": load_history(spark, f"{f}/History.csv", encoding),
            "fg": load_fg(spark, f"{f}/FG.csv", encoding),
            "capacity": load_capacity(spark, f"{f}/Capacity.csv", encoding),
            "shortage": load_shortage(spark, f"{f}/Shortage.csv", encoding)}


def status_concat(status_rows: DataFrame, key: str = "production_number", status: str = "status") -> DataFrame:
    """Several status rows per order -> one space-joined, sorted string.
    Bounded per order (a handful of statuses), aggregated after a hash shuffle."""
    return status_rows.filter(F.col(key).isNotNull()).groupBy(key).agg(
        F.array_join(F.array_sort(F.collect_list(F.col(status).cast("string"))), " ").alias("system_status"))
