"""Extracts that arrive in many files whose headers and encodings drift.

One pass over the files as text finds, for each file, its header line and whether all of its bytes are UTF-8. Files of
the same header and encoding form a dialect; each dialect is one CSV scan of the same folder, pruned to its files by
``_metadata.file_path``, and the dialects are united by name after their headers are mapped. What reaches the driver
is one short row for each file, as Spark's own file listing does.

Defined results: an empty file adds nothing and a file with only a header no rows; rows with too few fields end in
nulls, fields beyond the header are ignored; of two columns with one canonical name the first is taken; unknown
headers are ignored; a folder without files gives a typed empty table. UTF-16 and line breaks inside quotes aren't
supported.
"""

from __future__ import annotations

import csv
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .files import _exists, canonical_encoding, conform, empty, fix_cp1252

#: Name under which ``load_batches`` can return the file that a row came from.
SOURCE = "source_file"


class Dialect(NamedTuple):
    """Files that are read alike: their header names in order, their encoding, and their paths."""

    names: tuple[str, ...]
    encoding: str
    files: list[str]


def file_headers(spark: SparkSession, path: str) -> DataFrame:
    """(file, header as bytes, is_utf8) for each file that has a line; one pass, one combining aggregate."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                                         F.monotonically_increasing_id().alias("at"))
    first = F.when(F.col("block") == 0, F.col("at"))  # rows of a file's first block are in order
    return lines.groupBy("file").agg(F.min_by(F.col("value").cast("binary"), first).alias("header"),
                                     F.bool_and(F.is_valid_utf8("value")).alias("is_utf8"))


def dialects(spark: SparkSession, path: str, fallback: str = "windows-1252", sep: str = ",") -> list[Dialect]:
    """The dialects of a folder, in a fixed order; files that aren't UTF-8 are read in the ``fallback`` encoding."""
    groups = file_headers(spark, path).groupBy("header", "is_utf8").agg(F.collect_list("file").alias("files")).collect()
    found: dict[tuple, list[str]] = {}
    for g in groups:
        encoding = "UTF-8" if g.is_utf8 else fallback
        text = bytes(g.header).decode(encoding, "replace").lstrip("﻿")
        names = tuple(c.strip() for c in next(csv.reader([text], delimiter=sep), []))
        found.setdefault((names, encoding), []).extend(g.files)
    return [Dialect(n, e, sorted(f)) for (n, e), f in sorted(found.items())]


def read_dialect(spark: SparkSession, path: str, d: Dialect, headers: dict[str, str], sep: str = ",", prune: bool = True) -> DataFrame:
    """One scan of the dialect's files, all text: its columns under their canonical names, and ``source_file``."""
    raw = StructType([StructField(f"_c{i}", StringType()) for i in range(len(d.names))])
    df = (spark.read.schema(raw).option("header", True).option("enforceSchema", True).option("sep", sep)
          .option("encoding", canonical_encoding(d.encoding)).csv(path))
    if prune:
        df = df.where(F.col("_metadata.file_path").isin(d.files))
    place: dict[str, int] = {}
    for i, n in enumerate(d.names):
        place.setdefault(headers.get(n, n), i)
    cols = [fix_cp1252(F.col(f"_c{i}"), d.encoding).alias(n) for n, i in place.items() if n and n != SOURCE]
    return df.select(*cols, F.col("_metadata.file_path").alias(SOURCE))


def load_batches(spark: SparkSession, path: str, headers: dict[str, str], schema: StructType, fallback: str = "windows-1252",
                 sep: str = ",", prepare=None, keep_source: bool = False) -> DataFrame:
    """All files under ``path`` as one table of ``schema``, each by its own header and encoding; rows are never merged.

    ``prepare`` works on each dialect's text columns before they are typed (dates in another format, say).
    """
    out = StructType([*schema.fields, StructField(SOURCE, StringType())]) if keep_source else schema
    if not _exists(spark, path):
        return empty(spark, out)
    kinds = dialects(spark, path, fallback, sep)
    parts = []
    for d in kinds:
        raw = read_dialect(spark, path, d, headers, sep, prune=len(kinds) > 1)
        parts.append(conform(prepare(raw) if prepare else raw, out))
    return reduce(DataFrame.unionByName, parts) if parts else empty(spark, out)
