"""ERP response envelopes landed as text.

Responses arrive as JSON text in one of several shapes; they are parsed with
``from_json`` against the expected row schema and exploded, all JVM-side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType


def parse_envelopes(df: DataFrame, row_schema: StructType, text_col: str = "value") -> DataFrame:
    """Bare array, ``{"body": "[...]"}`` (array as a string), ``{"body": [...]}``
    or a single object -> one row per record. Unparsable text yields no rows."""
    arr = ArrayType(row_schema)
    v = F.col(text_col)
    body = F.get_json_object(v, "$.body")
    trimmed = F.ltrim(v)
    records = (F.when(trimmed.startswith("["), F.from_json(v, arr))
               .when(body.isNotNull(), F.from_json(body, arr))
               .otherwise(F.array(F.from_json(v, row_schema))))
    return df.select(F.explode(records).alias("r")).filter(F.col("r").isNotNull()).select("r.*")


def odata_results(df: DataFrame, row_schema: StructType, text_col: str = "value") -> DataFrame:
    """OData ``{"d": {"results": [...]}}`` envelope -> rows."""
    env = F.from_json(F.col(text_col), StructType().add("d", StructType().add("results", ArrayType(row_schema))))
    return df.select(F.explode(env["d"]["results"]).alias("r")).select("r.*")
