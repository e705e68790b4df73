"""Result sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Localised headers of the prediction export.
PREDICTION_HEADERS = {
    "sales_doc": "销售订单", "item": "行项目", "production_number": "生产订单", "material": "物料号",
    "material_description": "物料描述", "order_quantity": "订单数量", "planned_start_date": "计划开始日期",
    "planned_finish_date": "计划完成日期", "production_line": "生产线", "delay_probability": "延迟概率",
    "delay_probability_pct": "延迟概率(%)", "predicted_delay": "预测结果", "risk_level": "风险等级",
}
PREDICTION_COLUMNS = ["sales_doc", "item", "production_number", "material", "material_description", "order_quantity",
                      "planned_start_date", "planned_finish_date", "production_line", "delay_probability",
                      "predicted_delay", "risk_level"]


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None,
                mode: str = "overwrite") -> None:
    """K1/K2: write a processed table (parquet by default, CSV with header optional)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w = w.option("header", True)
    w.format(fmt).save(path)


def write_extracts(tables: dict[str, DataFrame | None], folder: str, fmt: str = "csv") -> list[str]:
    """K2: writes each extract under its own name and returns the names written. An extract that is absent or has no
    rows is skipped: what an earlier run left under its name stays. One row is looked for before each write."""
    done = []
    for name, df in tables.items():
        if df is not None and not df.isEmpty():
            write_table(df, f"{folder.rstrip('/')}/{name}", fmt)
            done.append(name)
    return done


def write_versioned(df: DataFrame, root: str, run_id: str, fmt: str = "parquet") -> None:
    """K3: append one run under ``run_id=<id>``; older runs stay readable."""
    df.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").format(fmt).save(root)


def read_latest(spark: SparkSession, root: str, fmt: str = "parquet") -> DataFrame:
    """K3 "latest" view: rows of the greatest run id (partition pruning on run_id)."""
    df = spark.read.format(fmt).load(root)
    latest = df.select(F.max("run_id").alias("_latest"))
    return df.join(F.broadcast(latest), F.col("run_id") == F.col("_latest"), "left_semi")


def prediction_export(df: DataFrame) -> DataFrame:
    """K4: localised headers, dates as yyyy-MM-dd, probability in percent (1 dp)."""
    cols = [c for c in PREDICTION_COLUMNS if c in df.columns]
    out = df.select(*cols)
    for c in ("planned_start_date", "planned_finish_date"):
        if c in out.columns:
            out = out.withColumn(c, F.date_format(c, "yyyy-MM-dd"))
    out = out.withColumn("delay_probability_pct", F.round(F.col("delay_probability") * 100, 1))
    return out.select(*[F.col(c).alias(PREDICTION_HEADERS.get(c, c)) for c in out.columns])


def payload_rows(df: DataFrame, id_candidates: list[str] = ("order_id", "Order", "order")) -> DataFrame:
    """K5: id = first *existing* id column, payload = JSON of the whole row."""
    idc = next((c for c in id_candidates if c in df.columns), None)
    ident = F.col(idc).cast("string") if idc else F.lit(None).cast("string")
    return df.select(ident.alias("id"), F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("payload"))


#: Record columns that are stored beside the payload, by kind of record.
RECORD_COLUMNS = {
    "orders": {}, "features": {"feature_version": "string"},
    "predictions": {"prediction_class": "int", "prediction_proba": "double", "model_version": "string",
                    "actual_result": "int", "is_correct": "boolean"},
}
RECORD_ID = ("order_id", "Order", "order")


def record_rows(df: DataFrame, kind: str) -> DataFrame:
    """K5: (order_id, the kind's own columns, payload) per row. The id is the first of ``order_id``, ``Order`` and
    ``order`` that the row has a value for (features and predictions know only the first two); null if none. Absent
    columns are null; the payload is the whole row as JSON, nulls left out."""
    names = {c: c for c in df.columns}
    ids = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in RECORD_ID[:3 if kind == "orders" else 2] if c in names]
    own = [(F.col(c).cast(t) if c in names else F.lit(None).cast(t)).alias(c) for c, t in RECORD_COLUMNS[kind].items()]
    return df.select((F.coalesce(*ids) if ids else F.lit(None).cast("string")).alias("order_id"), *own,
                     F.to_json(F.struct("*")).alias("payload"))


def append_records(df: DataFrame, root: str, kind: str, batch_id: str) -> None:
    """K5: appends one batch of orders, features or predictions to its table; a batch written again replaces itself."""
    (record_rows(df, kind).withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{root.rstrip('/')}/{kind}"))


# What a metadata value is stored as when its type isn't declared.
VALUE_TYPES = {"bool": "boolean", "int": "bigint", "float": "double", "datetime": "timestamp", "date": "date"}


def register_model(spark: SparkSession, path: str, meta: dict, known: list[str],
                   types: dict[str, str] | None = None) -> None:
    """K6: append a model-registry row; unknown keys are folded into ``extra`` JSON.

    ``types`` declares columns whose value may be missing: a None has no type of
    its own and is stored as a null string otherwise.
    """
    import json
    kind = {k: (types or {}).get(k) or VALUE_TYPES.get(type(meta.get(k)).__name__, "string") for k in known}
    row = {k: meta.get(k) if kind[k] != "string" or meta.get(k) is None else str(meta[k]) for k in known}
    extra = json.dumps({k: v for k, v in meta.items() if k not in known}, sort_keys=True, default=str)
    schema = ", ".join([f"`{k}` {kind[k]}" for k in known] + ["extra string"])
    spark.createDataFrame([(*row.values(), extra)], schema).write.mode("append").parquet(path)


def latest_active_model(registry: DataFrame, ts: str = "created_at") -> DataFrame:
    """K6: newest active model (a top-1, not a scan of the driver)."""
    return registry.filter(F.col("is_active")).orderBy(F.desc(ts)).limit(1)


def page(df: DataFrame, key: str, limit: int, offset: int = 0) -> DataFrame:
    """K7: stable paging on a total order."""
    return df.orderBy(key).offset(offset).limit(limit)


def write_json_records(df: DataFrame, path: str) -> None:
    """K8: JSON lines with explicit nulls (NaN already normalised to null)."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def file_inventory(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """K9: name, size, modification time and type of result files (no content read)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).drop("content")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"),
                        F.col("modificationTime").alias("modified"),
                        F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).alias("type"))


def material_export(mat: DataFrame, insight: DataFrame | None = None) -> DataFrame:
    """One row per material with a nested JSON document."""
    df = mat if insight is None else mat.join(insight, "material", "left")
    stats = F.struct(*[F.col(c) for c in ("predicted_tpt", "order_count", "tpt_std", "tpt_min", "tpt_max")
                       if c in df.columns]).alias("prediction")
    extra = [c for c in df.columns if c not in ("material", "predicted_tpt", "order_count", "tpt_std", "tpt_min",
                                                "tpt_max")]
    doc = F.struct(stats, F.struct(*[F.col(c) for c in extra]).alias("details"))
    return df.select("material", F.to_json(doc).alias("document"))


def read_material_export(exported: DataFrame, details: dict[str, str]) -> DataFrame:
    """The columns of a material export, read back from its documents; ``details``: name -> type of those beside the
    prediction's. A field that a document leaves out is null."""
    stats = {"predicted_tpt": "double", "order_count": "bigint", "tpt_std": "double", "tpt_min": "double", "tpt_max": "double"}
    fields = {"prediction": stats, "details": details}
    schema = ", ".join(f"{k} struct<{', '.join(f'{n}: {t}' for n, t in v.items())}>" for k, v in fields.items())
    return exported.select("material", F.from_json("document", schema).alias("d")).select("material", "d.prediction.*", "d.details.*")
