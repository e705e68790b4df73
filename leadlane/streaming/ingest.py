"""Incremental extract ingest.

X1: landed extract files are a Structured Streaming file source; the stream checkpoint says which files were read, and
``trigger(availableNow=True)`` processes whatever has landed and stops. A sync sends the orders of the last days again;
its look-back is a bound on lateness: rows whose event time lies more than the bound behind the latest one published
before their micro-batch are too late. They do not change the table and go to a side output. (Spark's own watermark
would drop them without a trace.) The high-water mark is part of the table's manifest, so it moves exactly when the
rows that moved it are published, and a replayed batch is judged as it was the first time.

X2: each micro-batch is upserted into the stored table (keep the newest version of every order) instead of overwriting
it with the increment. The table is hash-bucketed on the key: a batch reads only the buckets it touches, writes their
new files beside the old ones, and then publishes one small manifest (``snapshots``). A writer that stops anywhere
before that changes nothing; a batch that was published is not applied again.
"""

from __future__ import annotations

import hashlib

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import snapshots as SN


def latest_per_key(df: DataFrame, key: str = "production_number", version: str = "ingest_seq") -> DataFrame:
    """Newest row per key by ``version`` (ties: any one), as an aggregate:
    partial max_by on the map side, so a hot key never ships all its versions."""
    cols = [c for c in df.columns if c != key]
    agg = df.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(F.col(version), *[F.col(c) for c in cols]))
                              .alias("_r"))
    return agg.select(key, "_r.*")


def upsert(stored: DataFrame | None, increment: DataFrame, key: str = "production_number",
           version: str = "ingest_seq") -> DataFrame:
    """X2 batch form: union with what is stored and keep the latest per key."""
    both = increment if stored is None else stored.unionByName(increment, allowMissingColumns=True)
    return latest_per_key(both, key, version)


def bucket_of(key: str, buckets: int):
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


def upsert_batch_writer(table_path: str, key: str = "production_number", version: str = "ingest_seq",
                        buckets: int = 64, stream: str = "batch", event: str | None = None, late_days: int | None = None):
    """``foreachBatch`` function: merge a micro-batch into the snapshots of a table.

    ``stream`` names the sequence of batches (a stream's checkpoint): a batch number that this stream has published is
    skipped. ``event`` and ``late_days``: rows whose event date or timestamp lies more than so many days before the
    table's high-water mark go to the side output; rows without an event value are never late. The driver learns the
    touched buckets and one high-water mark, no rows. Costs O(batch + touched buckets).
    """
    def _write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        now = SN.resolve(spark, table_path)
        if now is not None and now.batches.get(stream, -1) >= batch_id:
            return
        if event is not None:
            batch.persist(StorageLevel.MEMORY_AND_DISK)  # read by the merge, the mark and the side output
        rows, water = batch, now.high_water if now else None
        if event is not None and late_days is not None and water is not None:
            mark = F.lit(water).cast(dict(batch.dtypes)[event]) - F.make_dt_interval(days=F.lit(late_days))
            late = F.coalesce(F.col(event) < mark, F.lit(False))
            rows = batch.where(~late)
            batch.where(late).write.mode("overwrite").parquet(f"{table_path}/late/stream={_name(stream)}/batch={batch_id}")
        inc = rows.withColumn(SN.BUCKET, bucket_of(key, buckets))
        highest = F.max(event) if event is not None else F.lit(None)
        # At most ``buckets`` numbers, and the latest event.
        seen = inc.groupBy(SN.BUCKET).agg(highest.cast("string").alias("high")).collect()
        touched = [r[SN.BUCKET] for r in seen]
        stored = SN.read(spark, table_path, now, touched)
        merged = upsert(None if stored is None else stored.withColumn(SN.BUCKET, bucket_of(key, buckets)), inc, key, version)
        schema = StructType([f for f in merged.schema.fields if f.name != SN.BUCKET])
        base = now or SN.Snapshot(0, schema.json())
        folder = SN.write_buckets(merged, table_path) if touched else ""
        # ISO text of one type sorts as time does.
        water = max([x for x in (water, *(r.high for r in seen)) if x is not None], default=None)
        SN.publish(spark, table_path, base.next(schema=schema.json() if touched else base.schema, buckets=base.buckets | {str(b): folder for b in touched},
                                                batches=base.batches | {stream: batch_id}, high_water=water))
        batch.unpersist()
    return _write


def _name(stream: str) -> str:
    return hashlib.sha256(stream.encode()).hexdigest()[:32]


def read_table(spark: SparkSession, table_path: str, version: int | None = None) -> DataFrame:
    """The table as last published, or as of a version."""
    df = SN.read(spark, table_path, SN.resolve(spark, table_path, version))
    if df is None:
        raise FileNotFoundError(f"nothing was published at {table_path}")
    return df


def read_late(spark: SparkSession, table_path: str, schema: StructType, stream: str) -> DataFrame:
    """The side output of a stream's published batches: rows that came too late."""
    now = SN.resolve(spark, table_path)
    known = now.batches.get(stream, -1) if now else -1
    from ..session import path_exists

    folder = f"{table_path}/late/stream={_name(stream)}"
    if not path_exists(spark, folder):
        return spark.createDataFrame([], schema)
    full = StructType([*schema.fields]).add("batch", "long")
    return spark.read.schema(full).parquet(folder).where(F.col("batch") <= known).drop("batch")


def run_incremental(spark: SparkSession, landing: str, schema: StructType, table_path: str, checkpoint: str,
                    key: str = "production_number", version: str = "ingest_seq",
                    fmt: str = "parquet", options: dict[str, str] | None = None,
                    event: str | None = None, late_days: int | None = None) -> None:
    """X1 + X2: process every landed file not yet seen (availableNow) and upsert.
    Extracts land as parquet or, with ``fmt="csv"`` and its options, as text."""
    stream = spark.readStream.schema(schema).format(fmt).options(**(options or {})).load(landing)
    write = upsert_batch_writer(table_path, key, version, stream=checkpoint, event=event, late_days=late_days)
    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def monthly_increments(history: DataFrame, overlap_days: int = 7) -> DataFrame:
    """Fixture: split orders into monthly extracts, re-emitting the last
    ``overlap_days`` of each month in the next extract with a later
    ``ingest_seq`` (the look-back overlap of the incremental sync)."""
    d = F.col("created_date")
    month_idx = (F.year(d) * 12 + F.month(d)).cast("long")
    base = history.withColumn("ingest_seq", month_idx)
    tail = history.filter(F.dayofmonth(d) > F.dayofmonth(F.last_day(d)) - overlap_days) \
        .withColumn("ingest_seq", month_idx + 1)
    return base.unionByName(tail)
