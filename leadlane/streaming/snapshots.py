"""Versioned snapshots of a bucketed table on shared storage.

A table is a folder with ``data/<id>/_bucket=<k>`` folders that are written once and never changed, and one small JSON
manifest for each version, which names the folder of every bucket. A new version is published by renaming a finished
manifest to its number, which fails if another writer was first: until then readers see the version before, whole, and
a writer that dies leaves files that no manifest names. ``vacuum`` deletes those and old versions.

A manifest has one entry for each bucket and for each stream that writes to the table, whatever the table's size.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKET = "_bucket"


class Conflict(RuntimeError):
    """Another writer has published this version."""


@dataclass(frozen=True)
class Snapshot:
    """``buckets``: bucket -> data folder. ``batches``: stream -> the last micro-batch that is in the table.
    ``high_water``: the latest event value published, in the event column's own text form."""

    version: int
    schema: str
    buckets: dict[str, str] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)
    high_water: str | None = None

    def next(self, **changes) -> "Snapshot":
        return replace(self, version=self.version + 1, **changes)


def _fs(spark: SparkSession, path: str):
    hp = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hp, hp.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, table: str) -> list[int]:
    """Published versions, ascending."""
    folder, fs = _fs(spark, f"{table}/manifest")
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def resolve(spark: SparkSession, table: str, version: int | None = None) -> Snapshot | None:
    """The latest snapshot, or that of a version; None if nothing was published yet. Errors of the store rise."""
    if version is None:
        known = versions(spark, table)
        if not known:
            return None
        version = known[-1]
    path, fs = _fs(spark, f"{table}/manifest/{version:020d}.json")
    stream = fs.open(path)
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return Snapshot(**json.loads(text))


def publish(spark: SparkSession, table: str, snapshot: Snapshot) -> None:
    """Make ``snapshot`` the table's next version, or raise ``Conflict``."""
    jvm = spark.sparkContext._jvm
    draft, fs = _fs(spark, f"{table}/manifest/.draft-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    try:
        out.write(bytearray(json.dumps(asdict(snapshot)).encode()))
    finally:
        out.close()
    final = jvm.org.apache.hadoop.fs.Path(f"{table}/manifest/{snapshot.version:020d}.json")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    never = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    never[0] = getattr(jvm.org.apache.hadoop.fs.Options.Rename, "NONE")  # do not replace
    try:
        context.rename(fs.makeQualified(draft), fs.makeQualified(final), never)
    except Exception as e:
        if fs.exists(final):
            fs.delete(draft, False)
            raise Conflict(f"version {snapshot.version} of {table} is there already") from e
        raise


def write_buckets(df: DataFrame, table: str) -> str:
    """Write ``df`` (with its bucket column) beside what is there; returns the new data folder's name."""
    name = uuid.uuid4().hex
    # One file a bucket where a bucket is small; large ones are split.
    df.hint("rebalance", F.col(BUCKET)).write.partitionBy(BUCKET).parquet(f"{table}/data/{name}")
    return name


def read(spark: SparkSession, table: str, snapshot: Snapshot | None, buckets: list[int] | None = None) -> DataFrame | None:
    """The rows of a snapshot, or of some of its buckets; None if it has none of them. Columns that older files lack are null."""
    if snapshot is None:
        return None
    wanted = snapshot.buckets if buckets is None else {str(b): snapshot.buckets[str(b)] for b in buckets if str(b) in snapshot.buckets}
    if not wanted:
        return None
    schema = StructType.fromJson(json.loads(snapshot.schema))
    return spark.read.schema(schema).parquet(*[f"{table}/data/{folder}/{BUCKET}={b}" for b, folder in sorted(wanted.items())])


def vacuum(spark: SparkSession, table: str, keep: int = 2) -> int:
    """Delete all but the last ``keep`` versions and every data folder that none of those names. Returns the number
    of deleted folders. For the table's one owner, while no writer is at work and no reader at an older version."""
    known = versions(spark, table)
    live = {folder for v in known[-keep:] for folder in resolve(spark, table, v).buckets.values()}
    for v in known[:-keep]:
        path, fs = _fs(spark, f"{table}/manifest/{v:020d}.json")
        fs.delete(path, False)
    folder, fs = _fs(spark, f"{table}/data")
    gone = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName() not in live] if fs.exists(folder) else []
    for path in gone:
        fs.delete(path, True)
    return len(gone)
