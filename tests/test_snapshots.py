"""The incremental sync's stored table: stops, replays, races, late rows, old versions."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from leadlane.streaming import ingest as I
from leadlane.streaming import snapshots as SN

SCHEMA = "production_number long, ingest_seq long, v string, created date"


def rows_of(df):
    return sorted(map(tuple, df.select("production_number", "ingest_seq", "v").collect()))


def batch(spark, ids, seq, v):
    return spark.createDataFrame([(i, seq, v, dt.date(2024, 1, 1)) for i in ids], SCHEMA)


def test_a_stop_before_publishing_loses_nothing(spark, tmp_path, monkeypatch):
    """The writer dies after its files are written: readers see the old rows, the replay gives the new ones."""
    table = str(tmp_path / "t")
    write = I.upsert_batch_writer(table, buckets=4, stream="s")
    write(batch(spark, range(40), 1, "old"), 0)
    before = rows_of(I.read_table(spark, table))
    real = SN.publish

    def dies(*_):
        raise OSError("lost")

    monkeypatch.setattr(SN, "publish", dies)
    for _ in range(2):
        with pytest.raises(OSError):
            write(batch(spark, range(20, 60), 2, "new"), 1)
        assert rows_of(I.read_table(spark, table)) == before
    monkeypatch.setattr(SN, "publish", real)
    write(batch(spark, range(20, 60), 2, "new"), 1)
    want = [(i, 1, "old") for i in range(20)] + [(i, 2, "new") for i in range(20, 60)]
    assert rows_of(I.read_table(spark, table)) == want
    assert SN.vacuum(spark, table, keep=1) == 3  # the old version's files and those of two dead writers
    assert rows_of(I.read_table(spark, table)) == want


def test_a_published_batch_is_not_applied_again(spark, tmp_path):
    table = str(tmp_path / "t")
    write = I.upsert_batch_writer(table, buckets=4, stream="s")
    write(batch(spark, range(5), 1, "a"), 0)
    write(batch(spark, range(5), 9, "other rows under a number that is done"), 0)
    assert rows_of(I.read_table(spark, table)) == [(i, 1, "a") for i in range(5)] and SN.versions(spark, table) == [1]
    I.upsert_batch_writer(table, buckets=4, stream="another")(batch(spark, [2], 3, "b"), 0)
    assert rows_of(I.read_table(spark, table))[2] == (2, 3, "b")
    assert rows_of(I.read_table(spark, table, version=1)) == [(i, 1, "a") for i in range(5)]


def test_of_two_writers_one_wins(spark, tmp_path):
    table = str(tmp_path / "t")
    I.upsert_batch_writer(table, buckets=2)(batch(spark, range(3), 1, "a"), 0)
    now = SN.resolve(spark, table)
    SN.publish(spark, table, now.next(high_water="x"))
    with pytest.raises(SN.Conflict):
        SN.publish(spark, table, now.next(high_water="y"))
    assert SN.resolve(spark, table).high_water == "x"


def test_only_touched_buckets_are_rewritten_and_columns_grow(spark, tmp_path):
    table = str(tmp_path / "t")
    write = I.upsert_batch_writer(table, buckets=16)
    write(batch(spark, range(200), 1, "a"), 0)
    first = SN.resolve(spark, table)
    write(batch(spark, [7], 2, "b").withColumn("more", F.lit(5)), 1)
    second = SN.resolve(spark, table)
    assert sum(first.buckets[b] != second.buckets[b] for b in first.buckets) == 1
    got = I.read_table(spark, table)
    assert got.where("more = 5").count() == 1 and got.count() == 200
    write(spark.createDataFrame([], SCHEMA), 2)  # an empty batch only advances the stream
    assert SN.resolve(spark, table).buckets == second.buckets and I.read_table(spark, table).count() == 200


@pytest.mark.parametrize("kind", ["date", "timestamp"])
def test_on_time_late_and_too_late_rows(spark, tmp_path, kind):
    """A stream of files against a batch walk over the same rows, one file after the other."""
    rng, day0 = random.Random(3), dt.datetime(2024, 3, 1)
    files = []
    for f in range(5):
        rows = [(rng.randrange(60), 10 * f + 1, f"f{f}r{i}", day0 + dt.timedelta(days=6 * f - rng.choice([0, 1, 6, 7, 8, 20]))) for i in range(40)]
        rows = list({r[0]: r for r in rows}.values())
        files.append([(a, b, c, (d.date() if kind == "date" else d) if rng.random() > 0.05 else None) for a, b, c, d in rows])
    table, landing, ck = (str(tmp_path / x) for x in ("t", "landing", "ck"))
    schema = spark.createDataFrame([], f"production_number long, ingest_seq long, v string, created {kind}").schema
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(landing)
        I.run_incremental(spark, landing, schema, table, ck, event="created", late_days=7)
    I.run_incremental(spark, landing, schema, table, ck, event="created", late_days=7)  # nothing new
    stored, late, high = {}, [], None
    for rows in files:
        ok = [r for r in rows if r[3] is None or high is None or r[3] >= high - dt.timedelta(days=7)]
        late += [r[:3] for r in rows if r not in ok]
        stored |= {r[0]: r[:3] for r in ok}
        high = max([r[3] for r in ok if r[3]] + ([high] if high else []))
    assert rows_of(I.read_table(spark, table)) == sorted(stored.values())
    assert rows_of(I.read_late(spark, table, schema, ck)) == sorted(late) and late
