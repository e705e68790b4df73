"""Driver contract, streaming vs batch, sources."""

import json

from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

import __spark_entry__ as entry_mod
from leadlane.sources import envelopes as ENV
from leadlane.sources import files as FI
from leadlane.streaming import ingest as I

from .conftest import SMOKE


def test_entry_runs(spark):
    df = entry_mod.entry(spark)
    assert df.count() > 0 and "material_target_encoded" in df.columns


def test_registry_keys(spark):
    q, o = entry_mod.queries(), entry_mod.oracle_sql()
    assert set(o) <= set(q) and len(q) > 80


def test_oracle_subset_runs_on_smoke(spark):
    import duckdb
    con = duckdb.connect()
    for t in ["part", "lineitem", "orders"]:
        con.execute(f"create view {t} as select * from read_parquet('{SMOKE}/{t}.parquet')")
    for k in ["shortage_rollup", "order_labels", "material_tpt", "target_encoding_material"]:
        spark_rows = entry_mod.queries()[k](spark, SMOKE).count()
        duck_rows = con.sql(entry_mod.oracle_sql()[k]).fetchall()
        assert spark_rows == len(duck_rows), k


def test_stream_equals_batch(spark, tmp_path):
    h = spark.createDataFrame([(i, f"M{i % 3}", float(i), f"2024-0{1 + i % 3}-{10 + i % 19:02d}") for i in range(60)],
                              "production_number long, material string, order_quantity double, d string") \
        .withColumn("created_date", F.to_date("d")).drop("d")
    inc = I.monthly_increments(h)
    inc.write.partitionBy("ingest_seq").parquet(str(tmp_path / "landing"))
    schema = spark.read.parquet(str(tmp_path / "landing")).schema
    I.run_incremental(spark, str(tmp_path / "landing"), schema, str(tmp_path / "table"), str(tmp_path / "ck"))
    got = I.read_table(spark, str(tmp_path / "table")).select("production_number", "ingest_seq")
    expect = I.upsert(None, inc).select("production_number", "ingest_seq")
    assert sorted(got.collect()) == sorted(expect.collect())


def test_envelopes(spark):
    rows = [json.dumps([{"a": 1}, {"a": 2}]), json.dumps({"body": json.dumps([{"a": 3}])}),
            json.dumps({"body": [{"a": 4}]}), json.dumps({"a": 5}), "not json"]
    df = spark.createDataFrame([(r,) for r in rows], "value string")
    got = sorted(r.a for r in ENV.parse_envelopes(df, StructType().add("a", IntegerType())).collect() if r.a is not None)
    assert got == [1, 2, 3, 4, 5]


def test_shortage_dialects(spark, tmp_path):
    p1 = tmp_path / "erp.csv"
    p1.write_text("Order,Material,Reqmnt qty,Shortage qty,ReqmtsDate\n1,C1,10,-3,3/4/2024\n")
    p2 = tmp_path / "tpl.csv"
    p2.write_text("﻿Order , Component Material,Required Qty,Shortage Qty,Requirement Date\n1,C1,x,2,2024-03-04\n")
    a = FI.load_shortage(spark, str(p1)).first()
    b = FI.load_shortage(spark, str(p2)).first()
    assert (a.component_material, a.shortage_qty, str(a.requirement_date)) == ("C1", -3.0, "2024-03-04")
    assert (b.required_qty, b.shortage_qty, str(b.requirement_date)) == (0.0, 2.0, "2024-03-04")
    assert FI.load_shortage(spark, str(tmp_path / "missing.csv")) is None
