"""Batched extracts of drifting form, sketches stored by day, checks by kind of table, appended records."""

import math
import random

import pytest
from pyspark.sql import functions as F

from leadlane import schemas as SC
from leadlane.operators import profiles as P
from leadlane.operators import quality as Q
from leadlane.operators.rollups import percentile_profile
from leadlane.sinks import writers as K
from leadlane.sources import batches as B
from leadlane.sources import files as FI


def _folder(tmp_path, files):
    d = tmp_path / "in"
    d.mkdir()
    for name, data in files.items():
        (d / name).write_bytes(data)
    return str(d)


def test_files_of_other_headers_and_encodings_make_one_table(spark, tmp_path):
    d = _folder(tmp_path, {
        "a b [1].csv": " Order , Material,Shortage qty,ReqmtsDate,Description\n1,m1,5,1/2/2024,Maß €\n".encode("cp1252"),
        "b.csv": '﻿Shortage Qty,Order,Component Material,Requirement Date,Component Description,Note\n7,2,m2,2024-01-03,"ö,€",x\nbad,3\n'.encode(),
        "c.csv": b"", "d.csv": b"Order\n", "e.csv": b"Order,Material\r\n4,m4\r\n",
        "f.csv": b"Order,Material\n4,m4\n"})
    got = FI.load_shortage_batches(spark, d, keep_source=True)
    rows = sorted((r.production_number, r.component_material, r.component_description, r.shortage_qty, str(r.requirement_date)) for r in got.collect())
    assert rows == [("1", "m1", "Maß €", 5.0, "2024-01-02"), ("2", "m2", "ö,€", 7.0, "2024-01-03"), ("3", None, None, 0.0, "None"),
                    ("4", "m4", None, 0.0, "None"), ("4", "m4", None, 0.0, "None")]
    assert len(B.dialects(spark, d)) == 4
    assert got.select("source_file").distinct().count() == 4
    assert [f.name for f in got.schema] == [f.name for f in SC.SHORTAGE] + ["source_file"]


def test_a_byte_that_is_not_utf8_far_behind_the_header_decides(spark, tmp_path):
    d = _folder(tmp_path, {"a.csv": b"Order,Description\n" + b"1,x\n" * 5000 + "2,Größe\n".encode("cp1252"), "b.csv": "Order,Description\n3,Größe\n".encode()})
    got = FI.load_shortage_batches(spark, d)
    assert got.count() == 5002
    assert got.where("component_description = 'Größe'").count() == 2


def test_a_split_file_loses_its_header_once(spark, tmp_path):
    d = _folder(tmp_path, {"a.csv": b"Order,Material\n" + b"".join(b"%d,m%d\n" % (i, i) for i in range(20000)), "b.csv": b"Material,Order\nm,x\n"})
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = FI.load_shortage_batches(spark, d)
        assert got.agg(F.count_distinct("production_number"), F.count("*")).first() == (20001, 20001)
        assert got.where("component_material is null").count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_empty_and_missing_folders(spark, tmp_path):
    for p in (_folder(tmp_path, {"a.csv": b""}), str(tmp_path / "none")):
        got = FI.load_shortage_batches(spark, p)
        assert got.count() == 0 and got.columns == [f.name for f in SC.SHORTAGE]


def test_one_file_in_windows_1252(spark, tmp_path):
    p = tmp_path / "h.csv"
    p.write_bytes("Order,Material description,“x”\n1,„Größe“ €,y\n".encode("cp1252"))
    r = FI.read_strings(spark, str(p), "cp1252")
    assert r.columns[2] == "“x”" and r.first()[1] == "„Größe“ €"
    assert FI.read_strings(spark, str(p), "latin1").first()[1] == "\x84Größe\x93 \x80"


@pytest.mark.parametrize("shift", [0.0, 1e9])
def test_sketches_of_days_merge_to_the_profile(spark, tmp_path, shift):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), f"2024-01-{rng.randint(1, 9):02d}", shift + rng.choice([rng.gauss(50, 9), 7.0])) for _ in range(30000)]
    rows += [("a", "2024-01-01", None), ("a", "2024-01-01", float("nan")), ("c", "2024-01-01", None), (None, "2024-01-02", 5.0)]
    df = spark.createDataFrame(rows, "k string, day string, x double")
    path = str(tmp_path / "s")
    for b, part in (("1", df.where("day <= '2024-01-04'")), ("2", df.where("day > '2024-01-04'")), ("2", df.where("day > '2024-01-04'"))):
        P.append_days(P.daily_sketches(part, "x", "day", ["k"]), path, b)
    got = {r.k: r for r in P.sketch_profile(P.stored_days(spark, path), ["k"]).collect()}
    assert set(got) == {"a", "b", None}
    assert got[None].n == 1 and got[None].std is None and got[None].p99 == 5.0
    one_pass = P.sketch_profile(P.daily_sketches(df, "x", "day", ["k"]).where("k = 'a'")).first()
    xs = sorted(x for k, _, x in rows if k == "a" and x is not None and not math.isnan(x))
    exact = percentile_profile(spark.createDataFrame([(x,) for x in xs], "x double"), "x").first()
    for r in (got["a"], one_pass):
        assert (r.n, r.min, r.max) == (len(xs), xs[0], xs[-1])
        assert r["mean"] == pytest.approx(exact["mean"], rel=1e-12) and r["std"] == pytest.approx(exact["std"], rel=1e-6)
        for p in (10, 25, 50, 75, 90, 95, 99):
            q = r[f"p{p}"]
            assert sum(x < q for x in xs) / len(xs) <= p / 100 + P.rank_error()
            assert sum(x <= q for x in xs) / len(xs) >= p / 100 - P.rank_error()
    days = P.sketch_profile(P.stored_days(spark, path, "2024-01-02", "2024-01-03")).first()
    assert days.n == sum("2024-01-02" <= d <= "2024-01-03" and x is not None for _, d, x in rows)
    assert P.sketch_profile(P.stored_days(spark, path).where("false")).count() == 0


def test_checks_by_kind_dates_and_labels(spark):
    df = spark.createDataFrame([("1", None, "2024-01-01", 1), ("2", "L", " ", None), (None, "L", "1.2.2024", 1)],
                               "material string, production_line string, d string, y int")
    got = {(r.rule, r.column_name): (r.violations, r.total, r.severity) for r in Q.type_rules(df, "material").collect()}
    assert got[("required_column", "total_production_time")] == (1, 1, "error")
    assert got[("not_null", "production_line")] == (1, 3, "warn")
    assert ("not_null", "total_production_time") not in got
    assert Q.date_rules(df, "t", {"d": "yyyy-MM-dd"}).first().violations == 1
    assert Q.date_rules(df.limit(0), "t", {"d": None}).first()[3:5] == (0, 0)
    assert {(r.column_name, r.violations, r.total) for r in Q.label_rules(df, "t", "y").collect()} == {("y=1", 2, 3), ("y=null", 1, 3)}
    assert Q.label_rules(df.limit(0), "t", "y").count() == 0
    assert Q.type_rules(df.limit(0), "other").first().violations == 1


def test_empty_extracts_leave_what_stands(spark, tmp_path):
    one, none = spark.range(3), spark.range(0)
    assert K.write_extracts({"a": one, "b": one}, str(tmp_path)) == ["a", "b"]
    assert K.write_extracts({"a": none, "b": spark.range(5), "c": None}, str(tmp_path)) == ["b"]
    assert [spark.read.option("header", True).csv(str(tmp_path / n)).count() for n in "ab"] == [3, 5]


def test_records_take_the_first_id_a_row_has_and_replays_add_nothing(spark, tmp_path):
    df = spark.createDataFrame([("", "A1", 0.5), ("7", "A2", None), (None, None, 0.1)], "order_id string, Order string, prediction_proba double")
    for b in ("1", "1", "2"):
        K.append_records(df, str(tmp_path), "predictions", b)
    got = spark.read.parquet(str(tmp_path / "predictions"))
    assert got.count() == 6 and got.where("model_version is null").count() == 6
    assert {r.order_id: r.prediction_proba for r in got.collect()} == {"A1": 0.5, "7": None, None: 0.1}
    assert K.record_rows(spark.createDataFrame([(1,)], "order int"), "features").first().order_id is None


def test_material_export_reads_back(spark):
    from leadlane.sinks import writers as K
    rows = [("M1", 2.5, 3, None, 1.0, 4.0, "a \"quoted\" name", None), ("M2", None, 0, 0.0, None, None, None, 1.25)]
    names = ["predicted_tpt", "order_count", "tpt_std", "tpt_min", "tpt_max", "material_description", "actual_tpt"]
    mat = spark.createDataFrame(rows, "material string, predicted_tpt double, order_count long, tpt_std double, tpt_min double, tpt_max double, "
                                      "material_description string, actual_tpt double")
    back = K.read_material_export(K.material_export(mat), {"material_description": "string", "actual_tpt": "double"})
    assert sorted(map(tuple, back.select("material", *names).collect())) == rows
    assert K.read_material_export(K.material_export(mat.limit(0)), {"actual_tpt": "double"}).count() == 0


def test_class_weights_balance(spark):
    from pyspark.sql import functions as F

    from leadlane.operators import ml as ML
    df = spark.range(40).select("id", (F.col("id") < 8).cast("int").alias("y"))
    got = {r.y: r.w for r in ML.class_weights(df, "y", "w").groupBy("y").agg(F.sum("w").alias("w")).collect()}
    assert got == {1: 32.0, 0: 32.0}
    assert ML.class_weights(df.where("y = 0"), "y", "w").agg(F.sum("w")).first()[0] == 32.0
