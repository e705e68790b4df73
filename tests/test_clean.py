from pyspark.sql import functions as F

from leadlane.functions import clean as C


def _one(spark, expr, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("o")).first().o


def test_strip_leading_zeros_variants(spark):
    assert _one(spark, C.strip_leading_zeros_opensql("x"), "  000123 ") == "123"
    assert _one(spark, C.strip_leading_zeros_opensql("x"), None) == "0"
    assert _one(spark, C.strip_leading_zeros_opensql("x"), "") == "0"
    assert _one(spark, C.strip_leading_zeros_odata("x"), "") == ""
    assert _one(spark, C.strip_leading_zeros_odata("x"), "0000") == "0"


def test_dats(spark):
    assert _one(spark, C.dats_to_iso("x"), "20260324") == "2026-03-24"
    assert _one(spark, C.dats_to_iso("x"), "00000000") == ""
    assert _one(spark, C.dats_to_short("x"), "20260304") == "3/4/2026"


def test_odata_date_negative_is_null(spark):
    assert _one(spark, C.odata_date("x"), "/Date(1711238400000)/") == "2024-03-24"
    assert _one(spark, C.odata_date("x"), "/Date(-86400000)/") is None


def test_backfill_order_key(spark):
    df = spark.createDataFrame([("123.0", "9", "1"), ("nan", "9", "2"), (None, "9", None), (" ", None, None)],
                               "o string, s string, i string")
    got = [r.k for r in df.select(C.backfill_order_key("o", "s", "i").alias("k")).collect()]
    assert got == ["123", "9_2", "9", None]


def test_day_capacity_weekend_and_null_use_monday(spark):
    df = spark.createDataFrame([(w,) for w in [0, 1, 4, 5, 6, None]], "wd int") \
        .withColumns({"cap_mo": F.lit(1.0), "cap_tu": F.lit(2.0), "cap_we": F.lit(3.0), "cap_th": F.lit(4.0),
                      "cap_fr": F.lit(5.0)})
    assert [r.c for r in df.select(C.day_capacity("wd").alias("c")).collect()] == [1.0, 2.0, 5.0, 1.0, 1.0, 1.0]


def test_dotted_dates_and_paren_split(spark):
    assert _one(spark, C.dotted_date("x"), "24.03.2026") == "2026-03-24"
    assert _one(spark, C.dotted_date("x"), "2026.03.24") == "2026-03-24"
    assert _one(spark, C.paren_inner("x"), "L1(SUP3)") == "SUP3"
    assert _one(spark, C.line_code("x"), "VSC_20260105_01") == "VSC"


def test_parse_number_is_ansi_safe(spark):
    assert _one(spark, C.parse_number("x"), "abc") is None
    assert _one(spark, C.parse_number("x", 0.0), "abc") == 0.0
    assert _one(spark, C.parse_number("x"), " 12.5 ") == 12.5
