"""Batched extracts, standing profiles, checks by kind of table, and sinks that skip or append."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas as SC
from ..operators import enrich as E
from ..operators import ml as ML
from ..operators import profiles as P
from ..operators import quality as Q
from ..operators.rollups import PERCENTILES
from ..sinks import writers as K
from ..sources import extracts as X
from ..sources import files as FI
from ..sources.fixtures import Views, with_views
from . import sqlparts as S
from .q_landed import _as_export, _csv, _landing
from .registry import enriched, r6, register

#: Headers of the template dialect (the ERP's are the first of each column in ``SC.SHORTAGE_HEADERS``).
TEMPLATE = {h: c for h, c in SC.SHORTAGE_HEADERS.items() if h == "Order" or h in (
    "Component Material", "Component Description", "Required Qty", "Shortage Qty", "Requirement Date")}


@register("union_batches", with_views("""
select cast(s.production_number as varchar) as production_number, cast(component_material as varchar) as component_material,
  case component_material % 3 when 0 then 'Größe ' || component_material when 1 then 'Maß €' || component_material end as component_description,
  required_qty, shortage_qty, planned_start_date as requirement_date
from shortage s join history h on s.production_number = h.production_number""", ["shortage", "history"]))
def q_union_batches(spark, sf):
    """One folder with files in both dialects, two encodings, another column order and a missing column."""
    v = Views(spark, sf)
    s = v.shortage.join(v.history.select("production_number", F.col("planned_start_date").alias("requirement_date")), "production_number")
    kind, key = F.col("component_material") % 3, F.col("component_material").cast("string")
    path = _landing(spark, "batches")
    erp = s.where(kind == 0).select("*", F.concat(F.lit("Größe "), key).alias("component_description"))
    _csv(_as_export(erp, SC.SHORTAGE_HEADERS, ("requirement_date",), "M/d/yyyy"), path)
    # Spark doesn't write windows-1252: its byte for the euro sign is written as the control character of ISO-8859-1.
    old = s.where(kind == 1).select("shortage_qty", "requirement_date", "production_number", "component_material", "required_qty",
                                    F.concat(F.lit("Maß \x80"), key).alias("component_description"))
    (_as_export(old, TEMPLATE, ("requirement_date",)).write.mode("append").option("header", True).option("encoding", "ISO-8859-1").csv(path))
    bare = s.where(kind == 2).select("requirement_date", "component_material", "shortage_qty", "required_qty", "production_number")
    _as_export(bare, TEMPLATE, ("requirement_date",)).write.mode("append").option("header", True).csv(path)
    return FI.load_shortage_batches(spark, path).select("production_number", "component_material", "component_description",
                                                        "required_qty", "shortage_qty", "requirement_date")


@register("load_all", with_views("""
select 'history' as source, (select count(*) from history) as n, (select count(material) from history) as filled
union all select 'fg', (select count(*) from fg), (select count(material) from fg)
union all select 'capacity', (select count(*) from capacity), 0
union all select 'order', (select count(*) from history where item = 2), (select count(material) from history where item = 2)
union all select 'aps', 0, 0""", ["history", "fg", "capacity"]))
def q_load_all(spark, sf):
    """A folder with history, master data, capacity and orders, without shortage and planning."""
    v, root = Views(spark, sf), _landing(spark, "folder")
    h = v.history.select("production_number", "material", "order_quantity", "item")
    _csv(_as_export(h, SC.HISTORY_HEADERS), f"{root}/History.csv")
    _csv(_as_export(h.where("item = 2"), SC.HISTORY_HEADERS), f"{root}/Order.csv")
    _csv(_as_export(v.fg.withColumnRenamed("material_description", "fg_material_description"), SC.FG_HEADERS), f"{root}/FG.csv")
    _csv(_as_export(v.capacity, SC.CAPACITY_HEADERS), f"{root}/Capacity.csv")
    got = FI.load_all(spark, root, "windows-1252")
    assert got.pop("shortage") is None
    out = None
    for name, df in got.items():
        key = F.col("material") if "material" in df.columns else F.lit(None)
        one = df.agg(F.count(F.lit(1)).alias("n"), F.count(key).alias("filled")).select(F.lit(name).alias("source"), "n", "filled")
        out = one if out is None else out.unionByName(one)
    return out


_SKETCHED = "select *, quarter(created_date) as period, total_production_time * order_quantity as c from enriched"


@register("standing_profile", S.over_enriched(f"""
select p.period, q.percentile, p.n, p.mean, p.std, p.min, p.max, 1 as within
from (select period, count(c) as n, round(avg(c), 6) as mean, round(stddev_samp(c), 6) as std, round(min(c), 6) as min, round(max(c), 6) as max
      from ({_SKETCHED}) t where c is not null and created_date is not null group by period) p,
  (values {', '.join(f'({p})' for p in PERCENTILES)}) q(percentile)"""))
def q_standing_profile(spark, sf):
    """Sketches of each day appended in two batches (the second written twice), merged by quarter when read; within
    is 1 where the share of smaller values allows for the percentile within the stated rank error."""
    df = enriched(Views(spark, sf)).select("created_date", (F.col("total_production_time") * F.col("order_quantity")).alias("c"),
                                           F.quarter("created_date").alias("period"))
    path = _landing(spark, "sketches")
    for batch, part in (("a", df.where("day(created_date) % 2 = 0")), ("b", df.where("day(created_date) % 2 = 1")), ("b", df.where("day(created_date) % 2 = 1"))):
        P.append_days(P.daily_sketches(part, "c", "created_date", ["period"]), path, batch)
    prof = r6(P.sketch_profile(P.stored_days(spark, path), ["period"]).drop(*(f"p{p}" for p in PERCENTILES), "median"))
    exact = P.sketch_profile(P.stored_days(spark, path), ["period"]).select(
        F.col("period").alias("_p"), F.explode(F.array(*[F.struct(F.lit(p).alias("percentile"), F.col(f"p{p}").alias("q")) for p in PERCENTILES])).alias("r"))
    probes = exact.select("_p", "r.*")  # seven rows a quarter
    share = (df.where("c is not null").join(F.broadcast(probes), F.col("period") == F.col("_p")).groupBy("period", "percentile")
             .agg(F.avg((F.col("c") < F.col("q")).cast("double")).alias("below"), F.avg((F.col("c") <= F.col("q")).cast("double")).alias("upto")))
    eps, at = P.rank_error(), F.col("percentile") / 100
    ok = ((F.col("below") <= at + eps) & (F.col("upto") >= at - eps)).cast("int")
    return share.withColumn("within", ok).join(prof, "period").select("period", "percentile", "n", "mean", "std", "min", "max", "within")


_ROUGH = """select *, case when production_number % 17 = 3 then 'n/a' when production_number % 17 = 5 then '2024-13-45' when production_number % 17 = 7 then ' '
  else cast(created_date as varchar) end as created_text from history"""


_KINDS = """
  select 'history' as t, 'production_number' as c, count(*) - count(production_number) as v, count(*) as n from history
  union all select 'history', 'material', count(*) - count(material), count(*) from history
  union all select 'history', 'planned_start_date', count(*) - count(planned_start_date), count(*) from history
  union all select 'history', 'planned_finish_date', count(*) - count(planned_finish_date), count(*) from history
  union all select 'history', 'actual_finish_date', count(*) - count(actual_finish_date), count(*) from history
  union all select 'material', 'material', count(*) - count(material), count(*) from fg
  union all select 'material', 'production_line', count(*) - count(production_line), count(*) from fg
  union all select 'material', 'total_production_time', count(*) - count(total_production_time), count(*) from fg
  union all select 'capacity', 'production_line', count(*) - count(production_line), count(*) from capacity"""


@register("quality_by_type", with_views("""
select t as table_name, 'not_null' as rule, c as column_name, cast(v as bigint) as violations, cast(n as bigint) as total, 'warn' as severity from kinds
union all select t, 'required_column', c, 0, 1, 'error' from kinds
union all select 'capacity', 'required_column', 'line_capacity', 1, 1, 'error'
union all select t, 'non_empty', null, case when max(n) = 0 then 1 else 0 end, max(n), 'error' from kinds group by t
union all select 'history', 'valid_date', 'created_text', count(*) filter (where trim(created_text) <> '' and try_cast(created_text as date) is null), count(*), 'warn' from rough
union all select 'history', 'label_count', 'is_delayed=' || coalesce(cast(cast(actual_finish_date > planned_finish_date as int) as varchar), 'null'),
  count(*), (select count(*) from history), 'info' from history group by 3""", ["history", "fg", "capacity"], [("rough", _ROUGH), ("kinds", _KINDS)]))
def q_quality_by_type(spark, sf):
    """Q3, Q4, Q5: required columns by kind of table, dates that are none, and how the label is spread."""
    v = Views(spark, sf)
    k = F.col("production_number") % 17
    rough = v.history.withColumn("created_text", F.when(k == 3, "n/a").when(k == 5, "2024-13-45").when(k == 7, " ").otherwise(F.col("created_date").cast("string")))
    labelled = v.history.withColumn("is_delayed", (F.col("actual_finish_date") > F.col("planned_finish_date")).cast("int"))
    return Q.quality_report([Q.type_rules(v.history, "history"), Q.type_rules(v.fg, "material"), Q.type_rules(v.capacity, "capacity"),
                             Q.date_rules(rough, "history", {"created_text": "yyyy-MM-dd"}), Q.label_rules(labelled, "history", "is_delayed")])


@register("write_extracts", with_views("""
select 'history' as extract, count(*) as n from history union all select 'fg', count(*) from fg
union all select 'shortage', (select count(*) from capacity)""", ["history", "fg", "capacity"]))
def q_write_extracts(spark, sf):
    """K2: four extracts, of which one is empty (what stands under its name stays) and one absent."""
    v, root = Views(spark, sf), _landing(spark, "extracts")
    K.write_table(v.capacity, f"{root}/shortage", "csv")
    done = K.write_extracts({"history": v.history.select("production_number", "material"), "fg": v.fg, "shortage": v.shortage.where("production_number < 0"),
                             "capacity": None}, root)
    assert done == ["history", "fg"]
    names = [*done, "shortage"]
    parts = [spark.read.option("header", True).csv(f"{root}/{n}").agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("extract"), "n") for n in names]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("append_records", with_views("""
select 'features' as kind, cast(order_id as varchar) as order_id, 'v' || (order_id % 2) as version, cast(null as double) as proba, planned_qty as payload_qty
from production_orders
union all select 'predictions', case when priority = 3 then 'P' || order_id else cast(order_id as varchar) end, 'm1', priority / 8.0, planned_qty
from production_orders""", ["production_orders"]))
def q_append_records(spark, sf):
    """K5: features and predictions, each appended in two batches of which one is written twice, and parsed back."""
    o, root = Views(spark, sf).production_orders.select("order_id", "planned_qty", "priority"), _landing(spark, "records")
    feats = o.withColumn("feature_version", F.concat(F.lit("v"), (F.col("order_id") % 2).cast("string")))
    preds = o.select(F.when(F.col("priority") == 3, "").otherwise(F.col("order_id").cast("string")).alias("order_id"), F.concat(F.lit("P"), "order_id").alias("Order"),
                     "planned_qty", (F.col("priority") / 8).alias("prediction_proba"), F.lit("m1").alias("model_version"))
    half = F.crc32(F.col("planned_qty").cast("string").cast("binary")) % 2
    for kind, df in (("features", feats), ("predictions", preds)):
        for batch in (0, 1, 1):
            K.append_records(df.where(half == batch), root, kind, f"b{batch}")
    qty = F.get_json_object("payload", "$.planned_qty").cast("double").alias("payload_qty")
    f = spark.read.parquet(f"{root}/features").select(F.lit("features").alias("kind"), "order_id", F.col("feature_version").alias("version"),
                                                      F.lit(None).cast("double").alias("proba"), qty)
    p = spark.read.parquet(f"{root}/predictions").select(F.lit("predictions").alias("kind"), "order_id", F.col("model_version").alias("version"),
                                                         F.col("prediction_proba").alias("proba"), qty)
    return f.unionByName(p)


@register("file_inventory", with_views("""
select 'txt' as type, sum(length(cast(order_id as varchar)) + 1) as size from production_orders""", ["production_orders"]))
def q_file_inventory(spark, sf):
    """K9: bytes and type of written result files, by name and without reading them."""
    path = _landing(spark, "inventory")
    Views(spark, sf).production_orders.select(F.col("order_id").cast("string")).write.text(path)
    inv = K.file_inventory(spark, path, "part-*").where(F.col("name").startswith("part-") & F.col("modified").isNotNull())
    return inv.groupBy("type").agg(F.sum("size").alias("size"))


@register("complete_rows", with_views("""
select production_number, order_quantity from history where production_supervisor is not null and actual_finish_date is not null
  and order_quantity is not null""", ["history"]))
def q_complete_rows(spark, sf):
    """rows without a null in features or label, behind the count gate."""
    return E.complete_rows(Views(spark, sf).history, ["order_quantity", "production_supervisor", "actual_finish_date"]).select("production_number", "order_quantity")


_TWO_LINES = "select material, production_line, total_production_time from fg union all select material, 'K' || production_line, total_production_time + 1 from fg where earliest_start_days = 2"


def _two_lines(v: Views):
    more = v.fg.where("earliest_start_days = 2").withColumns({"production_line": F.concat(F.lit("K"), "production_line"),
                                                              "total_production_time": F.col("total_production_time") + 1})
    return v.fg.unionByName(more)


@register("fg_fan_out", with_views(f"""
select h.production_number, f.production_line, f.total_production_time from history h left join ({_TWO_LINES}) f on h.material = f.material""", ["history", "fg"]))
def q_fg_fan_out(spark, sf):
    """A material on two lines makes two rows of an order."""
    v = Views(spark, sf)
    return E.join_fg(v.history, _two_lines(v)).select("production_number", "production_line", "total_production_time")


@register("fg_one_line", with_views(f"""
select h.production_number, f.production_line, f.total_production_time from history h
left join (select * from ({_TWO_LINES}) t qualify row_number() over (partition by material order by production_line) = 1) f on h.material = f.material""", ["history", "fg"]))
def q_fg_one_line(spark, sf):
    """J1 with dedupe: the smaller line stays."""
    v = Views(spark, sf)
    return E.join_fg(v.history, _two_lines(v), dedupe=True).select("production_number", "production_line", "total_production_time")


@register("master_history_rows", with_views("""
select cast(production_number as varchar) as production_number, material, case when item = 1 then null else order_quantity end as order_quantity,
  cast(mrp_controller as varchar) as mrp_controller from history""", ["history"]))
def q_master_history_rows(spark, sf):
    """C11: history records: keys without leading zeros, padded text, bad numbers null."""
    h = Views(spark, sf).history
    rec = h.select(F.lpad(F.col("production_number").cast("string"), 14, "0").alias("AUFNR"), F.concat(F.lit("0"), F.col("material")).alias("MATNR"),
                   F.when(F.col("item") == 1, "-").otherwise(F.concat(F.lit(" "), F.col("order_quantity").cast("string"))).alias("GAMNG"),
                   F.concat(F.lit("  "), F.col("mrp_controller"), F.lit(" ")).alias("DISPO"))
    return X.transform_master_rows(rec, {"AUFNR": "production_number", "MATNR": "material", "GAMNG": "order_quantity", "DISPO": "mrp_controller"}, ["order_quantity"])


@register("master_capacity_rows", with_views("select production_line, case when cap_mo > 12 then null else cap_mo end as cap_mo, cap_fr from capacity", ["capacity"]))
def q_master_capacity_rows(spark, sf):
    """C11: capacity records."""
    c = Views(spark, sf).capacity
    rec = c.select(F.concat(F.col("production_line"), F.lit(" ")).alias("ARBPL"), F.when(F.col("cap_mo") > 12, "n/a").otherwise(F.col("cap_mo").cast("string")).alias("MO"),
                   F.col("cap_fr").cast("string").alias("FR"))
    return X.transform_master_rows(rec, {"ARBPL": "production_line", "MO": "cap_mo", "FR": "cap_fr"}, ["cap_mo", "cap_fr"])


_VARIED = ["order_quantity", "planned_start_month", "has_supervisor", "constraint_factor", "total_production_time"]


@register("kept_features", S.over_enriched("\nunion all ".join(
    f"select '{c}' as feature from enriched having var_pop({c}) > 2" for c in _VARIED)))
def q_kept_features(spark, sf):
    """M5: columns whose population variance is above the threshold (here 2, so that some go)."""
    e = enriched(Views(spark, sf))
    return spark.createDataFrame([(c,) for c in ML.variance_filter(e, _VARIED, 2)], "feature string")


@register("aligned_features", S.over_enriched("""
select production_number, coalesce(cast(line_capacity as double), 0) as line_capacity, coalesce(cast(has_supervisor as double), 0) as has_supervisor,
  cast(0 as double) as never_seen from enriched"""))
def q_aligned_features(spark, sf):
    """M8: a model's columns in its order, absent ones and nulls as 0."""
    e = enriched(Views(spark, sf)).select("production_number", "line_capacity", "has_supervisor")
    return ML.align_features(e, ["line_capacity", "has_supervisor", "never_seen"])
