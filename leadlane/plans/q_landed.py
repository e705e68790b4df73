"""Loaders, extracts and sinks on landed files: the given tables are written out in the dialect that the operator
reads (or by the sink itself), read back through it, and compared with their source. The files lie in the shared
checkpoint folder and go with ``release_lineage_tables``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from .. import schemas as SC
from ..functions import clean as C
from ..operators import evaluate as EV
from ..operators import rollups as R
from ..session import ensure_checkpoint_dir, remember_scratch
from ..sinks import writers as K
from ..sources import envelopes as ENV
from ..sources import extracts as X
from ..sources import files as FI
from ..sources.fixtures import Views, with_views
from . import sqlparts as S
from .q_rollups import NEW_MODEL, _new_model
from .registry import enriched, r6, register


def _landing(spark, name: str) -> str:
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/landed/{uuid.uuid4().hex}/{name}"
    remember_scratch(path)
    return path


def _as_export(df: DataFrame, headers: dict[str, str], dates: tuple = (), fmt: str = "yyyy-MM-dd") -> DataFrame:
    """Canonical columns under their export headers (padded, as exports pad them), dates as text."""
    names = {}
    for h, c in headers.items():
        names.setdefault(c, h)
    cols = [F.date_format(c, fmt).alias(f" {names.get(c, c)} ") if c in dates else F.col(c).alias(f" {names.get(c, c)} ") for c in df.columns]
    return df.select(*cols)


def _csv(df: DataFrame, path: str) -> str:
    df.write.option("header", True).csv(path)
    return path


HISTORY_COLS = ["sales_doc", "item", "production_number", "material", "order_quantity", "planned_start_date", "actual_finish_date", "created_date"]


@register("load_history", with_views("""
select cast(sales_doc as varchar) as sales_doc, cast(item as varchar) as item, cast(production_number as varchar) as production_number, material,
  order_quantity, cast(planned_start_date as timestamp) as planned_start_date, cast(actual_finish_date as timestamp) as actual_finish_date,
  cast(created_date as timestamp) as created_date from history""", ["history"]))
def q_load_history(spark, sf):
    """Padded headers, all columns as text, typed on the way in."""
    src = Views(spark, sf).history.select(*HISTORY_COLS)
    p = _csv(_as_export(src, SC.HISTORY_HEADERS, ("planned_start_date", "actual_finish_date", "created_date")), _landing(spark, "History.csv"))
    return FI.load_history(spark, p).select(*HISTORY_COLS)


@register("load_fg", with_views("""
select production_line, material, material_description as fg_material_description, constraint_factor, earliest_start_days, total_production_time
from fg""", ["fg"]))
def q_load_fg(spark, sf):
    fg = Views(spark, sf).fg.withColumnRenamed("material_description", "fg_material_description")
    p = _csv(_as_export(fg, SC.FG_HEADERS), _landing(spark, "FG.csv"))
    return FI.load_fg(spark, p).select("production_line", "material", "fg_material_description", "constraint_factor", "earliest_start_days", "total_production_time")


@register("load_capacity", with_views("select * from capacity", ["capacity"]))
def q_load_capacity(spark, sf):
    return FI.load_capacity(spark, _csv(_as_export(Views(spark, sf).capacity, SC.CAPACITY_HEADERS), _landing(spark, "Capacity.csv")))


@register("load_capacity_legacy", with_views("select production_line, cap_mo as line_capacity from capacity", ["capacity"]))
def q_load_capacity_legacy(spark, sf):
    one = Views(spark, sf).capacity.select("production_line", F.col("cap_mo").alias("line_capacity"))
    return FI.load_capacity(spark, _csv(_as_export(one, SC.CAPACITY_HEADERS), _landing(spark, "Capacity.csv")))


@register("load_shortage", with_views("""
select cast(s.production_number as varchar) as production_number, cast(component_material as varchar) as component_material, required_qty, shortage_qty,
  planned_start_date as requirement_date from shortage s join history h on s.production_number = h.production_number""", ["shortage", "history"]))
def q_load_shortage(spark, sf):
    """The ERP dialect with M/d/yyyy dates."""
    v = Views(spark, sf)
    s = v.shortage.join(v.history.select("production_number", F.col("planned_start_date").alias("requirement_date")), "production_number")
    p = _csv(_as_export(s, SC.SHORTAGE_HEADERS, ("requirement_date",), "M/d/yyyy"), _landing(spark, "Shortage.csv"))
    return FI.load_shortage(spark, p).select("production_number", "component_material", "required_qty", "shortage_qty", "requirement_date")


@register("load_production_orders", with_views("""
select order_id, material_id, plant, order_type, cast(planned_start as timestamp) as planned_start, cast(planned_finish as timestamp) as planned_finish,
  cast(actual_finish as timestamp) as actual_finish, planned_qty, status, priority from production_orders""", ["production_orders"]))
def q_load_production_orders(spark, sf):
    """S2."""
    p = _csv(Views(spark, sf).production_orders, _landing(spark, "production_orders.csv"))
    return FI.load_production_orders(spark, p)


@register("load_optional", with_views("select production_line, cap_mo, cap_fr from capacity", ["capacity"]))
def q_load_optional(spark, sf):
    """A source that is there, united with one that is absent (typed and empty)."""
    p = _csv(_as_export(Views(spark, sf).capacity, SC.CAPACITY_HEADERS), _landing(spark, "Capacity.csv"))
    both = FI.load_optional(spark, p, SC.CAPACITY, SC.CAPACITY_HEADERS).unionByName(FI.load_optional(spark, p + ".none", SC.CAPACITY))
    return both.select("production_line", "cap_mo", "cap_fr")


RECORD = StructType([StructField("Aufnr", StringType()), StructField("Gamng", StringType()), StructField("Erdat", StringType())])


def _odata(v: Views) -> DataFrame:
    h = v.history
    ms = F.concat(F.lit("/Date("), (F.unix_date("created_date").cast("long") * 86_400_000).cast("string"), F.lit(")/"))
    key = F.when(F.col("production_number") % 50 != 21, F.lpad(F.col("production_number").cast("string"), 12, "0"))
    rec = F.struct(key.alias("Aufnr"), F.when(F.col("item") % 5 != 0, F.col("order_quantity").cast("string")).otherwise("n/a").alias("Gamng"), ms.alias("Erdat"))
    texts = h.groupBy("sales_doc").agg(F.to_json(F.struct(F.struct(F.collect_list(rec).alias("results")).alias("d"))).alias("value"))
    return ENV.odata_results(texts, RECORD)


@register("odata_orders", with_views("""
select cast(production_number as varchar) as production_number, case when item % 5 <> 0 then order_quantity else 0 end as order_quantity, created_date
from history where production_number % 50 <> 21""", ["history"]))
def q_odata_orders(spark, sf):
    """Results envelope, stripped keys, bad quantities as 0, /Date(ms)/ dates, keyless records rejected."""
    return X.transform_odata_orders(_odata(Views(spark, sf)), {"Aufnr": "production_number", "Gamng": "order_quantity", "Erdat": "created_date"},
                                    ["order_quantity"], ["created_date"])


@register("odata_rejected", with_views("select created_date from history where production_number % 50 = 21", ["history"]))
def q_odata_rejected(spark, sf):
    bad = X.rejected_odata_orders(_odata(Views(spark, sf)), "Aufnr")
    return bad.select(F.to_date(C.odata_date("Erdat")).alias("created_date"))


@register("fg_extract", with_views("select material as matnr, production_line as line, total_production_time as tpt from fg", ["fg"]))
def q_fg_extract(spark, sf):
    return X.fg_extract(Views(spark, sf).fg, {"material": "matnr", "production_line": "line", "total_production_time": "tpt"})


@register("capacity_as_of", with_views("""
select production_line from capacity where cap_tu >= 12 and cast(substr(production_line, 2) as bigint) % 3 = 1""", ["capacity"]))
def q_capacity_as_of(spark, sf):
    """Plant and validity, both ends inclusive."""
    n = F.substring("production_line", 2, 18).cast("long")
    c = Views(spark, sf).capacity.select("production_line", F.concat(F.lit("P"), n % 3).alias("plant"), F.date_add(F.lit("2024-01-01").cast("date"), -1).alias("valid_from"),
                                         F.date_add(F.lit("2024-01-01").cast("date"), (F.col("cap_tu") - 12).cast("int")).alias("valid_to"))
    return X.capacity_as_of(c, "P1", "2024-01-01").select("production_line")


@register("shortage_extract", with_views("""
select production_number, component_material from shortage where component_material % 4 = 2
  and production_number in (select production_number from history where created_date >= date '1996-01-01')""", ["shortage", "history"]))
def q_shortage_extract(spark, sf):
    v = Views(spark, sf)
    parts = v.shortage.withColumn("plant", F.concat(F.lit("P"), F.col("component_material") % 4))
    return X.shortage_extract(parts, v.history.filter("created_date >= date '1996-01-01'"), "P2").select("production_number", "component_material")


@register("order_extract", with_views("""
select production_number, actual_start_date from history where actual_finish_date is not null
  and actual_start_date between date '1995-03-01' and date '1995-09-30' order by actual_start_date desc, production_number desc limit 200 offset 100""", ["history"]))
def q_order_extract(spark, sf):
    """One page of a stable order."""
    return X.order_extract(Views(spark, sf).history, "1995-03-01", "1995-09-30", top=200, skip=100).select("production_number", "actual_start_date")


@register("order_history_view", with_views("""
select production_number, order_quantity, sales_doc, material_description, case when item % 2 = 0 then 'CLSD PRT' else 'TECO CLSD' end as system_status
from history h left join fg f on h.material = f.material
where actual_finish_date is not null and item % 3 <> 0 and mrp_controller <> 'CVC'""", ["history", "fg"]))
def q_order_history_view(spark, sf):
    """Header with order data, sales item, text and status; finished, closed, no test orders."""
    v = Views(spark, sf)
    h = v.history
    status = h.select("production_number", F.when(F.col("item") % 3 == 0, "REL").when(F.col("item") % 2 == 0, "CLSD PRT").otherwise("TECO CLSD").alias("system_status"))
    texts = h.join(v.fg.select("material", "material_description"), "material").select("production_number", "material_description")
    out = X.order_history_view(h.select("production_number", "actual_finish_date", F.when(F.col("mrp_controller") == "CVC", "TEST").alias("order_type")),
                               h.select("production_number", "order_quantity"), h.select("production_number", "sales_doc"), texts, status)
    return out.select("production_number", "order_quantity", "sales_doc", "material_description", "system_status")


@register("material_view", with_views("""
select material, material_description from fg where material like 'MAT0%' and not total_production_time > 3""", ["fg"]))
def q_material_view(spark, sf):
    fg = Views(spark, sf).fg
    m = fg.select("material", F.when(F.col("total_production_time") > 3, True).alias("deletion_flag"))
    return X.material_view(m, fg.select("material", "material_description"), "MAT0").select("material", "material_description")


@register("capacity_view", with_views("""
select work_centre, cap_mo from (select 'L' || cast(k as varchar) as work_centre, k from (select distinct p_partkey // 20 as k from part) t) w
left join capacity c on c.production_line = w.work_centre where work_centre like 'L1%' and k % 2 = 0""", ["capacity"]))
def q_capacity_view(spark, sf):
    v = Views(spark, sf)
    k = F.floor(F.col("p_partkey") / 20)
    wc = v.table("part").select(F.concat(F.lit("L"), k.cast("string")).alias("work_centre"), (k % 2).cast("string").alias("plant")).distinct()
    return X.capacity_view(wc.withColumn("capacity_id", F.col("work_centre")), v.capacity.withColumnRenamed("production_line", "capacity_id"), "0", "L1").select("work_centre", "cap_mo")


@register("distinct_keys", with_views("select distinct cast(component_material as varchar) as component_material from shortage where component_material is not null", ["shortage"]))
def q_distinct_keys(spark, sf):
    """Padded, repeated and blank keys."""
    k = F.when(F.col("required_qty") > 40, F.lit("  ")).otherwise(F.concat(F.lit(" "), F.lpad(F.col("component_material").cast("string"), 18, "0")))
    s = Views(spark, sf).shortage
    both = s.select(k.alias("component_material")).unionAll(s.select(F.lpad(F.col("component_material").cast("string"), 10, "0")))
    return X.distinct_keys(both, "component_material", strip_zeros=True)


@register("master_rows", with_views("""
select material, material_description, case when earliest_start_days <> 3 then total_production_time end as total_production_time from fg""", ["fg"]))
def q_master_rows(spark, sf):
    """Keys without leading zeros, trimmed text, bad numbers null."""
    fg = Views(spark, sf).fg
    rec = fg.select(F.concat(F.lit("000"), F.col("material")).alias("MATNR"), F.concat(F.lit(" "), F.col("material_description"), F.lit(" ")).alias("MAKTX"),
                    F.when(F.col("earliest_start_days") == 3, "n/a").otherwise(F.col("total_production_time").cast("string")).alias("TPT"))
    return X.transform_master_rows(rec, {"MATNR": "material", "MAKTX": "material_description", "TPT": "total_production_time"}, ["total_production_time"])


@register("shortage_transform", with_views("""
select production_number, component_material, required_qty, required_qty - coalesce(nullif(required_qty % 7, 3), 0) as shortage_qty from shortage""", ["shortage"]))
def q_shortage_transform(spark, sf):
    """Required less withdrawn, bad text as 0."""
    w = F.col("required_qty") % 7
    s = Views(spark, sf).shortage.drop("shortage_qty").withColumn("withdrawn_qty", F.when(w == 3, "bad").otherwise(w.cast("string")))
    return X.transform_shortage_extract(s).select("production_number", "component_material", "required_qty", "shortage_qty")


@register("schema_contract", with_views("""
select material as material_number, cast(null as double) as weight, production_line from fg""", ["fg"]))
def q_schema_contract(spark, sf):
    """First alias present, first existing column, columns by name, fixed projection."""
    fg = C.first_alias_rename(Views(spark, sf).fg, {"material_number": ["matnr", "material", "production_line"]})
    fg = fg.select("*", C.first_existing(fg, ["line", "production_line", "material_number"], "chosen"))
    assert C.columns_containing(fg, ["LINE"]) == ["production_line"]
    return C.project_contract(fg.drop("production_line").withColumnRenamed("chosen", "production_line"), ["material_number", "weight", "production_line"], {"weight": "double"})


@register("write_table", with_views("select production_number, material, order_quantity, mrp_controller from history", ["history"]))
def q_write_table(spark, sf):
    """K1: partitioned CSV and back."""
    p = _landing(spark, "table")
    K.write_table(Views(spark, sf).history.select("production_number", "material", "order_quantity", "mrp_controller"), p, "csv", ["mrp_controller"])
    return spark.read.option("header", True).schema("production_number long, material string, order_quantity double").csv(p)


@register("write_versioned", with_views("select production_number, order_quantity * 2 as order_quantity from history", ["history"]))
def q_write_versioned(spark, sf):
    """K3: two runs, the latest is read."""
    p, h = _landing(spark, "runs"), Views(spark, sf).history.select("production_number", "order_quantity")
    K.write_versioned(h, p, "20240101")
    K.write_versioned(h.withColumn("order_quantity", F.col("order_quantity") * 2), p, "20240102")
    return K.read_latest(spark, p).select("production_number", "order_quantity")


@register("result_page", with_views("select order_id, status from production_orders order by order_id limit 50 offset 100", ["production_orders"]))
def q_result_page(spark, sf):
    return K.page(Views(spark, sf).production_orders, "order_id", 50, 100).select("order_id", "status")


@register("json_records", with_views("select order_id, actual_finish, planned_qty from production_orders", ["production_orders"]))
def q_json_records(spark, sf):
    """K8: explicit nulls."""
    p = _landing(spark, "records")
    K.write_json_records(Views(spark, sf).production_orders.select("order_id", "actual_finish", "planned_qty"), p)
    return spark.read.schema("order_id long, actual_finish date, planned_qty double").json(p)


PAYLOAD = StructType([StructField("order_id", LongType()), StructField("status", StringType()), StructField("planned_qty", DoubleType())])


@register("payload_round_trip", with_views("select cast(order_id as varchar) as id, order_id, status, planned_qty from production_orders", ["production_orders"]))
def q_payload_round_trip(spark, sf):
    """K5: stored payloads, parsed back."""
    p = _landing(spark, "payloads")
    K.payload_rows(Views(spark, sf).production_orders).write.parquet(p)
    return spark.read.parquet(p).select("id", F.from_json("payload", PAYLOAD).alias("r")).select("id", "r.*")


@register("model_registry", with_views("""
select 'm' || cast(max(priority) as varchar) as name, max(planned_qty) as score from production_orders""", ["production_orders"]))
def q_model_registry(spark, sf):
    """K6: one registered version for each priority; the newest active one is read."""
    p = _landing(spark, "registry")
    rows = Views(spark, sf).production_orders.groupBy("priority").agg(F.max("planned_qty").alias("top")).orderBy("priority").collect()  # five priorities
    best = max(r.top for r in rows)
    for r in rows:
        K.register_model(spark, p, {"name": f"m{r.priority}", "score": best, "is_active": True, "created_at": r.priority, "note": None, "other": 1},
                         ["name", "score", "is_active", "created_at", "note"])
    return K.latest_active_model(spark.read.parquet(p)).select("name", "score")


# --- further forms of registered operators --------------------------------------------------------------------------

@register("comparison_totals", with_views("""
select o.d as old_delays, n.d as new_delays, n.d - o.d as delta_delays, round(o.m, 6) as old_mean_pct, round(n.m, 6) as new_mean_pct, round(n.m - o.m, 6) as delta_mean_pct
from (select count(*) filter (where delay_probability > 0.5) as d, avg(delay_probability) * 100 as m from scored) o,
  (select count(*) filter (where delay_probability > 0.5) as d, avg(delay_probability) * 100 as m from newm) n""", ["scored"], [("newm", NEW_MODEL)]))
def q_comparison_totals(spark, sf):
    v = Views(spark, sf)
    return r6(EV.comparison_totals(v.scored, _new_model(v)))


@register("label_coverage", with_views("""
select col as column, present, n as rows, round(present * 100.0 / n, 6) as pct
from (select 'actual_finish_date' as col, count(actual_finish_date) as present, count(*) as n from history
      union all select 'production_supervisor', count(production_supervisor), count(*) from history
      union all select 'created_date', count(created_date), count(*) from history) t""", ["history"]))
def q_label_coverage(spark, sf):
    return r6(R.label_coverage(Views(spark, sf).history, ["actual_finish_date", "production_supervisor", "created_date"]))


@register("plant_counts", with_views("select plant, count(*) as n from production_orders group by plant", ["production_orders"]))
def q_plant_counts(spark, sf):
    return R.value_counts(Views(spark, sf).production_orders, "plant")


@register("delayed_counts", S.over_enriched("select is_delayed, count(*) as n from enriched where is_delayed is not null group by is_delayed"))
def q_delayed_counts(spark, sf):
    return R.value_counts(enriched(Views(spark, sf)), "is_delayed")
