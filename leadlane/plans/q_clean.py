"""Cleaning-function queries (C3-C23, S17) on keys and dates formatted from the fixtures."""

from pyspark.sql import functions as F

from ..functions import clean as C
from ..operators import enrich as E
from ..sources import files as FI
from ..sources.fixtures import Views, with_views
from . import sqlparts as S
from .registry import enriched, register



def _raw_keys(v: Views):
    _pn = F.col("production_number")
    h = v.history
    return h.select(
        "production_number",
        F.when(_pn % 13 == 0, "000").when(_pn % 17 == 0, F.lit(None)).when(_pn % 19 == 0, "  ")
         .otherwise(F.lpad(_pn.cast("string"), 12, "0")).alias("raw_key"))


RAW_KEYS = """select production_number,
  case when production_number % 13 = 0 then '000' when production_number % 17 = 0 then null
       when production_number % 19 = 0 then '  ' else lpad(cast(production_number as varchar), 12, '0') end as raw_key
from history"""


@register("strip_leading_zeros", with_views("""
select production_number,
  case when regexp_replace(trim(coalesce(raw_key, '')), '^0+', '') = '' then '0'
       else regexp_replace(trim(coalesce(raw_key, '')), '^0+', '') end as opensql_key,
  case when raw_key is null or raw_key = '' then raw_key when regexp_replace(raw_key, '^0+', '') = '' then '0'
       else regexp_replace(raw_key, '^0+', '') end as odata_key
from raw""", ["history"], [("raw", RAW_KEYS)]))
def q_strip_leading_zeros(spark, sf):
    r = _raw_keys(Views(spark, sf))
    return r.select("production_number", C.strip_leading_zeros_opensql("raw_key").alias("opensql_key"),
                    C.strip_leading_zeros_odata("raw_key").alias("odata_key"))


def _raw_dats(v: Views):
    _pn = F.col("production_number")
    h = v.history
    d = F.col("created_date")
    return h.select("production_number", (F.when(_pn % 5 == 0, F.date_format(d, "yyyyMMdd"))
                                          .when(_pn % 5 == 1, "00000000")
                                          .when(_pn % 5 == 2, F.date_format(d, "yyyy-MM-dd"))
                                          .when(_pn % 5 == 3, F.lit(None)).otherwise("n/a")).alias("dats"))


RAW_DATS = """select production_number,
  case production_number % 5 when 0 then strftime(created_date, '%Y%m%d') when 1 then '00000000'
       when 2 then strftime(created_date, '%Y-%m-%d') when 3 then null else 'n/a' end as dats
from history"""


@register("dats_to_date", with_views("""
select production_number, iso, strftime(try_strptime(iso, '%Y-%m-%d'), '%-m/%-d/%Y') as short_date,
  cast(try_strptime(iso, '%Y-%m-%d') as date) as parsed_date
from (select production_number, case when dats is null or trim(dats) = '' or trim(dats) = '00000000' then ''
        when regexp_matches(trim(dats), '^\\d{4}-\\d{2}-\\d{2}$') then trim(dats)
        when regexp_matches(trim(dats), '^\\d{8}$') then substr(trim(dats), 1, 4) || '-' || substr(trim(dats), 5, 2) || '-' || substr(trim(dats), 7, 2)
        else trim(dats) end as iso from raw) t""", ["history"], [("raw", RAW_DATS)]))
def q_dats_to_date(spark, sf):
    r = _raw_dats(Views(spark, sf))
    return r.select("production_number", C.dats_to_iso("dats").alias("iso"),
                    C.dats_to_short("dats").alias("short_date"),
                    C.parse_date(C.dats_to_iso("dats"), "yyyy-MM-dd").alias("parsed_date"))


def _raw_odata(v: Views):
    _pn = F.col("production_number")
    d = F.col("created_date")
    ms = (F.unix_date(d).cast("long") * 86400000).cast("string")
    return v.history.select("production_number", (F.when(_pn % 4 == 0, F.concat(F.lit("/Date("), ms, F.lit(")/")))
                                                   .when(_pn % 4 == 1, F.concat(F.lit("/Date(-"), ms, F.lit(")/")))
                                                   .when(_pn % 4 == 2, F.date_format(d, "yyyy-MM-dd"))
                                                   .otherwise(F.lit(None))).alias("odata"))


RAW_ODATA = """select production_number,
  case production_number % 4 when 0 then '/Date(' || cast((created_date - date '1970-01-01') * 86400000 as varchar) || ')/'
       when 1 then '/Date(-' || cast((created_date - date '1970-01-01') * 86400000 as varchar) || ')/'
       when 2 then strftime(created_date, '%Y-%m-%d') else null end as odata
from history"""


@register("odata_date", with_views("""
select production_number,
  case when odata is null then null
       when starts_with(odata, '/Date(') then
         case when regexp_extract(odata, '^/Date\\((\\d+)\\)/$', 1) <> ''
              then strftime(make_timestamp(cast(regexp_extract(odata, '^/Date\\((\\d+)\\)/$', 1) as bigint) * 1000), '%Y-%m-%d') end
       else strftime(try_cast(odata as timestamp), '%Y-%m-%d') end as iso_date
from raw""", ["history"], [("raw", RAW_ODATA)]))
def q_odata_date(spark, sf):
    r = _raw_odata(Views(spark, sf))
    return r.select("production_number", C.odata_date("odata").alias("iso_date"))


def _raw_orders(v: Views):
    _pn = F.col("production_number")
    return v.history.select(
        "production_number",
        F.when(_pn % 7 == 0, F.lit(None)).when(_pn % 11 == 0, "nan")
         .otherwise(F.concat(_pn.cast("string"), F.lit(".0"))).alias("order_raw"),
        F.when(_pn % 13 == 0, F.lit(None)).otherwise(F.col("sales_doc").cast("string")).alias("sales_doc_raw"),
        F.when(_pn % 3 == 0, F.lit(None)).otherwise(F.col("item").cast("string")).alias("item_raw"))


RAW_ORDERS = """select production_number,
  case when production_number % 7 = 0 then null when production_number % 11 = 0 then 'nan'
       else cast(production_number as varchar) || '.0' end as order_raw,
  case when production_number % 13 = 0 then null else cast(sales_doc as varchar) end as sales_doc_raw,
  case when production_number % 3 = 0 then null else cast(item as varchar) end as item_raw
from history"""


def _blank_sql(x: str) -> str:
    t = f"trim(regexp_replace({x}, '\\.0$', ''))"
    return f"case when {t} is null or {t} = '' or lower({t}) = 'nan' then null else {t} end"


@register("backfill_order_key", with_views(f"""
select production_number,
  coalesce({_blank_sql('order_raw')},
           case when {_blank_sql('sales_doc_raw')} is not null and {_blank_sql('item_raw')} is not null
                then {_blank_sql('sales_doc_raw')} || '_' || {_blank_sql('item_raw')} end,
           {_blank_sql('sales_doc_raw')}) as order_key
from raw""", ["history"], [("raw", RAW_ORDERS)]))
def q_backfill_order_key(spark, sf):
    r = _raw_orders(Views(spark, sf))
    return r.select("production_number", C.backfill_order_key("order_raw", "sales_doc_raw", "item_raw").alias("order_key"))


@register("missing_key_report", with_views(f"""
select production_number from raw where order_raw is null or sales_doc_raw is null or item_raw is null""",
                                           ["history"], [("raw", RAW_ORDERS)]))
def q_missing_key_report(spark, sf):
    r = _raw_orders(Views(spark, sf))
    return r.filter(C.any_null(["order_raw", "sales_doc_raw", "item_raw"])).select("production_number")


@register("day_capacity", S.over_enriched("""
select production_number, planned_start_weekday,
  case planned_start_weekday when 1 then cap_tu when 2 then cap_we when 3 then cap_th when 4 then cap_fr else cap_mo end
    as planned_start_day_capacity
from enriched"""))
def q_day_capacity(spark, sf):
    df = enriched(Views(spark, sf))
    return df.select("production_number", "planned_start_weekday",
                     C.day_capacity("planned_start_weekday").alias("planned_start_day_capacity"))


@register("status_concat", with_views("""
select production_number, array_to_string(list_sort(list(cast(component_material as varchar))), ' ') as system_status
from shortage where production_number is not null group by production_number""", ["shortage"]))
def q_status_concat(spark, sf):
    return FI.status_concat(Views(spark, sf).shortage, status="component_material")


def _raw_line(v: Views):
    df = E.join_fg(v.history, v.fg)
    return df.select("production_number", F.concat(F.coalesce(F.col("production_line"), F.lit("NA")), F.lit("_"),
                                                   F.date_format("created_date", "yyyyMMdd"), F.lit("(SUP"),
                                                   F.coalesce(F.col("production_supervisor"), F.lit("")),
                                                   F.lit(")")).alias("raw_line"))


RAW_LINE = """select h.production_number, coalesce(f.production_line, 'NA') || '_' || strftime(h.created_date, '%Y%m%d')
  || '(SUP' || coalesce(h.production_supervisor, '') || ')' as raw_line
from history h left join fg f on h.material = f.material"""


@register("line_supervisor_split", with_views("""
select production_number, split_part(raw_line, '_', 1) as line_code,
  regexp_extract(raw_line, '\\(([^)]*)\\)', 1) as supervisor, trim(regexp_replace(raw_line, '\\(.*$', '')) as outer_text
from raw""", ["history", "fg"], [("raw", RAW_LINE)]))
def q_line_supervisor_split(spark, sf):
    r = _raw_line(Views(spark, sf))
    return r.select("production_number", C.line_code("raw_line").alias("line_code"),
                    C.paren_inner("raw_line").alias("supervisor"), C.paren_outer("raw_line").alias("outer_text"))


def _raw_dotted(v: Views):
    _pn = F.col("production_number")
    d = F.col("created_date")
    return v.history.select("production_number", F.when(_pn % 3 == 0, F.date_format(d, "dd.MM.yyyy"))
                            .when(_pn % 3 == 1, F.date_format(d, "yyyy.MM.dd")).otherwise("31.02.1996").alias("dotted"))


RAW_DOTTED = """select production_number, case production_number % 3 when 0 then strftime(created_date, '%d.%m.%Y')
  when 1 then strftime(created_date, '%Y.%m.%d') else '31.02.1996' end as dotted from history"""


@register("dotted_dates", with_views("""
select production_number,
  strftime(case when regexp_matches(replace(trim(dotted), '.', '-'), '^\\d{4}-\\d{1,2}-\\d{1,2}')
                then try_strptime(replace(trim(dotted), '.', '-'), '%Y-%m-%d')
                when regexp_matches(replace(trim(dotted), '.', '-'), '^\\d{1,2}-\\d{1,2}-\\d{4}$')
                then try_strptime(replace(trim(dotted), '.', '-'), '%d-%m-%Y') end, '%Y-%m-%d') as iso_date
from raw""", ["history"], [("raw", RAW_DOTTED)]))
def q_dotted_dates(spark, sf):
    r = _raw_dotted(Views(spark, sf))
    return r.select("production_number", C.dotted_date("dotted").alias("iso_date"))


@register("numeric_parse", with_views("""
select production_number, try_cast(trim(txt) as double) as parsed, coalesce(try_cast(trim(txt) as double), 0) as parsed_or_zero
from (select production_number, case production_number % 4 when 0 then cast(order_quantity as varchar)
        when 1 then ' ' || cast(order_quantity as varchar) || ' ' when 2 then 'abc' else null end as txt from history) t""",
                                     ["history"]))
def q_numeric_parse(spark, sf):
    _pn = F.col("production_number")
    h = Views(spark, sf).history
    txt = (F.when(_pn % 4 == 0, F.col("order_quantity").cast("string"))
           .when(_pn % 4 == 1, F.concat(F.lit(" "), F.col("order_quantity").cast("string"), F.lit(" ")))
           .when(_pn % 4 == 2, "abc").otherwise(F.lit(None)))
    t = h.select("production_number", txt.alias("txt"))
    return t.select("production_number", C.parse_number("txt").alias("parsed"),
                    C.parse_number("txt", 0.0).alias("parsed_or_zero"))
