"""Source, sink and ingest queries."""

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from ..operators import evaluate as EV
from ..operators import rollups as R
from ..session import cut_lineage, ensure_checkpoint_dir, remember_scratch
from ..sinks import writers as K
from ..sources import envelopes as ENV
from ..sources import extracts as X
from ..sources.fixtures import Views, with_views
from ..streaming import ingest as I
from .q_rollups import tpt_table
from .registry import r6, register

UPSERT_COLS = ["production_number", "material", "order_quantity", "created_date", "ingest_seq"]


@register("incremental_upsert", with_views("""
select production_number, material, order_quantity, created_date, max(ingest_seq) as ingest_seq
from (select *, cast(year(created_date) * 12 + month(created_date) as bigint) as ingest_seq from history
      union all
      select *, cast(year(created_date) * 12 + month(created_date) + 1 as bigint) from history
      where day(created_date) > day(last_day(created_date)) - 7) t
group by production_number, material, order_quantity, created_date""", ["history"]))
def q_incremental_upsert(spark, sf):
    inc = I.monthly_increments(Views(spark, sf).history.select(*UPSERT_COLS[:-1]))
    return I.upsert(None, inc).select(*UPSERT_COLS)


@register("incremental_upsert_stream", with_views("""
select production_number, material, order_quantity, created_date, max(ingest_seq) as ingest_seq
from (select *, cast(year(created_date) * 12 + month(created_date) as bigint) as ingest_seq from history
      union all
      select *, cast(year(created_date) * 12 + month(created_date) + 1 as bigint) from history
      where day(created_date) > day(last_day(created_date)) - 7) t
group by production_number, material, order_quantity, created_date""", ["history"]))
def q_incremental_upsert_stream(spark, sf):
    """Land monthly extracts (with overlap) under the shared checkpoint folder,
    run the availableNow stream with foreachBatch upserts, read the table."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream/{uuid.uuid4().hex}"
    remember_scratch(root)
    inc = I.monthly_increments(Views(spark, sf).history.select(*UPSERT_COLS[:-1]))
    inc.write.partitionBy("ingest_seq").parquet(f"{root}/landing")
    schema = spark.read.parquet(f"{root}/landing").schema
    I.run_incremental(spark, f"{root}/landing", schema, f"{root}/table", f"{root}/checkpoint")
    return I.read_table(spark, f"{root}/table").select(*UPSERT_COLS)


#: Extracts of a year each; some orders of the year before come along again, changed. Those of its last week are in time.
RESENT = "production_number % 9 = 0"
LATE_CTES = [
    ("sent", f"""select production_number, material, order_quantity, created_date, cast(year(created_date) as bigint) as ingest_seq from history
  union all select production_number, material, order_quantity + 1000, created_date, cast(year(created_date) + 1 as bigint) from history
  where {RESENT} and year(created_date) < (select max(year(created_date)) from history)"""),
    ("highs", "select ingest_seq, max(created_date) as high from sent group by ingest_seq"),
    ("judged", """select s.*, coalesce(s.created_date < h.high - interval 7 day, false) as late from sent s
  left join (select ingest_seq, max(high) over (order by ingest_seq rows between unbounded preceding and 1 preceding) as high from highs) h using (ingest_seq)""")]
LATE_COLS = "select production_number, material, order_quantity, created_date, ingest_seq from judged where "


def land(extract, folder: str) -> None:
    """An extract lands as many files as the scan has tasks; the files that are there when a sync starts are one micro-batch."""
    extract.write.mode("append").parquet(folder)


def _yearly_sync(spark, sf):
    """Lands an extract for each year, in order, one micro-batch each, and runs the bounded sync over them."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream/{uuid.uuid4().hex}"
    remember_scratch(root)
    h = Views(spark, sf).history.select(*UPSERT_COLS[:-1]).withColumn("y", F.year("created_date"))
    first, last = h.agg(F.min("y"), F.max("y")).first()
    again = h.where(RESENT).where(F.col("y") < last).withColumns({"order_quantity": F.col("order_quantity") + 1000, "y": F.col("y") + 1})
    sent = cut_lineage(h.unionByName(again).withColumnRenamed("y", "ingest_seq").withColumn("ingest_seq", F.col("ingest_seq").cast("long")))
    for y in range(first, last + 1):
        land(sent.where(F.col("ingest_seq") == y), f"{root}/landing")
        I.run_incremental(spark, f"{root}/landing", sent.schema, f"{root}/table", f"{root}/checkpoint", event="created_date", late_days=7)
    return root, sent.schema


@register("bounded_sync_stream", with_views(
    LATE_COLS + "not late qualify row_number() over (partition by production_number order by ingest_seq desc) = 1", ["history"], LATE_CTES))
def q_bounded_sync_stream(spark, sf):
    """X1's late bound and X2: resent orders of the last seven days replace the stored ones, older ones do not."""
    root, _ = _yearly_sync(spark, sf)
    return I.read_table(spark, f"{root}/table").select(*UPSERT_COLS)


@register("too_late_stream", with_views(LATE_COLS + "late", ["history"], LATE_CTES))
def q_too_late_stream(spark, sf):
    """X1's side output: the resent orders that came too late."""
    root, schema = _yearly_sync(spark, sf)
    return I.read_late(spark, f"{root}/table", schema, f"{root}/checkpoint").select(*UPSERT_COLS)


ROW = StructType([StructField("production_number", LongType()), StructField("material", StringType()),
                  StructField("order_quantity", DoubleType())])


@register("json_envelope", with_views("select production_number, material, order_quantity from history", ["history"]))
def q_json_envelope(spark, sf):
    """S7 round trip: records grouped per sales order into the four envelope
    shapes (bare array, body as string, body as array, single objects), parsed back."""
    h = Views(spark, sf).history
    rec = F.struct("production_number", "material", "order_quantity")
    shape = F.col("sales_doc") % 4
    grouped = h.filter(shape != 3).groupBy("sales_doc").agg(F.to_json(F.collect_list(rec)).alias("arr"))
    texts = grouped.select(F.when(F.col("sales_doc") % 4 == 0, F.col("arr"))
                           .when(F.col("sales_doc") % 4 == 1, F.to_json(F.struct(F.col("arr").alias("body"))))
                           .otherwise(F.concat(F.lit('{"body": '), F.col("arr"), F.lit("}"))).alias("value"))
    singles = h.filter(shape == 3).select(F.to_json(rec).alias("value"))
    return ENV.parse_envelopes(texts.unionByName(singles), ROW)


@register("history_extract", with_views("""
select h.production_number, h.material, f.material_description, h.created_date
from history h join fg f on h.material = f.material
where h.created_date between date '1995-01-01' and date '1995-12-31'""", ["history", "fg"]))
def q_history_extract(spark, sf):
    v = Views(spark, sf)
    texts = v.fg.select("material", "material_description", F.lit("E").alias("language"))
    out = X.history_extract(v.history, texts, v.fg, "1995-01-01", "1995-12-31")
    return out.select("production_number", "material", "material_description", "created_date")


def _predictions(v: Views):
    s = v.scored.join(v.history.select("production_number", "sales_doc", "item"), "production_number") \
        .join(v.fg.select("material", "material_description", "production_line"), "material", "left")
    p = F.col("delay_probability")
    return s.withColumns({"predicted_delay": (p > 0.5).cast("int"), "risk_level": EV.risk_band_a(p)})


@register("prediction_export", with_views("""
select h.sales_doc as "销售订单", h.item as "行项目", s.production_number as "生产订单", s.material as "物料号",
  f.material_description as "物料描述", s.order_quantity as "订单数量",
  strftime(s.planned_start_date, '%Y-%m-%d') as "计划开始日期", strftime(s.planned_finish_date, '%Y-%m-%d') as "计划完成日期",
  f.production_line as "生产线", round(s.delay_probability, 6) as "延迟概率",
  cast(s.delay_probability > 0.5 as int) as "预测结果",
  case when s.delay_probability > 0 and s.delay_probability <= 0.3 then 'low'
       when s.delay_probability > 0.3 and s.delay_probability <= 0.7 then 'medium'
       when s.delay_probability > 0.7 and s.delay_probability <= 1.0 then 'high' end as "风险等级",
  round(s.delay_probability * 100, 1) as "延迟概率(%)"
from scored s join history h on s.production_number = h.production_number left join fg f on s.material = f.material""",
                                           ["scored", "history", "fg"]))
def q_prediction_export(spark, sf):
    return r6(K.prediction_export(_predictions(Views(spark, sf))))


@register("payload_rows")
def q_payload_rows(spark, sf):
    po = Views(spark, sf).production_orders
    return K.payload_rows(po)


@register("material_export")
def q_material_export(spark, sf):
    v = Views(spark, sf)
    mat = tpt_table(v)
    return K.material_export(mat, R.material_insight(mat).drop(*[c for c in mat.columns if c != "material"]))
