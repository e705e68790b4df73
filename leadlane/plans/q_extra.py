"""Standards, finish forecast, material-level metrics, top risk and prediction mode."""

import uuid

from pyspark.sql import functions as F

from ..operators import diagnostics as DG
from ..operators import enrich as E
from ..operators import ml as ML
from ..operators import rollups as R
from ..operators import scoring as SCO
from ..operators.statistics import HistoryState
from ..session import cut_lineage, ensure_checkpoint_dir, remember_scratch
from ..sinks import writers as K
from ..sources.fixtures import Views, with_views
from .q_rollups import INSIGHT_SQL, MT, MT_COLS, SE, over_scored, scored_enriched, tpt_table
from . import sqlparts as S
from .registry import r6, register

STD_SQL = """
select production_line, material, material_description, round(avg(predicted), 4) as predicted_avg,
  round(stddev_samp(predicted), 4) as predicted_std, round(min(predicted), 4) as predicted_min,
  round(max(predicted), 4) as predicted_max, count(predicted) as sample_count
from se where production_line is not null and material is not null and material_description is not null
group by production_line, material, material_description"""


def _standards(spark, sf):
    return R.material_standards(scored_enriched(Views(spark, sf)))


@register("material_standards", over_scored("select * from st", [("st", STD_SQL)]))
def q_material_standards(spark, sf):
    return _standards(spark, sf)


@register("line_standards", over_scored("""
select production_line, round(avg(predicted_avg), 6) as avg_time, min(predicted_avg) as min_time,
  max(predicted_avg) as max_time, count(material) as material_count from st group by production_line""",
                                        [("st", STD_SQL)]))
def q_line_standards(spark, sf):
    return r6(R.line_standards_summary(_standards(spark, sf)))


@register("simple_standards", over_scored(
    "select production_line, material_description, material, predicted_avg from st", [("st", STD_SQL)]))
def q_simple_standards(spark, sf):
    return R.simple_standards(_standards(spark, sf))


@register("finish_forecast", with_views("""
select production_number,
  make_timestamp(epoch_us(cast(planned_start_date as timestamp)) + cast(floor(predicted * 86400000000.0) as bigint))
    as predicted_finish_date,
  round((epoch_us(cast(planned_start_date as timestamp)) + cast(floor(predicted * 86400000000.0) as bigint)
         - epoch_us(cast(planned_finish_date as timestamp))) / 86400000000.0, 1) as deviation_days,
  cast((epoch_us(cast(planned_start_date as timestamp)) + cast(floor(predicted * 86400000000.0) as bigint)
        - epoch_us(cast(planned_finish_date as timestamp))) > 0 as int) as at_risk
from scored""", ["scored"]))
def q_finish_forecast(spark, sf):
    df = R.finish_forecast(Views(spark, sf).scored)
    return df.select("production_number", "predicted_finish_date", "deviation_days", "at_risk")


@register("material_level_metrics", over_scored("""
select * from (
  select count(*) as n, round(sqrt(avg((actual_tpt - predicted_tpt) * (actual_tpt - predicted_tpt))), 6) as rmse,
    round(avg(abs(actual_tpt - predicted_tpt)), 6) as mae,
    round(case when var_pop(actual_tpt) * count(*) > 0 then 1 - sum((actual_tpt - predicted_tpt) * (actual_tpt - predicted_tpt))
          / (var_pop(actual_tpt) * count(*)) end, 6) as r2,
    round(coalesce(avg(case when (abs(actual_tpt) + abs(predicted_tpt)) / 2 > 0
          then abs(actual_tpt - predicted_tpt) / ((abs(actual_tpt) + abs(predicted_tpt)) / 2) end) * 100, 0), 6) as smape
  from mt where actual_tpt is not null and predicted_tpt is not null) t where n > 1"""))
def q_material_level_metrics(spark, sf):
    v = Views(spark, sf)
    return r6(ML.material_level_metrics(tpt_table(v)))


@register("top_risk_orders", with_views("""
select production_number, delay_probability from scored
where delay_probability > 0.7 and delay_probability <= 1.0
order by delay_probability desc, production_number limit 5""", ["scored"]))
def q_top_risk_orders(spark, sf):
    return R.top_risk_orders(Views(spark, sf).scored).select("production_number", "delay_probability")


@register("prefix_lookup", with_views("""
select production_number, sales_doc from history
where starts_with(cast(sales_doc as varchar), '12') or starts_with(cast(production_number as varchar), '12')""",
                                      ["history"]))
def q_prefix_lookup(spark, sf):
    return E.prefix_lookup(Views(spark, sf).history, "12").select("production_number", "sales_doc")


_V4_PARTS = ["time_features", "concurrent_load", "forward_load_line", "forward_load_material", "hist90_material",
             "hist90_line", "hist90_material_line", "count30_material", "target_encoding_material",
             "target_encoding_line", "ratio_features", "interaction_features"]


def _v4_oracle() -> str:
    from .registry import ORACLES
    parts = [f"({ORACLES[k]}) t{i}" for i, k in enumerate(_V4_PARTS)]
    sql = "select * from " + parts[0]
    for p in parts[1:]:
        sql += f"\njoin {p} using (production_number)"
    return sql


def _v4_columns():
    from .q_features import INTER_COLS, RATIO_COLS, TIME_COLS
    from ..operators.features import FORWARD_SPECS, HISTORY_COLUMNS
    fw = [f"{p}_{s}" for _, _, p in FORWARD_SPECS for s in ("orders", "qty")]
    return (TIME_COLS + ["concurrent_orders_on_start", "concurrent_qty_on_start", "qty_share_of_day"] + fw
            + HISTORY_COLUMNS + ["material_cv_production_time", "material_order_count_30d", "material_target_encoded",
                                 "line_target_encoded"] + RATIO_COLS + INTER_COLS)


@register("features_v4_columns", _v4_oracle())
def q_features_v4_columns(spark, sf):
    """The flagship feature table (v4 pipeline, one materialised base) against the
    joined per-stage oracles."""
    from ..operators import features as FT
    from .registry import enriched
    return r6(FT.features_v4(enriched(Views(spark, sf)).select(*FT.FEATURES_READ)).select("production_number", *_v4_columns()))


def _prediction_oracle() -> str:
    """The same per-stage oracles over all orders with their known targets, open orders taken out at the end."""
    everyone = f"select *, {S.TARGET_EXPR} as actual_production_days from enriched"
    sql = _v4_oracle().replace(S.TRAIN_ROWS, everyone).replace(S.enriched_sql(True), S.enriched_sql(False))
    return with_views(f"select p.* from ({sql}) p join history h on p.production_number = h.production_number where h.actual_finish_date is null", ["history"])


@register("prediction_mode_features", _prediction_oracle())
def q_prediction_mode(spark, sf):
    """Completed orders are history, open orders (not the latest ones) are scored as new."""
    from ..operators import features as FT
    v = Views(spark, sf)
    hist = E.enrich(v.history, v.fg, v.capacity, v.shortage, completed_only=True)
    new = E.basic_features(E.join_shortage(SCO.prepare_new_orders(E.pending_orders(v.history), v.fg, v.capacity),
                                           v.shortage))
    read = FT.FEATURES_READ
    return r6(SCO.score_features(hist.select(*read), new.select(*read)).select("production_number", *_v4_columns()))


def _history_and_new(spark, sf):
    v = Views(spark, sf)
    hist = E.enrich(v.history, v.fg, v.capacity, v.shortage, completed_only=True)
    new = E.basic_features(E.join_shortage(SCO.prepare_new_orders(E.pending_orders(v.history), v.fg, v.capacity), v.shortage))
    return hist, new


def _stored_state(spark, hist):
    """A history state, written and read back as scoring would find it."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/state/{uuid.uuid4().hex}"
    remember_scratch(path)
    SCO.build_state(hist).save(path)
    return HistoryState.load(spark, path)


@register("uploaded_orders_features", _prediction_oracle())
def q_uploaded_orders_features(spark, sf):
    """The features of new orders by look-up in the stored history, equal to those over history and new orders."""
    from ..operators import features as FT
    hist, new = _history_and_new(spark, sf)
    return r6(FT.features_v4(new, training=False, state=_stored_state(spark, hist)).select("production_number", *_v4_columns()))


@register("uploaded_orders_prediction")
def q_uploaded_orders_prediction(spark, sf):
    """Open orders scored with a saved model and a stored history state."""
    from ..operators import features as FT
    from ..operators import robust as RB
    hist, new = _history_and_new(spark, sf)
    hist = cut_lineage(hist.select(*FT.MODEL_READ))  # the training rows and the state read it
    df = FT.features_v4(hist)
    feats = FT.feature_columns(df)
    df = cut_lineage(df.select(FT.TARGET, *feats))  # the fit reads it several times
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/models/{uuid.uuid4().hex}"
    remember_scratch(path)
    RB.fit_huber(df, feats).save(path)
    return r6(SCO.score_uploaded(new, _stored_state(spark, hist), RB.HuberModel.load(spark, path)))


# --- master-data diagnostics ----------------------------------------------------------------

MASTER_LONG = """
select material, production_line, metric, value from (
  select material, production_line, unnest(['total_production_time', 'constraint_factor', 'implied_daily_capacity', 'production_complexity']) as metric,
    unnest([total_production_time, constraint_factor, 1.0 / nullif(total_production_time, 0), total_production_time * constraint_factor]) as value from fg) t
where value is not null"""


@register("master_profile", with_views(f"""
select metric, n, n_distinct, round(min_value, 6) as min_value, round(max_value, 6) as max_value, round(mean_value, 6) as mean_value,
  round(mean_value / max(case when metric = 'implied_daily_capacity' then mean_value end) over (), 6) as times_implied
from (select metric, count(*) as n, count(distinct value) as n_distinct, min(value) as min_value, max(value) as max_value, avg(value) as mean_value
      from ({MASTER_LONG}) l group by metric) t""", ["fg"]))
def q_master_profile(spark, sf):
    return r6(DG.master_profile(Views(spark, sf).fg))


@register("master_ranks", with_views(f"""
select material, production_line, metric, round(value, 6) as value, rank() over (partition by metric order by value desc) as rank,
  count(*) over (partition by metric) as n from ({MASTER_LONG}) l""", ["fg"]))
def q_master_ranks(spark, sf):
    return r6(DG.master_ranks(Views(spark, sf).fg))


@register("order_drilldown", S.over_enriched("""
select production_number, material, metric, round(value, 6) as value from (
  select production_number, material,
    unnest(['order_quantity', 'total_production_time', 'constraint_factor', 'line_capacity', 'qty_capacity_ratio', 'expected_production_days',
            'production_complexity', 'days_by_line_capacity', 'days_by_time', 'days_by_constraint']) as metric,
    unnest([cast(order_quantity as double), total_production_time, constraint_factor, line_capacity, qty_capacity_ratio, expected_production_days,
            total_production_time * constraint_factor, case when line_capacity > 0 then order_quantity * total_production_time / line_capacity end,
            order_quantity * total_production_time, case when constraint_factor > 0 then order_quantity / constraint_factor end]) as value from enriched) t
where value is not null"""))
def q_order_drilldown(spark, sf):
    from .registry import enriched
    return r6(DG.order_drilldown(enriched(Views(spark, sf))))


@register("material_export_rows", over_scored(f"""
select {', '.join('mt.' + c for c in MT_COLS)}, i.speed_class, i.sample_class, i.stability_class
from mt left join ({INSIGHT_SQL}) i on mt.material = i.material"""))
def q_material_export_rows(spark, sf):
    v = Views(spark, sf)
    mat = tpt_table(v)
    classes = ["speed_class", "sample_class", "stability_class"]
    details = {c: "double" if c in ("actual_tpt", "current_tpt", "tpt_change") else "string" for c in [*MT_COLS[6:], *classes]}
    out = K.read_material_export(K.material_export(mat, R.material_insight(mat).select("material", *classes)), details)
    return out.select(*MT_COLS, *classes)
