"""Enrichment, label and filter queries."""

from pyspark.sql import functions as F

from ..operators import enrich as E
from ..sources.fixtures import Views, with_views
from . import sqlparts as S
from .registry import enriched, r6, r6sql, register, train_rows

_FG_COLS = ["constraint_factor", "earliest_start_days", "total_production_time"]


@register("enrich_fg", with_views(f"""
select h.production_number, h.material, f.production_line, {r6sql(_FG_COLS)}
from history h left join fg f on h.material = f.material""", ["history", "fg"]))
def q_enrich_fg(spark, sf):
    v = Views(spark, sf)
    return r6(E.join_fg(v.history, v.fg).select("production_number", "material", "production_line", *_FG_COLS))


_CAP_COLS = ["cap_mo", "cap_tu", "cap_we", "cap_th", "cap_fr", "line_capacity"]


@register("enrich_capacity", S.over_enriched(f"""
select h.production_number, f.production_line, {r6sql(['c.' + c for c in _CAP_COLS]).replace('as c.', 'as ')}
from history h left join fg f on h.material = f.material left join cap c on f.production_line = c.production_line"""))
def q_enrich_capacity(spark, sf):
    v = Views(spark, sf)
    df = E.join_capacity(E.join_fg(v.history, v.fg), v.capacity)
    return r6(df.select("production_number", "production_line", *_CAP_COLS))


_SH_COLS = ["total_shortage_qty", "max_shortage_qty", "max_shortage_pct", "shortage_component_ratio", "shortage_qty_ratio"]


@register("shortage_rollup", with_views(f"""
select production_number, has_shortage, shortage_component_count, {r6sql(_SH_COLS)} from srollup""",
                                         ["shortage"], [("srollup", S.SHORTAGE_ROLLUP)]))
def q_shortage_rollup(spark, sf):
    v = Views(spark, sf)
    return r6(E.shortage_rollup(v.shortage))


@register("enrich_shortage", S.over_enriched(f"""
select production_number, has_shortage, shortage_component_count, {r6sql(_SH_COLS)} from enriched""",
                                             completed_only=False))
def q_enrich_shortage(spark, sf):
    v = Views(spark, sf)
    df = E.join_shortage(v.history, v.shortage)
    return r6(df.select("production_number", "has_shortage", "shortage_component_count", *_SH_COLS))


@register("order_labels", S.over_enriched("""
select production_number, planned_duration_days, actual_duration_days, delay_days, is_delayed,
  round(qty_capacity_ratio, 6) as qty_capacity_ratio, round(expected_production_days, 6) as expected_production_days,
  planned_start_month, planned_start_weekday, planned_start_quarter, planned_start_year, has_supervisor
from enriched"""))
def q_order_labels(spark, sf):
    v = Views(spark, sf)
    return r6(enriched(v).select(
        "production_number", "planned_duration_days", "actual_duration_days", "delay_days", "is_delayed",
        "qty_capacity_ratio", "expected_production_days", "planned_start_month", "planned_start_weekday",
        "planned_start_quarter", "planned_start_year", "has_supervisor"))


@register("lead_time_target", with_views(f"""
select production_number, round({S.TARGET_EXPR}, 6) as actual_production_days from history""", ["history"]))
def q_lead_time_target(spark, sf):
    v = Views(spark, sf)
    return r6(E.lead_time_target(v.history).select("production_number", "actual_production_days"))


@register("winsorised_target", S.over_enriched(f"""
select e.production_number, round(least(greatest(e.y0, b.lo), b.hi), 6) as actual_production_days
from (select *, {S.TARGET_EXPR} as y0 from enriched) e,
     (select quantile_cont(y0, 0.01) as lo, quantile_cont(y0, 0.99) as hi
      from (select {S.TARGET_EXPR} as y0, order_quantity from enriched) t
      where y0 is not null and y0 <= 45 and order_quantity <= 500) b
where e.y0 is not null and e.y0 <= 45 and e.order_quantity <= 500"""))
def q_winsorised_target(spark, sf):
    v = Views(spark, sf)
    df = E.winsorise(E.training_range_filter(E.lead_time_target(enriched(v))))
    return r6(df.select("production_number", "actual_production_days"))


@register("training_filter", S.over_enriched("""
select production_number, round(actual_production_days, 6) as actual_production_days, order_quantity from train""",
                                             train=True))
def q_training_filter(spark, sf):
    v = Views(spark, sf)
    return r6(train_rows(v).select("production_number", "actual_production_days", "order_quantity"))


@register("pending_orders", with_views("""
select production_number, material, created_date from history where actual_finish_date is null""", ["history"]))
def q_pending_orders(spark, sf):
    v = Views(spark, sf)
    return E.pending_orders(v.history).select("production_number", "material", "created_date")
