"""Feature queries (P1-P15, W6-W15, A29-A30) over the training rows."""

from pyspark.sql import functions as F

from ..operators import features as FT
from ..sources.fixtures import Views
from . import sqlparts as S
from .registry import TIMED_READ, r6, r6sql, register, train_rows


def fd(a: str, b: str) -> str:
    """DuckDB fractional days from a to b."""
    return f"(date_diff('microsecond', cast({a} as timestamp), cast({b} as timestamp)) / 86400000000.0)"


EPS = S.EPS
TIME_COLS = ["planned_production_days", "create_to_start_gap", "planned_start_month", "planned_start_quarter",
             "planned_start_weekday", "planned_start_day_of_month", "planned_start_is_weekend",
             "planned_start_is_month_start", "planned_start_is_month_end", "planned_finish_month",
             "planned_finish_quarter", "planned_finish_weekday", "qty_per_planned_day", "planned_total_cycle_days",
             "created_year", "created_day_of_year", "planned_prod_ratio"]

TIME_SQL = f"""
select t.*,
  {fd('planned_start_date', 'planned_finish_date')} as planned_production_days,
  {fd('created_date', 'planned_start_date')} as create_to_start_gap,
  month(planned_start_date) as planned_start_month_, quarter(planned_start_date) as planned_start_quarter,
  isodow(planned_start_date) - 1 as planned_start_weekday_, day(planned_start_date) as planned_start_day_of_month,
  cast(isodow(planned_start_date) >= 6 as int) as planned_start_is_weekend,
  cast(day(planned_start_date) <= 5 as int) as planned_start_is_month_start,
  cast(day(planned_start_date) >= 25 as int) as planned_start_is_month_end,
  month(planned_finish_date) as planned_finish_month, quarter(planned_finish_date) as planned_finish_quarter,
  isodow(planned_finish_date) - 1 as planned_finish_weekday,
  order_quantity / ({fd('planned_start_date', 'planned_finish_date')} + {EPS}) as qty_per_planned_day,
  {fd('created_date', 'planned_finish_date')} as planned_total_cycle_days,
  year(created_date) as created_year, dayofyear(created_date) as created_day_of_year,
  {fd('planned_start_date', 'planned_finish_date')} / ({fd('created_date', 'planned_finish_date')} + {EPS}) as planned_prod_ratio
from train t"""


def _time_select(cols):
    out = []
    for c in cols:
        src = c + "_" if c in ("planned_start_month", "planned_start_weekday") else c
        out.append(f"round({src}, 6) as {c}")
    return ", ".join(out)


@register("time_features", S.over_enriched(f"select production_number, {_time_select(TIME_COLS)} from tf",
                                           train=True, extra=[("tf", TIME_SQL)]))
def q_time_features(spark, sf):
    df = FT.time_features(train_rows(Views(spark, sf)))
    return r6(df.select("production_number", *TIME_COLS))


@register("concurrent_load", S.over_enriched(f"""
select production_number,
  case when planned_start_date is null then null
       else cast(count(order_quantity) over (partition by planned_start_date) as double) end as concurrent_orders_on_start,
  round(case when planned_start_date is null then null
       else coalesce(sum(order_quantity) over (partition by planned_start_date), 0) end, 6) as concurrent_qty_on_start,
  round(order_quantity / (case when planned_start_date is null then null
       else coalesce(sum(order_quantity) over (partition by planned_start_date), 0) end + {EPS}), 6) as qty_share_of_day
from train""", train=True))
def q_concurrent_load(spark, sf):
    df = FT.concurrent_load(train_rows(Views(spark, sf)))
    return r6(df.select("production_number", "concurrent_orders_on_start", "concurrent_qty_on_start",
                        "qty_share_of_day"))


def _forward_sql(key: str, spans: list[int], prefix: str) -> str:
    mx = max(spans)
    cols = []
    for d in spans:
        cond = f"b.planned_start_date > a.created_date and b.planned_start_date <= a.created_date + {d}"
        cols.append(f"cast(count(b.production_number) filter (where {cond}) as double) as forward_{d}d_{prefix}_orders")
        cols.append(f"round(coalesce(sum(b.order_quantity) filter (where {cond}), 0), 6) as forward_{d}d_{prefix}_qty")
    return f"""
select a.production_number, {', '.join(cols)}
from train a left join train b
  on a.{key} = b.{key} and a.production_number <> b.production_number
 and b.planned_start_date > a.created_date and b.planned_start_date <= a.created_date + {mx}
group by a.production_number"""


@register("forward_load_line", S.over_enriched(_forward_sql("production_line", [7, 14], "line"), train=True))
def q_forward_load_line(spark, sf):
    df = FT.forward_load(train_rows(Views(spark, sf)))
    return r6(df.select("production_number", "forward_7d_line_orders", "forward_7d_line_qty",
                        "forward_14d_line_orders", "forward_14d_line_qty"))


@register("forward_load_material", S.over_enriched(_forward_sql("material", [7], "material"), train=True))
def q_forward_load_material(spark, sf):
    df = FT.forward_load(train_rows(Views(spark, sf)))
    return r6(df.select("production_number", "forward_7d_material_orders", "forward_7d_material_qty"))


# W6 oracle: range frames over day numbers, null keys masked, W10 fill inclusive.
HIST_SQL = """
select *,
  avg(actual_production_days) over (order by created_date, production_number
      rows between unbounded preceding and current row) as fill,
  case when material is null then null else avg(actual_production_days) over wm end as m_avg,
  case when material is null then null
       when count(actual_production_days) over wm = 1 then 0.0 else stddev_samp(actual_production_days) over wm end as m_std,
  case when material is null then null else max(actual_production_days) over wm end as m_max,
  case when material is null then null
       else arg_max(actual_production_days, dn * 10000000000 + production_number) over wm end as m_last,
  case when production_line is null then null else avg(actual_production_days) over wl end as l_avg,
  case when production_line is null or material is null then null else avg(actual_production_days) over wml end as ml_avg,
  case when material is null then 0 else count(*) over wm30 end as m_c30,
  count(actual_production_days) over wg as g90
from (select *, created_date - date '1970-01-01' as dn from train) t
window wm as (partition by material order by dn range between 90 preceding and 1 preceding),
       wl as (partition by production_line order by dn range between 90 preceding and 1 preceding),
       wml as (partition by material, production_line order by dn range between 90 preceding and 1 preceding),
       wm30 as (partition by material order by dn range between 30 preceding and 1 preceding),
       wg as (order by dn range between 90 preceding and 1 preceding)"""


@register("hist90_material", S.over_enriched(f"""
select production_number,
  round(coalesce(m_avg, fill, 0), 6) as material_avg_production_time_90d,
  round(coalesce(m_std, 0), 6) as material_std_production_time_90d,
  round(coalesce(m_max, fill, 0), 6) as material_max_production_time_90d,
  round(coalesce(m_last, fill, 0), 6) as material_last_production_time,
  round(coalesce(m_std, 0) / (coalesce(m_avg, fill, 0) + {EPS}), 6) as material_cv_production_time
from h""", train=True, extra=[("h", HIST_SQL)]))
def q_hist90_material(spark, sf):
    df = FT.history_features(train_rows(Views(spark, sf), TIMED_READ))
    return r6(df.select("production_number", "material_avg_production_time_90d", "material_std_production_time_90d",
                        "material_max_production_time_90d", "material_last_production_time",
                        "material_cv_production_time"))


@register("hist90_line", S.over_enriched("""
select production_number, round(coalesce(l_avg, fill, 0), 6) as line_avg_production_time_90d from h""",
                                         train=True, extra=[("h", HIST_SQL)]))
def q_hist90_line(spark, sf):
    df = FT.history_features(train_rows(Views(spark, sf), TIMED_READ))
    return r6(df.select("production_number", "line_avg_production_time_90d"))


@register("hist90_material_line", S.over_enriched("""
select production_number, round(coalesce(ml_avg, fill, 0), 6) as material_line_avg_production_time_90d from h""",
                                                  train=True, extra=[("h", HIST_SQL)]))
def q_hist90_material_line(spark, sf):
    df = FT.history_features(train_rows(Views(spark, sf), TIMED_READ))
    return r6(df.select("production_number", "material_line_avg_production_time_90d"))


@register("count30_material", S.over_enriched("""
select production_number, cast(case when g90 > 0 then m_c30 else 0 end as double) as material_order_count_30d from h""",
                                              train=True, extra=[("h", HIST_SQL)]))
def q_count30_material(spark, sf):
    df = FT.history_stats(train_rows(Views(spark, sf), TIMED_READ))
    return df.select("production_number", "material_order_count_30d")


@register("expanding_fill", S.over_enriched("""
select production_number,
  round(avg(actual_production_days) over (order by created_date, production_number
        rows between unbounded preceding and current row), 6) as expanding_mean,
  round(avg(actual_production_days) over (order by created_date, production_number
        rows between unbounded preceding and 1 preceding), 6) as expanding_mean_strict
from train""", train=True))
def q_expanding_fill(spark, sf):
    df = FT.expanding_mean(train_rows(Views(spark, sf), TIMED_READ), name="expanding_mean")
    df = FT.expanding_mean(df, name="expanding_mean_strict", strict=True)
    return r6(df.select("production_number", "expanding_mean", "expanding_mean_strict"))


_TE_SQL = """
select production_number,
  round(coalesce(avg(actual_production_days) over (partition by {key} order by created_date, production_number
                     rows between unbounded preceding and 1 preceding),
                 avg(actual_production_days) over (order by created_date, production_number
                     rows between unbounded preceding and 1 preceding), 0), 6) as {name}
from train"""


@register("target_encoding_material", S.over_enriched(_TE_SQL.format(key="material", name="material_target_encoded"),
                                                      train=True))
def q_te_material(spark, sf):
    df = FT.target_encoding(train_rows(Views(spark, sf), TIMED_READ))
    return r6(df.select("production_number", "material_target_encoded"))


@register("target_encoding_line", S.over_enriched(_TE_SQL.format(key="production_line", name="line_target_encoded"),
                                                  train=True))
def q_te_line(spark, sf):
    df = FT.target_encoding(train_rows(Views(spark, sf), TIMED_READ))
    return r6(df.select("production_number", "line_target_encoded"))


@register("features_v4")
def q_features_v4(spark, sf):
    return r6(FT.features_v4(__import__("leadlane.plans.registry", fromlist=["enriched"]).enriched(Views(spark, sf))))


RATIO_COLS = ["material_family", "material_complexity", "log_order_quantity", "is_high_constraint",
              "mrp_controller_encoded", "is_large_order", "qty_ratio_to_material_avg", "production_line_freq",
              "expected_production_time", "capacity_utilization", "planned_start_day_capacity",
              "day_capacity_utilization"]


@register("ratio_features", S.over_enriched(f"""
select production_number, substr(material, 1, 8) as material_family,
  round(total_production_time * order_quantity, 6) as material_complexity,
  round(ln(1 + order_quantity), 6) as log_order_quantity,
  coalesce(cast(constraint_factor = 5 as int), 0) as is_high_constraint,
  coalesce(cast(mrp_controller = 'CVC' as int), 0) as mrp_controller_encoded,
  coalesce(cast(order_quantity > (select quantile_cont(order_quantity, 0.95) from tf) as int), 0) as is_large_order,
  round(order_quantity / (case when material is null then null else avg(order_quantity) over (partition by material) end + {EPS}), 6)
    as qty_ratio_to_material_avg,
  case when production_line is null then 0.0 else cast(count(*) over (partition by production_line) as double) end
    as production_line_freq,
  round(total_production_time * order_quantity, 6) as expected_production_time,
  round(order_quantity / (line_capacity * planned_production_days + {EPS}), 6) as capacity_utilization,
  case planned_start_weekday_ when 1 then cap_tu when 2 then cap_we when 3 then cap_th when 4 then cap_fr else cap_mo end
    as planned_start_day_capacity,
  round(order_quantity / (case planned_start_weekday_ when 1 then cap_tu when 2 then cap_we when 3 then cap_th
        when 4 then cap_fr else cap_mo end + {EPS}), 6) as day_capacity_utilization
from tf""", train=True, extra=[("tf", TIME_SQL)]))
def q_ratio_features(spark, sf):
    df = train_rows(Views(spark, sf))
    df = FT.line_features(FT.material_features(FT.time_features(df)))
    return r6(df.select("production_number", *RATIO_COLS))


INTER_COLS = ["complexity_capacity_interaction", "qty_time_interaction", "constraint_qty_interaction",
              "expected_planned_ratio", "shortage_qty_interaction", "shortage_complexity_interaction",
              "shortage_ratio_qty_interaction", "total_capacity_available", "workload_intensity"]


@register("interaction_features", S.over_enriched(f"""
select production_number,
  round((total_production_time * order_quantity) * (order_quantity / (line_capacity * planned_production_days + {EPS})), 6)
    as complexity_capacity_interaction,
  round(order_quantity * planned_production_days, 6) as qty_time_interaction,
  round(constraint_factor * order_quantity, 6) as constraint_qty_interaction,
  round((total_production_time * order_quantity) / (planned_production_days + {EPS}), 6) as expected_planned_ratio,
  round(total_shortage_qty * order_quantity, 6) as shortage_qty_interaction,
  round(max_shortage_pct * (total_production_time * order_quantity), 6) as shortage_complexity_interaction,
  round(shortage_component_ratio * order_quantity, 6) as shortage_ratio_qty_interaction,
  round(line_capacity * planned_production_days, 6) as total_capacity_available,
  round(order_quantity / (line_capacity * planned_production_days + {EPS}), 6) as workload_intensity
from tf""", train=True, extra=[("tf", TIME_SQL)]))
def q_interaction_features(spark, sf):
    df = train_rows(Views(spark, sf))
    df = FT.line_features(FT.material_features(FT.time_features(df)))
    df = FT.capacity_features(FT.interaction_features(df))
    return r6(df.select("production_number", *INTER_COLS))


# --- W6-W9 on timestamps: each order created at its own second of the day ------------------

HIST_TS_SQL = """
select *, {fill} as fill,
  case when material is null then null else avg(actual_production_days) over wm end as m_avg,
  case when material is null then null
       when count(actual_production_days) over wm = 1 then 0.0 else stddev_samp(actual_production_days) over wm end as m_std,
  case when material is null then null else max(actual_production_days) over wm end as m_max,
  case when material is null then null
       else arg_max(actual_production_days, cast(s as hugeint) * 10000000000 + production_number) over wm end as m_last,
  case when production_line is null then null else avg(actual_production_days) over wl end as l_avg,
  case when material is null then 0 else count(*) over wm30 end as m_c30,
  count(actual_production_days) over wg as g90
from (select *, cast(created_date - date '1970-01-01' as bigint) * 86400 + production_number % 86400 as s from train) t
window wm as (partition by material order by s range between 7776000 preceding and 1 preceding),
       wl as (partition by production_line order by s range between 7776000 preceding and 1 preceding),
       wm30 as (partition by material order by s range between 2592000 preceding and 1 preceding),
       wg as (order by s range between 7776000 preceding and 1 preceding)""".format(
    fill="avg(actual_production_days) over (order by s, production_number rows between unbounded preceding and current row)")


def _timed(spark, sf):
    """Training rows with created and planned times to the second."""
    at = lambda c, step: F.timestamp_seconds(F.unix_date(c) * 86400 + F.col("production_number") * step % 86400)
    return train_rows(Views(spark, sf), TIMED_READ).withColumns({"created_date": at("created_date", 1), "planned_start_date": at("planned_start_date", 7)})


@register("hist90_timestamps", S.over_enriched("""
select production_number,
  round(coalesce(m_avg, fill, 0), 6) as material_avg_production_time_90d,
  round(coalesce(m_std, 0), 6) as material_std_production_time_90d,
  round(coalesce(m_max, fill, 0), 6) as material_max_production_time_90d,
  round(coalesce(m_last, fill, 0), 6) as material_last_production_time,
  round(coalesce(l_avg, fill, 0), 6) as line_avg_production_time_90d,
  cast(case when g90 > 0 then m_c30 else 0 end as double) as material_order_count_30d
from h""", train=True, extra=[("h", HIST_TS_SQL)]))
def q_hist90_timestamps(spark, sf):
    df = FT.history_features(_timed(spark, sf))
    return r6(df.select("production_number", "material_avg_production_time_90d", "material_std_production_time_90d",
                        "material_max_production_time_90d", "material_last_production_time",
                        "line_avg_production_time_90d", "material_order_count_30d"))


def _forward_ts_sql(key: str, spans: list[int], prefix: str) -> str:
    cols = ", ".join(f"""cast(count(b.production_number) filter (where b.p > a.s and b.p <= a.s + {d * 86400}) as double) as forward_{d}d_{prefix}_orders,
  round(coalesce(sum(b.order_quantity) filter (where b.p > a.s and b.p <= a.s + {d * 86400}), 0), 6) as forward_{d}d_{prefix}_qty""" for d in spans)
    return f"""select a.production_number, {cols} from timed a left join timed b
  on a.{key} = b.{key} and a.production_number <> b.production_number and b.p > a.s and b.p <= a.s + {max(spans) * 86400}
group by a.production_number"""


@register("forward_load_timestamps", S.over_enriched(
    "select * from lines join mats using (production_number)", train=True,
    extra=[("timed", """select production_number, material, production_line, order_quantity,
  cast(created_date - date '1970-01-01' as bigint) * 86400 + production_number % 86400 as s,
  cast(planned_start_date - date '1970-01-01' as bigint) * 86400 + production_number * 7 % 86400 as p from train"""),
           ("lines", _forward_ts_sql("production_line", [7, 14], "line")), ("mats", _forward_ts_sql("material", [7], "material"))]))
def q_forward_load_timestamps(spark, sf):
    df = FT.forward_load(_timed(spark, sf))
    return r6(df.select("production_number", *[f"{p}_{x}" for _, _, p in FT.FORWARD_SPECS for x in ("orders", "qty")]))
