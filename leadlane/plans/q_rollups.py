"""Roll-up, insight and evaluation queries over the scored stand-in."""

from pyspark.sql import functions as F

from ..operators import enrich as E
from ..operators import evaluate as EV
from ..operators import rollups as R
from ..session import cut_lineage
from ..sources.fixtures import Views, with_views
from . import sqlparts as S
from .registry import enriched, r6, r6sql, register, train_rows


def bround_sql(x: str, d: int) -> str:
    """Spark ``bround`` (half-even on the decimal value) in DuckDB."""
    return f"cast(round_even(cast({x} as decimal(38,12)), {d}) as double)"


def scored_enriched(v: Views):
    return v.scored.join(v.fg.select("material", "material_description", "production_line"), "material", "left")


#: What ``material_tpt`` and the range positions read of the scored orders.
TPT_ROWS = ["production_number", "material", "predicted", "actual", "material_description", "production_line"]


def tpt_rows(v: Views):
    """Scored orders, written once: statistics, medians and positions each read them."""
    return cut_lineage(scored_enriched(v).select(*TPT_ROWS))


def tpt_table(v: Views, rows=None):
    """The ``material_tpt`` table, written once: the classes read it for their median and for their rows."""
    return cut_lineage(R.material_tpt(tpt_rows(v) if rows is None else rows, v.fg))


def errors(v: Views):
    return R.prediction_errors(scored_enriched(v)).filter(F.col("actual").isNotNull())


SE = """select s.*, f.material_description, f.production_line from scored s left join fg f on s.material = f.material"""
ER = f"""select *, actual - predicted as error, abs(actual - predicted) as abs_error,
  abs((actual - predicted) / (actual + {S.EPS})) * 100 as pct_error from se where actual is not null"""
MT = f"""
select m.*, c.current_tpt,
  case when c.current_tpt is not null then {bround_sql('m.predicted_tpt - c.current_tpt', 2)} end as tpt_change
from (select material, {bround_sql('quantile_cont(predicted, 0.5)', 2)} as predicted_tpt,
        count(predicted) as order_count, {bround_sql('coalesce(stddev_samp(predicted), 0)', 2)} as tpt_std,
        min(predicted) as tpt_min, max(predicted) as tpt_max,
        {bround_sql('quantile_cont(actual, 0.5)', 2)} as actual_tpt,
        arg_min(material_description, production_number) as material_description,
        arg_min(production_line, production_number) as production_line
      from se where material is not null group by material) m
left join (select material, arg_min(total_production_time, production_line) as current_tpt
           from fg where material is not null group by material) c on m.material = c.material"""


def over_scored(body: str, extra=None) -> str:
    ctes = [("se", SE), ("er", ER), ("mt", MT)] + list(extra or [])
    return with_views(body, ["scored", "fg"], ctes)


MT_COLS = ["material", "predicted_tpt", "order_count", "tpt_std", "tpt_min", "tpt_max", "actual_tpt",
           "material_description", "production_line", "current_tpt", "tpt_change"]


@register("material_tpt", over_scored(f"select {', '.join(MT_COLS)} from mt"))
def q_material_tpt(spark, sf):
    v = Views(spark, sf)
    return R.material_tpt(tpt_rows(v), v.fg).select(*MT_COLS)


INSIGHT_SQL = """
select material,
  round(diff_pct, 6) as speed_diff_pct,
  case when diff_pct > 20 then 'slow' when diff_pct < -20 then 'fast' else 'normal' end as speed_class,
  case when order_count <= 2 then 'very_small' when order_count <= 9 then 'medium' else 'large' end as sample_class,
  round(cv, 6) as cv,
  case when cv < 0.15 then 'stable' when cv < 0.30 then 'moderate' else 'dispersed' end as stability_class,
  cast((tpt_max - tpt_min) > predicted_tpt * 0.5 as int) as span_warning,
  case when current_tpt is null then null when predicted_tpt - current_tpt > 0.5 then 'up'
       when predicted_tpt - current_tpt < -0.5 then 'down' else 'same' end as drift_class,
  round(case when current_tpt is null then null when current_tpt > 0.01
       then (predicted_tpt - current_tpt) / current_tpt * 100 else 0.0 end, 6) as drift_pct,
  coalesce(cast(abs(predicted_tpt - current_tpt) > 2 as int), 0) as flag_master_gap,
  case when actual_tpt is null then null when abs(err_pct) <= 10 then 'accurate'
       when abs(err_pct) <= 20 then 'moderate_' || case when predicted_tpt - actual_tpt > 0 then 'over' else 'under' end
       else 'large_' || case when predicted_tpt - actual_tpt > 0 then 'over' else 'under' end end as accuracy_class,
  cast(case when predicted_tpt > 0 then tpt_std / predicted_tpt * 100 else 0.0 end > 30 as int) as flag_dispersed,
  cast(order_count <= 2 as int) as flag_few_orders,
  coalesce(cast(abs((predicted_tpt - actual_tpt) / nullif(actual_tpt, 0)) * 100 > 20 as int), 0) as flag_large_error
from (select mt.*,
        case when g.gm > 0 then (predicted_tpt - g.gm) / g.gm * 100 else 0.0 end as diff_pct,
        case when predicted_tpt > 0.01 then tpt_std / predicted_tpt else 0.0 end as cv,
        case when actual_tpt > 0.01 then (predicted_tpt - actual_tpt) / actual_tpt * 100 else 0.0 end as err_pct
      from mt, (select quantile_cont(predicted_tpt, 0.5) as gm from mt) g) t"""

INSIGHT_COLS = ["material", "speed_diff_pct", "speed_class", "sample_class", "cv", "stability_class", "span_warning",
                "drift_class", "drift_pct", "flag_master_gap", "accuracy_class", "flag_dispersed", "flag_few_orders",
                "flag_large_error"]


@register("material_insight", over_scored(INSIGHT_SQL))
def q_material_insight(spark, sf):
    v = Views(spark, sf)
    return r6(R.material_insight(tpt_table(v)).select(*INSIGHT_COLS))


@register("range_position", over_scored("""
select mt.material, round(case when tpt_max - tpt_min > 0.01 then (predicted_tpt - tpt_min) / (tpt_max - tpt_min) else 0.5 end, 6) as position,
  case when (case when tpt_max - tpt_min > 0.01 then (predicted_tpt - tpt_min) / (tpt_max - tpt_min) else 0.5 end) <= 0.33 then 'optimistic'
       when (case when tpt_max - tpt_min > 0.01 then (predicted_tpt - tpt_min) / (tpt_max - tpt_min) else 0.5 end) >= 0.67 then 'conservative'
       else 'centered' end as position_class,
  coalesce(c.n_low, 0) as n_low, order_count - coalesce(c.n_low, 0) as n_high
from mt left join (select se.material, count(case when se.predicted <= mt.predicted_tpt then 1 end) as n_low
                   from se join mt on se.material = mt.material group by se.material) c on mt.material = c.material"""))
def q_range_position(spark, sf):
    v = Views(spark, sf)
    se = tpt_rows(v)
    return r6(R.range_position(se, tpt_table(v, se)))


@register("rank_trend", with_views("""
select a.production_number, a.material, a.rk as rank,
  round(case when a.n >= 6 then avg(b.predicted) else a.predicted end, 6) as trend
from (select *, greatest(3, n // 5) as win from r) a
join r b on a.material is not distinct from b.material
 and b.rk between greatest(a.rk - a.win // 2, 1) and least(a.rk + (a.win - 1 - a.win // 2), a.n)
group by a.production_number, a.material, a.rk, a.n, a.predicted""", ["scored"], [("r", """
select production_number, material, predicted,
  row_number() over (partition by material order by predicted, production_number) as rk,
  count(*) over (partition by material) as n
from scored where predicted is not null""")]))
def q_rank_trend(spark, sf):
    return r6(R.rank_trend(Views(spark, sf).scored))


@register("error_by_days", over_scored("""
select days_bucket, count(actual) as n, round(avg(error), 6) as bias, round(avg(abs_error), 6) as mae,
  round(sqrt(avg(error * error)), 6) as rmse
from (select *, case when actual >= 0 and actual < 1 then '0-1' when actual >= 1 and actual < 3 then '1-3'
                     when actual >= 3 and actual < 5 then '3-5' when actual >= 5 and actual < 10 then '5-10'
                     when actual >= 10 and actual < 999 then '10+' end as days_bucket from er) t
where days_bucket is not null group by days_bucket"""))
def q_error_by_days(spark, sf):
    return r6(R.error_by_days(errors(Views(spark, sf))))


@register("error_bands", over_scored("""
select b.band_order, b.band, coalesce(c.n, 0) as orders,
  """ + bround_sql("coalesce(c.n, 0) * 100.0 / t.total", 1) + """ as pct
from (values (0, 'lt_0.25'), (1, '0.25-0.5'), (2, '0.5-1'), (3, '1-2'), (4, 'gt_2')) b(band_order, band)
left join (select case when abs_error > 0 and abs_error <= 0.25 then 0 when abs_error > 0.25 and abs_error <= 0.5 then 1
                       when abs_error > 0.5 and abs_error <= 1 then 2 when abs_error > 1 and abs_error <= 2 then 3
                       when abs_error > 2 then 4 end as band_order, count(*) as n
           from er group by 1) c on b.band_order = c.band_order,
(select count(*) as total from er) t"""))
def q_error_bands(spark, sf):
    return R.error_bands(errors(Views(spark, sf)))


def half_even_sql(expr: str, digits: int) -> str:
    """Half-even rounding of a value that is first rounded to 9 decimals, in exact decimals."""
    t = f"cast(round({expr}, 9) as decimal(38, 9)) * {10 ** digits}"
    up = f"case when {t} - floor({t}) > 0.5 or ({t} - floor({t}) = 0.5 and floor({t}) % 2 = 1) then 1 else 0 end"
    return f"cast((floor({t}) + {up}) as double) / {10 ** digits}"


def _acc_sql(keys: str) -> str:
    means = {"total_qty": "sum(order_quantity)", "mean_actual": "avg(actual)", "mean_predicted": "avg(predicted)",
             "mae": "avg(abs_error)", "rmse": "sqrt(avg(error * error))"}
    cols = ", ".join(f"{half_even_sql(e, 2)} as {n}" for n, e in means.items())
    return f"""
select {keys}, count(production_number) as orders, {cols}
from er where {' and '.join(k.strip() + ' is not null' for k in keys.split(','))} group by {keys}"""


@register("accuracy_by_material", over_scored(_acc_sql("material, material_description")))
def q_accuracy_by_material(spark, sf):
    return r6(R.group_accuracy(errors(Views(spark, sf)), ["material", "material_description"]))


@register("accuracy_by_line", over_scored(_acc_sql("production_line")))
def q_accuracy_by_line(spark, sf):
    return r6(R.group_accuracy(errors(Views(spark, sf)), ["production_line"]))


@register("accuracy_overall", over_scored("""
select count(*) as orders, round(avg(actual), 6) as mean_actual, round(avg(predicted), 6) as mean_predicted,
  round(avg(abs_error), 6) as mae, round(sqrt(avg(error * error)), 6) as rmse from er"""))
def q_accuracy_overall(spark, sf):
    return r6(R.overall_accuracy(errors(Views(spark, sf))))


@register("material_accuracy", over_scored("""
select material, count(actual) as n, round(avg(actual), 6) as mean_actual, round(avg(predicted), 6) as mean_predicted,
  round(avg(abs_error), 6) as mae from er where material is not null group by material"""))
def q_material_accuracy(spark, sf):
    return r6(R.material_accuracy(errors(Views(spark, sf))))


@register("top_errors", over_scored("""
select production_number, material, round(actual, 6) as actual, round(predicted, 6) as predicted,
  round(abs_error, 6) as abs_error, round(pct_error, 6) as pct_error
from er order by abs_error desc, production_number limit 10"""))
def q_top_errors(spark, sf):
    e = errors(Views(spark, sf))
    return r6(R.top_by(e, [F.desc("abs_error"), F.asc("production_number")], 10)
              .select("production_number", "material", "actual", "predicted", "abs_error", "pct_error"))


@register("top_errors_50", over_scored("""
select production_number, round(abs_error, 6) as abs_error from er order by abs_error desc, production_number limit 50"""))
def q_top_errors_50(spark, sf):
    return r6(R.top_by(errors(Views(spark, sf)), [F.desc("abs_error"), F.asc("production_number")], 50).select("production_number", "abs_error"))


def _histogram_sql(col: str, bins: int) -> str:
    return over_scored(f"""
select bin, round(lo + bin * (hi - lo) / {bins}, 6) as bin_start, count(*) as n
from (select cast(case when hi = lo then 0 else least(floor(({col} - lo) / ((hi - lo) / {bins})), {bins - 1}) end as int) as bin, lo, hi
      from er, (select min({col}) as lo, max({col}) as hi from er) m where {col} is not null) t group by bin, lo, hi""")


@register("error_histogram", _histogram_sql("error", 50))
def q_error_histogram(spark, sf):
    return r6(R.histogram(errors(Views(spark, sf)), "error", 50))


@register("label_histogram", _histogram_sql("actual", 40))
def q_label_histogram(spark, sf):
    return r6(R.histogram(errors(Views(spark, sf)), "actual", 40))


@register("top_mae_materials", over_scored("""
select material, round(avg(abs_error), 6) as mae, count(actual) as n from er where material is not null
group by material order by avg(abs_error) desc, material limit 30"""))
def q_top_mae(spark, sf):
    m = R.material_accuracy(errors(Views(spark, sf)))
    return r6(R.top_by(m, [F.desc("mae"), F.asc("material")], 30).select("material", "mae", "n"))


@register("top_predicted_materials", over_scored("""
select material, predicted_tpt, order_count from mt order by predicted_tpt desc, material limit 30"""))
def q_top_predicted(spark, sf):
    v = Views(spark, sf)
    m = tpt_table(v)
    return R.top_by(m, [F.desc("predicted_tpt"), F.asc("material")], 30).select("material", "predicted_tpt",
                                                                                 "order_count")


def _delay_sql(keys: str, having: str = "") -> str:
    return S.over_enriched(f"""
select {keys}, count(is_delayed) as orders, sum(is_delayed) as delayed, {bround_sql('avg(is_delayed)', 3)} as delay_rate
from enriched group by {keys.split(' as ')[0] if ' as ' not in keys else ', '.join(k.split(' as ')[0] for k in keys.split(', '))}
{having}""")


@register("delay_by_material", S.over_enriched(f"""
select * from (select material, count(is_delayed) as orders, sum(is_delayed) as delayed,
  {bround_sql('avg(is_delayed)', 3)} as delay_rate from enriched group by material) t
where orders > 10 and delay_rate > 0.20"""))
def q_delay_by_material(spark, sf):
    return R.delay_rate(enriched(Views(spark, sf)), ["material"], min_orders=10, min_rate=0.20)


@register("delay_by_line", S.over_enriched(f"""
select production_line, count(is_delayed) as orders, sum(is_delayed) as delayed,
  {bround_sql('avg(is_delayed)', 3)} as delay_rate from enriched group by production_line"""))
def q_delay_by_line(spark, sf):
    return R.delay_rate(enriched(Views(spark, sf)), ["production_line"])


@register("delay_by_quarter", S.over_enriched(f"""
select year(planned_start_date) as year, quarter(planned_start_date) as quarter, count(is_delayed) as orders,
  sum(is_delayed) as delayed, {bround_sql('avg(is_delayed)', 3)} as delay_rate
from enriched group by 1, 2"""))
def q_delay_by_quarter(spark, sf):
    df = enriched(Views(spark, sf))
    return R.delay_rate(df, [F.year("planned_start_date").alias("year"), F.quarter("planned_start_date").alias("quarter")])


V0_DELAY = "coalesce(cast(actual_finish > planned_finish as int), 0)"


@register("plant_delay", with_views(f"""
select plant, count(*) as orders, sum({V0_DELAY}) as delayed, {bround_sql(f'avg({V0_DELAY})', 3)} as delay_rate
from production_orders group by plant""", ["production_orders"]))
def q_plant_delay(spark, sf):
    po = Views(spark, sf).production_orders
    po = po.withColumn("is_delayed", F.coalesce((F.col("actual_finish") > F.col("planned_finish")).cast("int"), F.lit(0)))
    return R.delay_rate(po, ["plant"])


@register("material_id_delay", with_views(f"""
select material_id, count(*) as orders, sum({V0_DELAY}) as delayed, {bround_sql(f'avg({V0_DELAY})', 3)} as delay_rate
from production_orders group by material_id""", ["production_orders"]))
def q_material_id_delay(spark, sf):
    po = Views(spark, sf).production_orders
    po = po.withColumn("is_delayed", F.coalesce((F.col("actual_finish") > F.col("planned_finish")).cast("int"), F.lit(0)))
    return R.delay_rate(po, ["material_id"])


@register("kpi_overview", with_views("""
select count(*) as total, count(actual_finish) as completed, count(*) - count(actual_finish) as pending,
  count(case when actual_finish > planned_finish then 1 end) as delayed,
  count(case when actual_finish <= planned_finish then 1 end) as on_time,
  round(count(case when actual_finish <= planned_finish then 1 end) * 100.0 / count(actual_finish), 6) as on_time_pct,
  round(avg(case when actual_finish > planned_finish then datediff('day', planned_finish, actual_finish) end), 6)
    as mean_delay_of_delayed
from production_orders""", ["production_orders"]))
def q_kpi_overview(spark, sf):
    return r6(R.order_kpis(Views(spark, sf).production_orders))


@register("status_counts", with_views("""
select status, count(*) as n from production_orders where status is not null group by status""",
                                      ["production_orders"]))
def q_status_counts(spark, sf):
    return R.value_counts(Views(spark, sf).production_orders, "status")


@register("delay_stats", S.over_enriched("""
select count(*) as total, sum(is_delayed) as delayed, round(avg(is_delayed), 6) as delay_rate,
  round(avg(delay_days), 6) as avg_delay, max(delay_days) as max_delay, min(delay_days) as min_delay,
  min(planned_start_date) as first_start, max(planned_start_date) as last_start from enriched"""))
def q_delay_stats(spark, sf):
    return r6(R.delay_stats(enriched(Views(spark, sf))))


@register("top_volume", S.over_enriched("""
select material, round(sum(order_quantity), 6) as total_qty from enriched group by material
order by sum(order_quantity) desc, material limit 5"""))
def q_top_volume(spark, sf):
    return r6(R.top_volume(enriched(Views(spark, sf))))


@register("delay_histogram", S.over_enriched("""
select bin, round(lo + bin * (hi - lo) / 20, 6) as bin_start, count(*) as n
from (select cast(case when hi = lo then 0 else least(floor((delay_days - lo) / ((hi - lo) / 20)), 19) end as int) as bin, lo, hi
      from enriched, (select cast(min(delay_days) as double) as lo, cast(max(delay_days) as double) as hi from enriched) m
      where delay_days is not null) t group by bin, lo, hi"""))
def q_delay_histogram(spark, sf):
    df = enriched(Views(spark, sf)).withColumn("delay_days", F.col("delay_days").cast("double"))
    return r6(R.histogram(df, "delay_days", 20))


COMPLEXITY = "total_production_time * order_quantity"


@register("percentile_profile", S.over_enriched(f"""
select count(c) as n, round(avg(c), 6) as mean, round(quantile_cont(c, 0.5), 6) as median, round(stddev_samp(c), 6) as std,
  round(min(c), 6) as min, round(max(c), 6) as max,
  {', '.join(f'round(quantile_cont(c, {p / 100}), 6) as p{p}' for p in R.PERCENTILES)}
from (select {COMPLEXITY} as c from enriched) t"""))
def q_percentile_profile(spark, sf):
    df = enriched(Views(spark, sf)).withColumn("c", F.col("total_production_time") * F.col("order_quantity"))
    return r6(R.percentile_profile(df, "c"))


_OPEN = f"""select h.production_number, f.total_production_time * h.order_quantity as complexity
from history h left join fg f on h.material = f.material where h.actual_finish_date is null"""


def _open_orders(v: Views):
    return (E.pending_orders(E.join_fg(v.history, v.fg))
            .select("production_number", (F.col("total_production_time") * F.col("order_quantity")).alias("complexity")))


def _hist_complexity(v: Views):
    return enriched(v).withColumn("complexity", F.col("total_production_time") * F.col("order_quantity"))


@register("percentile_rank", S.over_enriched("""
select o.production_number, round(o.complexity, 6) as complexity,
  round((select count(*) from enriched e where e.total_production_time * e.order_quantity < o.complexity) * 100.0
        / (select count(total_production_time * order_quantity) from enriched), 6) as percentile,
  (select count(*) from enriched e where e.total_production_time * e.order_quantity < o.complexity) + 1 as rank,
  (select count(total_production_time * order_quantity) from enriched) as n_reference
from open_orders o where o.complexity is not null""", extra=[("open_orders", _OPEN)]))
def q_percentile_rank(spark, sf):
    v = Views(spark, sf)
    return r6(R.percentile_rank(_hist_complexity(v), _open_orders(v), "complexity", "production_number"))


@register("neighbourhood_delay", S.over_enriched("""
select o.production_number, round(o.complexity, 6) as complexity, count(e.is_delayed) as similar,
  round(case when count(e.is_delayed) > 0 then sum(e.is_delayed) * 1.0 / count(e.is_delayed) end, 6) as delay_rate
from open_orders o left join (select total_production_time * order_quantity as c, is_delayed from enriched
                              where total_production_time * order_quantity is not null) e
  on e.c >= o.complexity - 5 and e.c <= o.complexity + 5
where o.complexity is not null group by o.production_number, o.complexity""", extra=[("open_orders", _OPEN)]))
def q_neighbourhood_delay(spark, sf):
    v = Views(spark, sf)
    return r6(R.neighbourhood_delay(_hist_complexity(v), _open_orders(v), "complexity", "production_number"))


@register("label_audit", with_views(f"""
select count(y) as n, round(avg(cast(y <= 1 as double)) * 100, 6) as pct_le_1d,
  round(avg(cast(y <= 2 as double)) * 100, 6) as pct_le_2d, round(stddev_samp(y) / avg(y), 6) as cv
from (select {S.TARGET_EXPR} as y, order_quantity from history) t
where y is not null and y <= 30 and order_quantity <= 500""", ["history"]))
def q_label_audit(spark, sf):
    t = E.lead_time_target(Views(spark, sf).history)
    t = t.filter((F.col("actual_production_days") <= 30) & (F.col("order_quantity") <= 500))
    return r6(R.label_audit(t))


@register("material_overview", over_scored("""
select count(*) as materials, round(avg(predicted_tpt), 6) as mean_predicted_tpt, sum(order_count) as orders,
  round(avg(tpt_std), 6) as mean_std, count(case when abs(tpt_change) > 0.5 then 1 end) as changed_materials from mt"""))
def q_material_overview(spark, sf):
    v = Views(spark, sf)
    return r6(R.material_overview(tpt_table(v)))


AS_OF = "1996-12-31"


@register("material_window_delay", with_views(f"""
select material, count(*) as orders, sum(coalesce(cast(actual_finish_date > planned_finish_date as int), 0)) as delayed,
  round(sum(coalesce(cast(actual_finish_date > planned_finish_date as int), 0)) * 1.0 / count(*), 6) as delay_rate
from history where planned_start_date >= date '{AS_OF}' - 90 and planned_start_date <= date '{AS_OF}'
group by material""", ["history"]))
def q_material_window_delay(spark, sf):
    return r6(R.material_window_delay(Views(spark, sf).history, AS_OF))


@register("sample_orders", with_views("""
select production_number, material, order_quantity, planned_start_date, planned_finish_date, actual, predicted, delay_probability
from scored order by md5(cast(production_number as varchar) || ':42'), production_number limit 10""", ["scored"]))
def q_sample_orders(spark, sf):
    return R.sample_rows(Views(spark, sf).scored, "production_number", 10, 42)


# --- insight bands / evaluation ---------------------------------------------------

BAND_A_SQL = """case when p > 0 and p <= 0.3 then 'low' when p > 0.3 and p <= 0.7 then 'medium'
  when p > 0.7 and p <= 1.0 then 'high' end"""


@register("risk_band_a", with_views(f"""
select production_number, {BAND_A_SQL.replace('p ', 'delay_probability ').replace('p >', 'delay_probability >')} as risk_band,
  round(delay_probability * 100, 1) as probability_pct from scored""", ["scored"]))
def q_risk_band_a(spark, sf):
    s = Views(spark, sf).scored
    return s.select("production_number", EV.risk_band_a(F.col("delay_probability")).alias("risk_band"),
                    F.round(F.col("delay_probability") * 100, 1).alias("probability_pct"))


@register("risk_band_b", with_views("""
select production_number,
  case when delay_probability >= 0.7 then 'high' when delay_probability >= 0.4 then 'medium' else 'low' end as risk_band,
  case when delay_probability >= 0.7 then 'expedite' when delay_probability >= 0.4 then 'monitor' else 'none' end as action
from scored""", ["scored"]))
def q_risk_band_b(spark, sf):
    s = Views(spark, sf).scored
    band = EV.risk_band_b(F.col("delay_probability"))
    return s.select("production_number", band.alias("risk_band"), EV.risk_action(band).alias("action"))


@register("prediction_summary", with_views(f"""
select {BAND_A_SQL.replace('p ', 'delay_probability ').replace('p >', 'delay_probability >')} as risk_band,
  count(*) as orders, count(case when delay_probability > 0.5 then 1 end) as predicted_delays,
  round(avg(round(delay_probability * 100, 1)), 6) as mean_pct
from scored group by 1""", ["scored"]))
def q_prediction_summary(spark, sf):
    return r6(EV.prediction_summary(Views(spark, sf).scored))


REG_SQL = f"""
select count(*) as n, sqrt(avg((actual - predicted) * (actual - predicted))) as rmse, avg(abs(actual - predicted)) as mae,
  case when var_pop(actual) * count(*) > 0
       then 1 - sum((actual - predicted) * (actual - predicted)) / (var_pop(actual) * count(*)) end as r2,
  coalesce(avg(case when (abs(actual) + abs(predicted)) / 2 > 0
                    then abs(actual - predicted) / ((abs(actual) + abs(predicted)) / 2) end) * 100, 0) as smape
from scored where actual is not null and predicted is not null"""


@register("regression_metrics", with_views(f"select n, {r6sql(['rmse', 'mae', 'r2', 'smape'])} from reg",
                                           ["scored"], [("reg", REG_SQL)]))
def q_regression_metrics(spark, sf):
    return r6(EV.regression_metrics(Views(spark, sf).scored))


@register("metric_grades", with_views("""
select n, round(rmse, 6) as rmse, round(mae, 6) as mae, round(r2, 6) as r2, round(smape, 6) as smape,
  case when rmse <= 1 then 'excellent' when rmse <= 2 then 'good' when rmse <= 3 then 'fair' else 'poor' end as rmse_grade,
  case when r2 >= 0.8 then 'excellent' when r2 >= 0.6 then 'good' when r2 >= 0.4 then 'fair' else 'poor' end as r2_grade,
  case when smape <= 10 then 'excellent' when smape <= 20 then 'good' when smape <= 30 then 'fair' else 'poor' end as smape_grade,
  case when cast(rmse <= 2 as int) + coalesce(cast(r2 >= 0.6 as int), 0) + coalesce(cast(smape <= 20 as int), 1) >= 2 then 'usable'
       when cast(rmse <= 2 as int) + coalesce(cast(r2 >= 0.6 as int), 0) + coalesce(cast(smape <= 20 as int), 1) >= 1 then 'needs_work'
       else 'poor' end as verdict
from reg""", ["scored"], [("reg", REG_SQL)]))
def q_metric_grades(spark, sf):
    return r6(EV.metric_grades(EV.regression_metrics(Views(spark, sf).scored)))


def _labelled(v: Views):
    lab = E.order_labels(E.completed_orders(v.history)).select("production_number", "is_delayed")
    return v.scored.select("production_number", "delay_probability").join(lab, "production_number")


LABELLED = """select s.production_number, s.delay_probability, cast(datediff('day', h.planned_finish_date, h.actual_finish_date) > 0 as int) as is_delayed
from scored s join history h on s.production_number = h.production_number where h.actual_finish_date is not null"""


@register("confusion_metrics", with_views("""
select tp, fp, tn, fn, round((tp + tn) * 1.0 / (tp + fp + tn + fn), 6) as accuracy,
  round(case when tp + fp > 0 then tp * 1.0 / (tp + fp) else 0 end, 6) as precision,
  round(case when tp + fn > 0 then tp * 1.0 / (tp + fn) else 0 end, 6) as recall,
  round(case when tp + fp > 0 and tp + fn > 0 and tp > 0
        then 2.0 * (tp * 1.0 / (tp + fp)) * (tp * 1.0 / (tp + fn)) / ((tp * 1.0 / (tp + fp)) + (tp * 1.0 / (tp + fn))) else 0 end, 6) as f1,
  round(case when tn + fp > 0 then tn * 1.0 / (tn + fp) else 0 end, 6) as specificity,
  round(case when tn + fn > 0 then tn * 1.0 / (tn + fn) else 0 end, 6) as npv
from (select count(case when is_delayed = 1 and delay_probability > 0.5 then 1 end) as tp,
             count(case when is_delayed <> 1 and delay_probability > 0.5 then 1 end) as fp,
             count(case when is_delayed <> 1 and delay_probability <= 0.5 then 1 end) as tn,
             count(case when is_delayed = 1 and delay_probability <= 0.5 then 1 end) as fn from lab) c""",
                                         ["scored", "history"], [("lab", LABELLED)]))
def q_confusion_metrics(spark, sf):
    return r6(EV.confusion_metrics(_labelled(Views(spark, sf))))


@register("exact_auc", with_views("""
select round(sum(pos * (neg_below + neg / 2.0)) / (sum(pos) * sum(neg)), 6) as auc, sum(pos) as positives, sum(neg) as negatives
from (select pos, neg, coalesce(sum(neg) over (order by s rows between unbounded preceding and 1 preceding), 0) as neg_below
      from (select delay_probability as s, count(case when is_delayed = 1 then 1 end) as pos,
                   count(case when is_delayed <> 1 then 1 end) as neg from lab group by 1) g) t""",
                                 ["scored", "history"], [("lab", LABELLED)]))
def q_exact_auc(spark, sf):
    df = EV.exact_auc(_labelled(Views(spark, sf)))
    return r6(df.select("auc", F.col("positives").cast("long").alias("positives"),
                        F.col("negatives").cast("long").alias("negatives")))


def _new_model(v: Views):
    return v.scored.select("production_number",
                           (((F.col("production_number") * 29) % 1001).cast("double") / 1000).alias("delay_probability"))


NEW_MODEL = "select production_number, cast((production_number * 29) % 1001 as double) / 1000 as delay_probability from scored"


@register("model_comparison", with_views(f"""
select b.risk_band, coalesce(o.c, 0) as old_orders, coalesce(n.c, 0) as new_orders,
  coalesce(n.c, 0) - coalesce(o.c, 0) as delta
from (values ('high'), ('medium'), ('low')) b(risk_band)
left join (select {BAND_A_SQL.replace('p ', 'delay_probability ').replace('p >', 'delay_probability >')} as risk_band, count(*) as c from scored group by 1) o
  on b.risk_band = o.risk_band
left join (select {BAND_A_SQL.replace('p ', 'delay_probability ').replace('p >', 'delay_probability >')} as risk_band, count(*) as c from newm group by 1) n
  on b.risk_band = n.risk_band""", ["scored"], [("newm", NEW_MODEL)]))
def q_model_comparison(spark, sf):
    v = Views(spark, sf)
    return EV.model_comparison(v.scored, _new_model(v))


@register("probability_movers", with_views("""
select o.production_number, round(o.delay_probability * 100, 1) as old_pct, round(n.delay_probability * 100, 1) as new_pct,
  round(round(n.delay_probability * 100, 1) - round(o.delay_probability * 100, 1), 6) as change
from scored o join newm n on o.production_number = n.production_number
where abs(round(n.delay_probability * 100, 1) - round(o.delay_probability * 100, 1)) > 10
order by round(n.delay_probability * 100, 1) - round(o.delay_probability * 100, 1) desc, o.production_number limit 10""",
                                            ["scored"], [("newm", NEW_MODEL)]))
def q_probability_movers(spark, sf):
    v = Views(spark, sf)
    return r6(EV.probability_movers(v.scored, _new_model(v)))


@register("high_risk_diff", with_views("""
select production_number, 'old_only' as side from scored where delay_probability > 0.7 and delay_probability <= 1
  and production_number not in (select production_number from newm where delay_probability > 0.7 and delay_probability <= 1)
union all
select production_number, 'new_only' as side from newm where delay_probability > 0.7 and delay_probability <= 1
  and production_number not in (select production_number from scored where delay_probability > 0.7 and delay_probability <= 1)""",
                                        ["scored"], [("newm", NEW_MODEL)]))
def q_high_risk_diff(spark, sf):
    v = Views(spark, sf)
    return EV.high_risk_diff(v.scored, _new_model(v))


@register("chronological_split", S.over_enriched("""
select production_number, row_number() over (order by created_date, production_number) - 1 as row_index,
  case when row_number() over (order by created_date, production_number) - 1 < floor(count(*) over () * 0.8)
       then 'train' else 'test' end as split
from train""", train=True))
def q_chronological_split(spark, sf):
    df = EV.chronological_split(train_rows(Views(spark, sf)))
    return df.select("production_number", "row_index", "split")


@register("cv_fold_assignment", S.over_enriched("""
select production_number, idx as row_index,
  case when idx >= n - (n // 6) * 5 and n // 6 > 0 then cast(floor((idx - (n - (n // 6) * 5)) / (n // 6)) + 1 as bigint) end as test_fold
from (select production_number, row_number() over (order by created_date, production_number) - 1 as idx,
             count(*) over () as n from train) t""", train=True))
def q_cv_fold_assignment(spark, sf):
    df = EV.cv_fold_assignment(train_rows(Views(spark, sf)))
    return df.select("production_number", "row_index", F.col("test_fold").cast("long").alias("test_fold"))
