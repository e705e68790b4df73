"""Shared DuckDB CTE fragments for the oracle SQL (independent re-statements of
the operators in plain SQL; never executed by the library itself)."""

from ..sources.fixtures import with_views

EPS = "cast(1e-6 as double)"

SHORTAGE_ROLLUP = f"""
select production_number,
  cast(count(case when abs(coalesce(try_cast(shortage_qty as double), 0)) > 0 then component_material end) > 0 as int) as has_shortage,
  count(case when abs(coalesce(try_cast(shortage_qty as double), 0)) > 0 then component_material end) as shortage_component_count,
  coalesce(sum(case when abs(coalesce(try_cast(shortage_qty as double), 0)) > 0 then abs(try_cast(shortage_qty as double)) end), 0) as total_shortage_qty,
  coalesce(max(case when abs(coalesce(try_cast(shortage_qty as double), 0)) > 0 then abs(try_cast(shortage_qty as double)) end), 0) as max_shortage_qty,
  coalesce(max(case when abs(coalesce(try_cast(shortage_qty as double), 0)) > 0
      then abs(try_cast(shortage_qty as double)) / (coalesce(try_cast(required_qty as double), 0) + {EPS}) end), 0) as max_shortage_pct,
  count(case when abs(coalesce(try_cast(shortage_qty as double), 0)) > 0 then component_material end)
      / (count(distinct component_material) + {EPS}) as shortage_component_ratio,
  coalesce(sum(case when abs(coalesce(try_cast(shortage_qty as double), 0)) > 0 then abs(try_cast(shortage_qty as double)) end), 0)
      / (sum(coalesce(try_cast(required_qty as double), 0)) + {EPS}) as shortage_qty_ratio
from shortage where production_number is not null group by production_number"""

CAP = """
select production_line, cap_mo, cap_tu, cap_we, cap_th, cap_fr,
  case when (cap_mo is not null)::int + (cap_tu is not null)::int + (cap_we is not null)::int
          + (cap_th is not null)::int + (cap_fr is not null)::int > 0
       then (coalesce(cap_mo,0)+coalesce(cap_tu,0)+coalesce(cap_we,0)+coalesce(cap_th,0)+coalesce(cap_fr,0))
          / ((cap_mo is not null)::int + (cap_tu is not null)::int + (cap_we is not null)::int
             + (cap_th is not null)::int + (cap_fr is not null)::int) end as line_capacity
from capacity"""


def enriched_sql(completed_only: bool = True) -> str:
    where = "where h.actual_finish_date is not null" if completed_only else ""
    return f"""
select h.*,
  datediff('day', h.planned_start_date, h.planned_finish_date) as planned_duration_days,
  datediff('day', h.planned_start_date, h.actual_finish_date) as actual_duration_days,
  datediff('day', h.planned_finish_date, h.actual_finish_date) as delay_days,
  cast(datediff('day', h.planned_finish_date, h.actual_finish_date) > 0 as int) as is_delayed,
  f.production_line, f.constraint_factor, f.earliest_start_days, f.total_production_time,
  c.cap_mo, c.cap_tu, c.cap_we, c.cap_th, c.cap_fr, c.line_capacity,
  coalesce(s.has_shortage, 0) as has_shortage, coalesce(s.shortage_component_count, 0) as shortage_component_count,
  coalesce(s.total_shortage_qty, 0) as total_shortage_qty, coalesce(s.max_shortage_qty, 0) as max_shortage_qty,
  coalesce(s.max_shortage_pct, 0) as max_shortage_pct, coalesce(s.shortage_component_ratio, 0) as shortage_component_ratio,
  coalesce(s.shortage_qty_ratio, 0) as shortage_qty_ratio,
  h.order_quantity / nullif(c.line_capacity, 0) as qty_capacity_ratio,
  h.order_quantity * f.total_production_time / nullif(c.line_capacity, 0) as expected_production_days,
  month(h.planned_start_date) as planned_start_month, isodow(h.planned_start_date) - 1 as planned_start_weekday,
  quarter(h.planned_start_date) as planned_start_quarter, year(h.planned_start_date) as planned_start_year,
  cast(h.production_supervisor is not null as int) as has_supervisor
from history h left join fg f on h.material = f.material
  left join cap c on f.production_line = c.production_line
  left join srollup s on h.production_number = s.production_number
{where}"""


TARGET_EXPR = """case when actual_finish_date is null then null
  else greatest(date_diff('microsecond', cast(created_date as timestamp), cast(actual_finish_date as timestamp)) / 86400000000.0, 1.0) end"""

TRAIN_ROWS = f"""
select e.*, least(greatest(e.y0, b.lo), b.hi) as actual_production_days
from (select *, {TARGET_EXPR} as y0 from enriched) e,
     (select quantile_cont(y0, 0.01) as lo, quantile_cont(y0, 0.99) as hi
      from (select {TARGET_EXPR} as y0, order_quantity from enriched) t
      where y0 is not null and y0 <= 45 and order_quantity <= 500) b
where e.y0 is not null and e.y0 <= 45 and e.order_quantity <= 500
  and (e.actual_start_date is null
       or date_diff('microsecond', cast(e.created_date as timestamp), cast(e.actual_start_date as timestamp)) / 86400000000.0 < 3)"""


def base_ctes(completed_only: bool = True, train: bool = False) -> list[tuple[str, str]]:
    ctes = [("srollup", SHORTAGE_ROLLUP), ("cap", CAP), ("enriched", enriched_sql(completed_only))]
    if train:
        ctes.append(("train", TRAIN_ROWS))
    return ctes


def over_enriched(body: str, completed_only: bool = True, train: bool = False,
                  extra: list[tuple[str, str]] | None = None) -> str:
    return with_views(body, ["fg", "capacity", "history", "shortage"],
                      base_ctes(completed_only, train) + list(extra or []))
