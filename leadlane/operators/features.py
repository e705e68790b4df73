"""Lead-time (v4) order features: calendar, workload, history, encodings.

``features_v4`` composes the stages in the reference's order. Every stage is a
``DataFrame -> DataFrame`` function and can be used alone. The total order of
orders is ``(created_date, production_number)``; ``production_number`` breaks
date ties so results are deterministic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clean import WEEKDAY_CAPACITY_COLUMNS, day_capacity
from ..functions.dates import eps_div, fractional_days, weekday_mon0
from ..session import cut_lineage
from . import enrich as E
from .scale import EVENT, ROW, day_records, row_slice, running_totals, with_order_value
from .statistics import SourceStatistics, expanding_mean_table, global_running, labelled_gate  # noqa: F401

TARGET = "actual_production_days"
TIME_ORDER = ["created_date", "production_number"]

# Statistics come from ``stats`` (SourceStatistics over ``source``, by default the rows themselves, or StateStatistics
# over a stored history); each stage joins one table of them.

HISTORY_COLUMNS = ["material_avg_production_time_90d", "material_std_production_time_90d",
                   "material_max_production_time_90d", "material_last_production_time",
                   "line_avg_production_time_90d", "material_line_avg_production_time_90d"]


# --- P1-P4 ------------------------------------------------------------------------

def time_features(df: DataFrame) -> DataFrame:
    """Planned spans, calendar parts, per-day quantity and ratio."""
    ps, pf, cr = F.col("planned_start_date"), F.col("planned_finish_date"), F.col("created_date")
    out = df.withColumns({
        "planned_production_days": fractional_days(ps, pf),
        "create_to_start_gap": fractional_days(cr, ps),
        "planned_start_month": F.month(ps),
        "planned_start_quarter": F.quarter(ps),
        "planned_start_weekday": weekday_mon0(ps),
        "planned_start_day_of_month": F.dayofmonth(ps),
        "planned_finish_month": F.month(pf),
        "planned_finish_quarter": F.quarter(pf),
        "planned_finish_weekday": weekday_mon0(pf),
        "planned_total_cycle_days": fractional_days(cr, pf),
        "created_year": F.year(cr),
        "created_day_of_year": F.dayofyear(cr),
    })
    return out.withColumns({
        "planned_start_is_weekend": F.coalesce(F.col("planned_start_weekday").isin(5, 6), F.lit(False)).cast("int"),
        "planned_start_is_month_start": F.coalesce(F.col("planned_start_day_of_month") <= 5, F.lit(False)).cast("int"),
        "planned_start_is_month_end": F.coalesce(F.col("planned_start_day_of_month") >= 25, F.lit(False)).cast("int"),
        "qty_per_planned_day": eps_div("order_quantity", "planned_production_days"),
        "planned_prod_ratio": eps_div("planned_production_days", "planned_total_cycle_days"),
    })


def by_day(table: DataFrame, rows: DataFrame, col: str) -> DataFrame:
    """A table of a row per value of ``col``: broadcast if those are dates, whose number the calendar bounds."""
    return F.broadcast(table) if dict(rows.dtypes)[col] == "date" else table


def with_creation_value(df: DataFrame) -> DataFrame:
    """Rows with ``_ov``, the order value of their creation, as they come if they have it: look-ups by the same key and
    the same ``_ov`` column follow each other without another exchange."""
    return df if "_ov" in df.columns else with_order_value(df, "created_date", "_ov")[0]


# --- W14 --------------------------------------------------------------------------

def concurrent_load(df: DataFrame, source: DataFrame | None = None, stats=None) -> DataFrame:
    """Orders (non-null quantity) and quantity starting on the same planned day,
    and this order's share. Aggregate + join back, so a busy day is never one task.
    ``source`` (default ``df``) is the row set the statistics are taken over."""
    stats = stats or SourceStatistics(source if source is not None else df)
    out = df.join(by_day(stats.starting(), df, "planned_start_date"), "planned_start_date", "left")
    return out.withColumn("qty_share_of_day", eps_div("order_quantity", "concurrent_qty_on_start"))


# --- W8 / W9 ----------------------------------------------------------------------

FORWARD_SPECS = [("production_line", 7, "forward_7d_line"), ("production_line", 14, "forward_14d_line"),
                 ("material", 7, "forward_7d_material")]


def others_to_come(prefix: str, key: str, span: int, n: Column, q: Column) -> dict[str, Column]:
    """Number and quantity of the orders that start in (_ov, _ov + span] without the row's own."""
    own = F.coalesce((F.col("_ev") > F.col("_ov")) & (F.col("_ev") <= F.col("_ov") + F.lit(span))
                     & F.col(key).isNotNull(), F.lit(False))
    return {f"{prefix}_orders": (F.coalesce(n, F.lit(0)) - F.when(own, 1).otherwise(0)).cast("double"),
            f"{prefix}_qty": (F.coalesce(q, F.lit(0.0))
                              - F.when(own, F.coalesce(F.col("order_quantity"), F.lit(0.0))).otherwise(0.0))}


def forward_load(df: DataFrame, source: DataFrame | None = None, stats=None) -> DataFrame:
    """*other* orders whose planned start falls in (created, created + k days],
    same line (7 and 14 days) and same material (7 days). Null key -> 0."""
    stats = stats or SourceStatistics(source if source is not None else df)
    out, _ = with_order_value(with_creation_value(df), "planned_start_date", "_ev")
    unit = stats.unit
    by_key: dict[str, dict[str, int]] = {}
    for key, days, prefix in FORWARD_SPECS:
        by_key.setdefault(key, {})[prefix] = days
    for key, spans in by_key.items():
        if key not in df.columns:
            out = out.withColumns({f"{p}_{s}": F.lit(0.0) for p in spans for s in ("orders", "qty")})
            continue
        table = stats.forward(key, {f"_fw{p}": d for p, d in spans.items()})
        out = out.join(table.withColumnRenamed("_fv", "_ov"), [key, "_ov"], "left")
        for prefix, days in spans.items():
            n, q = f"_fw{prefix}_n", f"_fw{prefix}_q"
            out = out.withColumns(others_to_come(prefix, key, days * unit, F.col(n), F.col(q))).drop(n, q)
    return out.drop("_ev") if "_ov" in df.columns else out.drop("_ov", "_ev")


# --- P5-P7, W15 ---------------------------------------------------------------------

def material_features(df: DataFrame, approx_percentile: bool = False, source: DataFrame | None = None, stats=None) -> DataFrame:
    """Family, complexity, log quantity, flags, large-order flag
    against the P95 quantity of ``source``, ratio to the material's mean quantity."""
    stats = stats or SourceStatistics(source if source is not None else df)
    q = F.col("order_quantity")
    out = df.withColumns({
        "material_family": F.substring(F.col("material"), 1, 8),
        "material_complexity": F.col("total_production_time") * q,
        "log_order_quantity": F.log1p(q),
        "is_high_constraint": F.coalesce(F.col("constraint_factor") == 5, F.lit(False)).cast("int"),
        "mrp_controller_encoded": (F.coalesce(F.col("mrp_controller") == "CVC", F.lit(False)).cast("int")
                                   if "mrp_controller" in df.columns else F.lit(0)),
    })
    p95 = stats.quantity_p95(approx_percentile)
    # one-row table: broadcasting it is bounded by construction
    out = out.crossJoin(F.broadcast(p95)) \
        .withColumn("is_large_order", F.coalesce(q > F.col("_p95"), F.lit(False)).cast("int")).drop("_p95")
    if "_mat_avg_qty" not in out.columns:
        out = out.join(stats.material_quantity(), "material", "left")
    return out.withColumn("qty_ratio_to_material_avg", eps_div("order_quantity", "_mat_avg_qty")) \
        .drop("_mat_avg_qty")


# --- A30, P8, P9 --------------------------------------------------------------------

def line_features(df: DataFrame, source: DataFrame | None = None, stats=None) -> DataFrame:
    """Line frequency (null line -> 0), expected time, utilisation,
    capacity of the planned-start weekday."""
    q = F.col("order_quantity")
    if "production_line" in df.columns:
        out = df
        if "production_line_freq" not in out.columns:
            out = df.join((stats or SourceStatistics(source if source is not None else df)).line_orders(), "production_line", "left")
        out = out.fillna(0.0, subset=["production_line_freq"])
    else:
        out = df.withColumn("production_line_freq", F.lit(0.0))
    out = out.withColumns({
        "expected_production_time": F.col("total_production_time") * q,
        "capacity_utilization": eps_div(q, F.col("line_capacity") * F.col("planned_production_days")),
    })
    if all(c in out.columns for c in WEEKDAY_CAPACITY_COLUMNS):
        out = out.withColumn("planned_start_day_capacity", day_capacity("planned_start_weekday"))
        out = out.withColumn("day_capacity_utilization", eps_div(q, "planned_start_day_capacity"))
    return out


# --- W6, W7, W10, P10 -----------------------------------------------------------------

def _var_from_sums(n, s, s2):
    return F.when(n > 1, F.greatest((s2 - s * s / n) / (n - 1), F.lit(0.0)))


def history_stats(df: DataFrame, lookback_days: int = 90, count_days: int = 30,
                  target: str = TARGET, source: DataFrame | None = None, stats=None) -> DataFrame:
    """W6/W7 raw: statistics of labelled orders created in [created - 90 d, created)
    for the same material, line and (material, line); 30-day material order
    count (only when any labelled order exists in the 90-day window across all
    materials, else 0). Null keys match nothing. No null filling here.

    Each statistic is a window over one row per (key, creation day), joined
    back on (key, day): work per key is bounded by its number of days."""
    stats = stats or SourceStatistics(source if source is not None else df, target)
    out = with_creation_value(df)
    mat = stats.look_back(["material"], {
        -lookback_days: {"_mn": ("sum", "_n"), "_ms": ("sum", "_s"), "_ms2": ("sum", "_s2"),
                         "material_max_production_time_90d": ("max", "_mx"), "_mlast": ("max", "_last")},
        -count_days: {"_c30": ("sum", "_c")}})
    # What rows look up is worked out in the tables: fewer columns meet the rows.
    mat = mat.withColumns(material_history(F.col("_mn"), F.col("_ms"), F.col("_ms2"), F.col("_mlast"))).drop("_mn", "_ms", "_ms2", "_mlast")
    out = out.join(mat, ["material", "_ov"], "left")
    for keys, name in ((["production_line"], "line_avg_production_time_90d"),
                       (["material", "production_line"], "material_line_avg_production_time_90d")):
        if not all(k in df.columns for k in keys):
            out = out.withColumn(name, F.lit(None).cast("double"))
            continue
        t = stats.look_back(keys, {-lookback_days: {"_wn": ("sum", "_n"), "_ws": ("sum", "_s")}})
        t = t.withColumn(name, F.when(F.col("_wn") > 0, F.col("_ws") / F.col("_wn"))).drop("_wn", "_ws")
        out = out.join(t, keys + ["_ov"], "left")
    out = gated_count(out, by_day(stats.gate(lookback_days), df, "created_date"))
    return out if "_ov" in df.columns else out.drop("_ov")


def material_history(n: Column, s: Column, s2: Column, last: Column) -> dict[str, Column]:
    return {"material_avg_production_time_90d": F.when(n > 0, s / n),
            "material_std_production_time_90d": F.when(n == 1, F.lit(0.0)).otherwise(F.sqrt(_var_from_sums(n, s, s2))),
            "material_last_production_time": last["y"]}


def gated_count(df: DataFrame, gate: DataFrame) -> DataFrame:
    """The 30-day count ``_c30`` where any labelled order was created in the look-back."""
    out = df.join(gate.withColumnRenamed("_ov", "_gov"), F.col("_ov") == F.col("_gov"), "left").drop("_gov")
    return out.withColumn("material_order_count_30d",
                          F.when(F.coalesce(F.col("_g90"), F.lit(0)) > 0,
                                 F.coalesce(F.col("_c30"), F.lit(0))).otherwise(0).cast("double")) \
        .drop("_c30", "_g90")


# --- W6-W9 over days ------------------------------------------------------------------

def windowed_days(df: DataFrame, stats, lookback_days: int = 90, count_days: int = 30, target: str = TARGET) -> DataFrame:
    """``forward_load`` and ``history_stats`` of rows whose creation and planned start are days, with the orders of the
    line and the mean quantity of the material. The rows are dealt once a key, and windows over ``day_records`` give
    them what the tables of ``stats`` have by key and day. ``df``: all rows that ``stats`` are of, or new ones."""
    out, _ = with_order_value(with_creation_value(df), "planned_start_date", "_ev")
    all_rows, out = out, out.drop("created_date", "planned_start_date")
    y, kind, at = F.col(target), F.col("_kind"), F.col("_v") * F.lit(86_400_000_000)
    parts = {"_n": y.isNotNull().cast("long"), "_s": y, "_s2": y * y, "_mx": y, "_c": F.when(kind != EVENT, 1).cast("long"),
             "_last": F.when(y.isNotNull(), F.struct(at.alias("t"), F.col("production_number").alias("k"), y.alias("y")))}
    coming = {"_en": F.lit(1).cast("long"), "_eq": F.col("order_quantity")}
    for key, total in (("production_line", stats.line_orders), ("material", stats.material_quantity)):
        spans = {p: days for k, days, p in FORWARD_SPECS if k == key}
        forward = max(spans.values())
        if key not in df.columns:
            out = out.withColumns({f"{p}_{x}": F.lit(0.0) for p in spans for x in ("orders", "qty")}
                                  | {c: F.lit(None).cast("double") for c in ("line_avg_production_time_90d", "material_line_avg_production_time_90d")})
            continue
        lines = key == "material" and "production_line" in df.columns
        entry = [target] if key == "production_line" else [target, "production_number", *["production_line"] * lines]
        stored = stats.stored(key, lookback_days, forward)
        records = day_records(out, key, lookback_days, forward, entry, ["order_quantity"], stored=stored)
        # Worked out after the exchange, which carries the target and the quantity alone.
        has = lambda c, e: e if stored is None else F.coalesce(F.col(c), e)
        records = records.withColumns({c: has(c, e) for c, e in parts.items()} | {c: F.when(kind == EVENT, has(c, e)) for c, e in coming.items()})
        by = [key, "_slice"]
        frame = lambda e, lo, hi, *more: e.over(Window.partitionBy(*by, *more).orderBy("_v").rangeBetween(lo, hi))
        seen = {f"_fw{p}_{x}": frame(F.sum(f"_e{x}"), 1, days) for p, days in spans.items() for x in ("n", "q")}
        seen |= {f"_w{c}": frame(fn(c), -lookback_days, -1) for c, fn in (("_n", F.sum), ("_s", F.sum))}
        if key == "material":
            seen |= {f"_w{c}": frame(fn(c), -days, -1) for c, fn, days in (
                ("_s2", F.sum, lookback_days), ("_mx", F.max, lookback_days), ("_last", F.max, lookback_days), ("_c", F.sum, count_days))}
        records = records.select("*", *[e.alias(c) for c, e in seen.items()])
        if lines:
            records = records.select("*", *[frame(F.sum(c), -lookback_days, -1, "production_line").alias(f"_l{c}") for c in ("_n", "_s")])
        rows = records.where(kind == ROW).withColumnRenamed("_v", "_ov")
        found = F.col(key).isNotNull() & F.col("_ov").isNotNull()
        w = lambda c: F.when(found, F.col(c))
        made = {c: e for p, days in spans.items() for c, e in others_to_come(p, key, days, w(f"_fw{p}_n"), w(f"_fw{p}_q")).items()}
        if key == "production_line":
            made["line_avg_production_time_90d"] = F.when(w("_w_n") > 0, F.col("_w_s") / F.col("_w_n"))
        else:
            made |= material_history(w("_w_n"), w("_w_s"), w("_w_s2"), w("_w_last")) | {"material_max_production_time_90d": w("_w_mx"), "_c30": w("_w_c")}
        if lines:
            both = found & F.col("production_line").isNotNull() & (F.col("_l_n") > 0)
            made["material_line_avg_production_time_90d"] = F.when(both, F.col("_l_s") / F.col("_l_n"))
        rows = rows.select(*by, "_ov", *[c for c in out.columns if c not in (key, "_ov")], *[e.alias(c) for c, e in made.items()])
        # Totals of a key go to the slices that its rows have.
        slices = all_rows.where(F.col(key).isNotNull()).select(key, row_slice(key, 2 * lookback_days).alias("_slice")).distinct()
        out = rows.join(slices.join(total(), key), by, "left").drop("_slice")
    return gated_count(out, F.broadcast(stats.gate(lookback_days)))


def expanding_mean(df: DataFrame, target: str = TARGET, name: str = "_expanding_mean",
                   strict: bool = False, source: DataFrame | None = None) -> DataFrame:
    """W10 / W13 attached to rows."""
    t = expanding_mean_table(source if source is not None else df, target, name, strict)
    return df.join(t, "production_number", "left")


def history_features(df: DataFrame, lookback_days: int = 90, strict_fill: bool = False,
                     target: str = TARGET, source: DataFrame | None = None,
                     global_means: DataFrame | None = None, stats=None) -> DataFrame:
    """W6/W7 + W10 fill + P10. Missing averages/max/last take the expanding mean
    (inclusive of the current order unless ``strict_fill``), std takes 0, then 0."""
    src = source if source is not None else df
    return filled_history(history_stats(df, lookback_days, target=target, source=src, stats=stats), strict_fill, target, src, global_means)


def filled_history(out: DataFrame, strict_fill: bool = False, target: str = TARGET, src: DataFrame | None = None,
                   global_means: DataFrame | None = None) -> DataFrame:
    """What ``history_stats`` found with its gaps filled."""
    if global_means is not None:
        out = out.join(global_means.select("production_number",
                                           F.col("_strict_mean" if strict_fill else "_incl_mean").alias("_fill")),
                       "production_number", "left")
    else:
        out = expanding_mean(out, target, "_fill", strict=strict_fill, source=src)
    fills = {c: F.coalesce(F.col(c), F.col("_fill"), F.lit(0.0)) for c in HISTORY_COLUMNS}
    fills["material_std_production_time_90d"] = F.coalesce(F.col("material_std_production_time_90d"), F.lit(0.0))
    out = out.withColumns(fills).drop("_fill")
    return out.withColumn("material_cv_production_time",
                          eps_div("material_std_production_time_90d", "material_avg_production_time_90d"))


# --- W11-W13 --------------------------------------------------------------------------

def target_encoding(df: DataFrame, target: str = TARGET, source: DataFrame | None = None,
                    global_means: DataFrame | None = None, stats=None) -> DataFrame:
    """Mean target of strictly earlier orders of the same material / line
    (null keys form their own group); fallback global strictly-earlier mean, then 0."""
    src = source if source is not None else df
    g = (global_means.select("production_number", F.col("_strict_mean").alias("_global_prev"))
         if global_means is not None else expanding_mean_table(src, target, "_global_prev", strict=True))
    out = df.join(g, "production_number", "left")
    specs = [("material", "material_target_encoded")]
    if "production_line" in df.columns:
        specs.append(("production_line", "line_target_encoded"))
    for key, name in specs:
        t = (stats or SourceStatistics(src, target)).expanding(key)
        out = out.join(t, "production_number", "left") \
            .withColumn(name, F.coalesce(F.col("_te"), F.col("_global_prev"), F.lit(0.0))).drop("_te")
    return out.drop("_global_prev")


# --- P11-P13 --------------------------------------------------------------------------

def interaction_features(df: DataFrame) -> DataFrame:
    """Products and ratios of earlier features."""
    q = F.col("order_quantity")
    out = df.withColumns({
        "complexity_capacity_interaction": F.col("material_complexity") * F.col("capacity_utilization"),
        "qty_time_interaction": q * F.col("planned_production_days"),
        "constraint_qty_interaction": F.col("constraint_factor") * q,
        "expected_planned_ratio": eps_div("expected_production_time", "planned_production_days"),
    })
    if "has_shortage" in df.columns:
        out = out.withColumns({
            "shortage_qty_interaction": F.col("total_shortage_qty") * q,
            "shortage_complexity_interaction": F.col("max_shortage_pct") * F.col("material_complexity"),
            "shortage_ratio_qty_interaction": F.col("shortage_component_ratio") * q,
        })
    return out


def capacity_features(df: DataFrame) -> DataFrame:
    """Available capacity over the planned span and workload intensity."""
    out = df.withColumn("total_capacity_available", F.col("line_capacity") * F.col("planned_production_days"))
    return out.withColumn("workload_intensity", eps_div("order_quantity", "total_capacity_available"))


# --- pipeline ---------------------------------------------------------------------------

def features_v4(enriched: DataFrame, training: bool = True, max_wait_days: float | None = 3.0,
                strict_fill: bool = False, approx_percentiles: bool = False, materialize: bool = True,
                state=None, rows: Column | None = None) -> DataFrame:
    """Full v4 feature table. ``training=True`` applies T2 -> F3 -> T3 -> F4 first;
    ``training=False`` (P16) keeps every order and the target where known.

    Every statistic is computed from the same base row set and joined back by
    its natural key, so the plan grows linearly with the number of stages.
    ``state`` (a HistoryState): the rows are new orders; statistics are looked up
    in the stored history and take the new orders into account too. ``rows``: the
    features of these rows only; the statistics are of all.
    """
    base = E.training_rows(enriched, max_wait_days, approx_percentiles) if training else E.lead_time_target(enriched)
    if materialize and not training:
        # The base feeds ~20 statistics; cut its lineage once (reliable checkpoint
        # in the shared checkpoint folder) so each reads a scan, not the joins.
        # Training rows are scans of what ``training_rows`` wrote.
        base = cut_lineage(base)
    # Statistics read only the few columns that they need, and rows look them up with no more than keys, dates and
    # quantity; the wide rows join what was looked up once.
    slim = base.select(*[c for c in STATISTICS_READ if c in base.columns])
    stats = SourceStatistics(slim) if state is None else state.statistics(slim)
    gm = stats.global_means()  # W10 and W13 from one pass
    wide = base if rows is None else base.where(rows)
    days = {"date"} == {t for c, t in base.dtypes if c in ("created_date", "planned_start_date")}
    if days:
        df = windowed_days(slim if rows is None else base.select(*slim.columns, rows.alias("_asked")), stats)
        df = filled_history(df if rows is None else df.where("_asked").drop("_asked"), strict_fill, global_means=gm)
    else:
        look = slim if rows is None else slim.join(wide.select("production_number"), "production_number", "left_semi")
        df = concurrent_load(with_creation_value(look.drop(TARGET)), stats=stats)
        if "production_line" in look.columns:
            df = df.join(stats.line_orders(), "production_line", "left")
        df = df.join(stats.material_quantity(), "material", "left")
        df = forward_load(df, stats=stats)
        df = history_features(df, strict_fill=strict_fill, global_means=gm, stats=stats)
    df = target_encoding(df, global_means=gm, stats=stats)
    made = [c for c in df.columns if c not in slim.columns and c not in ("_ov", "_ev")]
    df = time_features(wide.join(df.select("production_number", *made), "production_number"))
    if days:
        df = concurrent_load(df, stats=stats)
    df = material_features(df, approx_percentiles, stats=stats)
    df = line_features(df, stats=stats)
    df = interaction_features(df)
    return capacity_features(df)


#: What the window and group statistics of ``features_v4`` read.
STATISTICS_READ = ["production_number", "material", "production_line", "created_date", "planned_start_date", TARGET,
                   "order_quantity"]


#: What ``features_v4`` reads of enriched orders; all other columns it hands on.
FEATURES_READ = ["production_number", "material", "production_line", "created_date", "planned_start_date", "planned_finish_date",
                 "actual_start_date", "actual_finish_date", "order_quantity", "total_production_time", "constraint_factor",
                 "mrp_controller", "line_capacity", *WEEKDAY_CAPACITY_COLUMNS, "has_shortage", "total_shortage_qty",
                 "max_shortage_pct", "shortage_component_ratio"]


#: What the model inputs need of enriched orders.
MODEL_READ = [*FEATURES_READ, "earliest_start_days", "planned_duration_days", "qty_capacity_ratio", "expected_production_days",
              *[c for c in E.SHORTAGE_COLUMNS if c not in FEATURES_READ]]


# --- P15: what the model may read, by the stage that makes it ------------------------------

ORDER_INPUTS = ["order_quantity", "planned_duration_days", "qty_capacity_ratio", "expected_production_days"]
MASTER_INPUTS = ["constraint_factor", "earliest_start_days", "total_production_time", "line_capacity"]
SHORTAGE_INPUTS = ["has_shortage", "shortage_component_count", "total_shortage_qty", "max_shortage_qty",
                   "max_shortage_pct", "shortage_component_ratio", "shortage_qty_ratio"]
CALENDAR_INPUTS = [f"planned_start_{p}" for p in ("month", "quarter", "weekday", "day_of_month", "is_weekend",
                                                  "is_month_start", "is_month_end")] \
    + [f"planned_finish_{p}" for p in ("month", "quarter", "weekday")] + ["created_year", "created_day_of_year"]
SPAN_INPUTS = ["planned_production_days", "create_to_start_gap", "planned_total_cycle_days", "qty_per_planned_day",
               "planned_prod_ratio"]
LOAD_INPUTS = ["concurrent_orders_on_start", "concurrent_qty_on_start", "qty_share_of_day"] \
    + [f"{p}_{x}" for _, _, p in FORWARD_SPECS for x in ("orders", "qty")]
MATERIAL_INPUTS = ["material_complexity", "log_order_quantity", "is_high_constraint", "mrp_controller_encoded",
                   "is_large_order", "qty_ratio_to_material_avg"]
LINE_INPUTS = ["production_line_freq", "expected_production_time", "capacity_utilization",
               "planned_start_day_capacity", "day_capacity_utilization"]
HISTORY_INPUTS = [*HISTORY_COLUMNS, "material_order_count_30d", "material_cv_production_time",
                  "material_target_encoded", "line_target_encoded"]
INTERACTION_INPUTS = ["complexity_capacity_interaction", "qty_time_interaction", "constraint_qty_interaction",
                      "expected_planned_ratio", "shortage_qty_interaction", "shortage_complexity_interaction",
                      "shortage_ratio_qty_interaction", "total_capacity_available", "workload_intensity"]
MODEL_INPUTS = [*ORDER_INPUTS, *MASTER_INPUTS, *SHORTAGE_INPUTS, *CALENDAR_INPUTS, *SPAN_INPUTS, *LOAD_INPUTS,
                *MATERIAL_INPUTS, *LINE_INPUTS, *HISTORY_INPUTS, *INTERACTION_INPUTS]


def feature_columns(df: DataFrame) -> list[str]:
    """The allowed model inputs that ``df`` has. A column that no stage declares never enters the model."""
    return [c for c in MODEL_INPUTS if c in df.columns]
