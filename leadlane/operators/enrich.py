"""Order-grain enrichment: master-data joins, shortage roll-up, labels, filters.

Joins are plain equi-joins. Master tables (finished goods, line capacity) are
left to AQE's runtime broadcast decision, which is size-checked against
``spark.sql.adaptive.autoBroadcastJoinThreshold``; nothing here forces a
broadcast of a table whose size is not bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clean import WEEKDAY_CAPACITY_COLUMNS, row_mean
from ..functions.dates import eps_div, floor_days, fractional_days, safe_div, weekday_mon0
from ..session import cut_lineage
from .scale import exact_quantiles

FG_JOIN_COLUMNS = ["material", "production_line", "constraint_factor", "earliest_start_days",
                   "total_production_time"]

SHORTAGE_COLUMNS = ["has_shortage", "shortage_component_count", "total_shortage_qty", "max_shortage_qty",
                    "max_shortage_pct", "shortage_component_ratio", "shortage_qty_ratio"]


# --- F1 / F2 ---------------------------------------------------------------------

def completed_orders(df: DataFrame, finish: str = "actual_finish_date") -> DataFrame:
    """orders with an actual finish."""
    return df.filter(F.col(finish).isNotNull())


def pending_orders(df: DataFrame, finish: str = "actual_finish_date") -> DataFrame:
    """open orders (no actual finish)."""
    return df.filter(F.col(finish).isNull())


# --- T1 --------------------------------------------------------------------------

def order_labels(df: DataFrame) -> DataFrame:
    """Planned / actual duration, delay (floor days) and the delayed flag."""
    return df.withColumns({
        "planned_duration_days": floor_days("planned_start_date", "planned_finish_date"),
        "actual_duration_days": floor_days("planned_start_date", "actual_finish_date"),
        "delay_days": floor_days("planned_finish_date", "actual_finish_date"),
    }).withColumn("is_delayed", (F.col("delay_days") > 0).cast("int"))


# --- J1 / J2 / J3 -----------------------------------------------------------------

def join_fg(orders: DataFrame, fg: DataFrame, dedupe: bool = False) -> DataFrame:
    """Left join finished-goods master on material (5 columns).

    FG may hold several lines per material; the reference fans out. With
    ``dedupe=True`` one line per material is kept (the smallest line code).
    """
    fg5 = fg.select(*FG_JOIN_COLUMNS)
    if dedupe:
        fg5 = (fg5.filter(F.col("material").isNotNull()).groupBy("material")
               .agg(F.min_by(F.struct(*FG_JOIN_COLUMNS[1:]), F.col("production_line")).alias("_fg"))
               .select("material", "_fg.*"))
    return orders.join(fg5, "material", "left")


def capacity_table(capacity: DataFrame) -> DataFrame:
    """Normalise capacity to ``production_line, [cap_mo..cap_fr], line_capacity``.

    Weekday form: line_capacity = mean of the non-null Mon-Fri values (C24).
    Legacy form: a single ``line_capacity`` (or ``Capacity``) column.
    """
    if all(c in capacity.columns for c in WEEKDAY_CAPACITY_COLUMNS):
        return capacity.select("production_line", *[F.col(c).cast("double").alias(c) for c in WEEKDAY_CAPACITY_COLUMNS],
                               row_mean(WEEKDAY_CAPACITY_COLUMNS).alias("line_capacity"))
    cap = "line_capacity" if "line_capacity" in capacity.columns else "Capacity"
    return capacity.select("production_line", F.col(cap).cast("double").alias("line_capacity"))


def join_capacity(orders: DataFrame, capacity: DataFrame) -> DataFrame:
    """Left join line capacity on production_line (null line matches nothing)."""
    return orders.join(capacity_table(capacity), "production_line", "left")


def join_master(orders: DataFrame, fg: DataFrame, capacity: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """J1 and J2 with one join of the orders: capacity meets the finished goods first, as the line is theirs. Rows and
    columns are those of ``join_capacity(join_fg(orders, fg), capacity)``, and with ``also`` those of a further left
    join with these columns of ``fg`` by material."""
    fg5 = fg.select(*[c for c in FG_JOIN_COLUMNS if c in fg.columns])
    master = join_capacity(fg5, capacity)
    if also:
        master = master.join(fg.select("material", *also), "material", "left")
    own = [c for c in orders.columns if c != "material"]
    made = [c for c in [*fg5.columns, *master.columns] if c not in ("material", "production_line")]
    return orders.join(master, "material", "left").select("production_line", "material", *own, *dict.fromkeys(made))


def shortage_rollup(shortage: DataFrame) -> DataFrame:
    """A1: one row per order, a single pass with conditional aggregates.

    Quantities are coerced (bad -> 0); shortage is taken as absolute value; the
    shortage-only figures count component *rows* while the denominator counts
    *distinct* components, so the ratio may exceed 1 (as in the source).
    Rows are dealt by order once: distinct components and sums need no other exchange.
    """
    s = (shortage.select("production_number", "component_material", "required_qty", "shortage_qty")
         .filter(F.col("production_number").isNotNull()).repartition("production_number")
         .withColumn("_req", F.coalesce(F.col("required_qty").cast("string").try_cast("double"), F.lit(0.0)))
         .withColumn("_short", F.abs(F.coalesce(F.col("shortage_qty").cast("string").try_cast("double"), F.lit(0.0)))))
    pos = F.col("_short") > 0
    agg = s.groupBy("production_number").agg(
        F.countDistinct("component_material").alias("_n_components"),
        F.sum("_req").alias("_sum_required"),
        F.count(F.when(pos, F.col("component_material"))).alias("shortage_component_count"),
        F.coalesce(F.sum(F.when(pos, F.col("_short"))), F.lit(0.0)).alias("total_shortage_qty"),
        F.coalesce(F.max(F.when(pos, F.col("_short"))), F.lit(0.0)).alias("max_shortage_qty"),
        F.coalesce(F.max(F.when(pos, eps_div("_short", "_req"))), F.lit(0.0)).alias("max_shortage_pct"),
    )
    return agg.select(
        "production_number",
        (F.col("shortage_component_count") > 0).cast("int").alias("has_shortage"),
        "shortage_component_count", "total_shortage_qty", "max_shortage_qty", "max_shortage_pct",
        eps_div("shortage_component_count", "_n_components").alias("shortage_component_ratio"),
        eps_div("total_shortage_qty", "_sum_required").alias("shortage_qty_ratio"),
    )


def join_shortage(orders: DataFrame, shortage: DataFrame | None) -> DataFrame:
    """Left join the order-grain shortage roll-up; orders without rows get 0.

    Without a shortage source all seven columns are still emitted as 0.
    """
    if shortage is None:
        return orders.withColumns({c: (F.lit(0) if c in ("has_shortage", "shortage_component_count")
                                       else F.lit(0.0)) for c in SHORTAGE_COLUMNS})
    joined = orders.join(shortage_rollup(shortage), "production_number", "left")
    return joined.fillna(0, subset=SHORTAGE_COLUMNS)


# --- loader basics ---------------------------------------------------------------

def basic_features(df: DataFrame) -> DataFrame:
    """Loader-level ratios and calendar parts of the planned start."""
    q, cap, tpt = F.col("order_quantity"), F.col("line_capacity"), F.col("total_production_time")
    ps = F.col("planned_start_date")
    return df.withColumns({
        "qty_capacity_ratio": safe_div(q, cap),
        "expected_production_days": safe_div(q * tpt, cap),
        "planned_start_month": F.month(ps),
        "planned_start_weekday": weekday_mon0(ps),
        "planned_start_quarter": F.quarter(ps),
        "planned_start_year": F.year(ps),
        "has_supervisor": F.col("production_supervisor").isNotNull().cast("int"),
    })


def enrich(history: DataFrame, fg: DataFrame, capacity: DataFrame, shortage: DataFrame | None,
           completed_only: bool = True, also: tuple[str, ...] = ()) -> DataFrame:
    """Full loader chain: F1 -> T1 -> J1 -> J2 -> J3 -> basics. ``also``: further columns of ``fg``."""
    df = completed_orders(history) if completed_only else history
    df = order_labels(df)
    df = join_master(df, fg, capacity, also)
    df = join_shortage(df, shortage)
    return basic_features(df)


# --- T2 / F3 / T3 / F4 ---------------------------------------------------------------

def lead_time_target(df: DataFrame, name: str = "actual_production_days") -> DataFrame:
    """Fractional days created -> actual finish, floored at 1.0; null stays null."""
    d = fractional_days("created_date", "actual_finish_date")
    return df.withColumn(name, F.when(d.isNull(), F.lit(None).cast("double")).otherwise(F.greatest(d, F.lit(1.0))))


def training_range_filter(df: DataFrame, target: str = "actual_production_days",
                          max_days: float = 45.0, max_qty: float = 500.0) -> DataFrame:
    """target present, target <= 45 days, quantity <= 500 (null quantity dropped)."""
    return df.filter(F.col(target).isNotNull() & (F.col(target) <= max_days) & (F.col("order_quantity") <= max_qty))


def winsor_bounds(df: DataFrame, col: str, lower: float = 0.01, upper: float = 0.99,
                  approx: bool = False) -> DataFrame:
    """One-row table of linear-interpolated percentiles (exact by default)."""
    if approx:
        return df.agg(F.percentile_approx(col, [lower, upper], 100000).alias("_b")).select(
            F.col("_b")[0].cast("double").alias("_lo"), F.col("_b")[1].cast("double").alias("_hi"))
    return exact_quantiles(df, col, [lower, upper], ["_lo", "_hi"])


def winsorise(df: DataFrame, col: str = "actual_production_days", lower: float = 0.01,
              upper: float = 0.99, approx: bool = False, materialize: bool = False) -> DataFrame:
    """Clip ``col`` to its global [P1, P99]. The bounds are one row, so the
    cross join is a broadcast of a single row; ``materialize`` writes that row once for all readers."""
    b = winsor_bounds(df, col, lower, upper, approx)
    b = cut_lineage(b) if materialize else b
    return (df.crossJoin(F.broadcast(b))
            .withColumn(col, F.least(F.greatest(F.col(col), F.col("_lo")), F.col("_hi")))
            .drop("_lo", "_hi"))


def wait_filter(df: DataFrame, max_wait_days: float | None = 3.0) -> DataFrame:
    """drop orders that waited >= ``max_wait_days`` from creation to actual start.
    Unknown wait is kept; 0/None disables the filter."""
    if not max_wait_days or "actual_start_date" not in df.columns:
        return df
    wait = fractional_days("created_date", "actual_start_date")
    return df.filter(wait.isNull() | (wait < F.lit(float(max_wait_days))))


def training_rows(enriched: DataFrame, max_wait_days: float | None = 3.0, approx: bool = False,
                  materialize: bool = True, columns: list[str] | None = None) -> DataFrame:
    """T2 -> F3 -> T3 -> F4, the row set the regressor trains on. The joined rows and
    their bounds are written once (``materialize``); whoever reads the result reads those.
    ``columns``: what is read of the rows, if not all."""
    df = lead_time_target(enriched)
    df = training_range_filter(df)
    df = df.select(*columns) if columns else df
    df = cut_lineage(df) if materialize else df
    df = winsorise(df, approx=approx, materialize=materialize)
    return wait_filter(df, max_wait_days)


# --- F5 / F7 / F10 -------------------------------------------------------------------------

def complete_rows(df: DataFrame, columns: list[str], min_rows: int | None = 50) -> DataFrame:
    """drop rows with a null in any feature or label; with ``min_rows`` the
    count gate is checked (one count job) and too few rows raise."""
    out = df.dropna(subset=columns)
    if min_rows is not None:
        n = out.count()
        if n < min_rows:
            raise ValueError(f"only {n} complete rows, need at least {min_rows}")
    return out


def test_set_filter(df: DataFrame, materials: list[str] | None = None, max_target: float | None = None,
                    target: str = "actual_production_days") -> DataFrame:
    """restrict an evaluation set to materials and, when below 30, a target cap."""
    out = df
    if materials:
        out = out.filter(F.col("material").isin(materials))
    if max_target is not None and max_target < 30:
        out = out.filter(F.col(target) <= max_target)
    return out


def prefix_lookup(df: DataFrame, prefix: str, columns: tuple[str, ...] = ("sales_doc", "production_number")) -> DataFrame:
    """orders whose sales document or order number starts with ``prefix``."""
    cond = None
    for c in columns:
        e = F.col(c).cast("string").startswith(prefix)
        cond = e if cond is None else cond | e
    return df.filter(cond)
