"""Report roll-ups over scored orders.

Inputs are order-grain DataFrames with ``actual`` / ``predicted`` (lead time in
days), ``delay_probability`` or ``is_delayed``. All roll-ups are single
aggregations (partial aggregation map side) or joins of small per-group
tables; nothing is collected to the driver. Where the source rounds with
numpy (half-to-even) we use ``bround``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import eps_div, floor_days, round_decimal
from ..session import cut_lineage
from .scale import exact_quantiles, group_medians, group_table, hash_order, null_safe_join, running_totals


# --- E2 -----------------------------------------------------------------------------

def prediction_errors(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """error = actual - predicted, abs_error, pct_error = |error / (actual + eps)| * 100."""
    err = F.col(actual) - F.col(predicted)
    return df.withColumns({"error": err, "abs_error": F.abs(err),
                           "pct_error": F.abs(eps_div(err, actual)) * 100})


def rmse(col: str = "error") -> Column:
    return F.sqrt(F.avg(F.col(col) * F.col(col)))


# --- A2 / A3 / J7 / R9 ----------------------------------------------------------------

def _center(col: str, how: str) -> Column:
    return F.avg(col) if how != "median" else F.percentile_approx(col, 0.5, 10000).cast("double")


def material_tpt(scored: DataFrame, fg: DataFrame | None = None, agg: str = "median",
                 predicted: str = "predicted", actual: str = "actual", approx: bool = False) -> DataFrame:
    """Per material - representative predicted TPT (median or mean),
    order count, std (n = 1 -> 0), min, max, first-seen description/line,
    master TPT and its change, representative actual TPT. Rounded to 2 (half even)."""
    first = F.col("production_number")
    # An exact median by Spark's percentile would gather a hot material's values in one task.
    exact = agg == "median" and not approx
    aggs = [
        F.count(predicted).alias("order_count"),
        F.stddev_samp(predicted).alias("_std"),
        F.min(predicted).alias("tpt_min"),
        F.max(predicted).alias("tpt_max"),
    ]
    if not exact:
        aggs += [_center(predicted, agg).alias("_pred"), _center(actual, agg).alias("_act")]
    for c in ("material_description", "production_line"):
        if c in scored.columns:
            aggs.append(F.min_by(c, first).alias(c))
    m = scored.filter(F.col("material").isNotNull()).groupBy("material").agg(*aggs)
    if exact:
        m = m.join(group_medians(scored, "material", {"_pred": predicted, "_act": actual}), "material", "left")
    m = m.withColumns({
        "predicted_tpt": F.bround("_pred", 2),
        "tpt_std": F.bround(F.coalesce(F.col("_std"), F.lit(0.0)), 2),
        "actual_tpt": F.bround("_act", 2),
    }).drop("_pred", "_std", "_act")
    if fg is not None:
        # master value of the first line per material (deterministic "first")
        cur = (fg.filter(F.col("material").isNotNull()).groupBy("material")
               .agg(F.min_by("total_production_time", F.col("production_line")).alias("current_tpt")))
        m = m.join(cur, "material", "left").withColumn(
            "tpt_change", F.when(F.col("current_tpt").isNotNull(),
                                 F.bround(F.col("predicted_tpt") - F.col("current_tpt"), 2)))
    return m


# --- R1-R6, R8 ---------------------------------------------------------------------

def material_insight(mat: DataFrame) -> DataFrame:
    """R1-R6, R8 on a ``material_tpt`` table (unrounded CV, one variant)."""
    gm = exact_quantiles(mat, "predicted_tpt", [0.5], ["_gm"])
    pred, std, cnt = F.col("predicted_tpt"), F.col("tpt_std"), F.col("order_count")
    diff_pct = F.when(F.col("_gm") > 0, (pred - F.col("_gm")) / F.col("_gm") * 100).otherwise(0.0)
    cv = F.when(pred > 0.01, std / pred).otherwise(0.0)
    out = mat.crossJoin(F.broadcast(gm)).withColumns({
        "speed_diff_pct": diff_pct,
        "speed_class": F.when(diff_pct > 20, "slow").when(diff_pct < -20, "fast").otherwise("normal"),
        "sample_class": F.when(cnt <= 2, "very_small").when(cnt <= 9, "medium").otherwise("large"),
        "cv": cv,
        "stability_class": F.when(cv < 0.15, "stable").when(cv < 0.30, "moderate").otherwise("dispersed"),
        "span_warning": ((F.col("tpt_max") - F.col("tpt_min")) > pred * 0.5).cast("int"),
    })
    if "current_tpt" in mat.columns:
        cur = F.col("current_tpt")
        chg = pred - cur
        out = out.withColumns({
            "drift_class": F.when(cur.isNull(), None).when(chg > 0.5, "up").when(chg < -0.5, "down").otherwise("same"),
            "drift_pct": F.when(cur.isNull(), None).when(cur > 0.01, chg / cur * 100).otherwise(0.0),
            "flag_master_gap": F.coalesce(F.abs(chg) > 2, F.lit(False)).cast("int"),
        })
    act = F.col("actual_tpt")
    err = pred - act
    err_pct = F.when(act > 0.01, err / act * 100).otherwise(0.0)
    side = F.when(err > 0, "over").otherwise("under")
    out = out.withColumns({
        "accuracy_class": F.when(act.isNull(), None).when(F.abs(err_pct) <= 10, "accurate")
                           .when(F.abs(err_pct) <= 20, F.concat(F.lit("moderate_"), side))
                           .otherwise(F.concat(F.lit("large_"), side)),
        "flag_dispersed": (F.when(pred > 0, std / pred * 100).otherwise(0.0) > 30).cast("int"),
        "flag_few_orders": (cnt <= 2).cast("int"),
        "flag_large_error": F.coalesce(F.abs(eps_div(err, act, 0.0)) * 100 > 20, F.lit(False)).cast("int"),
    })
    return out.drop("_gm")


# --- R7 -------------------------------------------------------------------------------

def range_position(scored: DataFrame, mat: DataFrame, predicted: str = "predicted") -> DataFrame:
    """Where the representative TPT sits in [min, max] and how many orders
    are at or below it."""
    counts = scored.join(mat.select("material", "predicted_tpt"), "material", "inner") \
        .groupBy("material").agg(F.count(F.when(F.col(predicted) <= F.col("predicted_tpt"), 1)).alias("n_low"))
    span = F.col("tpt_max") - F.col("tpt_min")
    pos = F.when(span > 0.01, (F.col("predicted_tpt") - F.col("tpt_min")) / span).otherwise(0.5)
    out = mat.join(counts, "material", "left").withColumn("position", pos)
    return out.select("material", "position",
                      F.when(pos <= 0.33, "optimistic").when(pos >= 0.67, "conservative").otherwise("centered")
                      .alias("position_class"),
                      F.coalesce(F.col("n_low"), F.lit(0)).alias("n_low"),
                      (F.col("order_count") - F.coalesce(F.col("n_low"), F.lit(0))).alias("n_high"))


# --- W16 / W17 -----------------------------------------------------------------------------

def rank_trend(scored: DataFrame, predicted: str = "predicted", min_orders: int = 6) -> DataFrame:
    """Rank orders within a material by predicted TPT (ties by order
    number) and a centred moving mean with window max(3, n // 5) (even window
    covers [r - w/2, r + w/2 - 1]); materials with fewer than 6 orders keep the
    raw value.

    Scale form: running sums along (material, predicted, order) and two
    equi-join lookups at the frame bounds, so no material is sorted in one task.
    """
    # Written once: the running totals, their sizes and both look-ups read these three columns.
    src = cut_lineage(scored.filter(F.col(predicted).isNotNull()).select("production_number", "material", predicted))
    # Exact sums: a difference of growing double sums loses digits with the length of the total.
    rt = running_totals(src, ["production_number"], [predicted, "production_number"],
                        {"_cum": F.col(predicted).cast("decimal(28,10)"), "rank": F.lit(1).cast("long")}, keys=["material"])
    sizes = group_table(src, ["material"], {"_n": F.count(F.lit(1))}, null_keys="group")
    ranked = cut_lineage(src.join(rt, "production_number"))  # read by the orders and by both look-ups
    base = null_safe_join(ranked, sizes, ["material"])
    w = F.greatest(F.lit(3), F.floor(F.col("_n") / 5)).cast("long")
    base = base.withColumns({"_hi": F.least(F.col("rank") + (w - 1 - F.floor(w / 2)), F.col("_n")),
                             "_lo": F.greatest(F.col("rank") - F.floor(w / 2), F.lit(1))})
    look = ranked.select("material", "rank", "_cum")
    up = look.select(F.col("material").alias("_m1"), F.col("rank").alias("_r1"), F.col("_cum").alias("_c_hi"))
    lo = look.select(F.col("material").alias("_m2"), F.col("rank").alias("_r2"), F.col("_cum").alias("_c_lo"))
    out = base.join(up, base["material"].eqNullSafe(up["_m1"]) & (base["_hi"] == up["_r1"]), "left") \
        .join(lo, base["material"].eqNullSafe(lo["_m2"]) & (base["_lo"] - 1 == lo["_r2"]), "left")
    mean = (F.col("_c_hi") - F.coalesce(F.col("_c_lo"), F.lit(0))).cast("double") / (F.col("_hi") - F.col("_lo") + 1)
    return out.select("production_number", "material", F.col("rank").alias("rank"),
                      F.when(F.col("_n") >= min_orders, mean).otherwise(F.col(predicted)).alias("trend"))


# --- A7-A12 ---------------------------------------------------------------------------------

def group_accuracy(errs: DataFrame, keys: list[str], digits: int = 2) -> DataFrame:
    """Orders, total quantity, mean actual/predicted, MAE, RMSE per group."""
    g = errs.filter(F.expr(" and ".join(f"`{k}` is not null" for k in keys))).groupBy(*keys).agg(
        F.count("production_number").alias("orders"), F.sum("order_quantity").alias("total_qty"),
        F.avg("actual").alias("mean_actual"), F.avg("predicted").alias("mean_predicted"),
        F.avg("abs_error").alias("mae"), rmse().alias("rmse"))
    # Means that differ in their last binary digits are one value before the half-even rule decides.
    return g.select(*keys, "orders", *[F.bround(F.round(c, 9), digits).alias(c) for c in
                                       ["total_qty", "mean_actual", "mean_predicted", "mae", "rmse"]])


def overall_accuracy(errs: DataFrame) -> DataFrame:
    """One row - orders, mean actual, mean predicted, MAE, RMSE."""
    return errs.agg(F.count(F.lit(1)).alias("orders"), F.avg("actual").alias("mean_actual"),
                    F.avg("predicted").alias("mean_predicted"), F.avg("abs_error").alias("mae"),
                    rmse().alias("rmse"))


DAY_BUCKETS = [(0, 1, "0-1"), (1, 3, "1-3"), (3, 5, "3-5"), (5, 10, "5-10"), (10, 999, "10+")]


def error_by_days(errs: DataFrame) -> DataFrame:
    """A10: error statistics per actual-days bucket [0,1) [1,3) [3,5) [5,10) [10,999);
    only observed buckets are reported."""
    b = None
    for lo, hi, name in DAY_BUCKETS:
        cond = (F.col("actual") >= lo) & (F.col("actual") < hi)
        b = F.when(cond, name) if b is None else b.when(cond, name)
    # The filter reads ``actual`` twice; on the bucket, Spark would push the whole case chain down, with all that
    # ``actual`` is made of in each of its branches.
    seen = errs.filter((F.col("actual") >= DAY_BUCKETS[0][0]) & (F.col("actual") < DAY_BUCKETS[-1][1]))
    return seen.withColumn("days_bucket", b).groupBy("days_bucket").agg(
        F.count("actual").alias("n"), F.avg("error").alias("bias"), F.avg("abs_error").alias("mae"),
        rmse().alias("rmse"))


ERROR_BANDS = [(0.0, 0.25, "lt_0.25"), (0.25, 0.5, "0.25-0.5"), (0.5, 1.0, "0.5-1"), (1.0, 2.0, "1-2"),
               (2.0, float("inf"), "gt_2")]


def error_bands(errs: DataFrame) -> DataFrame:
    """Count per abs-error band (lo, hi] and percent of *all* rows (1 dp);
    every band is reported, exact 0 falls in none."""
    spark = errs.sparkSession
    bands = spark.createDataFrame([(i, n) for i, (_, _, n) in enumerate(ERROR_BANDS)], "band_order int, band string")
    b = None
    for i, (lo, hi, _) in enumerate(ERROR_BANDS):
        cond = (F.col("abs_error") > lo) & (F.col("abs_error") <= hi)
        b = F.when(cond, i) if b is None else b.when(cond, i)
    counts = errs.groupBy(b.alias("band_order")).agg(F.count(F.lit(1)).alias("n"))
    total = errs.agg(F.count(F.lit(1)).alias("_total"))
    out = bands.join(counts, "band_order", "left").crossJoin(F.broadcast(total))
    n = F.coalesce(F.col("n"), F.lit(0))
    return out.select("band_order", "band", n.alias("orders"),
                      F.bround(F.coalesce(F.try_divide(n * F.lit(100.0), F.col("_total")), F.lit(0.0)), 1).alias("pct"))


def material_accuracy(errs: DataFrame) -> DataFrame:
    """N, mean actual/predicted, MAE per material."""
    return errs.filter(F.col("material").isNotNull()).groupBy("material").agg(
        F.count("actual").alias("n"), F.avg("actual").alias("mean_actual"),
        F.avg("predicted").alias("mean_predicted"), F.avg("abs_error").alias("mae"))


# --- A13-A21 -----------------------------------------------------------------------------------

def delay_rate(df: DataFrame, keys: list[Column | str], min_orders: int | None = None,
               min_rate: float | None = None, digits: int = 3, flag: str = "is_delayed") -> DataFrame:
    """Orders, delayed, delay rate (rounded before any HAVING, like the
    source) per group; optional filter n > min_orders and rate > min_rate."""
    g = df.groupBy(*keys).agg(F.count(flag).alias("orders"), F.sum(flag).alias("delayed"),
                              F.bround(F.avg(flag), digits).alias("delay_rate"))
    if min_orders is not None:
        g = g.filter(F.col("orders") > min_orders)
    if min_rate is not None:
        g = g.filter(F.col("delay_rate") > min_rate)
    return g


def order_kpis(orders: DataFrame, finish: str = "actual_finish", planned_finish: str = "planned_finish") -> DataFrame:
    """Total, completed, pending, delayed; on-time share (null when nothing
    is completed) and mean delay of delayed orders only. Delays are whole days,
    floored from fractional ones; less than one day late is on time."""
    done = F.col(finish).isNotNull()
    delay = floor_days(F.col(planned_finish), F.col(finish))
    late = done & F.coalesce(delay > 0, F.lit(False))
    return orders.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(done).alias("completed"),
        F.count_if(~done).alias("pending"), F.count_if(late).alias("delayed"),
        F.count_if(done & ~late).alias("on_time"),
        F.try_divide(F.count_if(done & ~late) * F.lit(100.0), F.count_if(done)).alias("on_time_pct"),
        F.avg(F.when(late, delay)).alias("mean_delay_of_delayed"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Frequency of each value (nulls excluded, as pandas)."""
    return df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def delay_stats(df: DataFrame) -> DataFrame:
    """Totals, delayed, rate, mean/max/min delay days and date range."""
    return df.agg(F.count(F.lit(1)).alias("total"), F.sum("is_delayed").alias("delayed"),
                  F.avg("is_delayed").alias("delay_rate"), F.avg("delay_days").alias("avg_delay"),
                  F.max("delay_days").alias("max_delay"), F.min("delay_days").alias("min_delay"),
                  F.min("planned_start_date").alias("first_start"), F.max("planned_start_date").alias("last_start"))


def top_by(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """Top-k (a TakeOrderedAndProject: per-task top-k, then merge)."""
    return df.orderBy(*order).limit(k)


def top_volume(df: DataFrame, k: int = 5) -> DataFrame:
    """Materials with the largest total quantity."""
    g = df.groupBy("material").agg(F.sum("order_quantity").alias("total_qty"))
    return top_by(g, [F.desc("total_qty"), F.asc("material")], k)


def histogram(df: DataFrame, col: str, bins: int = 20) -> DataFrame:
    """Equal-width histogram between the global min and max (numpy edges,
    last bin closed)."""
    mm = df.agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    x = F.col(col)
    width = (F.col("_hi") - F.col("_lo")) / bins
    idx = F.when(F.col("_hi") == F.col("_lo"), 0).otherwise(
        F.least(F.floor((x - F.col("_lo")) / width), F.lit(bins - 1)))
    g = df.filter(x.isNotNull()).crossJoin(F.broadcast(mm)).groupBy(idx.cast("int").alias("bin"), "_lo", "_hi") \
        .agg(F.count(F.lit(1)).alias("n"))
    return g.select("bin", (F.col("_lo") + F.col("bin") * (F.col("_hi") - F.col("_lo")) / bins).alias("bin_start"), "n")


PERCENTILES = [10, 25, 50, 75, 90, 95, 99]


def percentile_profile(df: DataFrame, col: str, approx: bool = False) -> DataFrame:
    """Mean, median, std, min, max and P10..P99 (linear interpolation)."""
    fr, names = [p / 100 for p in PERCENTILES], [f"p{p}" for p in PERCENTILES]
    one = df.agg(F.count(col).alias("n"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"),
                 F.min(col).alias("min"), F.max(col).alias("max"))
    if approx:
        ps = df.agg(F.percentile_approx(col, fr, 100000).alias("_p")).select(
            *[F.col("_p")[i].cast("double").alias(n) for i, n in enumerate(names)])
    else:
        ps = exact_quantiles(df.select(F.col(col).cast("double").alias(col)), col, fr, names)
    # one row each; the quantile table is empty when there is no value
    out = one.join(F.broadcast(ps), F.lit(True), "left")
    return out.select("n", "mean", F.col("p50").alias("median"), "std", "min", "max", *names)


def percentile_rank(reference: DataFrame, probes: DataFrame, col: str, probe_key: str) -> DataFrame:
    """For each probe value v, 100 * #(reference < v) / n and rank #(x < v) + 1.

    Reference values are counted per distinct value, unioned with the probes
    (ordered before equal reference values) and a running count along the value
    order gives #(x < v) - a sort, not a cross join.
    """
    ref = reference.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    pr = probes.select(F.col(probe_key).alias("_key"), F.col(col).alias("_v")).filter(F.col("_v").isNotNull())
    u = ref.select(F.lit(None).cast(pr.schema["_key"].dataType).alias("_key"), "_v", F.lit(1).alias("_kind"), "_c") \
        .unionByName(pr.select("_key", "_v", F.lit(0).alias("_kind"), F.lit(0).cast("long").alias("_c")))
    u = u.withColumn(
        "_id", F.concat_ws("|", F.col("_kind").cast("string"), F.col("_key").cast("string"), F.col("_v").cast("string")))
    rt = running_totals(u, ["_id"], ["_v", "_kind", "_id"], {"_below": F.col("_c")})
    n = ref.agg(F.sum("_c").alias("_n"))
    out = u.filter(F.col("_kind") == 0).join(rt, "_id").crossJoin(F.broadcast(n))
    return out.select(F.col("_key").alias(probe_key), F.col("_v").alias(col),
                      (F.col("_below") / F.col("_n") * 100).alias("percentile"),
                      (F.col("_below") + 1).alias("rank"), F.col("_n").alias("n_reference"))


def neighbourhood_delay(reference: DataFrame, probes: DataFrame, col: str, probe_key: str,
                        radius: float = 5.0) -> DataFrame:
    """Delay rate of reference orders with |x - v| <= radius for each probe v.

    Reference rows are counted per value; running counts along the values
    (range-partitioned, so a crowded stretch spreads over tasks) are looked up
    at both ends of each distinct probe's neighbourhood, and their difference
    is the answer.
    """
    ref = reference.filter(F.col(col).isNotNull()).groupBy(F.col(col).cast("double").alias("_at")).agg(
        F.count(F.lit(1)).alias("_c"), F.sum("is_delayed").cast("long").alias("_d"))
    keyed = probes.select(F.col(probe_key).alias("_key"), F.col(col).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    # At one value the lower end (0) asks before the reference's rows (1) count, the upper end (2) after them.
    ends = keyed.select("_v").distinct().select("_v", F.explode(F.array(
        F.struct((F.col("_v") - radius).alias("at"), F.lit(0).alias("kind")), F.struct((F.col("_v") + radius).alias("at"), F.lit(2).alias("kind")))).alias("e"))
    marks = ref.select("_at", F.lit(1).alias("_kind"), F.lit(None).cast("double").alias("_v"), "_c", "_d").unionByName(
        ends.select(F.col("e.at").alias("_at"), F.col("e.kind").alias("_kind"), "_v", F.lit(0).cast("long").alias("_c"), F.lit(0).cast("long").alias("_d")))
    rt = running_totals(marks, ["_at", "_kind", "_v"], ["_at", "_kind", "_v"], {"_n": F.col("_c"), "_late": F.col("_d")})
    signed = lambda c: F.sum(F.when(F.col("_kind") == 2, F.col(c)).otherwise(-F.col(c)))
    seen = rt.where("_kind != 1").groupBy("_v").agg(signed("_n").alias("similar"), signed("_late").alias("_delayed"))
    out = keyed.join(seen, "_v")
    return out.select(F.col("_key").alias(probe_key), F.col("_v").alias(col), "similar",
                      F.when(F.col("similar") > 0, F.col("_delayed") / F.col("similar")).alias("delay_rate"))


def label_audit(targets: DataFrame, col: str = "actual_production_days") -> DataFrame:
    """Share of labels <= 1 and <= 2 days, coefficient of variation, count."""
    y = F.col(col)
    return targets.filter(y.isNotNull()).agg(
        F.count(y).alias("n"), (F.avg((y <= 1).cast("double")) * 100).alias("pct_le_1d"),
        (F.avg((y <= 2).cast("double")) * 100).alias("pct_le_2d"),
        (F.stddev_samp(y) / F.avg(y)).alias("cv"))


def label_coverage(df: DataFrame, cols: list[str]) -> DataFrame:
    """Per column, rows with a value and their share in percent of all rows (0 without rows)."""
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(c) for c in cols])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("present")) for c in cols])
    return one.select("_n", F.explode(pairs).alias("r")).select(
        "r.column", "r.present", F.col("_n").alias("rows"),
        F.coalesce(F.try_divide(F.col("r.present") * F.lit(100.0), F.col("_n")), F.lit(0.0)).alias("pct"))


def material_overview(mat: DataFrame) -> DataFrame:
    """Materials, mean representative TPT, total orders, materials whose
    master TPT changed by more than 0.5 day, mean std."""
    aggs = [F.count(F.lit(1)).alias("materials"), F.avg("predicted_tpt").alias("mean_predicted_tpt"),
            F.sum("order_count").alias("orders"), F.avg("tpt_std").alias("mean_std")]
    if "tpt_change" in mat.columns:
        aggs.append(F.count_if(F.abs(F.col("tpt_change")) > 0.5).alias("changed_materials"))
    return mat.agg(*aggs)


def material_window_delay(orders: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """Per material, delayed / all orders with planned start in
    [as_of - days, as_of]; open orders count in the denominator."""
    ref = F.to_date(F.lit(as_of))
    w = orders.filter((F.col("planned_start_date") >= F.date_sub(ref, days)) & (F.col("planned_start_date") <= ref))
    delayed = F.coalesce((F.col("actual_finish_date") > F.col("planned_finish_date")), F.lit(False)).cast("int")
    return w.groupBy("material").agg(F.count(F.lit(1)).alias("orders"), F.sum(delayed).alias("delayed"),
                                     (F.sum(delayed) / F.count(F.lit(1))).alias("delay_rate"))


def sample_rows(df: DataFrame, key: str, k: int = 10, seed: int = 42) -> DataFrame:
    """Reproducible sample of k rows (hash order, no driver-side randomness)."""
    return df.orderBy(hash_order(key, seed), F.col(key)).limit(k)


# --- A4 / A5 / A6 ------------------------------------------------------------------------

def material_standards(scored: DataFrame, predicted: str = "predicted", digits: int = 4) -> DataFrame:
    """A4: per (line, material, description): mean, std (null for one order),
    min, max of the prediction and the order count; rows with a null key are
    dropped (pandas groupby)."""
    keys = ["production_line", "material", "material_description"]
    g = scored.filter(F.expr(" and ".join(f"{k} is not null" for k in keys))).groupBy(*keys).agg(
        F.avg(predicted).alias("predicted_avg"), F.stddev_samp(predicted).alias("predicted_std"),
        F.min(predicted).alias("predicted_min"), F.max(predicted).alias("predicted_max"),
        F.count(predicted).alias("sample_count"))
    return g.select(*keys, *[round_decimal(c, digits).alias(c) for c in
                             ("predicted_avg", "predicted_std", "predicted_min", "predicted_max")], "sample_count")


def line_standards_summary(standards: DataFrame) -> DataFrame:
    """A5: per line, mean/min/max of the material averages and the material count."""
    return standards.groupBy("production_line").agg(
        F.avg("predicted_avg").alias("avg_time"), F.min("predicted_avg").alias("min_time"),
        F.max("predicted_avg").alias("max_time"), F.count("material").alias("material_count"))


def simple_standards(standards: DataFrame) -> DataFrame:
    """The four-column standards table."""
    return standards.select("production_line", "material_description", "material", "predicted_avg")


# --- T5 / O5 --------------------------------------------------------------------------------

def finish_forecast(df: DataFrame, predicted: str = "predicted", start: str = "planned_start_date",
                    planned_finish: str = "planned_finish_date") -> DataFrame:
    """T5: predicted finish = start + predicted days; deviation from the planned
    finish in days (1 dp); at risk when the deviation is positive."""
    start_us = F.unix_micros(F.col(start).cast("timestamp"))
    fin_us = start_us + F.floor(F.col(predicted) * F.lit(86_400_000_000.0)).cast("long")
    dev = (fin_us - F.unix_micros(F.col(planned_finish).cast("timestamp"))) / F.lit(86_400_000_000.0)
    return df.withColumns({"predicted_finish_date": F.timestamp_micros(fin_us),
                           "deviation_days": F.round(dev, 1),
                           "at_risk": F.coalesce(dev > 0, F.lit(False)).cast("int")})


def top_risk_orders(df: DataFrame, prob: str = "delay_probability", k: int = 5) -> DataFrame:
    """The k high-risk orders (band A 'high') with the largest probability."""
    from .evaluate import risk_band_a
    high = df.filter(risk_band_a(F.col(prob)) == "high")
    return top_by(high, [F.desc(prob), F.asc("production_number")], k)
