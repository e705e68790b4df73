"""Model evaluation as aggregations.

Metrics are one ``agg`` each; ranks and splits use the range-partitioned
running totals instead of a single-partition ``row_number``.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .scale import running_totals

TIME_ORDER = ["created_date", "production_number"]


# --- E1 -----------------------------------------------------------------------------

def regression_metrics(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """N, RMSE, MAE, R^2, SMAPE (pairs with |a| + |p| = 0 skipped; 0 if none)."""
    a, p = F.col(actual), F.col(predicted)
    e = a - p
    den = (F.abs(a) + F.abs(p)) / 2
    g = df.filter(a.isNotNull() & p.isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        F.sum(e * e).alias("_sse"), (F.var_pop(a) * F.count(F.lit(1))).alias("_sst"),
        F.avg(F.when(den > 0, F.abs(e) / den)).alias("_smape"))
    return g.select("n", "rmse", "mae",
                    F.when(F.col("_sst") > 0, 1 - F.col("_sse") / F.col("_sst")).alias("r2"),
                    F.coalesce(F.col("_smape") * 100, F.lit(0.0)).alias("smape"))


# --- E3 / E4 -----------------------------------------------------------------------------

def confusion_metrics(df: DataFrame, label: str = "is_delayed", score: str = "delay_probability",
                      threshold: float = 0.5) -> DataFrame:
    """2x2 confusion counts, accuracy, precision, recall, F1 (0 on zero
    division), specificity and NPV at ``score > threshold``."""
    y, yhat = F.col(label) == 1, F.col(score) > threshold
    g = df.filter(F.col(label).isNotNull() & F.col(score).isNotNull()).agg(
        F.count_if(y & yhat).alias("tp"), F.count_if(~y & yhat).alias("fp"),
        F.count_if(~y & ~yhat).alias("tn"), F.count_if(y & ~yhat).alias("fn"))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))

    def ratio(num, den):
        return F.when(den > 0, num / den).otherwise(0.0)

    prec, rec = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return g.select("tp", "fp", "tn", "fn", ratio(tp + tn, tp + fp + tn + fn).alias("accuracy"),
                    prec.alias("precision"), rec.alias("recall"),
                    F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0).alias("f1"),
                    ratio(tn, tn + fp).alias("specificity"), ratio(tn, tn + fn).alias("npv"))


def exact_auc(df: DataFrame, label: str = "is_delayed", score: str = "delay_probability") -> DataFrame:
    """E3 ROC AUC, exact with ties: per distinct score, positives x (negatives with a
    lower score + half the tied negatives), over P x N. Running negatives along
    the score order come from range-partitioned running totals (no single task)."""
    g = (df.filter(F.col(label).isNotNull() & F.col(score).isNotNull())
         .groupBy(F.col(score).alias("_s"))
         .agg(F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) != 1).alias("_neg")))
    rt = running_totals(g, ["_s"], ["_s"], {"_neg_below": F.col("_neg")}, inclusive=False)
    j = g.join(rt, "_s")
    # As doubles: pairs of rows exceed a long from about 4e9 rows a class; one class alone has no AUC.
    pos, neg = F.col("_pos").cast("double"), F.col("_neg").cast("double")
    return j.agg(F.try_divide(F.sum(pos * (F.col("_neg_below") + neg / 2)), F.sum(pos) * F.sum(neg)).alias("auc"),
                 F.sum("_pos").alias("positives"), F.sum("_neg").alias("negatives"))


# --- E6 ------------------------------------------------------------------------------

def metric_grades(metrics: DataFrame) -> DataFrame:
    """Grades for RMSE (1/2/3), R^2 (.8/.6/.4), SMAPE (10/20/30) and a verdict
    from how many of RMSE <= 2, R^2 >= .6, SMAPE <= 20 hold."""
    def grade(c: Column, cuts, higher_better=False):
        names = ["excellent", "good", "fair"]
        expr = None
        for cut, name in zip(cuts, names):
            cond = c >= cut if higher_better else c <= cut
            expr = F.when(cond, name) if expr is None else expr.when(cond, name)
        return expr.otherwise("poor")

    rm, r2, sm = F.col("rmse"), F.col("r2"), F.col("smape")
    good = ((rm <= 2).cast("int") + F.coalesce(r2 >= 0.6, F.lit(False)).cast("int")
            + F.coalesce(sm <= 20, F.lit(True)).cast("int"))
    return metrics.select("*", grade(rm, [1.0, 2.0, 3.0]).alias("rmse_grade"),
                          grade(r2, [0.8, 0.6, 0.4], True).alias("r2_grade"),
                          grade(sm, [10.0, 20.0, 30.0]).alias("smape_grade"),
                          F.when(good >= 2, "usable").when(good >= 1, "needs_work").otherwise("poor").alias("verdict"))


# --- M16 / M17 / A32 -------------------------------------------------------------------

def risk_band_a(p: Column) -> Column:
    """(0, .3] low, (.3, .7] medium, (.7, 1] high; 0 and out of range -> null."""
    return F.when((p > 0) & (p <= 0.3), "low").when((p > 0.3) & (p <= 0.7), "medium") \
        .when((p > 0.7) & (p <= 1.0), "high")


def risk_band_b(p: Column) -> Column:
    """>= .7 high, >= .4 medium, else low."""
    return F.when(p >= 0.7, "high").when(p >= 0.4, "medium").otherwise("low")


RISK_ACTIONS = {"high": "expedite", "medium": "monitor", "low": "none"}


def risk_action(band: Column) -> Column:
    expr = None
    for k, v in RISK_ACTIONS.items():
        expr = F.when(band == k, v) if expr is None else expr.when(band == k, v)
    return expr


def prediction_summary(df: DataFrame, prob: str = "delay_probability") -> DataFrame:
    """Per band A - orders, predicted delays (p > .5), mean probability in %."""
    p = F.col(prob)
    return df.withColumn("risk_band", risk_band_a(p)).groupBy("risk_band").agg(
        F.count(F.lit(1)).alias("orders"), F.count_if(p > 0.5).alias("predicted_delays"),
        F.avg(F.round(p * 100, 1)).alias("mean_pct"))


# --- E8 / A27 / J6 / O6 / U3 --------------------------------------------------------------

def model_comparison(old: DataFrame, new: DataFrame, key: str = "production_number",
                     prob: str = "delay_probability") -> DataFrame:
    """For each of the three named bands, old count, new count and delta
    (bands with no orders report 0; unbanded probabilities are not reported)."""
    def counts(df, tag):
        return df.groupBy(risk_band_a(F.col(prob)).alias("risk_band")).agg(F.count(F.lit(1)).alias(tag))
    bands = old.sparkSession.createDataFrame([("high",), ("medium",), ("low",)], "risk_band string")
    c = bands.join(counts(old, "old_orders"), "risk_band", "left").join(counts(new, "new_orders"), "risk_band", "left")
    return c.select("risk_band", F.coalesce("old_orders", F.lit(0)).alias("old_orders"),
                    F.coalesce("new_orders", F.lit(0)).alias("new_orders"),
                    (F.coalesce("new_orders", F.lit(0)) - F.coalesce("old_orders", F.lit(0))).alias("delta"))


def comparison_totals(old: DataFrame, new: DataFrame, prob: str = "delay_probability") -> DataFrame:
    """A27/E8 totals, one row: predicted delays (p > .5) and mean probability in
    percent of either model, and the new one's change."""
    def one(df, tag):
        return df.agg(F.count_if(F.col(prob) > 0.5).alias(f"{tag}_delays"), (F.avg(prob) * 100).alias(f"{tag}_mean_pct"))
    # one row each
    j = one(old, "old").crossJoin(F.broadcast(one(new, "new")))
    return j.select("*", (F.col("new_delays") - F.col("old_delays")).alias("delta_delays"),
                    (F.col("new_mean_pct") - F.col("old_mean_pct")).alias("delta_mean_pct"))


def probability_movers(old: DataFrame, new: DataFrame, key: str = "production_number",
                       prob: str = "delay_probability", min_change_pts: float = 10.0, k: int = 10) -> DataFrame:
    """J6 + O6: inner join on the order, change in percentage points, |change| > 10,
    top-k by signed change descending."""
    o = old.select(F.col(key), F.round(F.col(prob) * 100, 1).alias("old_pct"))
    n = new.select(F.col(key), F.round(F.col(prob) * 100, 1).alias("new_pct"))
    j = o.join(n, key).withColumn("change", F.col("new_pct") - F.col("old_pct"))
    return j.filter(F.abs("change") > min_change_pts).orderBy(F.desc("change"), F.asc(key)).limit(k)


def high_risk_diff(old: DataFrame, new: DataFrame, key: str = "production_number",
                   prob: str = "delay_probability") -> DataFrame:
    """Orders high-risk in only one model (left anti both ways)."""
    ho = old.filter(risk_band_a(F.col(prob)) == "high").select(key).distinct()
    hn = new.filter(risk_band_a(F.col(prob)) == "high").select(key).distinct()
    return ho.join(hn, key, "left_anti").withColumn("side", F.lit("old_only")) \
        .unionByName(hn.join(ho, key, "left_anti").withColumn("side", F.lit("new_only")))


# --- M1 / M6 ---------------------------------------------------------------------------

def row_index(df: DataFrame, order_cols: list[str] = TIME_ORDER, key: str = "production_number") -> DataFrame:
    """0-based position of every row in the total order ``order_cols``."""
    rt = running_totals(df.select(*dict.fromkeys([key] + order_cols)), [key], order_cols,
                        {"_one": F.lit(1).cast("long")}, inclusive=False)
    return df.join(rt.withColumnRenamed("_one", "row_index"), key)


def chronological_split(df: DataFrame, test_size: float = 0.2, order_cols: list[str] = TIME_ORDER,
                        key: str = "production_number") -> DataFrame:
    """M1: first int(n * (1 - test_size)) rows in time order are train, rest test."""
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    out = row_index(df, order_cols, key).crossJoin(F.broadcast(n))
    cut = F.floor(F.col("_n") * (1 - test_size))
    return out.withColumn("split", F.when(F.col("row_index") < cut, "train").otherwise("test")).drop("_n")


def cv_fold_assignment(df: DataFrame, n_splits: int = 5, order_cols: list[str] = TIME_ORDER,
                       key: str = "production_number") -> DataFrame:
    """M6: expanding time-series folds. Fold size n // (k + 1); fold i tests rows
    [n - (k - i + 1) * size, + size) and trains on everything before."""
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    out = row_index(df, order_cols, key).crossJoin(F.broadcast(n))
    size = F.floor(F.col("_n") / (n_splits + 1))
    first = F.col("_n") - size * n_splits
    return out.withColumn("test_fold", F.when((F.col("row_index") >= first) & (size > 0),
                                              F.floor((F.col("row_index") - first) / size) + 1)).drop("_n")


def before_places(df: DataFrame, places: Callable[[int], list[int]], order_cols: list[str] = TIME_ORDER,
                  key: str = "production_number") -> list[Column] | None:
    """For each of ``places`` (0-based, of the number of rows), whether a row stands before it in the total order. Rows
    are compared with the one that stands there, so wide rows need no join with their places. None if a key repeats or
    a value is null: a row's place then takes ``row_index``."""
    cols = list(dict.fromkeys([key, *order_cols]))
    rt = running_totals(df.select(*cols), cols, order_cols, {"_at": F.lit(1).cast("long")}, inclusive=False)
    some_null = F.lit(False)
    for c in cols:
        some_null |= F.col(c).isNull()
    n, nulls = rt.agg(F.count(F.lit(1)), F.count_if(some_null)).first()
    if nulls or rt.groupBy(key).count().where("count > 1").limit(1).count():
        return None
    asked = places(n)
    there = {r["_at"]: r for r in rt.where(F.col("_at").isin(asked)).collect()} if asked else {}  # one row a place

    def before(place: int) -> Column:
        if place not in there:
            return F.lit(place >= n)
        less = F.lit(False)
        for c in reversed(order_cols):
            at = F.lit(there[place][c])
            less = (F.col(c) < at) | ((F.col(c) == at) & less)
        return less

    return [before(p) for p in asked]


def split_in_time(df: DataFrame, test_size: float = 0.2, validation_share: float = 0.0) -> DataFrame:
    """``chronological_split`` of a table that is written already, with ``_is_val`` for the last share of the training
    rows (and all test rows)."""
    def places(n):
        train = math.floor(n * (1 - test_size))
        return [train, math.floor(train * (1 - validation_share))]

    before = before_places(df, places)
    if before:
        return df.withColumns({"split": F.when(before[0], "train").otherwise("test"), "_is_val": ~before[1]})
    split = cut_lineage(chronological_split(df, test_size))
    n_train = split.where("split = 'train'").agg(F.count(F.lit(1)).alias("_n"))
    return split.crossJoin(F.broadcast(n_train)).withColumn("_is_val", F.col("row_index") >= F.floor(F.col("_n") * (1 - validation_share))).drop("_n")


def folds_in_time(df: DataFrame, n_splits: int) -> DataFrame:
    """``cv_fold_assignment`` of a table that is written already."""
    def places(n):
        size = n // (n_splits + 1)
        return [n - size * i for i in range(n_splits, -1, -1)] if size else []

    before = before_places(df, places)
    if before is None:
        return cut_lineage(cv_fold_assignment(df, n_splits))
    fold = F.lit(None).cast("long")
    for i in range(len(before) - 1, 0, -1):
        fold = F.when(before[i], F.lit(i).cast("long")).otherwise(fold)
    return df.withColumn("test_fold", F.when(~before[0], fold) if before else fold)
