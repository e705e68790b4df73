"""Model training and scoring with Spark ML.

Boosted trees are Spark's ``GBTRegressor`` / ``GBTClassifier``; feature
vectors come from ``VectorAssembler`` over an allow-list of numeric columns.
Splits are computed as columns (row position in time order, hash order within
the label) so every fit and evaluation is a distributed job; the driver only
loops over *models* (folds, parameter draws), never over data.
"""

from __future__ import annotations

import json
import math
import random
import threading
import uuid
from concurrent.futures import ThreadPoolExecutor, as_completed
from concurrent.futures import TimeoutError as FuturesTimeout
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .evaluate import folds_in_time, regression_metrics, split_in_time
from .scale import hash_order, running_totals

LABEL = "actual_production_days"


# --- M5 / M8 ------------------------------------------------------------------------

def variance_filter(df: DataFrame, cols: list[str], threshold: float = 0.01) -> list[str]:
    """M5: keep columns whose *population* variance exceeds ``threshold`` (one
    aggregate; the per-column variances are a single row)."""
    row = df.agg(*[F.var_pop(F.col(c).cast("double")).alias(c) for c in cols]).first()
    return [c for c in cols if row[c] is not None and row[c] > threshold]


def align_features(df: DataFrame, feature_cols: list[str]) -> DataFrame:
    """Add missing features as 0, cast to double, nulls -> 0."""
    exprs = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in df.columns
             else F.lit(0.0).alias(c) for c in feature_cols]
    others = [F.col(c) for c in df.columns if c not in feature_cols]
    return df.select(*others, *exprs)


# --- M2 / M3 / M4 / M9 ----------------------------------------------------------------

@dataclass
class LeadTimeModel:
    """Fitted regressor + the metadata needed to score (feature list, log flag)."""
    pipeline: PipelineModel
    features: list[str]
    log_target: bool = False
    params: dict = field(default_factory=dict)

    def predict(self, df: DataFrame, out: str = "predicted") -> DataFrame:
        scored = self.pipeline.transform(align_features(df, self.features))
        p = F.col("prediction")
        if self.log_target:
            p = F.greatest(F.expm1(p), F.lit(0.0))  # clamp only in log mode, as the source
        return scored.withColumn(out, p).drop("prediction", "features")

    def importance(self) -> list[tuple[str, float]]:
        """M9: (feature, importance) sorted descending - one value per feature."""
        imp = self.pipeline.stages[-1].featureImportances.toArray()
        return sorted(zip(self.features, map(float, imp)), key=lambda t: -t[1])

    def save(self, path: str) -> None:
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        from pyspark.sql import SparkSession
        meta = {"features": self.features, "log_target": self.log_target, "params": self.params}
        SparkSession.getActiveSession().createDataFrame([(json.dumps(meta),)], "meta string") \
            .coalesce(1).write.mode("overwrite").text(f"{path}/metadata")

    @staticmethod
    def load(spark, path: str) -> "LeadTimeModel":
        meta = json.loads(spark.read.text(f"{path}/metadata").first()[0])
        return LeadTimeModel(PipelineModel.load(f"{path}/pipeline"), meta["features"], meta["log_target"],
                             meta.get("params", {}))


GBT_DEFAULTS = {"maxIter": 60, "maxDepth": 5, "stepSize": 0.05, "subsamplingRate": 0.8,
                "featureSubsetStrategy": "0.8", "minInstancesPerNode": 3, "minInfoGain": 0.0,
                "lossType": "squared", "seed": 42}


def fit_regressor(train: DataFrame, features: list[str], label: str = LABEL, log_target: bool = False,
                  params: dict | None = None, validation_col: str | None = None) -> LeadTimeModel:
    """M2/M3/M4: GBT regression. ``validation_col`` (boolean) enables early
    stopping on a validation slice of the *training* period (not the test set)."""
    p = dict(GBT_DEFAULTS)
    p.update(params or {})
    data = align_features(train, features).withColumn(
        "_y", F.log1p(F.col(label)) if log_target else F.col(label).cast("double"))
    if validation_col:
        p.update(validationIndicatorCol=validation_col, validationTol=0.001)
    gbt = GBTRegressor(featuresCol="features", labelCol="_y", **p)
    pipe = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"), gbt])
    return LeadTimeModel(pipe.fit(data), features, log_target, p)


def train_lead_time(df: DataFrame, features: list[str], test_size: float = 0.2, log_target: bool = False,
                    params: dict | None = None, validation_share: float = 0.1,
                    variance_threshold: float | None = 0.01, written: bool = False):
    """M1 + M5 + M2/M3 + E1/E2: chronological split, variance filter on the
    training rows, fit (early stopping on the last ``validation_share`` of the
    training period), predictions for every row and train/test metrics.
    ``written``: ``df`` is a written table, that split, filter, fit, predict and metrics can read again."""
    split = split_in_time(df if written else cut_lineage(df), test_size, validation_share)
    train = split.filter(F.col("split") == "train")
    feats = variance_filter(train, features, variance_threshold) if variance_threshold is not None else features
    val_col = "_is_val" if validation_share else None
    model = fit_regressor(train, feats, log_target=log_target, params=params, validation_col=val_col)
    pred = model.predict(split.drop("_is_val"))
    metrics = (regression_metrics(pred.filter(F.col("split") == "train"), LABEL, "predicted").withColumn("part", F.lit("train"))
               .unionByName(regression_metrics(pred.filter(F.col("split") == "test"), LABEL, "predicted")
                            .withColumn("part", F.lit("test"))))
    return model, pred, metrics


# --- M6 / M7 ---------------------------------------------------------------------------

@dataclass
class FoldVectors:
    """Expanding folds over feature vectors: (test_fold, label, _y, features); a fold's number is null before the first."""
    data: DataFrame
    folds: list[int]
    features: list[str]
    log_target: bool

    def fit_and_score(self, fold: int, params: dict, early_stop: bool):
        """One fit on all rows before the fold, and E1 on the fold. ``early_stop``: the fold is also the set on which
        boosting stops, as the source's search does."""
        p = GBT_DEFAULTS | params
        at = F.coalesce("test_fold", F.lit(0))
        before, own = at < fold, at == fold
        if early_stop:
            p |= {"validationIndicatorCol": "_is_val", "validationTol": 0.001}
        train = self.data.where(before | own).withColumn("_is_val", own) if early_stop else self.data.where(before)
        out = GBTRegressor(featuresCol="features", labelCol="_y", **p).fit(train).transform(self.data.where(own))
        pred = F.greatest(F.expm1("prediction"), F.lit(0.0)) if self.log_target else F.col("prediction")
        return regression_metrics(out.withColumn("predicted", pred), LABEL, "predicted").first()


def fold_vectors(df: DataFrame, features: list[str], n_splits: int, log_target: bool = False, written: bool = False) -> FoldVectors:
    """Vectors are put together as they are read, from rows that are written once."""
    y = F.log1p(F.col(LABEL)) if log_target else F.col(LABEL).cast("double")
    rows = align_features(folds_in_time(df if written else cut_lineage(df), n_splits), features).withColumn("_y", y)
    data = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep").transform(rows).select("test_fold", LABEL, "_y", "features")
    folds = rows.where("test_fold is not null").select("test_fold").distinct().collect()  # one row a fold
    return FoldVectors(data, sorted(r.test_fold for r in folds), features, log_target)


def run_all(spark, jobs: dict, parallelism: int, timeout: float | None = None) -> dict:
    """Results of the jobs (name -> function) that end within ``timeout`` seconds, run ``parallelism`` at a time from
    driver threads; what still runs then is cancelled by its tag. An error in a job rises."""
    tag, sc = f"leadlane-{uuid.uuid4().hex}", spark.sparkContext
    late = threading.Event()

    def tagged(fn):
        def run():
            if late.is_set():
                return None
            sc.addJobTag(tag)
            try:
                return fn()
            finally:
                sc.removeJobTag(tag)
        return inheritable_thread_target(spark)(run)

    done: dict = {}
    with ThreadPoolExecutor(parallelism) as pool:
        asked = {pool.submit(tagged(fn)): name for name, fn in jobs.items()}
        try:
            for f in as_completed(asked, timeout):
                done[asked[f]] = f.result()
        except FuturesTimeout:
            pass
        finally:  # also when a job failed: the others stop
            late.set()
            pool.shutdown(wait=False, cancel_futures=True)
            if any(f.running() for f in asked):
                sc.cancelJobsWithTag(tag)
    return {k: v for k, v in done.items() if v is not None}


def time_series_cv(df: DataFrame, features: list[str], n_splits: int = 5, params: dict | None = None,
                   log_target: bool = False, parallelism: int = 4, written: bool = False) -> DataFrame:
    """M6: expanding folds (train = everything before the fold). Returns per-fold
    metrics plus mean and population std rows. Folds are fitted ``parallelism`` at a time."""
    folds = fold_vectors(df, features, n_splits, log_target, written)
    got = run_all(df.sparkSession, {k: (lambda k=k: folds.fit_and_score(k, params or {}, False)) for k in folds.folds}, parallelism)
    per_fold = df.sparkSession.createDataFrame([(k, *(got[k][c] for c in ("n", "rmse", "mae", "r2"))) for k in sorted(got)],
                                               "fold int, n long, rmse double, mae double, r2 double")
    summary = per_fold.agg(*[F.avg(c).alias(f"{c}_mean") for c in ("rmse", "mae", "r2")],
                           *[F.stddev_pop(c).alias(f"{c}_std") for c in ("rmse", "mae", "r2")])
    return per_fold.crossJoin(F.broadcast(summary))


#: Ten parameters, in ranges as wide as the source's: trees, depth, rate, row and column shares, leaf size and gain as
#: there; bins, loss and least leaf weight stand for its slope and penalties, which boosted trees of Spark lack.
PARAM_SPACE = {
    "maxIter": ("int", 100, 800), "maxDepth": ("int", 3, 9), "stepSize": ("log", 0.01, 0.3),
    "subsamplingRate": ("float", 0.5, 1.0), "featureSubsetStrategy": ("choice", ["0.5", "0.6", "0.7", "0.8", "0.9", "all"]),
    "minInstancesPerNode": ("int", 1, 10), "minInfoGain": ("float", 0.0, 1.0), "maxBins": ("int", 16, 64),
    "lossType": ("choice", ["squared", "absolute"]), "minWeightFractionPerNode": ("log", 1e-4, 0.05),
}


def sample_params(n: int, seed: int = 42, space: dict | None = None) -> list[dict]:
    """Seeded random draws from the search space (driver-side, tiny)."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        d = {}
        for k, spec in (space or PARAM_SPACE).items():
            kind = spec[0]
            if kind == "int":
                d[k] = rng.randint(spec[1], spec[2])
            elif kind == "float":
                d[k] = rng.uniform(spec[1], spec[2])
            elif kind == "log":
                d[k] = math.exp(rng.uniform(math.log(spec[1]), math.log(spec[2])))
            else:
                d[k] = rng.choice(spec[1])
        out.append(d)
    return out


def random_search(df: DataFrame, features: list[str], n_trials: int = 5, n_splits: int = 3, seed: int = 42,
                  space: dict | None = None, parallelism: int = 5, timeout: float | None = None, log_target: bool = False,
                  written: bool = False):
    """M7: seeded random search minimising mean RMSE of the expanding CV, with early stopping on the fold.
    Returns (best params, trials DataFrame). All fits of all trials share one table of vectors and run
    ``parallelism`` at a time; after ``timeout`` seconds the trials whose folds are all done are returned."""
    folds = fold_vectors(df, features, n_splits, log_target, written)
    drawn = sample_params(n_trials, seed, space)
    jobs = {(i, k): (lambda p=p, k=k: folds.fit_and_score(k, p, True)) for i, p in enumerate(drawn) for k in folds.folds}
    got = run_all(df.sparkSession, jobs, parallelism, timeout)
    rows = []
    for i, p in enumerate(drawn):
        own = [got[i, k] for k in folds.folds if (i, k) in got]
        if own and len(own) == len(folds.folds):
            mean = [sum(r[c] for r in own) / len(own) if all(r[c] is not None for r in own) else None for c in ("rmse", "mae", "r2")]
            rows.append((i, json.dumps(p), *mean))
    if not rows:
        raise TimeoutError(f"no trial ended within {timeout} s")
    trials = df.sparkSession.createDataFrame(rows, "trial int, params string, rmse_mean double, mae_mean double, r2_mean double")
    best = min(rows, key=lambda t: t[2])
    return json.loads(best[1]), trials


# --- M11-M14 ----------------------------------------------------------------------------

def stratified_split(df: DataFrame, label: str, key: str, train_share: float = 0.8, seed: int = 42) -> DataFrame:
    """Per label, rows in hash order; the first share of each class is train.
    Positions come from range-partitioned running counts (a class may be huge)."""
    h = cut_lineage(df)
    rt = running_totals(h.select(key, label, hash_order(key, seed).alias("_h")), [key], ["_h", key], {"_pos": F.lit(1).cast("long")},
                        keys=[label], inclusive=False)
    n = h.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    out = h.join(rt, key).join(n, label)
    return out.withColumn("split", F.when(F.col("_pos") < F.floor(F.col("_n") * train_share), "train")
                          .otherwise("test")).drop("_pos", "_n")


def class_weights(df: DataFrame, label: str, weight_col: str = "weight") -> DataFrame:
    """Weight positives by neg/pos so the imbalance correction takes effect."""
    c = df.agg(F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) != 1).alias("_neg"))
    return df.crossJoin(F.broadcast(c)).withColumn(
        weight_col, F.when(F.col(label) == 1, F.col("_neg") / F.col("_pos")).otherwise(1.0)).drop("_pos", "_neg")


def oversample_minority(train: DataFrame, label: str, key: str, ratio: float = 0.5, seed: int = 42) -> DataFrame:
    """M14 (after the split): replicate minority rows so the minority reaches
    ``ratio`` x majority rows. Copies per row are derived from its hash rank:
    deterministic, exact count, no driver-side sampling."""
    counts = train.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    mm = counts.agg(F.min_by(label, "_n").alias("_min_label"), F.min("_n").alias("_nmin"), F.max("_n").alias("_nmaj"))
    h = train.crossJoin(F.broadcast(mm))
    minority = h.filter(F.col(label) == F.col("_min_label"))
    rt = running_totals(minority.select(key, hash_order(key, seed).alias("_h")), [key], ["_h", key],
                        {"_pos": F.lit(1).cast("long")}, inclusive=False)
    target = F.greatest(F.floor(F.col("_nmaj") * ratio), F.col("_nmin"))
    copies = F.floor(target / F.col("_nmin")) + F.when(F.col("_pos") < target % F.col("_nmin"), 1).otherwise(0)
    up = minority.join(rt, key).withColumn("_copy", F.explode(F.sequence(F.lit(1), copies.cast("int"))))
    majority = h.filter(F.col(label) != F.col("_min_label")).withColumn("_copy", F.lit(1))
    cols = train.columns + ["_copy"]
    return majority.select(*cols).unionByName(up.select(*cols))


def fit_classifier(train: DataFrame, features: list[str], label: str = "is_delayed", weight_col: str | None = None,
                   params: dict | None = None) -> PipelineModel:
    """GBT classifier (probability in ``probability[1]``)."""
    p = {k: v for k, v in GBT_DEFAULTS.items() if k != "lossType"}
    p.update(params or {})
    gbt = GBTClassifier(featuresCol="features", labelCol="_y", **p)
    if weight_col:
        gbt = gbt.setWeightCol(weight_col)
    data = align_features(train, features).withColumn("_y", F.col(label).cast("double"))
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"),
                            gbt]).fit(data)


def score_delay(model: PipelineModel, df: DataFrame, features: list[str]) -> DataFrame:
    """Nulls -> 0, probability of delay and the 0/1 prediction."""
    from pyspark.ml.functions import vector_to_array
    out = model.transform(align_features(df, features))
    return out.withColumn("delay_probability", vector_to_array("probability")[1]) \
        .withColumn("predicted_delay", F.col("prediction").cast("int")) \
        .drop("features", "rawPrediction", "probability", "prediction")


# --- E5 -----------------------------------------------------------------------------

def material_level_metrics(mat: DataFrame, actual: str = "actual_tpt", predicted: str = "predicted_tpt") -> DataFrame:
    """E5: RMSE/MAE/R^2 across materials that have an actual value (needs > 1)."""
    m = mat.filter(F.col(actual).isNotNull())
    return regression_metrics(m, actual, predicted).filter(F.col("n") > 1)
