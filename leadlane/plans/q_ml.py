"""Model queries (rows-only checks: boosted-tree values have no SQL oracle)."""

import uuid

from pyspark.sql import functions as F

from ..operators import classic as CL
from ..operators import enrich as E
from ..operators import evaluate as EV
from ..operators import features as FT
from ..operators import ml as ML
from ..operators import robust as RB
from ..operators import rollups as R
from ..session import cut_lineage, ensure_checkpoint_dir, remember_scratch
from ..sources.fixtures import Views
from . import sqlparts as S
from .q_classic import v1_rows
from .registry import enriched, r6, register, train_rows


def _v4(spark, sf):
    """The model's inputs with what names, orders and labels a row, written once: splits, folds, filters and fits read
    them many times, and each reading would run all feature joins again."""
    rows = enriched(Views(spark, sf))
    df = FT.features_v4(rows if rows is None else rows.select(*FT.MODEL_READ))
    feats = FT.feature_columns(df)
    return cut_lineage(df.select("production_number", "material", "created_date", ML.LABEL, *feats)), feats


@register("gbt_lead_time")
def q_gbt_lead_time(spark, sf):
    df, feats = _v4(spark, sf)
    _, pred, _ = ML.train_lead_time(df, feats, written=True)
    out = R.prediction_errors(pred.select("production_number", "material", "split",
                                          F.col("actual_production_days").alias("actual"), "predicted"))
    return r6(out)


@register("gbt_lead_time_metrics")
def q_gbt_metrics(spark, sf):
    df, feats = _v4(spark, sf)
    _, _, metrics = ML.train_lead_time(df, feats, written=True, log_target=True)
    return r6(metrics)


@register("feature_importance")
def q_feature_importance(spark, sf):
    df, feats = _v4(spark, sf)
    model, _, _ = ML.train_lead_time(df, feats, written=True, validation_share=0.0)
    # one row per model feature (bounded by the feature list, not by data)
    return spark.createDataFrame(model.importance(), "feature string, importance double")


@register("huber_lead_time")
def q_huber_lead_time(spark, sf):
    """M4: robust regression with L1 and L2 penalties; train and test metrics."""
    df, feats = _v4(spark, sf)
    _, _, metrics = RB.train_huber_lead_time(df, feats, written=True)
    return r6(metrics)


@register("cv_metrics")
def q_cv_metrics(spark, sf):
    df, feats = _v4(spark, sf)
    return r6(ML.time_series_cv(df, feats, 5, written=True))


@register("random_search")
def q_random_search(spark, sf):
    df, feats = _v4(spark, sf)
    _, trials = ML.random_search(df, feats, written=True)
    return trials


#: F7 of the evaluation queries: targets up to ten days.
EVALUATE_UP_TO = 10.0


@register("evaluation_rows", S.over_enriched(f"""
select production_number, round(y, 6) as actual_production_days
from (select production_number, actual_production_days as y, row_number() over (order by created_date, production_number) - 1 as k, count(*) over () as n from train) t
where k >= floor(n * 0.8) and y <= {EVALUATE_UP_TO}""", train=True))
def q_evaluation_rows(spark, sf):
    """The rows that a saved model is evaluated on, the tail of the time order up to a target."""
    tail = EV.chronological_split(train_rows(Views(spark, sf))).filter("split = 'test'")
    return r6(E.test_set_filter(tail, max_target=EVALUATE_UP_TO).select("production_number", "actual_production_days"))


@register("saved_model_eval")
def q_saved_model_eval(spark, sf):
    """Train, save, load, and report E1 on the filtered tail with the loaded model."""
    df, feats = _v4(spark, sf)
    model, pred, _ = ML.train_lead_time(df, feats, written=True)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/models/{uuid.uuid4().hex}"
    remember_scratch(path)
    model.save(path)
    tail = E.test_set_filter(pred.filter("split = 'test'").drop("predicted"), max_target=EVALUATE_UP_TO)
    scored = ML.LeadTimeModel.load(spark, path).predict(tail)
    return r6(EV.regression_metrics(scored, ML.LABEL, "predicted"))


def _v1(spark, sf):
    return CL.features_v1(v1_rows(Views(spark, sf)))


def _labels(spark, sf):
    return enriched(Views(spark, sf)).select("production_number", "is_delayed")


_POS = """select production_number, is_delayed,
  row_number() over (partition by is_delayed order by md5(cast(production_number as varchar) || ':42'), production_number) - 1 as pos,
  count(*) over (partition by is_delayed) as n from enriched"""


@register("stratified_split", S.over_enriched(f"""
select production_number, is_delayed, case when pos < floor(n * 0.8) then 'train' else 'test' end as split from ({_POS}) p"""))
def q_stratified_split(spark, sf):
    return ML.stratified_split(_labels(spark, sf), "is_delayed", "production_number")


@register("oversample", S.over_enriched(f"""
select production_number, is_delayed, 'train' as split, cast(unnest(range(1, 1 + cast(copies as bigint))) as int) as _copy
from (select t.*, case when is_delayed = minority then floor(target / smallest)
        + case when row_number() over (partition by is_delayed order by md5(cast(production_number as varchar) || ':42'), production_number) - 1 < target % smallest
            then 1 else 0 end else 1 end as copies
      from (select *, greatest(floor(largest * 0.5), smallest) as target
            from (select * from ({_POS}) p where pos < floor(n * 0.8)) s,
              (select arg_min(is_delayed, c) as minority, min(c) as smallest, max(c) as largest
               from (select is_delayed, count(*) as c from ({_POS}) p where pos < floor(n * 0.8) group by 1) g) k) t) o"""))
def q_oversample(spark, sf):
    split = ML.stratified_split(_labels(spark, sf), "is_delayed", "production_number")
    return ML.oversample_minority(split.filter(F.col("split") == "train"), "is_delayed", "production_number")


@register("class_weights", S.over_enriched(f"""
select production_number, is_delayed,
  round(case when is_delayed = 1 then cast(neg as double) / pos_n else 1 end, 6) as weight
from (select * from ({_POS}) p where pos < floor(n * 0.8)) s,
  (select count(case when is_delayed = 1 then 1 end) as pos_n, count(case when is_delayed <> 1 then 1 end) as neg
   from ({_POS}) p where pos < floor(n * 0.8)) c"""))
def q_class_weights(spark, sf):
    train = ML.stratified_split(_labels(spark, sf), "is_delayed", "production_number").filter(F.col("split") == "train")
    return r6(ML.class_weights(train, "is_delayed").select("production_number", "is_delayed", "weight"))


@register("gbt_delay")
def q_gbt_delay(spark, sf):
    df = _v1(spark, sf)
    rows = df.select(*dict.fromkeys(["production_number", "is_delayed", *CL.V1_FEATURES]))
    # Written once: the counts of the weights, the bins, every reading of a fit and the scores take it from there.
    split = cut_lineage(ML.stratified_split(rows, "is_delayed", "production_number"))
    train = ML.class_weights(split.filter(F.col("split") == "train"), "is_delayed")
    model = ML.fit_classifier(train, CL.V1_FEATURES, weight_col="weight")
    scored = ML.score_delay(model, split, CL.V1_FEATURES)
    return r6(scored.select("production_number", "split", "is_delayed", "delay_probability", "predicted_delay"))
