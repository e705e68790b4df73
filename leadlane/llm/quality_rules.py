"""Quality rules as a learned decision list, with DataFrame and SQL functions only.

``text_features`` measures every whole text inside the JVM. ``learn_rules`` runs sequential covering over labelled
rows: it grows a conjunction of thresholds on two thirds of the statistics, prunes it on the last third, keeps it when
it is precise enough, removes what it covers and starts again. The driver only ever sees histograms of at most
``bins`` cells a feature; the rows stay in Spark. ``verdict`` turns the list into one ordered conditional expression.

Defined results: a null text counts as one without words; an empty text likewise; a null ``doc_id`` is measured but
never used for learning; labelled rows repeated for a ``doc_id`` count once (the lower label); without labelled rows
the list is empty and nothing but the base rule rejects; other columns of the input are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import ASCII_SPACE, table

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks",
            "n_digits", "n_distinct"]
#: What rules may test: ratios, so that a rule means the same for a short and a long text.
RATIOS = {
    "word_length": ("word_chars", "n_words"), "symbol_share": ("n_symbols", "word_chars"),
    "dup_line_share": ("n_dup_lines", "n_lines"), "repeat_share": ("n_repeat_words", "n_words"),
    "upper_share": ("n_upper", "word_chars"), "mark_share": ("n_marks", "word_chars"),
    "digit_share": ("n_digits", "word_chars"), "distinct_share": ("n_distinct", "n_words"),
}
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def text_features(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns and MEASURES (long) per row of ``docs``; linear in the text but for one sort of its windows.

    A repeated word lies in a 3-word window that the text holds twice or more. Windows are told apart by a 64-bit
    hash; their positions are sorted with the hash only in texts that repeat one at all.
    """
    size = lambda c: F.size(c).cast("long")
    t = docs.select(*[F.col(c) for c in keep], F.coalesce("text", F.lit("")).alias("t"))
    t = t.withColumn("w", F.filter(F.split("t", "[ \\t\\n\\x0B\\f\\r]+"), lambda x: x != ""))
    t = t.withColumn("h", F.transform(
        F.slice("w", F.lit(1), F.greatest(F.size("w") - 2, F.lit(0))),
        lambda x, i: F.xxhash64(x, F.get(F.col("w"), i + 1), F.get(F.col("w"), i + 2))))
    # Only lines with a word count; raw lines are compared.
    t = t.withColumn("l", F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(ASCII_SPACE)) != ""))
    t = t.withColumn("s", F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(
        F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    t = t.withColumn("r", F.filter("s", lambda x, j: F.coalesce(
        (x.h == F.get(F.col("s"), j - 1).h) | (x.h == F.get(F.col("s"), j + 1).h),
        x.h == F.get(F.col("s"), j + 1).h, x.h == F.get(F.col("s"), j - 1).h, F.lit(False))))
    covered = F.array_distinct(F.flatten(F.transform("r", lambda x: F.array(x.i, x.i + 1, x.i + 2))))
    return t.select(
        *[F.col(c) for c in keep], size("w").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (size("l") - size(F.array_distinct("l"))).alias("n_dup_lines"),
        F.coalesce(size(covered), F.lit(0)).alias("n_repeat_words"), size("l").alias("n_lines"),
        F.regexp_count("t", F.lit("[A-Z]")).cast("long").alias("n_upper"),
        F.regexp_count("t", F.lit("[!?]")).cast("long").alias("n_marks"),
        F.regexp_count("t", F.lit("[0-9]")).cast("long").alias("n_digits"),
        size(F.array_distinct("w")).alias("n_distinct"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def ratio(name: str) -> Column:
    """A rule's quantity; 0 where there is nothing to divide by."""
    above, below = RATIOS[name]
    return F.coalesce(F.try_divide(F.col(above).cast("double"), F.col(below)), F.lit(0.0))


@dataclass(frozen=True)
class Test:
    """``feature > at`` (above) or ``feature <= at``. ``bin``: the threshold's place among the feature's thresholds."""

    feature: str
    above: bool
    at: float
    bin: int

    def on_bins(self) -> Column:
        return F.col(self.feature) > self.bin if self.above else F.col(self.feature) <= self.bin

    def on_values(self) -> Column:
        return ratio(self.feature) > self.at if self.above else ratio(self.feature) <= self.at

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.at:.6g}"


def _all(tests, how) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & getattr(t, how)()
    return out


def _thresholds(rows: DataFrame, names: list[str], bins: int) -> dict[str, list[float]]:
    """Midpoints between neighbouring approximate quantiles of either class: a rare class gets thresholds of its own, and a
    threshold keeps off the values themselves, so that one stray character does not decide."""
    probs = F.array(*[F.lit(i / (bins + 1)) for i in range(1, bins + 1)])
    ask = [F.percentile_approx(F.when(F.col("y") == y, F.col(n)), probs, 1000).alias(f"{n}_{y}") for n in names for y in (0, 1)]
    got = rows.agg(*ask).first()
    at = {n: sorted({float(v) for y in (0, 1) for v in got[f"{n}_{y}"] or []}) for n in names}
    return {n: [(a + b) / 2 for a, b in zip(v, v[1:])] for n, v in at.items()}


def learn_rules(rows: DataFrame, bins: int = 24, max_rules: int = 12, max_tests: int = 3, min_precision: float = 0.8,
                min_cover: int = 8) -> list[list[Test]]:
    """Ordered conjunctions that mark rejects, from ``rows`` (RATIOS, ``y``: 1 for a reject, ``fold``: 0 prunes)."""
    names = list(RATIOS)
    cuts = _thresholds(rows, names, bins)
    # The bin of a value is the number of thresholds below it: value > cuts[k] exactly where bin > k.
    cells = cut_lineage(rows.select(
        "y", (F.col("fold") > 0).alias("grow"),
        *[sum([(F.col(n) > c).cast("int") for c in cuts[n]], F.lit(0)).alias(n) for n in names],
    ).groupBy("grow", *names).agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")))
    rules: list[list[Test]] = []
    left = F.lit(True)
    for _ in range(max_rules):
        tests: list[Test] = []
        p0 = n0 = None
        for _ in range(max_tests):
            now = cells.where(F.col("grow") & left & _all(tests, "on_bins"))
            hist = now.select(F.explode(F.array(*[F.struct(F.lit(n).alias("f"), F.col(n).alias("b")) for n in names])).alias("x"),
                              "pos", "neg").groupBy("x.f", "x.b").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).collect()
            by = {n: {} for n in names}
            for r in hist:
                by[r.f][r.b] = (r.pos, r.neg)
            if not hist:
                break
            p0, n0 = (sum(v[i] for v in by[names[0]].values()) for i in (0, 1))
            best = max((c for n in names for c in _gains(n, cuts[n], by[n], p0, n0, min_cover)), key=lambda c: c[0], default=None)
            if p0 == 0 or n0 == 0 or best is None or best[0] <= 1e-9:
                break
            tests.append(best[1])
        if not tests:
            break
        held = cells.where(~F.col("grow") & left)
        sums = held.agg(*[F.sum(F.when(_all(tests[:k], "on_bins"), F.col(c))).alias(f"{c}{k}") for k in range(1, len(tests) + 1) for c in ("pos", "neg")]).first()
        worth = lambda k: ((sums[f"pos{k}"] or 0) + 1) / ((sums[f"pos{k}"] or 0) + (sums[f"neg{k}"] or 0) + 2)
        k = max(range(1, len(tests) + 1), key=lambda k: (round(worth(k), 9), -k))
        if worth(k) < min_precision:
            break
        rules.append(tests[:k])
        left = left & ~_all(tests[:k], "on_bins")
    return rules


def _gains(name, cuts, hist, p0, n0, min_cover):
    """FOIL gain of every threshold test on one feature, from its histogram."""
    from math import log2

    before = log2((p0 + 1) / (p0 + n0 + 2))
    low_p = low_n = 0
    for k, at in enumerate(cuts):
        got = hist.get(k, (0, 0))
        low_p, low_n = low_p + got[0], low_n + got[1]
        for above, p, n in ((False, low_p, low_n), (True, p0 - low_p, n0 - low_n)):
            if p >= min_cover and (p, n) != (p0, n0):
                yield p * (log2((p + 1) / (p + n + 2)) - before), Test(name, above, at, k)


def verdict(rules: list[list[Test]]) -> Column:
    """0 where no rule fires, else the place of the first rule that does: one ordered conditional expression."""
    out = None
    for k, tests in enumerate(rules, 1):
        out = F.when(_all(tests, "on_values"), k) if out is None else out.when(_all(tests, "on_values"), k)
    return F.lit(0) if out is None else out.otherwise(0)


def labelled(features: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Ratios of the rows that carry a label, once for each ``key``."""
    y = labels.where(f"{key} is not null and quality is not null").groupBy(key).agg((1 - F.min("quality")).alias("y"))
    return (features.where(F.col(key).isNotNull() & ~base_failed()).select(key, *[ratio(n).alias(n) for n in RATIOS])
            .dropDuplicates([key]).join(y, key)
            .select("y", F.pmod(F.xxhash64(key), F.lit(3)).alias("fold"), *RATIOS))


def apply_rules(features: DataFrame, rules: list[list[Test]]) -> DataFrame:
    """``features`` with base_failed, rule (0: none) and kept."""
    return features.withColumns({"base_failed": base_failed(), "rule": verdict(rules)}).withColumn(
        "kept", ~F.col("base_failed") & (F.col("rule") == 0))


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: measures, base rule and learned verdict of every document."""
    f = cut_lineage(text_features(table(spark, sf_dir, "documents"), ["doc_id"]))
    rules = learn_rules(labelled(f, table(spark, sf_dir, "labels")))
    return apply_rules(f, rules).select("doc_id", *MEASURES[:5], "base_failed", "kept", "rule")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the base rule and the learned list keep, with all their columns."""
    row = docs.select("doc_id", "text", F.struct("*").alias("row"))
    f = cut_lineage(text_features(row, ["doc_id", "row"]))
    rules = learn_rules(labelled(f.drop("row"), table(spark, sf_dir, "labels")))
    return apply_rules(f, rules).where("kept").select("row.*")
