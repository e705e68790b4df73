"""The statistics that order features look up, as tables by their natural key.

``SourceStatistics`` computes them from a set of rows. ``HistoryState`` keeps what they are made of for a history of
orders - sums per key, counts and sums per key and creation value, counts per value - as parquet tables, so that new
orders are scored without reading the history again. ``StateStatistics`` answers for new orders from those tables:
it reads the entries of the keys that the new orders have, adds the new orders' own entries (as if all had been in
one table), and applies the same windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .scale import (BEFORE, EVENT, exact_quantiles, forward_over, forward_table, group_table, null_safe_join, quantiles_of_counts, range_over,
                    running_totals, with_order_value)

TARGET = "actual_production_days"
TIME_ORDER = ["created_date", "production_number"]


def parts_of(target: str) -> dict:
    """What look-backs read of the orders of one key and creation value: labelled count, sum, squares, maximum, latest; all orders."""
    y = F.col(target)
    last = F.struct(F.unix_micros(F.col("created_date").cast("timestamp")).alias("t"), F.col("production_number").alias("k"), y.alias("y"))
    return {"_n": F.count(y), "_s": F.sum(y), "_s2": F.sum(y * y), "_mx": F.max(y), "_last": F.max(F.when(y.isNotNull(), last)), "_c": F.count(F.lit(1))}


#: How entries of one key and value are put together.
MERGE = {"_n": F.sum, "_s": F.sum, "_s2": F.sum, "_mx": F.max, "_last": F.max, "_c": F.sum, "_q": F.sum, "_g": F.sum}


class SourceStatistics:
    """Statistics over the rows of ``source``."""

    def __init__(self, source: DataFrame, target: str = TARGET):
        self.source, self.target = source, target
        with_ov, self.unit = with_order_value(source, "created_date", "_ov")
        self.timed = with_ov.withColumn("_fv", F.col("_ov"))
        if "planned_start_date" in source.columns:
            self.timed, _ = with_order_value(self.timed, "planned_start_date", "_ev")

    def starting(self) -> DataFrame:
        return group_table(self.source, ["planned_start_date"], {
            "concurrent_orders_on_start": F.count("order_quantity").cast("double"),
            "concurrent_qty_on_start": F.coalesce(F.sum("order_quantity"), F.lit(0.0))})

    def forward(self, key: str, spans: dict[str, int]) -> DataFrame:
        return forward_table(self.timed, key, "_fv", "_ev", "order_quantity", self.unit, spans)

    def quantity_p95(self, approx: bool = False) -> DataFrame:
        if approx:
            return self.source.agg(F.percentile_approx("order_quantity", 0.95, 100000).cast("double").alias("_p95"))
        return exact_quantiles(self.source, "order_quantity", [0.95], ["_p95"])

    def material_quantity(self) -> DataFrame:
        return group_table(self.source, ["material"], {"_mat_avg_qty": F.avg("order_quantity")})

    def line_orders(self) -> DataFrame:
        return group_table(self.source, ["production_line"], {"production_line_freq": F.count(F.lit(1)).cast("double")})

    def look_back(self, keys: list[str], frames: dict[int, dict[str, tuple[str, str]]]) -> DataFrame:
        needed = {c for aggs in frames.values() for _, c in aggs.values()}
        parts = self.timed.groupBy(*keys, "_ov").agg(*[v.alias(n) for n, v in parts_of(self.target).items() if n in needed])
        return range_over(parts, keys, "_ov", self.unit, frames)

    def stored(self, key: str, back: int, forward: int) -> DataFrame | None:
        """Records for ``day_records`` besides the rows themselves."""
        return None

    def gate(self, lookback_days: int) -> DataFrame:
        return labelled_gate(self.timed, F.col(self.target), self.unit, lookback_days)

    def global_means(self) -> DataFrame:
        return global_running(self.source, self.target)

    def expanding(self, key: str) -> DataFrame:
        return expanding_mean_table(self.source, self.target, "_te", strict=True, keys=[key])


def labelled_gate(src: DataFrame, y, unit: int, lookback_days: int) -> DataFrame:
    """Per creation value t: the number ``_g90`` of labelled orders created in [t - look-back, t), over all keys.

    Each value is shifted to where it enters and leaves a look-back; running
    totals along the values (range-partitioned, so timestamps that are all
    distinct spread over the tasks) give the count as a difference.
    """
    return gate_of_counts(src.groupBy("_ov").agg(F.count(y).alias("_g")), unit, lookback_days)


def gate_of_counts(day: DataFrame, unit: int, lookback_days: int) -> DataFrame:
    """``labelled_gate`` from the labelled orders ``_g`` of each creation value."""
    day = day.where("_ov is not null")
    # At one value, kind 1 asks before kind 2 enters or leaves: rows created at t aren't earlier than t, and rows
    # created exactly a look-back before t still count.
    marks = day.select(F.explode(F.array(
        F.struct((F.col("_ov") + lookback_days * unit).alias("v"), F.lit(2).alias("kind"), F.col("_ov").alias("src"), (-F.col("_g")).alias("g")),
        F.struct(F.col("_ov").alias("v"), F.lit(1).alias("kind"), F.col("_ov").alias("src"), F.lit(0).cast("long").alias("g")),
        F.struct(F.col("_ov").alias("v"), F.lit(2).alias("kind"), F.col("_ov").alias("src"), F.col("_g").alias("g")))).alias("m")).select(
        "m.v", "m.kind", "m.src", "m.g")
    rt = running_totals(marks, ["v", "kind", "src"], ["v", "kind", "src"], {"_g90": F.col("g")})
    return rt.filter("kind = 1").select(F.col("src").alias("_ov"), "_g90")


def expanding_mean_table(source: DataFrame, target: str = TARGET, name: str = "_expanding_mean",
                         strict: bool = False, keys: list[str] | None = None) -> DataFrame:
    """W10/W11-W13 table ``(production_number, name)``: mean of the non-null target
    over earlier orders in time order (per ``keys`` if given; the current order
    is included unless ``strict``). Null when there is none."""
    rt = running_totals(source, ["production_number"], TIME_ORDER,
                        {"_es": F.col(target), "_en": F.col(target).isNotNull().cast("long")},
                        keys=keys, inclusive=not strict)
    return rt.select("production_number", F.when(F.col("_en") > 0, F.col("_es") / F.col("_en")).alias(name))


def global_running(source: DataFrame, target: str = TARGET) -> DataFrame:
    """One pass of global running totals in time order giving both the inclusive
    (W10) and the strictly-earlier (W13) mean target per order."""
    y = F.col(target)
    rt = running_totals(source.select("production_number", *TIME_ORDER, target), ["production_number"], TIME_ORDER,
                        {"_es": y, "_en": y.isNotNull().cast("long")}, inclusive=True)
    own = source.select("production_number", F.coalesce(y, F.lit(0.0)).alias("_oy"),
                        y.isNotNull().cast("long").alias("_on"))
    j = rt.join(own, "production_number")
    return j.select("production_number",
                    F.when(F.col("_en") > 0, F.col("_es") / F.col("_en")).alias("_incl_mean"),
                    F.when(F.col("_en") - F.col("_on") > 0,
                           (F.col("_es") - F.col("_oy")) / (F.col("_en") - F.col("_on"))).alias("_strict_mean"))


class HistoryState:
    """A history of orders as the tables that scoring needs, each of a row per key (and day), and the labelled rows by
    month of creation, of which scoring reads the months of the new orders only."""

    def __init__(self, tables: dict[str, DataFrame]):
        self.tables = tables

    @staticmethod
    def build(base: DataFrame, target: str = TARGET) -> "HistoryState":
        """``base``: orders with labels where known, as ``features_v4`` takes them."""
        s = SourceStatistics(base, target)
        y, t = F.col(target), s.timed
        parts = lambda *keys: t.groupBy(*keys, "_ov").agg(*[v.alias(n) for n, v in parts_of(target).items()])
        events = lambda key: t.groupBy(key, F.col("_ev").alias("_v")).agg(F.count(F.lit(1)).alias("_n"), F.sum("order_quantity").alias("_q"))
        return HistoryState({
            "starting": t.groupBy("planned_start_date").agg(F.count("order_quantity").alias("_n"), F.sum("order_quantity").alias("_q")),
            "events_production_line": events("production_line"), "events_material": events("material"),
            "parts_material": parts("material"), "parts_production_line": parts("production_line"),
            "parts_material_production_line": parts("material", "production_line"),
            "day": t.groupBy("_ov").agg(F.count(y).alias("_n"), F.sum(y).alias("_s")),
            "quantity": t.groupBy(F.col("order_quantity").alias("_x")).agg(F.count(F.lit(1)).alias("_n")),
            "material": t.groupBy("material").agg(F.count("order_quantity").alias("_n"), F.sum("order_quantity").alias("_q")),
            "production_line": t.groupBy("production_line").agg(F.count(F.lit(1)).alias("_n")),
            "labelled": t.where(y.isNotNull()).select("production_number", "material", "production_line", "_ov", y.alias("_s"), F.date_format("created_date", "yyyyMM").cast("int").alias("month")),
        })

    def save(self, path: str) -> None:
        for name, df in self.tables.items():
            w = df.hint("rebalance", F.col("month")).write.partitionBy("month") if name == "labelled" else df.write
            w.mode("overwrite").parquet(f"{path}/{name}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "HistoryState":
        names = ["starting", "events_production_line", "events_material", "parts_material", "parts_production_line",
                 "parts_material_production_line", "day", "quantity", "material", "production_line", "labelled"]
        return HistoryState({n: spark.read.parquet(f"{path}/{n}") for n in names})

    def append(self, base: DataFrame, target: str = TARGET) -> "HistoryState":
        """The state of this history and further orders that it does not hold yet."""
        more = HistoryState.build(base, target).tables
        out = {}
        for name, old in self.tables.items():
            both = old.unionByName(more[name])
            keys = [c for c in old.columns if c not in MERGE]
            out[name] = both if name == "labelled" else both.groupBy(*keys).agg(*[MERGE[c](c).alias(c) for c in old.columns if c in MERGE])
        return HistoryState(out)

    def statistics(self, new: DataFrame, target: str = TARGET) -> "StateStatistics":
        return StateStatistics(self, new, target)


#: Keys of new orders up to which a stored history is read by key.
FEW_KEYS = 10_000


class StateStatistics(SourceStatistics):
    """Statistics for ``new`` orders over a stored history and the new orders themselves."""

    def __init__(self, state: HistoryState, new: DataFrame, target: str = TARGET):
        super().__init__(new, target)
        self.state, self.own = state.tables, HistoryState.build(new, target).tables

    def _entries(self, name: str, keys: list[str]) -> DataFrame:
        """The entries of a table for the key values that new orders have; null is no key."""
        old = self.state[name]
        if keys:
            old = old.join(self.source.select(*keys).dropna().distinct(), keys, "left_semi")
        both = old.unionByName(self.own[name])
        by = [c for c in old.columns if c not in MERGE]
        return both.groupBy(*by).agg(*[MERGE[c](c).alias(c) for c in old.columns if c in MERGE])

    def starting(self) -> DataFrame:
        return self._entries("starting", ["planned_start_date"]).where("planned_start_date is not null").select(
            "planned_start_date", F.col("_n").cast("double").alias("concurrent_orders_on_start"), F.coalesce("_q", F.lit(0.0)).alias("concurrent_qty_on_start"))

    def forward(self, key: str, spans: dict[str, int]) -> DataFrame:
        return forward_over(self._entries(f"events_{key}", [key]), self.timed, key, "_fv", self.unit, spans)

    def quantity_p95(self, approx: bool = False) -> DataFrame:
        return quantiles_of_counts(self._entries("quantity", []).withColumnRenamed("_n", "_c"), [0.95], ["_p95"])

    def material_quantity(self) -> DataFrame:
        return self._entries("material", ["material"]).where("material is not null").select("material", F.try_divide("_q", "_n").alias("_mat_avg_qty"))

    def line_orders(self) -> DataFrame:
        return self._entries("production_line", ["production_line"]).where("production_line is not null").select(
            "production_line", F.col("_n").cast("double").alias("production_line_freq"))

    def look_back(self, keys: list[str], frames: dict[int, dict[str, tuple[str, str]]]) -> DataFrame:
        return range_over(self._entries("_".join(["parts", *keys]), keys), keys, "_ov", self.unit, frames)

    def stored(self, key: str, back: int, forward: int) -> DataFrame:
        """Entries of the history that new orders' days reach; of their keys only, where those are few."""
        parts = self.state["parts_material_production_line" if key == "material" else f"parts_{key}"]
        events = self.state[f"events_{key}"].select(key, "_v", F.col("_n").alias("_en"), F.col("_q").alias("_eq"), F.lit(EVENT).alias("_kind"))
        both = parts.withColumnRenamed("_ov", "_v").withColumn("_kind", F.lit(BEFORE)).unionByName(events, allowMissingColumns=True)
        reach = self.timed.agg(F.min("_ov").alias("_lo"), F.max("_ov").alias("_hi"))
        before, v = F.col("_kind") == BEFORE, F.col("_v")
        near = F.when(before, (v >= F.col("_lo") - back) & (v < F.col("_hi"))).otherwise((v > F.col("_lo")) & (v <= F.col("_hi") + forward))
        both = both.crossJoin(F.broadcast(reach)).where(near).drop("_lo", "_hi")  # one row
        asked = self.source.select(key).dropna().distinct()
        return both.join(F.broadcast(asked), key, "left_semi") if asked.limit(FEW_KEYS + 1).count() <= FEW_KEYS else both

    def gate(self, lookback_days: int) -> DataFrame:
        days = self._entries("day", []).select("_ov", F.col("_n").alias("_g"))
        return gate_of_counts(days, self.unit, lookback_days).join(self.timed.select("_ov").distinct(), "_ov", "left_semi")

    def _before(self, key: str | None) -> DataFrame:
        """(production_number, _en, _es): labelled orders earlier in time order, of the same key (null is one too)."""
        keys = [key] if key else []
        new = self.timed.select("production_number", "_ov", *keys, F.date_format("created_date", "yyyyMM").cast("int").alias("month"))
        whole = self.state[f"parts_{key}"] if key else self.state["day"]
        if key:
            asked = new.select(key).distinct().withColumn("_asked", F.lit(True))
            whole = null_safe_join(whole, asked, [key]).where("_asked")
        values = new.select("_ov").distinct()
        # Values at which a new order was created count order by order, all others as one entry each.
        whole = whole.join(values, "_ov", "left_anti").select(*keys, "_ov", F.lit(None).cast("long").alias("production_number"), "_n", "_s")
        same = self.state["labelled"].join(new.select("month").distinct(), "month", "left_semi")
        same = same.join(values, "_ov", "left_semi").select(*keys, "_ov", "production_number", F.lit(1).cast("long").alias("_n"), "_s")
        own = self.timed.select(*keys, "_ov", "production_number", F.col(self.target).isNotNull().cast("long").alias("_n"), F.col(self.target).alias("_s"))
        every = whole.unionByName(same.withColumn("_new", F.lit(False)), allowMissingColumns=True).unionByName(own.withColumn("_new", F.lit(True)), allowMissingColumns=True)
        rt = running_totals(cut_lineage(every.withColumn("_new", F.coalesce("_new", F.lit(False)))), ["production_number", "_new", "_ov"], ["_ov", "production_number", "_new"],
                            {"_en": F.col("_n"), "_es": F.col("_s")}, keys=keys, inclusive=False)
        return rt.where("_new").select("production_number", "_en", "_es")

    def global_means(self) -> DataFrame:
        j = self._before(None).join(self.source.select("production_number", F.col(self.target).alias("_y")), "production_number")
        n, s = F.col("_en") + F.col("_y").isNotNull().cast("long"), F.col("_es") + F.coalesce("_y", F.lit(0.0))
        return j.select("production_number", F.when(n > 0, s / n).alias("_incl_mean"), F.when(F.col("_en") > 0, F.col("_es") / F.col("_en")).alias("_strict_mean"))

    def expanding(self, key: str) -> DataFrame:
        return self._before(key).select("production_number", F.when(F.col("_en") > 0, F.col("_es") / F.col("_en")).alias("_te"))
