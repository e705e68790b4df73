"""Skew-safe building blocks for order-dependent statistics.

Naive forms of these operators either run a window with no PARTITION BY (the
whole table in one task) or partition by a key that may hold a third of all
rows. The forms here never do:

* ``running_totals`` - running sums along a total order, optionally per key.
  Rows are range-partitioned on ``(keys, order)`` so a hot key spans many
  tasks; per-partition totals form a table of at most ``partitions x keys``
  rows whose prefix sums are joined back.
* ``range_table`` - statistics over a value range of the order column (e.g.
  the 90 days before creation). Rows are first aggregated to one row per
  ``(key, day)`` - decomposable sums, counts, maxima - so the window runs over
  distinct days, never over orders, and a hot key is just a longer day list.
* ``sliced_frames`` - the same on timestamps: a key's time line is cut into
  slices, and a frame is put together from the ends of two slices and whole
  slices between them, so a hot key is many groups.
* ``day_records`` - rows of days themselves, dealt by key and slice of time, so
  that windows give them such statistics without a join.
* ``forward_table`` - the same for "rows whose event falls in (t, t + k]".
* ``group_table`` - group aggregate to be joined back to rows (pandas
  ``groupby.transform``) instead of an unordered window over a possibly hot key.

Each builder returns a small *stats table* keyed by its natural key; callers
join it back once. Computing every table from one shared source keeps the plan
linear in the number of stages.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def all_not_null(cols: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join on ``keys`` where null equals null; right-side key copies are dropped."""
    ren = right.select(*[F.col(k).alias(f"_nk_{k}") for k in keys],
                       *[c for c in right.columns if c not in keys])
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(ren[f"_nk_{k}"]) for k in keys])
    return left.join(ren, cond, how).drop(*[f"_nk_{k}" for k in keys])


def group_table(source: DataFrame, keys: list[str], aggs: dict[str, Column],
                null_keys: str = "mask") -> DataFrame:
    """One row per group of ``keys``. ``null_keys='mask'`` drops null-key rows
    (pandas groupby semantics); ``'group'`` keeps nulls as a group."""
    src = source if null_keys == "group" else source.filter(all_not_null(keys))
    return src.groupBy(*keys).agg(*[v.alias(n) for n, v in aggs.items()])


def attach_group_agg(df: DataFrame, keys: list[str], aggs: dict[str, Column],
                     null_keys: str = "mask", source: DataFrame | None = None) -> DataFrame:
    """``groupby(keys).transform``: aggregate (map-side partial) and join back.
    AQE broadcasts the group table when its runtime size allows."""
    g = group_table(source if source is not None else df, keys, aggs, null_keys)
    if null_keys == "group":
        return null_safe_join(df, g, keys)
    return df.join(g, keys, "left")


def hash_order(key: str, seed: int) -> Column:
    """A row's place in a seeded pseudo-random order that any engine can repeat: md5 of "key:seed"."""
    return F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))


def order_value(col: str, dtype: str) -> tuple[Column, int]:
    """Integer order value of a date/timestamp column and the length of one day in it."""
    if dtype == "date":
        return F.unix_date(F.col(col)).cast("long"), 1
    return F.unix_micros(F.col(col).cast("timestamp")), 86_400_000_000


def with_order_value(df: DataFrame, col: str, name: str) -> tuple[DataFrame, int]:
    ov, unit = order_value(col, "date" if dict(df.dtypes)[col] == "date" else "ts")
    return df.withColumn(name, ov), unit


def _value_aggs(aggs: dict[str, tuple[str, str]]) -> dict[str, Column]:
    return {name: getattr(F, fn)(col) for name, (fn, col) in aggs.items()}


def _either(fn: str, a: Column, b: Column) -> Column:
    """Two partial results in one; a null is no result."""
    return F.greatest(a, b) if fn == "max" else F.coalesce(a + b, a, b)


def sliced_frames(events: DataFrame, probes: DataFrame, keys: list[str], ov: str, frames: dict[str, tuple[int, int]],
                  aggs: dict[str, tuple[str, str]], per_span: int = 8) -> DataFrame:
    """Table ``(keys, ov, <frame>_<name>...)``: for each probe t and frame (lo, hi), the aggregates of the events of
    the same keys with value in ``[t + lo, t + hi)``. Aggregates are ``name -> ("sum" | "max", column)``.

    Each key's time line is cut into slices, so that a key that holds most rows is as many groups as it has slices,
    and no frame slides over rows. The slice length divides every frame's length, at least ``per_span`` times the
    shortest one's; a frame is then always

    * the end of the slice that it begins in: rows from t + lo on, summed from the slice's end,
    * a fixed number of whole slices, summed over one row a slice,
    * the beginning of the slice that it ends in: rows before t + hi, summed from the slice's start.

    Probes go as halo rows to the two slices in which their frames begin and end, and take the running aggregate there
    in linear time; what a task holds is one slice of one key, or one key's slices as one row each.
    """
    length = reduce(math.gcd, [hi - lo for lo, hi in frames.values()])
    assert length % per_span == 0, "frames too short for slices"
    length //= per_span
    start = lambda c: F.col(c) - F.pmod(F.col(c), F.lit(length))
    names = list(aggs)
    cols = list(dict.fromkeys(c for _, c in aggs.values()))
    types = dict(events.dtypes)
    nulls = [F.lit(None).cast(types[c]).alias(c) for c in cols]
    ev = events.where(all_not_null(keys + [ov])).select(*keys, F.col(ov).alias("_v"), F.lit(None).cast("long").alias("_t"),
                                                         F.lit(None).cast("string").alias("_f"), F.lit(False).alias("_end"), *cols)
    asked = probes.where(all_not_null(keys + [ov])).select(*keys, F.col(ov).alias("_t")).distinct()
    ends = F.explode(F.array(*[F.struct((F.col("_t") + at).alias("v"), F.lit(f).alias("f"), F.lit(end).alias("end"))
                               for f, (lo, hi) in frames.items() for at, end in ((lo, False), (hi, True))])).alias("p")
    halo = asked.select(*keys, "_t", ends).select(*keys, F.col("p.v").alias("_v"), "_t", F.col("p.f").alias("_f"), F.col("p.end").alias("_end"), *nulls)
    rows = ev.unionByName(halo).withColumn("_slice", start("_v"))
    before = Window.partitionBy(*keys, "_slice").orderBy("_v").rangeBetween(Window.unboundedPreceding, -1)
    onward = Window.partitionBy(*keys, "_slice").orderBy(F.col("_v").desc()).rangeBetween(Window.unboundedPreceding, 0)
    value = _value_aggs(aggs)
    edges = rows.select(*keys, "_slice", "_t", "_f", "_end",
                        *[F.when(F.col("_end"), value[n].over(before)).otherwise(value[n].over(onward)).alias(n) for n in names]).where("_t is not null")
    # Whole slices: one row a slice, also where only probes begin.
    whole = rows.groupBy(*keys, "_slice").agg(*[value[n].alias(n) for n in names])
    over = lambda f: Window.partitionBy(*keys).orderBy("_slice").rangeBetween(length, frames[f][1] - frames[f][0] - length)
    middle = whole.select(*keys, "_slice", *[getattr(F, fn)(n).over(over(f)).alias(f"_{f}_{n}") for f in frames for n, (fn, _) in aggs.items()])
    j = edges.join(middle, [*keys, "_slice"])
    mid = {n: reduce(lambda a, f: F.when((F.col("_f") == f) & ~F.col("_end"), F.col(f"_{f}_{n}")).otherwise(a), frames, F.lit(None)) for n in names}
    j = j.select(*keys, "_t", "_f", *[_either(aggs[n][0], F.col(n), mid[n]).alias(n) for n in names])
    return j.groupBy(*keys, F.col("_t").alias(ov)).agg(
        *[getattr(F, fn)(F.when(F.col("_f") == f, F.col(n))).alias(f"{f}_{n}") for f in frames for n, (fn, _) in aggs.items()])


#: Kinds of ``day_records``: a row at its day, what happened before the rows of the next slice, an event to come.
ROW, BEFORE, EVENT = 0, 1, 2


def row_slice(key: str, length: int, row_key: str = "production_number") -> Column:
    """The slice of a row's own day ``_ov``; rows without key or day are alone."""
    return F.when(F.col(key).isNotNull() & F.col("_ov").isNotNull(), F.floor(F.col("_ov") / F.lit(length))).otherwise(F.xxhash64(row_key))


def day_records(rows: DataFrame, key: str, back: int, forward: int, entry: list[str], event: list[str],
                row_key: str = "production_number", stored: DataFrame | None = None) -> DataFrame:
    """Rows with a day ``_ov`` and the day ``_ev`` of their event as records ``(key, _slice, _v, _kind, ...)``, dealt by
    (key, slice of time): windows over ``_v`` by those see what happened up to ``back`` days before a row's day, and
    events up to ``forward`` days after it. Rows keep all their columns and need no join to meet their statistics.

    A slice is as long as two of the longer frame; rows at its end go to the next slice too (with the ``entry``
    columns), events (with the ``event`` columns) at its beginning to the one before. So a key that holds most rows is
    as many groups as it has slices. Rows without key or day are groups of their own, to be given nothing. ``stored``:
    further records ``(key, _v, _kind, ...)`` of kind BEFORE or EVENT; what else they have is null for rows.
    """
    length = 2 * max(back, forward)
    at = lambda v: F.floor(v / F.lit(length))
    into = lambda v: F.pmod(v, F.lit(length))
    place = lambda kind, v, s: F.struct(F.lit(kind).alias("k"), v.alias("v"), s.alias("s"))
    after = lambda v: F.when(into(v) >= length - back, place(BEFORE, v, at(v) + 1))
    ahead = lambda v: F.when(into(v) < forward, place(EVENT, v, at(v) - 1))
    ov, ev, named, kind = F.col("_ov"), F.col("_ev"), F.col(key).isNotNull(), F.col("_p.k")
    places = [place(ROW, ov, row_slice(key, length, row_key)), F.when(named, after(ov)), F.when(named & ev.isNotNull(), place(EVENT, ev, at(ev))), F.when(named, ahead(ev))]
    seen = {c: kind == ROW for c in rows.columns if c not in (key, "_ov")}
    seen |= {c: kind != EVENT for c in entry} | {c: kind != BEFORE for c in event}
    out = rows.select("*", F.explode(F.filter(F.array(*places), lambda p: p.isNotNull())).alias("_p")).select(
        key, F.col("_p.s").alias("_slice"), F.col("_p.v").alias("_v"), kind.alias("_kind"), *[F.when(when, F.col(c)).alias(c) for c, when in seen.items()])
    if stored is not None:
        v = F.col("_v")
        of_kind = lambda p: p.isNotNull() & (p["k"] == F.col("_kind"))
        places = F.filter(F.array(place(BEFORE, v, at(v)), after(v), place(EVENT, v, at(v)), ahead(v)), of_kind)
        more = stored.where(named & v.isNotNull()).select("*", F.explode(places).alias("_p")).withColumn("_slice", F.col("_p.s")).drop("_p")
        out = out.unionByName(more, allowMissingColumns=True)
    return out.repartition(key, "_slice")


def range_table(source: DataFrame, keys: list[str], ov: str, unit: int, lo_days: int,
                per_value_aggs: dict[str, Column], window_aggs: dict[str, tuple[str, str]],
                extra_frames: dict[int, dict[str, tuple[str, str]]] | None = None) -> DataFrame:
    """Stats table ``(keys, ov, window_aggs...)``: for each ``(key, value t)``
    present in ``source``, combine partial aggregates of rows with value in
    ``[t + lo_days, t)``. Null keys are dropped (they match nothing).

    Dates have few values a key, so one window over the values does; timestamps (``unit`` in micro-seconds) have as
    many as there are orders, and go by slices of time (``sliced_frames``)."""
    parts = source.groupBy(*keys, ov).agg(*[v.alias(n) for n, v in per_value_aggs.items()])
    return range_over(parts, keys, ov, unit, {lo_days: window_aggs} | (extra_frames or {}))


def range_over(parts: DataFrame, keys: list[str], ov: str, unit: int, frames: dict[int, dict[str, tuple[str, str]]]) -> DataFrame:
    """``range_table`` from its partial aggregates, one row per (key, value); ``frames``: look-back in days -> aggregates."""
    parts = parts.filter(all_not_null(keys + [ov]))
    if unit > 1:
        every = {k: v for aggs in frames.values() for k, v in aggs.items()}
        t = sliced_frames(parts, parts, keys, ov, {f"f{-lo}": (lo * unit, 0) for lo in frames}, every)
        return t.select(*keys, ov, *[F.col(f"f{-lo}_{n}").alias(n) for lo, aggs in frames.items() for n in aggs])
    cols = []
    for lo, aggs in frames.items():  # other look-backs, same sort
        w = Window.partitionBy(*keys).orderBy(ov).rangeBetween(lo * unit, -1)
        cols += [e.over(w).alias(n) for n, e in _value_aggs(aggs).items()]
    return parts.select(*keys, ov, *cols)


def forward_table(source: DataFrame, key: str, from_ov: str, event_ov: str, qty_col: str,
                  unit: int, spans: dict[str, int]) -> DataFrame:
    """Stats table ``(key, from_ov, <prefix>_n, <prefix>_q for prefix, days in spans)``:
    count and quantity of rows with the same key whose event value lies in
    ``(t, t + days]``. Several spans share one sort.

    Events are aggregated per ``(key, event value)``; the distinct query values
    are added with zero weight and one range window over the union answers all
    queries, by slices of time where values are timestamps. The caller subtracts the row's own event when it falls inside.
    """
    events = source.groupBy(key, F.col(event_ov).alias("_v")).agg(F.count(F.lit(1)).alias("_n"), F.sum(qty_col).alias("_q"))
    return forward_over(events, source, key, from_ov, unit, spans)


def forward_over(events: DataFrame, asked: DataFrame, key: str, from_ov: str, unit: int, spans: dict[str, int]) -> DataFrame:
    """``forward_table`` from events counted per (key, ``_v``), for the values that ``asked`` has."""
    events = events.where(all_not_null([key, "_v"])).select(key, "_v", "_n", "_q", F.lit(False).alias("_probe"))
    probes = (asked.filter(F.col(key).isNotNull() & F.col(from_ov).isNotNull())
              .select(key, F.col(from_ov).alias("_v")).distinct()
              .withColumns({"_n": F.lit(0).cast("long"), "_q": F.lit(None).cast("double"),
                            "_probe": F.lit(True)}))
    if unit > 1:
        t = sliced_frames(events, probes, [key], "_v", {p: (1, 1 + d * unit) for p, d in spans.items()},
                          {"n": ("sum", "_n"), "q": ("sum", "_q")})
        return t.withColumnRenamed("_v", from_ov)
    cols = []
    for prefix, days in spans.items():
        w = Window.partitionBy(key).orderBy("_v").rangeBetween(1, days * unit)
        cols += [F.sum("_n").over(w).alias(f"{prefix}_n"), F.sum("_q").over(w).alias(f"{prefix}_q")]
    return (events.unionByName(probes).select(key, "_v", "_probe", *cols)
            .filter("_probe").drop("_probe").withColumnRenamed("_v", from_ov))


def running_totals(source: DataFrame, row_key: list[str], order_cols: list[str], values: dict[str, Column],
                   keys: list[str] | None = None, inclusive: bool = True,
                   partitions: int | None = None) -> DataFrame:
    """Table ``(row_key, values...)`` of running sums along ``order_cols`` (a total
    order) per ``keys``; ``inclusive=False`` sums strictly earlier rows only.
    Null keys form one group; null values add 0.

    Rows are range-partitioned on ``(keys, order)``; within each partition a
    window sums per ``(key, partition)``; per-partition totals (a table of at
    most partitions x keys rows) are prefix-summed, and those of the one group
    that a range goes on with, at most a row a range, are broadcast to its rows.
    No task ever holds a whole key or the whole table.

    The range boundaries are sampled, so the partitioned sums are written once
    under the shared checkpoint folder and both uses read that table: totals
    and rows can never see different boundaries, whatever is pruned or reused.
    The number of ranges follows ``spark.sql.shuffle.partitions`` and AQE's
    target size unless ``partitions`` fixes it.
    """
    keys = list(keys or [])
    tmp = {name: f"_rv{i}" for i, name in enumerate(values)}
    slim = source.select(*dict.fromkeys(row_key + keys + order_cols),
                         *[F.coalesce(v, F.lit(0)).alias(tmp[k]) for k, v in values.items()])
    by = [F.col(c) for c in keys + order_cols]
    ranged = (slim.repartitionByRange(partitions, *by) if partitions else slim.repartitionByRange(*by)) \
        .withColumn("_rp", F.spark_partition_id())
    w_in = Window.partitionBy(*keys, "_rp").orderBy(*order_cols) \
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    w_all = Window.partitionBy(*keys, "_rp")
    within = cut_lineage(
        ranged.select(*dict.fromkeys(row_key + keys), "_rp",
                      *[F.coalesce(F.sum(t).over(w_in), F.lit(0)).alias(f"_in{t}") for t in tmp.values()],
                      *[F.sum(t).over(w_all).alias(f"_tot{t}") for t in tmp.values()]))
    totals = within.groupBy(*keys, "_rp").agg(*[F.max(f"_tot{t}").alias(f"_tot{t}") for t in tmp.values()])
    w_off = Window.partitionBy(*keys).orderBy("_rp").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_rp", F.count(F.lit(1)).over(w_off).alias("_earlier"),
                            *[F.coalesce(F.sum(f"_tot{t}").over(w_off), F.lit(0)).alias(f"_off{t}") for t in tmp.values()])
    # A range can go on with one group of an earlier range, its first; all others begin in it. So there is at most one
    # such row a range, whatever the number of groups, and rows need no shuffle to meet it.
    offsets = offsets.where("_earlier > 0").drop("_earlier")
    joined = null_safe_join(within, F.broadcast(offsets), keys + ["_rp"])
    return joined.select(*row_key, *[(F.coalesce(F.col(f"_off{t}"), F.lit(0)) + F.col(f"_in{t}")).alias(name) for name, t in tmp.items()])


def exact_quantiles(source: DataFrame, col: str, probs: list[float], names: list[str]) -> DataFrame:
    """One-row table of exact linear-interpolation quantiles (numpy/pandas default).

    Spark's exact ``percentile`` buffers every value of a global group in one
    task. Here values are counted per distinct value, running counts along the
    value order come from range-partitioned running totals, and the two order
    statistics around position (n - 1) * p are found with a range lookup.
    """
    counts = source.groupBy(F.col(col).alias("_x")).agg(F.count(F.lit(1)).alias("_c"))
    return quantiles_of_counts(counts, probs, names)


def quantiles_of_counts(counts: DataFrame, probs: list[float], names: list[str]) -> DataFrame:
    """``exact_quantiles`` of values that are counted already: (_x, _c), one row a value. The counts are written once:
    the running totals, the join and the number of values all read them."""
    counts = cut_lineage(counts.where("_x is not null"))
    rt = running_totals(counts, ["_x"], ["_x"], {"_below": F.col("_c")}, inclusive=False)
    table = counts.join(rt, "_x")  # value x occupies 0-based ranks [_below, _below + _c)
    n = counts.agg(F.sum("_c").alias("_n"))
    pos = [(F.col("_n") - 1) * F.lit(p) for p in probs]
    targets = n.select("_n", *[F.floor(pp).cast("long").alias(f"_k{i}") for i, pp in enumerate(pos)],
                       *[(pp - F.floor(pp)).alias(f"_f{i}") for i, pp in enumerate(pos)])
    covers = []
    for i in range(len(probs)):
        for side, off in (("lo", 0), ("hi", 1)):
            k = F.least(F.col(f"_k{i}") + off, F.col("_n") - 1)
            covers.append(F.max(F.when((k >= F.col("_below")) & (k < F.col("_below") + F.col("_c")), F.col("_x")))
                          .alias(f"_{side}{i}"))
    # one pass over the distinct-value table against the one-row target table
    hits = table.crossJoin(F.broadcast(targets)).groupBy(*[f"_f{i}" for i in range(len(probs))]).agg(*covers)
    return hits.select(*[(F.col(f"_lo{i}") + F.col(f"_f{i}") * (F.col(f"_hi{i}") - F.col(f"_lo{i}"))).alias(nm)
                         for i, nm in enumerate(names)])


def group_medians(source: DataFrame, key: str, cols: dict[str, str]) -> DataFrame:
    """Table ``(key, name...)`` of exact medians per group, for ``cols`` name -> column.

    The per-group form of ``exact_quantiles``: values are counted per (key,
    value), ranks come from range-partitioned running totals, and the two
    middle values are picked by an aggregate. A hot key's values spread over
    the ranges instead of meeting in one task. The columns are stacked as rows,
    so all of them take one shuffle and one running total.
    """
    stacked = source.filter(F.col(key).isNotNull()).select(key, F.explode(F.array(*[
        F.struct(F.lit(name).alias("m"), F.col(col).cast("double").alias("x")) for name, col in cols.items()])).alias("s"))
    counts = cut_lineage(stacked.select(key, F.col("s.m").alias("_m"), F.col("s.x").alias("_x")).where("_x is not null")
                         .groupBy(key, "_m", "_x").agg(F.count(F.lit(1)).alias("_c")))
    rt = running_totals(counts, [key, "_m", "_x", "_c"], ["_x"], {"_below": F.col("_c")}, keys=[key, "_m"], inclusive=False)
    t = rt.join(counts.groupBy(key, "_m").agg(F.sum("_c").alias("_n")), [key, "_m"])
    holds = lambda name, k: F.max(F.when((F.col("_m") == name) & (F.col("_below") <= k) & (k < F.col("_below") + F.col("_c")), F.col("_x")))
    lo, hi = F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)
    return t.groupBy(key).agg(*[((holds(name, lo) + holds(name, hi)) / 2).alias(name) for name in cols])


def category_codes(df: DataFrame, col: str, out: str) -> DataFrame:
    """Lexicographic category codes (0-based, null -> -1) like pandas
    ``Categorical.codes``: distinct values are ranked with range-partitioned
    running counts and joined back (no single-partition ``dense_rank``)."""
    distinct = df.select(F.col(col)).filter(F.col(col).isNotNull()).distinct()
    codes = running_totals(distinct, [col], [col], {out: F.lit(1).cast("long")}, inclusive=False)
    return df.join(codes, col, "left").withColumn(out, F.coalesce(F.col(out), F.lit(-1)).cast("int"))


def trailing_frames(source: DataFrame, row_key: list[str], keys: list[str], order_cols: list[str],
                    frames: dict[str, tuple[Column, int, int]], position: str) -> DataFrame:
    """Table ``(row_key, names..., position, _times)``: per ``keys`` in ``order_cols`` order the mean of a value over the
    previous ``n`` rows (not the current one), null unless at least ``min_periods`` of them are not null - pandas
    ``rolling(n, min_periods).mean().shift(1)`` - and the number of earlier rows. Null keys form one group.

    ``frames`` maps output name -> (value, n, min_periods). Rows are range-partitioned on ``(keys, order)`` and written
    once, with what their own range has of each frame. Only the first rows of a group that a range goes on with look
    further back: there the sum is the difference of two running sums, the earlier one from the last rows of the ranges
    before, which are broadcast: at most one group a range, and as many rows of it as the longest frame has.
    ``_times``: how many rows have this row's place in the order.
    """
    values = [v for v, _, _ in frames.values()]
    longest = max(n for _, n, _ in frames.values())
    slim = source.select(*dict.fromkeys(row_key + keys + order_cols), *[v.alias(f"_v{i}") for i, v in enumerate(values)])
    ranged = slim.repartitionByRange(*[F.col(c) for c in keys + order_cols]).withColumn("_rp", F.spark_partition_id())
    group = Window.partitionBy(*keys, "_rp")
    earlier = group.orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, -1)
    one = F.count(F.lit(1))
    cols = {"_pos": one.over(earlier), "_rows": one.over(group), "_times": one.over(Window.partitionBy(*keys, "_rp", *order_cols))}
    for i, (_, n, _) in enumerate(frames.values()):
        v, near = F.col(f"_v{i}"), group.orderBy(*order_cols).rowsBetween(-n, -1)
        for place, w in (("", near), ("_before", earlier), ("_all", group)):
            cols |= {f"{place}_s{i}": F.coalesce(F.sum(v).over(w), F.lit(0)), f"{place}_c{i}": F.count(v).over(w)}
    within = cut_lineage(ranged.select(*dict.fromkeys(row_key + keys), "_rp", *[e.alias(c) for c, e in cols.items()]))
    sums = [f"{x}{i}" for i in range(len(values)) for x in "sc"]
    totals = within.groupBy(*keys, "_rp").agg(F.max("_rows").alias("_rows"), *[F.max(f"_all_{c}").alias(f"_all_{c}") for c in sums])
    ranges = Window.partitionBy(*keys).orderBy("_rp").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_rp", F.sum("_rows").over(ranges).alias("_off"), *[F.sum(f"_all_{c}").over(ranges).alias(f"_off_{c}") for c in sums]).where("_off is not null")
    rows = null_safe_join(within, F.broadcast(offsets), keys + ["_rp"])  # at most one group a range goes on
    since = lambda c: F.col(f"_before_{c}") + F.coalesce(F.col(f"_off_{c}"), F.lit(0))
    rows = rows.select(*dict.fromkeys(row_key + keys), "_times", "_off", "_pos", "_rows", (F.col("_pos") + F.coalesce("_off", F.lit(0))).alias(position),
                       *[f"_{c}" for c in sums], *[since(c).alias(f"_since_{c}") for c in sums])
    goes_on = F.broadcast(offsets.select(*keys).distinct().withColumn("_goes_on", F.lit(True)))
    last = null_safe_join(rows.where(F.col("_rows") - F.col("_pos") <= longest), goes_on, keys).where("_goes_on")
    out = rows
    for n in dict.fromkeys(n for _, n, _ in frames.values()):
        mine = [c for c in sums if list(frames.values())[int(c[1:])][1] == n]
        look = last.select(*[F.col(k).alias(f"_lk_{k}") for k in keys], (F.col(position) + n).alias("_lpos"), *[F.col(f"_since_{c}").alias(f"_look_{c}") for c in mine])
        head = F.col("_off").isNotNull() & (F.col("_pos") < n)
        cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_lk_{k}")) for k in keys]) & (F.col(position) == F.col("_lpos")) & head
        out = out.join(F.broadcast(look), cond, "left")
        out = out.withColumns({f"_{c}": F.when(head, F.col(f"_since_{c}") - F.coalesce(F.col(f"_look_{c}"), F.lit(0))).otherwise(F.col(f"_{c}")) for c in mine}).drop(*look.columns)
    return out.select(*row_key, *[F.when(F.col(f"_c{i}") >= least, F.col(f"_s{i}") / F.col(f"_c{i}")).alias(name)
                                  for i, (name, (_, _, least)) in enumerate(frames.items())], position, "_times")


def repeated(table: DataFrame, *names: str) -> DataFrame:
    """Each row of ``trailing_frames`` as often as rows have its place: what comes m times is joined m times m times."""
    return table.select(*names, F.explode(F.array_repeat(F.lit(0), F.col("_times").cast("int"))).alias("_copy")).drop("_copy")


def trailing_rows_stats(source: DataFrame, row_key: list[str], keys: list[str], order_cols: list[str],
                        value: Column, frames: dict[str, tuple[int, int]]) -> DataFrame:
    """``trailing_frames`` of one value: ``frames`` maps output name -> (n, min_periods). Returns ``row_key + names``."""
    table = trailing_frames(source, row_key, keys, order_cols, {name: (value, *f) for name, f in frames.items()}, "_at")
    return repeated(table, *row_key, *frames)
