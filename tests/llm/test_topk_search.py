import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadlane.llm import topk_search as T
from tests.conftest import SMOKE

TOP = (1 << 63) - 1


def brute(rows, k=5, every=50, scale=256):
    """All pairs with unbounded integers."""
    whole = lambda x: max(-TOP - 1, min(TOP, math.floor(x * scale) if abs(x * scale) < 2.0 ** 64 else int(math.copysign(TOP + 1, x))))
    ok = [(i, [whole(x) for x in e]) for i, e in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for a, (qi, q) in enumerate(ok):
        if qi is None or qi % every:
            continue
        s = sorted((-max(-TOP, min(TOP, sum(x * y for x, y in zip(q, v)))), i is None, i or 0) for b, (i, v) in enumerate(ok) if a != b and len(v) == len(q))
        out += [(qi, r + 1, None if none else i, -score) for r, (score, none, i) in enumerate(s[:k])]
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.select("query_id", "rank", "vec_id", "score").collect()), key=str)


def test_given_vectors(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMOKE}/embeddings.parquet").collect()]
    assert got(T.topk_search(spark, SMOKE)) == brute(rows)


@pytest.mark.parametrize("segment", [16, 4096])
def test_clusters_ties_and_copies(spark, segment, monkeypatch):
    """Few distinct components make ties; a third of all rows is one vector; cells and segments are many."""
    for name, x in (("SEGMENT", segment), ("FIRST", 8), ("CELL", 64), ("QUERIES", 4)):
        monkeypatch.setattr(T, name, x)
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.integers(-2, 3, (150, 6)) / 256, rng.standard_normal((100, 6)), np.tile(rng.standard_normal(6), (130, 1)), np.zeros((10, 6)), rng.standard_normal((20, 3))[:, [0, 1, 2, 0, 1, 2]]])
    rows = [(int(i), e.tolist()) for i, e in zip(rng.permutation(len(x)), x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7)
    assert got(T.top_k(df, F.col("vec_id") % 3 == 0)) == brute(rows, every=3)
    assert got(T.top_k(df, F.col("vec_id") % 3 == 0, k=2, scale=1000)) == brute(rows, k=2, every=3, scale=1000)


def test_bounds_rule_out_most_and_nothing_better(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(-60, 60, (4000, 16)).astype(float)
    x[:200] += 3 * x[0]
    lists, read = T.Lists(x), 0
    for q in x[:40]:
        s = x @ q
        for floor in (-np.inf, np.sort(s)[-20], np.sort(s)[-3]):
            left = lists.qualifying(q, 6, floor)
            assert set(np.flatnonzero(s >= max(floor, np.sort(s)[-6]))) <= set(left.tolist())
            read += len(left)
    assert read < 3 * 40 * 600
    assert len(lists.qualifying(np.zeros(16), 6, -np.inf)) == 4000  # nothing to read, all tie


def test_odd_rows_and_empty(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, None), (50, []), (100, [0.0, 0.0]), (150, [1.0, None]), (200, [nan, 1.0]), (250, [inf, 1.0]), (300, [1.0, -1.0]), (300, [1.0, -1.0]), (300, [2.0, 1.0]),
            (350, [1e300, -1e300]), (400, [3.0]), (450, []), (7, [1.0, -1.0]), (None, [1.0, -1.0]), (None, [2.0, 1.0]), (500, [5e-300, -0.0]), (550, [1e10, 3e10]), (-50, [-1.0, 2.0])]
    df = spark.createDataFrame([(i, e, 1, "x", False) for i, e in rows], "vec_id long, embedding array<double>, rank int, h1 string, is_query boolean")
    assert got(T.top_k(df, F.col("vec_id") % 50 == 0)) == brute(rows)
    assert T.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert got(T.top_k(df.where("vec_id = 400"), F.col("vec_id") % 50 == 0)) == []
