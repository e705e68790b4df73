import numpy as np
import pytest

from leadlane.llm import cap_filters as C
from tests.conftest import SMOKE


def brute(rows, cosine=0.9):
    """vec_id -> (links, component): exact, all pairs."""
    ok = [k for k, (_, e) in enumerate(rows) if e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    links = {k: set() for k in range(len(rows))}
    for dim in {len(rows[k][1]) for k in ok}:
        at = [k for k in ok if len(rows[k][1]) == dim]
        x = np.array([rows[k][1] for k in at], np.float64)
        x /= np.abs(x).max(axis=1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for i, j in zip(*np.nonzero(x @ x.T >= cosine)):
            if i != j:
                links[at[i]].add(at[j])
    comp = {}
    for k in links:
        if k in comp:
            continue
        todo, group = [k], {k}
        while todo:
            new = links[todo.pop()] - group
            group |= new
            todo += new
        ids = [rows[g][0] for g in group if rows[g][0] is not None]
        comp |= {g: min(ids, default=None) for g in group}
    return [(rows[k][0], len(links[k]), comp[k], rows[k][0] == comp[k]) for k in links]


def key(r):
    return tuple(-1 if x is None else x for x in r)


def test_query_matches_all_pairs(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMOKE}/embeddings.parquet").collect()]
    assert sorted(map(key, C.cap_filters(spark, SMOKE).collect())) == sorted(map(key, brute(rows)))


@pytest.mark.parametrize("limit", [16, 512])
def test_clusters_larger_than_a_block(spark, limit):
    """A dense cluster over many blocks, chains of links, copies; links at 0.95 and more are found exactly."""
    rng = np.random.default_rng(3)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    dense = unit(unit(rng.standard_normal(32)) + 0.02 * rng.standard_normal((150, 32)))
    far = unit(rng.standard_normal((300, 32)))
    a, b = unit(rng.standard_normal((2, 32)))
    chain = [unit(np.cos(t) * a + np.sin(t) * unit(b - (a @ b) * a)) for t in np.arange(0, 2, 0.3)]
    x = np.concatenate([dense, far, np.array(chain), dense[:20], 3 * far[:5]])
    rows = [(int(i), e.tolist()) for i, e in zip(rng.permutation(len(x)), x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(key, C.near_duplicates(df, limit=limit).collect())) == sorted(map(key, brute(rows)))


@pytest.mark.parametrize("n, most", [(5000, 160), (3_000_000, 320)])
def test_recall_at_the_threshold(n, most):
    """Pairs at exactly the threshold, the hardest ones, that the height was not set on; lists grow slowly with the table."""
    dim = 64
    rng = np.random.default_rng(11)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    u = unit(rng.standard_normal((600, dim)))
    w = rng.standard_normal((600, dim))
    v = 0.9 * u + np.sqrt(0.19) * unit(w - (w * u).sum(1, keepdims=True) * u)
    code = C.code_for(dim, *C.shape_for(dim, n))
    h = C.height_for(code, dim, 0.9, C.RECALL)
    lists = code.decode(u, h)
    hit = [np.intersect1d(a, b).size > 0 for a, b in zip(lists, code.decode(v, h))]
    assert np.mean(hit) >= 0.97 and np.mean([len(x) for x in lists]) <= most
    code3 = C.code_for(dim, 3, 60)
    got, x = code3.decode(u[:3], 0.6), code3.products(u[:3])
    for k in range(3):  # list decoding finds all filters above the height
        s = (x[0][k][:, None, None] + x[1][k][None, :, None] + x[2][k][None, None, :]).ravel()
        assert got[k].tolist() == np.flatnonzero(s >= 0.6).tolist()


def test_pairs_that_met_are_left_out():
    """Members under one smaller filter are not compared again, all other links are found, and new ones told from old."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal(8) + 0.05 * rng.standard_normal((40, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lists = [[3, 9] if k < 30 else [5, 9] if k < 36 else [9] for k in range(40)]
    shared = C.Shared(np.concatenate(lists), np.r_[0, np.cumsum([len(f) for f in lists])], 9)
    assert shared.apart(40).tolist() == list(range(30, 40))
    got = {(a, b): n for p, q, new in C.tiles(x, np.zeros(40, int), False, shared, 0.9) for a, b, n in zip(p.tolist(), q.tolist(), new.tolist())}
    assert got == {(a, b): not (30 <= a < 36 and 30 <= b < 36) for a in range(30, 40) for b in range(40) if a != b}
    assert C.join(np.arange(6), np.array([5, 3, 1]), np.array([3, 4, 0])).tolist() == [0, 0, 2, 3, 3, 3]


def test_odd_rows_and_empty(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 0.0]), (8, [2.0, 0.1]), (9, [1.0]),
            (10, [-1.0]), (11, [5.0]), (12, [1e300, 1e299]), (13, [1e-300, 0.0]), (None, [1.0, 0.0]), (None, None), (7, [1.0, 0.0]), (15, [0.0, -0.0, 1.0])]
    df = spark.createDataFrame([(i, e, 5, "x") for i, e in rows], "vec_id long, embedding array<double>, node int, filter string")
    assert sorted(map(key, C.near_duplicates(df).collect())) == sorted(map(key, brute(rows)))
    assert C.near_duplicates(df.limit(0)).count() == 0
