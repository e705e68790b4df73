import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from leadlane.llm import simhash as S
from leadlane.llm.common import components
from tests.conftest import SMOKE


def brute_fp(text, k=3):
    w = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in __import__("re").findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())]
    grams = [b" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [b" ".join(w)] if w else []
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hs) > len(hs))


def brute_components(fps, radius):
    """fp -> least fp reachable."""
    fps, label = sorted(set(fps)), {}
    x = np.array(fps, np.uint64)
    for f in fps:
        if f in label:
            continue
        todo = [f]
        label[f] = f
        while todo:
            near = x[np.bitwise_count(x ^ np.uint64(todo.pop())) <= radius]
            for g in map(int, near):
                if g not in label:
                    label[g] = f
                    todo.append(g)
    return label


def test_fingerprint():
    for t in [None, "", "one", "One two", "a b c", "A-b ÀÉ x y z " * 50, "w " * 70000 + "end of it"]:
        assert S.fingerprint(t) == brute_fp(t)
    assert S.fingerprint("q w e r t y u i o p", piece=3) == brute_fp("q w e r t y u i o p")


@pytest.mark.parametrize("radius", [1, 2, 3, 5])
def test_carry_save_counts(radius):
    rng = random.Random(radius)
    planes = [rng.getrandbits(300) & rng.getrandbits(300) & rng.getrandbits(300) & rng.getrandbits(300) for _ in range(64)]
    got = S.carry_save(planes, (1 << 300) - 1, radius)
    assert got == sum(1 << i for i in range(300) if sum(p >> i & 1 for p in planes) <= radius)


def cluster(rng, n, bits):
    base, out = rng.getrandbits(64), set()
    while len(out) < n:
        f = base
        for _ in range(rng.randrange(bits + 1)):
            f ^= 1 << rng.randrange(64)
        out.add(f)
    return out


@pytest.mark.parametrize("limit", [8, 512])
def test_links_connect_what_brute_force_connects(spark, limit):
    """Tight clusters with far more fingerprints under a key than the limit, chains, and noise."""
    rng = random.Random(7)
    fps = cluster(rng, 700, 3) | cluster(rng, 40, 6) | {rng.getrandbits(64) for _ in range(500)}
    chain = rng.getrandbits(64)
    for i in range(0, 60, 2):
        fps.add(chain)
        chain ^= 3 << i
    df = spark.createDataFrame([(S.signed(f),) for f in fps], "fp long")
    got = {r.node: r.component for r in components(S.fingerprint_links(df, 2, limit)).collect()}
    want = brute_components(fps, 2)
    sets = lambda d: sorted(sorted(k for k, v in d.items() if v == c) for c in set(d.values()))
    alone = {S.signed(f): S.signed(f) for f in fps} | got
    assert sets(alone) == sets({S.signed(k): S.signed(v) for k, v in want.items()})


def check(docs, out):
    fps = [(r.doc_id, brute_fp(r.text)) for r in docs.select("doc_id", "text").collect()]
    label = brute_components([f for _, f in fps], 2)
    least = {}
    for i, f in fps:
        if i is not None:
            least[label[f]] = min(least.get(label[f], i), i)
    none = lambda r: tuple(-1 if x is None else x for x in r)
    want = sorted(none((i, f"{f:016x}", least.get(label[f]))) for i, f in fps)
    assert sorted(map(none, out.collect())) == want


def test_query_matches_brute_force(spark):
    check(spark.read.parquet(f"{SMOKE}/documents.parquet"), S.simhash(spark, SMOKE))


def test_odd_rows_and_empty(spark, odd_docs, tmp_path):
    odd_docs.write.parquet(str(tmp_path / "documents.parquet"))
    check(odd_docs, S.simhash(spark, str(tmp_path)))
    odd_docs.limit(0).write.parquet(str(tmp_path / "e/documents.parquet"))
    assert S.simhash(spark, str(tmp_path / "e")).count() == 0


def test_one_of_each(spark, odd_docs):
    out = S.one_of_each(odd_docs)
    assert out.columns == odd_docs.columns
    # null, empty and blank texts are one group; the repeated row stays once; the null id keeps its own text.
    got = sorted((-1 if r.doc_id is None else r.doc_id) for r in out.collect())
    assert got[0] == -1 and len(got) == len(set(got)) and {0, 3} <= set(got) and not {1, 2, 8} & set(got)


def test_components_of_long_paths_and_hubs(spark):
    e = spark.range(400).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).unionAll(
        spark.range(1000, 3000).select(F.lit(2500).cast("long"), "id")).unionAll(spark.createDataFrame([(5, 5), (None, 3)], "a long, b long"))
    got = {r.node: r.component for r in components(e.repartition(7)).collect()}
    assert {v for k, v in got.items() if k <= 400} == {0} and {v for k, v in got.items() if k >= 1000} == {1000} and len(got) == 401 + 2000


def texts_with_equal_31_bits():
    """Two texts of different words whose 64-bit hashes agree in 31 bits."""
    import xxhash

    seen, i = {}, 0
    while True:
        t = f"a{i} b{i * 7} c{i * 13} d{i}"
        if (k := xxhash.xxh64_intdigest(t.encode(), 42) & 0x7FFFFFFF) in seen:
            return seen[k], t
        seen[k] = t
        i += 1


def test_rows_without_id_are_told_apart_by_128_bits(spark):
    x, y = texts_with_equal_31_bits()
    df = spark.createDataFrame([(None, x), (None, y), (7, "other words in here"), (None, x)], "doc_id long, text string")
    assert len({r.component_id for r in S.near_duplicates(df).collect()}) == 2  # 7, and null for those without an id
    assert sorted(r.text for r in S.one_of_each(df).collect()) == sorted([x, y, "other words in here"])
