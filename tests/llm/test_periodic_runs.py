import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from leadlane.llm import periodic_runs as P
from tests.conftest import SMOKE


def brute(w):
    """Every period of every stretch, longest match by longest match."""
    least = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                least.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in least.items()), key=lambda x: (x[0], x[2]))


def result(doc_id, text):
    """The contract's row, said plainly."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute(w)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2], sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)),
            sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query_against_brute_force(spark):
    rows = spark.read.parquet(f"{SMOKE}/documents.parquet").select("doc_id", "text").collect()
    got = P.periodic_runs(spark, SMOKE)
    assert dict(got.dtypes) == {c: "string" if "sha" in c else "bigint" for c in COLUMNS}
    want = sorted(result(r.doc_id, r.text) for r in rows if len(r.text or "") < 60000)
    ids = {w[0] for w in want}
    assert sorted(tuple(r) for r in got.select(COLUMNS).collect() if r.doc_id in ids) == want and any(w[1] for w in want)


@pytest.mark.parametrize("small", [False, True])
def test_random_repetitions(small, monkeypatch):
    """Runs inside, beside and across each other, few and many different words; slices of a few numbers too."""
    if small:
        monkeypatch.setattr(P, "SLICE", 32)
    rng = random.Random(small)
    for _ in range(150):
        seqs = []
        for _ in range(rng.randrange(1, 6)):
            s, size = [], rng.randrange(400)
            while len(s) < size:
                unit = [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.choice([1, 2, 3, 4, 5, 8, 13, 31]))]
                s += (unit * rng.randrange(1, 9))[:rng.randrange(1, 250)]
            seqs.append(s)
        assert P.runs_of([np.array(s, np.int64) for s in seqs]) == [brute(s) for s in seqs]


def test_strings_rich_in_repetitions():
    fib, tri = "a", "b"
    while len(fib) < 700:
        fib, tri = fib + tri, fib
    thue = [bin(i).count("1") % 2 for i in range(512)]
    power = [(i & -i).bit_length() for i in range(1, 600)]
    for s in ([ord(c) for c in fib], thue, power, [0] * 500, [0, 1] * 250, ([0] * 40 + [1]) * 12, ([0] * 9 + [1]) * 3 + [2] * 5 + [3] * 6):
        assert P.runs_of([np.array(s, np.int64)]) == [brute(s)]


def test_long_text_uses_the_large_prime():
    unit = np.random.default_rng(1).integers(0, 20000, 40000)
    s = np.concatenate([[30000], np.tile(unit, 5)[:170000], [30001]])
    assert P.runs_of([s]) == [[(1, 170000, 40000)]]


@pytest.mark.parametrize("prime", [P.FERMAT, P.LARGE])
def test_transform_is_an_exact_convolution(prime):
    p, g = prime
    rng = np.random.default_rng(3)
    for size in (1, 2, 8, 64):
        a, b = rng.integers(0, p, (2, size, 3))
        assert (P.inverse(P.transform(a, p, g), p, g) == a).all()
        c = P.inverse(P.transform(a, p, g) * P.transform(b, p, g) % p, p, g)
        for j in range(3):
            assert c[:, j].tolist() == [sum(int(a[i, j]) * int(b[(k - i) % size, j]) for i in range(size)) % p for k in range(size)]


def test_odd_rows_and_empty(spark, odd_docs):
    more = spark.createDataFrame([(None, "x y " * 5), (20, "x Y " * 5 + "x"), (20, "x Y " * 5 + "x"), (21, "é 漢 b  " * 7), (22, "a b c d e f")], "doc_id long, text string")
    docs = odd_docs.unionByName(more, allowMissingColumns=True).withColumnRenamed("row", "runs")
    got = {(r.doc_id, bytes(r.kept)): [tuple(x) for x in r.runs] for r in P.text_runs(docs).collect()}
    assert len(P.text_runs(docs).collect()) == docs.count()
    for r in docs.collect():
        w = (r.text or "").encode().split()
        runs = [(0, 30000, 1)] if len(w) == 30000 else brute(w)
        assert got[r.doc_id, b" ".join(P.kept_words(w, runs))] == runs
    assert P.text_runs(docs.limit(0)).count() == 0
