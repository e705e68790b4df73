import random
from collections import defaultdict

import pytest

from leadlane.llm import suffix_dedup as S
from leadlane.llm.common import words
from tests.conftest import SMOKE


def brute(rows, length=S.LENGTH):
    """(doc, text) -> word -> set of smallest holders of the shared windows over it."""
    holders = defaultdict(set)
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - length + 1):
            holders[tuple(w[k:k + length])].add(S.NO_ID if i is None else i)
    out = defaultdict(set)
    for i, t in set(rows):
        w, i = words(t), S.NO_ID if i is None else i
        for k in range(len(w) - length + 1):
            h = holders[tuple(w[k:k + length])]
            if len(h) > 1:
                out[i].update((k + j, min(h)) for j in range(length))
    return dict(out)


def check(docs, **how):
    got = defaultdict(set)
    for r in S.shared_spans(docs, **how).collect():
        got[r.doc].update((k, x["first"]) for x in r.spans for k in range(x.start, x.end))
    assert dict(got) == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], how.get("length", S.LENGTH))


def test_given_documents(spark):
    check(spark.read.parquet(f"{SMOKE}/documents.parquet"))


@pytest.mark.parametrize("partitions", [1, 23])
def test_planted_passages_of_all_lengths(spark, partitions):
    """Passages from 45 to 120 words in changing surroundings, near copies with an edit, a very common passage, runs of one word."""
    rng = random.Random(1)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(3000))
    text = lambda n: [word() for _ in range(n)]
    shared = [text(n) for n in [*range(45, 56), 60, 80, 84, 120]]
    docs = []
    for _ in range(160):
        t = text(rng.randrange(80))
        for p in rng.sample(shared, rng.randrange(3)):
            t += p + text(rng.randrange(40))
        docs.append(t + shared[-1] * (rng.random() < 0.5) + ["same"] * rng.choice([0, 0, 49, 50, 70]))
    base = text(300)
    for _ in range(25):
        t = base[:]
        for _ in range(3):
            t[rng.randrange(300)] = word()
        docs.append(t)
    df = spark.createDataFrame([(i, (" " if i % 2 else " \n").join(x.upper() if i % 3 else x for x in t)) for i, t in enumerate(docs)], "doc_id long, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        check(df)
        check(df, length=20, gram=5)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_odd_rows_and_empty(spark, odd_docs):
    long = " ".join(f"w{i}" for i in range(60))
    extra = spark.createDataFrame([(None, long), (20, long), (21, "x " + long), (21, long + " y"), (30, "word " * 90)], "doc_id long, text string")
    docs = odd_docs.unionByName(extra, allowMissingColumns=True)
    check(docs)
    out = S.drop_passages(docs)
    assert out.columns == docs.columns
    got = sorted((-1 if r.doc_id is None else r.doc_id, (r.text or "")[:9]) for r in out.where("doc_id is null or doc_id >= 5").collect())
    # 20 and 30 are all passage and go; 21 keeps its own words in both of its texts.
    assert got == [(-1, "a null id"), (-1, "w0 w1 w2 "), (5, "word word"), (6, "xxxxxxxxx"), (7, "é ß 漢字 😀 "), (8, "\n\n\n"), (21, "x "), (21, "y")]
    assert S.drop_passages(docs.limit(0)).count() == 0


def test_without():
    assert S.without(" a b\nc  d e", [(1, 3), (2, 3)]) == " a d e" and S.without("a b", [(0, 2)]) == ""


def test_query(spark):
    out = S.suffix_dedup(spark, SMOKE)
    assert set(out.columns) == {"doc_id", "start_word", "end_word", "first_doc_id", "removable"} and out.where("removable").count() > 0


def test_rows_without_id_are_told_apart_by_128_bits(spark):
    """Two texts without an id whose 31-bit tags agree: only the one that holds the passage loses it."""
    from .test_simhash import texts_with_equal_31_bits

    tail = " ".join(f"p{i}" for i in range(60))
    x, y = texts_with_equal_31_bits()
    df = spark.createDataFrame([(-(1 << 62), tail), (None, x), (None, y), (5, x + " " + tail)], "doc_id long, text string")
    assert sorted((r.doc_id is None, r.text) for r in S.drop_passages(df).collect()) == sorted([(False, tail), (True, x), (True, y), (False, x + " ")])
