import random
import zlib

import pytest
from pyspark.sql import functions as F

from leadlane.llm import toxicity as T


def edits(a, b):
    """Brute-force distance with swaps, look-alike digits of the text's word free."""
    same = lambda x, y: x == y or y in T.LOOKS_LIKE.get(x, "")
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (not same(a[i - 1], b[j - 1])))
            if i > 1 and j > 1 and same(a[i - 1], b[j - 2]) and same(a[i - 2], b[j - 1]):
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_automaton_against_brute_force():
    rng = random.Random(5)
    terms = {"".join(rng.choice("abc") for _ in range(rng.randrange(5, 8))) for _ in range(60)}
    x = T.Lexicon({t: 1.0 for t in terms}, {})
    for _ in range(3000):
        w = "".join(rng.choice("abcd48") for _ in range(rng.randrange(1, 9)))
        near = sorted(t for t in terms if edits(w, t) <= 1)
        assert T.fuzzy(x.trie, w) == (near[0] if near else None), w


def test_half_terms_never_hide_a_match():
    rng = random.Random(6)
    terms = {"".join(rng.choice("abc") for _ in range(rng.randrange(5, 10))) for _ in range(40)}
    x = T.Lexicon({t: 1.0 for t in terms}, {})
    for t in sorted(terms):
        for _ in range(60):
            w, i = list(t), rng.randrange(len(t))
            kind = rng.randrange(4)
            w[i:i + 1] = [[], [rng.choice("abcd")], [rng.choice("abcd"), w[i]], [w[i]]][kind]
            if kind == 3 and i + 1 < len(w):
                w[i], w[i + 1] = w[i + 1], w[i]
            assert x.may_match("".join(w)) and T.fuzzy(x.trie, "".join(w)) is not None


LEX = T.Lexicon({"idiot": 2.0, "worthless": 2.0}, {"lowei": 1.0})


@pytest.mark.parametrize("text, hits", [
    (None, 0), ("", 0), ("idiot", 1), ("IDIOT!!", 1), ("id1ot", 1), ("idoit", 1), ("idioot", 1), ("diot", 1), ("idxxt", 0), ("w0rthles", 1),
    ("loweischaft", 1), ("lowei", 0), ("a\nb", 0), ("idiot " * 20000, 20000)])
def test_hits(text, hits):
    assert T.measure(text, T.Lookup(LEX))[3] == hits


SHORT = T.Lexicon({"scum": 2.0, "idiots": 1.0}, {"idiot": 2.0})


@pytest.mark.parametrize("text, hits", [
    ("scumm", 1), ("scvm", 1), ("5cum", 1), ("csum", 1), ("cum", 1), ("svvm", 0), ("1diotic", 1), ("idoitic", 1), ("idiotic", 1), ("idotic", 1), ("idoits", 1),
    ("idiot", 1), ("ixxotic", 0)])
def test_short_terms_and_beginnings_are_misspelled_too(text, hits):
    assert T.measure(text, T.Lookup(SHORT))[3] == hits


def test_misspelled_beginnings_against_brute_force():
    rng = random.Random(7)
    begins = {"".join(rng.choice("abc") for _ in range(rng.randrange(3, 7))) for _ in range(12)}
    x = T.Lexicon({}, dict.fromkeys(begins, 1.0))
    for _ in range(3000):
        w = "".join(rng.choice("abcd48") for _ in range(rng.randrange(1, 10)))
        near = {p for p in begins if len(w) >= len(p) and edits(w, p) > 0 and any(edits(w[:i], p) <= 1 for i in range(len(w)))}
        assert {m[1] for m in T.matches(x.trie, w)} == near, w
        assert not near or x.may_match(w)


def test_edits_follow_held_in_precision(spark):
    """Word families leave no member out; words of their own and kinds of edits that catch other words are no hits."""
    rows = [(f"you {x} a{i} b{i}", 1.0) for i in range(30) for x in ("idiot", "idiots", "idiotic", "scum")]
    rows += [(f"fine {x} c{i} d{i}", 0.0) for i in range(200) for x in ("scam", "slum" if i == 0 else "well")] + [("fine scxm", 0.0)]
    x = T.learn_lexicon(spark.createDataFrame(rows, "text string, y double"))
    hits = {w for w in ("idoit", "1diot", "5cum", "scumm", "scam", "slum", "idiotic") if T.Lookup(x)[w]}
    assert hits == {"idoit", "1diot", "5cum", "scumm", "idiotic"} and "scam" not in x.words and (False, 4, "substitution") in x.refused


def test_quotation_and_windows():
    m = lambda t: T.measure(t, T.Lookup(LEX))
    filler = "word " * 30
    assert m('he said "you idiot" and left')[:2] == (0.0, 2.0) and m("> idiot\nno")[0] == 0
    assert m("you idiot and left")[:2] == (2.0, 0.0) and m('"fine" idiot "fine"')[0] == 2.0
    assert m("idiot worthless")[2] > m("idiot " + filler + "worthless")[2]


def test_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    out = T.toxicity(spark, d).cache()
    rows = out.select("doc_id", "held_out", "score", "predicted").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    j = out.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out")
    n = {(r.toxic, r.predicted): r["count"] for r in j.groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) > 0.9 and n.get((0, 1), 0) / (n[0, 0] + n.get((0, 1), 0)) < 0.02


def test_labels_of_held_out_rows_are_not_read(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(
        F.when(F.col("id") % 3 == 0, "bad awful words here").otherwise("good fine words there"), *[F.concat(F.lit(f" {x}"), F.col("id")) for x in "uvw"]).alias("text"))
    labels = spark.range(400).select(F.col("id").alias("doc_id"), (F.col("id") % 3 == 0).cast("int").alias("toxic"))
    flipped = labels.withColumn("toxic", F.when(T.crc_mod("doc_id") == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(map(tuple, T.score(docs, x).select("doc_id", "score").collect())) for x in (labels, flipped))
    assert a == b and {s > 0.3 for i, s in a if i % 3 == 0} == {True} and {s > 0.3 for i, s in a if i % 3} == {False}


def test_copies_of_a_text_count_once(spark):
    """Rare words of a text that was copied often are no terms."""
    rows = [("the rare word is only here " * 3, 1.0)] * 50 + [(f"a{i} b{i} awful c{i} d{i}", 1.0) for i in range(30)]
    rows += [(f"e{i} f{i} fine g{i} h{i}", 0.0) for i in range(300)]
    x = T.learn_lexicon(spark.createDataFrame(rows, "text string, y double"))
    assert "awful" in x.words and "rare" not in x.words


def test_texts_that_share_a_passage_all_count(spark):
    """The first form of the test above: texts with a common passage are no copies."""
    rows = [("the rare word is only here " * 3, 1.0)] * 50 + [(f"you awful thing {i} a{i} b{i} c{i}", 1.0) for i in range(30)]
    rows += [(f"fine thing {i} d{i} e{i} f{i} rest", 0.0) for i in range(300)]
    x = T.learn_lexicon(spark.createDataFrame(rows, "text string, y double"))
    assert "awful" in x.words and "rare" not in x.words
    rows = [(f"one phrase they all share and awful a{i} b{i}", 1.0) for i in range(30)] + [(f"one phrase they all share c{i} d{i}", 0.0) for i in range(300)]
    assert "awful" in T.learn_lexicon(spark.createDataFrame(rows, "text string, y double")).words


def test_labels_of_held_out_rows_are_not_read_of_two_texts(spark):
    """The first form of the test above: with one text a label, all rows count."""
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "bad awful words here").otherwise("good fine words there").alias("text"))
    labels = spark.range(400).select(F.col("id").alias("doc_id"), (F.col("id") % 3 == 0).cast("int").alias("toxic"))
    flipped = labels.withColumn("toxic", F.when(T.crc_mod("doc_id") == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(map(tuple, T.score(docs, x).select("doc_id", "score").collect())) for x in (labels, flipped))
    assert a == b and {s > 0.3 for i, s in a if i % 3 == 0} == {True} and {s > 0.3 for i, s in a if i % 3} == {False}


def test_the_evidence_bounds_the_lexicon_not_a_count(spark):
    many = " ".join(f"w{k:04d}" for k in range(2300))
    rows = [(f"{many} a{i}", 1.0) for i in range(30)] + [(f"fine c{i}", 0.0) for i in range(300)]
    x = T.learn_lexicon(spark.createDataFrame(rows, "text string, y double"))
    assert len(x.words) == 2300 and set(x.prefixes) == {"w00", "w01", *(f"w{k}" for k in range(10, 23)), "w02", "w03", "w04", "w05", "w06", "w07", "w08", "w09"}


def test_odd_rows_and_empty(spark, odd_docs):
    labels = spark.createDataFrame([(0, 1, 0), (None, 1, 1), (1, None, None), (3, 0, 1), (3, 0, 0)], "doc_id long, quality int, toxic int")
    out = T.score(odd_docs, labels)
    assert out.count() == odd_docs.count() and out.where("score is null or predicted is null or held_out is null").count() == 0
    assert T.score(odd_docs, labels.limit(0)).where("score > 0").count() == 0
    assert T.score(odd_docs.limit(0), labels).count() == 0
