import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadlane.llm import sentencepiece_scan as S
from tests.conftest import SMOKE

PATH = S.default_model()


def texts():
    rng = random.Random(4)
    base = ["the quick brown fox jumps over the lazy dog. " * 30, "x" * 900, "漢字のテキスト" * 120, "a  b   c    d" * 60, "no_spaces_at_all_in_this_identifier" * 30,
            "\U0001f600\x00\xe9́ \xdf\n\t" * 90, " " * 700, "ab" * 400 + " " + "internationalisation" * 40, "▁▁ ▁x" * 100, "\n" * 500]
    return base + ["".join(rng.choice("ab eét\n ") for _ in range(rng.randrange(300, 900))) for _ in range(25)]


def unigram():
    """The given model read as a unigram model: the same pieces and scores, another rule."""
    import sentencepiece

    b = bytearray(sentencepiece.SentencePieceProcessor(model_file=PATH).serialized_model_proto())
    trainer = next(v for k, v in S._fields(bytes(b)) if k == 2)
    at = bytes(b).index(trainer)
    k = trainer.index(b"\x18\x02")  # field 3, BPE
    b[at + k + 1] = S.UNIGRAM
    return bytes(b)


def in_chunks(model, text, size, fan):
    """The operator's steps without Spark."""
    t = model.sp.normalize(text).replace(" ", S.MARK)
    n, side = max(1, len(t) // size), 2 * model.longest
    cut = [(k * size, len(t) if k == n - 1 else (k + 1) * size) for k in range(n)]
    chunks = [S.Chunk(model, t[max(0, a - side):b + side], min(a, side), b - max(0, a - side), k == 0, k == n - 1) for k, (a, b) in enumerate(cut)]
    ms = [c.matrix() for c in chunks]
    groups = [ms[k:k + fan] for k in range(0, n, fan)]
    ends = S.best_states([S.product(g) for g in groups], 0, 0)
    states = [s for g, a, b in zip(groups, ends, ends[1:]) for s in S.best_states(g, a, b)[:-1]] + [0]
    return [x for c, a, b in zip(chunks, states, states[1:]) for x in c.ids(a, b)]


@pytest.mark.parametrize("size", [40, 100])
def test_chunks_give_the_librarys_ids(size):
    m = S.Model.get(PATH)
    for t in texts():
        assert in_chunks(m, t, size, 3) == m.sp.encode(t), t[:40]


def test_unigram_chunks_reach_the_librarys_score():
    m = S.Model.get("", unigram())
    assert m.kind == S.UNIGRAM and m.sp.encode("hello") is not None
    score = lambda ids: sum(m.unknown if m.sp.is_byte(i) or m.sp.is_unknown(i) else m.sp.get_score(i) for i in ids)
    for t in texts():
        if any(c in t for c in "\x00\ń\U0001f600") or "  " in t or S.MARK in t:
            continue  # scores of a billion leave no digits in single precision; bytes share one penalty
        got, want = in_chunks(m, t, 64, 3), m.sp.encode(t)
        assert m.sp.decode(got) == m.sp.decode(want) and score(got) == pytest.approx(score(want), rel=1e-6)


def test_product_is_associative():
    rng = np.random.default_rng(2)
    a, b, c = (np.where(rng.random((4, 4)) < 0.3, -np.inf, rng.integers(-9, 0, (4, 4)).astype(float)) for _ in range(3))
    assert (S.times(S.times(a, b), c) == S.times(a, S.times(b, c))).all() and (S.unpack_matrix(S.pack_matrix(a)) == a).all()


def test_operator_with_giant_rows(spark):
    rows = [(i if i else None, t, 1) for i, t in enumerate(texts() + [None, "", "short"])] + [(1, texts()[1], 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, k int")
    sp = S.Model.get(PATH).sp
    out = S.decode(S.encode(df, PATH, chunk=100, fan_in=2), PATH).collect()
    want = sorted((i or -1, tuple(sp.encode(t or ""))) for i, t, _ in rows)
    assert sorted((r.doc_id or -1, tuple(r.ids)) for r in out) == want
    assert all(r.decoded == sp.decode(list(r.ids)) for r in out)
    assert S.encode(df.limit(0), PATH).count() == 0


def test_giant_texts_of_one_id_are_told_apart_by_128_bits(spark):
    """Two giant texts without an id whose 31-bit tags agree each get their own ids."""
    import xxhash

    seen, i, x = {}, 0, None
    while x is None:
        y = "the quick brown fox " * 30 + f"number {i}"
        x = seen.setdefault(xxhash.xxh64_intdigest(y.encode(), 42) & 0x7FFFFFFF, y)
        i, x = i + 1, None if x == y else x
    sp = S.Model.get(PATH).sp
    out = S.encode(spark.createDataFrame([(None, x), (None, y), (None, y)], "doc_id long, text string"), PATH, chunk=100, fan_in=2).collect()
    assert sorted((r.text, tuple(r.ids)) for r in out) == sorted((t, tuple(sp.encode(t))) for t in (x, y, y))


def test_query(spark):
    sp = S.Model.get(PATH).sp
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMOKE}/documents.parquet").collect()}
    out = S.sentencepiece_scan(spark, SMOKE).collect()
    assert len(out) == len(docs)
    for r in out:
        ids = sp.encode(docs[r.doc_id])
        assert (r.n_ids, r.ids_crc32, r.round_trip) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True)
