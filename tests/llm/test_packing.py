import zlib
from collections import defaultdict

import numpy as np
import pytest

from leadlane.llm import packing as P
from tests.conftest import SMOKE

PATH = P.default_tokenizer()


def exact(text):
    from tokenizers import Tokenizer

    global tok
    try:
        tok
    except NameError:
        tok = Tokenizer.from_file(PATH)
    return [*tok.encode(text or "", add_special_tokens=False).ids, 1]


def check(docs, pieces, window=2048, with_ids=False):
    """Each id of each document in one piece, right sums, gapless windows. Returns the share of padding."""
    want = defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        want[r.doc_id].append(exact(r.text))
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in pieces.collect():
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(want)
    for i, copies in want.items():
        rows = sorted(by_doc[i], key=lambda r: (r.doc_tokens, r.start))
        assert sum(r.length for r in rows) == sum(map(len, copies))
        if len(copies) == 1:
            at = 0
            for r in rows:
                ids = copies[0][r.start:r.start + r.length]
                assert r.start == at and r.length == len(ids) > 0 and r.doc_tokens == len(copies[0])
                assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
                if with_ids:
                    assert np.frombuffer(r.ids, "<u4").tolist() == ids
                at += r.length
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
    return 1 - sum(map(len, sum(want.values(), []))) / (window * len(by_seq)) if by_seq else 0


def test_ids_are_those_of_the_tokenizer_file(spark):
    t = P.Tokens.get(PATH)
    texts = [r.text for r in spark.read.parquet(f"{SMOKE}/documents.parquet").collect()]
    for x in [*texts, "", " ", "a  b\n\n c\t", "it's 12 o''clock", "<|endoftext|> x", "é漢字😀\x1c ", " " * 9000 + "a", "x" * 5000]:
        assert [*t.ids(x), 1] == exact(x)
        assert P.token_ids(t, x, 1).tolist() == exact(x)


@pytest.mark.parametrize("text", ["one two three " * 400, "a" * 5000, "a, b. c " * 300, "é ß  \n x " * 300])
def test_parts_leave_the_ids_alone(text):
    got = [x for p in P.parts(text, 100) for x in exact(p)[:-1]]
    assert "".join(P.parts(text, 100)) == text and got == exact(text)[:-1]


def test_query(spark):
    waste = check(spark.read.parquet(f"{SMOKE}/documents.parquet"), P.packing(spark, SMOKE))
    assert waste < 0.02


def test_leftovers_merge_in_rounds(spark):
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet").repartition(23)
    out = P.pack(docs, PATH, window=512, open_windows=4, min_piece=8, fan_in=3)
    assert check(docs, out, 512, True) < 0.03


def test_odd_rows_and_empty(spark, odd_docs):
    check(odd_docs, P.pack(odd_docs, PATH))
    assert P.pack(odd_docs.limit(0), PATH).count() == 0
