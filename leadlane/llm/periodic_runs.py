"""Runs: stretches of words that repeat a period four times and more, by block convolution.

At each scale B = 1, 2, 4, ... the word sequence is cut into blocks of B words. A run whose smallest period q lies in
[B, 2B) is at least 4q words long, so several blocks in a row lie in it and occur again q words later. Where a block
occurs in the 2B words after it is read off the sum of squared differences at each distance d, which is zero exactly at
an occurrence:  sum x^2 + sum y^2 - 2 sum xy. The last sum, for all d at once, is a cyclic convolution of 2B numbers,
taken by a number-theoretic transform modulo a prime: word codes are kept so small that no sum reaches the prime, so
the result is the exact integer. Each block is transformed once; the window's transform is put together from those of
the two blocks in it.

Codes are coarser than words at large scales, so an occurrence is only a seed. Seeds of one distance in neighbouring
blocks form a chain; a chain shorter than any run of that period has is dropped, as is one inside a run found before
(at a smaller period). The others are compared word by word, less than B words beyond their ends. That bounds the work
at n words by n log n a scale, and the blocks are transformed in slices of bounded size.

Defined results: a null, empty or blank text has no words, no run and the digests of nothing; a null doc_id leaves the
text as it is (it has no decimal form to plant a period by); repeated rows give repeated results; extra columns are
ignored; very long texts are one sequence of words, in memory of one task.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

MIN_LENGTH, MIN_REPEATS = 6, 4
#: Words that are searched at once, and numbers in a slice of blocks that is transformed at once.
GROUP, SLICE = 1 << 18, 1 << 19
#: Primes with a power of two dividing p - 1, and a generator: 2^16 + 1, and 15 * 2^27 + 1 for blocks beyond its reach.
FERMAT, LARGE = (65537, 3), (2013265921, 31)


def _fold(x: np.ndarray) -> np.ndarray:
    """x modulo 65537, up to a multiple of it, about 16 bits shorter: 2^16 is -1."""
    return (x & 0xFFFF) - (x >> 16)


def reduced(x: np.ndarray, p: int) -> np.ndarray:
    return _fold(_fold(x)) if p == FERMAT[0] else x % p


@lru_cache(maxsize=64)
def roots(size: int, p: int, g: int, inverse: bool) -> np.ndarray:
    """The powers 0 .. size/2 - 1 of a root of unity of order ``size``."""
    w = pow(g, (p - 1) // size, p)
    w = pow(w, -1, p) if inverse else w
    out = np.ones(max(1, size // 2), np.int64)
    step = 1
    while step < len(out):  # doubling: the next powers are those so far times w^step
        out[step:2 * step] = out[:len(out[step:2 * step])] * pow(w, step, p) % p
        step *= 2
    return out


def transform(a: np.ndarray, p: int, g: int) -> np.ndarray:
    """Number-theoretic transform along axis 0, natural order to bit-reversed order; columns are sequences."""
    size, cols = a.shape
    half = size // 2
    while half:
        b = a.reshape(-1, 2, half, cols)
        w = roots(2 * half, p, g, False)[None, :, None]
        out = np.empty_like(b)
        np.add(b[:, 0], b[:, 1], out=out[:, 0])
        out[:, 1] = reduced((b[:, 0] - b[:, 1]) * w, p)
        if p != FERMAT[0]:
            out[:, 0] %= p
        a, half = out.reshape(size, cols), half // 2
    return a % p


def inverse(a: np.ndarray, p: int, g: int) -> np.ndarray:
    """The inverse of ``transform``: bit-reversed order to natural order, each value in [0, p)."""
    size, cols = a.shape
    half = 1
    while half < size:
        b = a.reshape(-1, 2, half, cols)
        hi = reduced(b[:, 1] * roots(2 * half, p, g, True)[None, :, None], p)
        out = np.empty_like(b)
        np.add(b[:, 0], hi, out=out[:, 0])
        np.subtract(b[:, 0], hi, out=out[:, 1])
        if p != FERMAT[0]:
            out %= p
        a, half = out.reshape(size, cols), half * 2
    return a % p * pow(size, -1, p) % p


@lru_cache(maxsize=64)
def negated(size: int) -> np.ndarray:
    """Where the frequency -f stands that stands at f's place, in bit-reversed order."""
    bits = size.bit_length() - 1
    at = np.arange(size)
    rev = sum((at >> i & 1) << bits - 1 - i for i in range(bits)) + 0 * at
    return rev[-rev % size]


def occurrences(codes: np.ndarray, block: int, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """(block number, distance) at which the code of each block occurs again, for distances in [block, 2 * block).

    codes: at least (blocks + 2) * block small numbers; block * max(codes)^2 is less than the prime.
    """
    p, g = FERMAT if 2 * block <= 1 << 16 else LARGE
    found = []
    cols = max(1, SLICE // (2 * block))
    for at in range(0, blocks, cols):
        n = min(cols, blocks - at)
        x = codes[at * block:(at + n + 2) * block].reshape(n + 2, block)
        padded = np.zeros((2 * block, n + 2), np.int64)
        padded[:block] = x.T
        t = transform(padded, p, g)
        y = t[:, 1:n + 1].copy()  # the window: the next block, then the one after it, half a turn on
        y[:block] += t[:, 2:][:block]
        y[block:] -= t[:, 2:][block:]
        xy = inverse(reduced(t[negated(2 * block), :n] * (y % p), p), p, g)[:block]
        sq = np.concatenate([np.zeros(1, np.int64), np.cumsum(codes[at * block:(at + n + 2) * block] ** 2)])
        start = np.arange(n) * block
        near = start[None, :] + np.arange(block)[:, None] + block
        zero = (sq[start + block] - sq[start])[None, :] + sq[near + block] - sq[near] == 2 * xy
        d, k = np.nonzero(zero)
        found.append((k + at, d + block))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 2


def runs_of(seqs: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """For each sequence of word numbers its runs (start, length, period), by start, then period.

    Word numbers are shared by the sequences and not negative.
    """
    runs: list[list[tuple[int, int, int]]] = [[] for _ in seqs]
    block = 1
    while live := [i for i, s in enumerate(seqs) if len(s) >= max(MIN_LENGTH, MIN_REPEATS * block)]:
        # One text behind the other, each followed by a word of its own, and two blocks of such words at the end.
        offset = np.cumsum([0, *(len(seqs[i]) + 1 for i in live)])
        blocks = -(-int(offset[-1]) // block)
        ids = -1 - np.arange((blocks + 2) * block)
        reach = np.zeros(len(ids), np.int64)  # the furthest end of a run that starts at or before a place
        for i, o in zip(live, offset):
            ids[o:o + len(seqs[i])] = seqs[i]
            for s, n, _ in runs[i]:
                reach[o + s] = max(reach[o + s], o + s + n)
        reach = np.maximum.accumulate(reach)
        p = FERMAT[0] if 2 * block <= 1 << 16 else LARGE[0]
        top = int(((p - 1) // block) ** 0.5)
        while block * top * top >= p:
            top -= 1
        k, d = occurrences(ids % (top + 1), block, blocks)
        inside = reach[k * block] >= k * block + d + block
        k, d = k[~inside], d[~inside]
        order = np.lexsort((k, d))
        k, d = k[order], d[order]
        cut = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (k[1:] != k[:-1] + 1)]) if len(k) else np.empty(0, np.int64)
        last = np.r_[cut[1:], len(k)] - 1
        # A run of period d matches itself over 3d words and more; so many whole blocks lie in them.
        match = np.maximum((MIN_REPEATS - 1) * d[cut], MIN_LENGTH - d[cut]) if len(k) else cut
        enough = last - cut + 1 >= (match + 1) // block - 1
        for a, z in zip(cut[enough].tolist(), last[enough].tolist()):
            q = int(d[a])
            lo, hi = max(0, (int(k[a]) - 1) * block + 1), min(len(ids) - q, (int(k[z]) + 2) * block - 1)
            differ = np.flatnonzero(ids[lo:hi] != ids[lo + q:hi + q])
            begin, end = np.r_[lo, differ + lo + 1], np.r_[differ + lo, hi]
            for x, y in zip(begin.tolist(), end.tolist()):
                if y - x + q < max(MIN_LENGTH, MIN_REPEATS * q) or reach[x] >= y + q:
                    continue
                i = int(np.searchsorted(offset, x, "right")) - 1
                runs[live[i]].append((x - int(offset[i]), y - x + q, q))
        block *= 2
    return [sorted(set(r), key=lambda x: (x[0], x[2])) for r in runs]


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words as the query takes them: one text in ten by its id's checksum goes on with a period."""
    n = len(words)
    if doc_id is None or not n or (h := zlib.crc32(b"%d" % doc_id)) % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * (-(-(n - a) // p)))[:n - a]


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run repeats: of each run, all after its first period go."""
    out, at = [], 0
    for a, z in sorted((s + q, s + n) for s, n, q in runs):
        if z > at:
            out += words[at:max(a, at)]
            at = z
    return out + words[at:]


def text_runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """(doc_id, runs, kept) per row of ``docs`` (doc_id, text): array of (start, length, period), and the kept words, UTF-8."""
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def search(ids, texts):
        number: dict[bytes, int] = defaultdict(count().__next__)
        seqs = [np.fromiter(map(number.__getitem__, w), np.int64, len(w)) for w in texts]
        found = runs_of(seqs)
        rows = [[{"start": s, "length": n, "period": q} for s, n, q in r] for r in found]
        kept = [b" ".join(kept_words(w, r)) for w, r in zip(texts, found)]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, kind), pa.array(kept, pa.binary())], names=["doc_id", "runs", "kept"])

    def run(batches):
        for b in batches:
            ids, texts, size = [], [], 0
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                w = (t.as_py() or b"").split()
                ids.append(i)
                texts.append(planted(w, i) if plant else w)
                size += len(w)
                if size >= GROUP:
                    yield search(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield search(ids, texts)

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return d.mapInArrow(run, "doc_id long, runs array<struct<start:long,length:long,period:long>>, kept binary")


def periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: runs of every document, its longest one, and digests of all runs and of the words kept."""
    best = F.expr("array_max(transform(runs, x -> struct(x.length as length, -x.start as start, -x.period as period)))")
    lines = F.expr("array_join(transform(runs, x -> concat_ws(',', x.start, x.length, x.period) || '\n'), '')")
    r = text_runs(table(spark, sf_dir, "documents"), plant=True).withColumns({"b": best, "runs_sha256": F.sha2(lines.cast("binary"), 256)})
    return r.select("doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("b.start")).alias("start"), F.col("b.length").alias("length"),
                    (-F.col("b.period")).alias("period"), F.expr("(1000 * b.length) div -b.period").alias("exponent_milli"), "runs_sha256", F.sha2("kept", 256).alias("collapsed_sha256"))
