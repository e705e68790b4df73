"""SentencePiece encoding and decoding, with giant documents as a max-plus parallel scan.

A text's encoding is the best path through a lattice of its pieces: in a unigram model the path of the highest sum of
scores, in a BPE model the one path whose neighbours are all compatible (two pieces are if merging their joint text
gives them back; the joint text of a whole path is then merged to it, and to nothing else), so that a step weighs 0 or
minus infinity. A giant document is split into chunks. The states at a boundary are the pieces that could cover or end
at it; a chunk's matrix holds the best weight from each state at its left to each at its right. Matrices are combined by
the associative max-plus product, in groups of ``fan_in`` and then over the groups; that fixes each boundary's state,
and every chunk is traced back on its own. Where no piece can lie across a place (before a space mark that follows
another character, if the vocabulary says so), all paths share one state; the stretch between the first and the last
such place of a chunk weighs the same for all states and is encoded at once by the sentencepiece library, as are
documents of one chunk.

Defined results: null, empty texts have no ids and decode to the empty text; repeated rows repeat; a null doc_id is an
id like others; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import table, text_tag

CHUNK, FAN_IN = 16384, 64
MARK, UNK_PENALTY = "▁", 10.0
UNIGRAM, BPE = 1, 2
NONE = -np.inf


def _fields(b: bytes):
    """(number, value) of a serialised message's fields."""
    i = 0

    def number():
        nonlocal i
        x = s = 0
        while True:
            c = b[i]
            i, x, s = i + 1, x | (c & 127) << s, s + 7
            if c < 128:
                return x

    while i < len(b):
        t = number()
        size = {0: 0, 1: 8, 5: 4}.get(t & 7)
        if size == 0:
            yield t >> 3, number()
        else:
            size = number() if size is None else size
            yield t >> 3, b[i:i + size]
            i += size


class Model:
    """A model file, loaded once in each Python worker."""

    loaded: dict[str, Model] = {}

    def __init__(self, path: str, proto: bytes | None = None):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(**({"model_proto": proto} if proto else {"model_file": path}))
        trainer = next(v for k, v in _fields(self.sp.serialized_model_proto()) if k == 2)
        self.kind = dict(_fields(trainer)).get(3, UNIGRAM)
        sp, n = self.sp, self.sp.piece_size()
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models have a lattice")
        if any(sp.is_unused(i) for i in range(n)):
            raise ValueError("models with unused pieces are not supported")
        self.id = {sp.id_to_piece(i): i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
        self.score = {p: sp.get_score(i) for p, i in self.id.items()}
        self.unknown = min(self.score.values()) - UNK_PENALTY
        self.longest = max(map(len, self.id))
        #: No piece lies across the place before a mark that follows another character.
        self.words = not any(a != MARK and b == MARK for p in self.id for a, b in zip(p, p[1:]))
        self.pairs: dict[tuple[str, str], bool] = {}

    @classmethod
    def get(cls, path: str, proto: bytes | None = None) -> Model:
        key = path if proto is None else hashlib.sha256(proto).hexdigest()
        if key not in cls.loaded:
            cls.loaded[key] = cls(path, proto)
        return cls.loaded[key]

    def merged(self, text: str) -> list[str]:
        """A short normalised text merged by the BPE rule: always the pair of the best score, the leftmost of equals."""
        p = list(text)
        while True:
            best = max(((self.score[a + b], -k) for k, (a, b) in enumerate(zip(p, p[1:])) if a + b in self.score), default=None)
            if best is None:
                return p
            k = -best[1]
            p[k:k + 2] = [p[k] + p[k + 1]]

    def weight(self, before: str, piece: str) -> float:
        """What a path gains by ``piece`` after ``before`` (empty at the start of the text)."""
        if self.kind == UNIGRAM:
            return self.score.get(piece, self.unknown)
        key = (before, piece)
        if (ok := self.pairs.get(key)) is None:
            if len(self.pairs) >= 1 << 20:
                self.pairs.clear()
            ok = self.pairs[key] = self.merged(before + piece) == [x for x in key if x]
        return 0.0 if ok else NONE

    def pieces_at(self, text: str, at: int) -> list[int]:
        """Ends of the pieces that begin at ``at``; a character that is no piece stands alone."""
        return [e for e in range(at + 1, min(len(text), at + self.longest) + 1) if e == at + 1 or text[at:e] in self.id]

    def ids_of(self, pieces: list[str]) -> list[int]:
        """Ids as the library gives them: a character that is no piece becomes its bytes, or the unknown id, once a run."""
        out: list[int] = []
        for p in pieces:
            if p in self.id:
                out.append(self.id[p])
            elif (first := self.sp.piece_to_id("<0x00>")) != self.sp.unk_id():
                out += [first + x for x in p.encode()]
            elif not out or out[-1] != self.sp.unk_id():
                out.append(self.sp.unk_id())
        return out

    def whole(self, text: str) -> list[int]:
        """Ids of a normalised text that begins and ends at places that all paths share."""
        # The library puts a mark before what it encodes.
        return self.sp.encode(text[1:].replace(MARK, " "), num_threads=1) if text else []

    def states(self, text: str, at: int) -> list[tuple[int, int]]:
        """Pieces (begin, end) with begin < at <= end: the states at a boundary inside a text."""
        return [(s, e) for s in range(max(0, at - self.longest), at) for e in self.pieces_at(text, s) if e >= at]


class Lattice:
    """All paths through text[lo:hi] from states at ``lo`` (None: the text begins there) to states at ``hi``."""

    def __init__(self, model: Model, text: str, lo: int, hi: int, starts: list[tuple[int, int]] | None, last: bool):
        self.model, self.text, self.starts = model, text, starts
        # A path's future depends on where its last piece ends, in a BPE model also on that piece.
        key = (lambda s, e: (e, s)) if model.kind == BPE else (lambda s, e: (e, -1))
        n = len(starts) if starts is not None else 1
        self.score: dict[tuple[int, int], np.ndarray] = {}
        self.into: dict[tuple[int, int], list[tuple]] = {}
        todo: dict[int, list] = {}

        def reach(node, vec, edge):
            if node not in self.score:
                self.score[node], self.into[node] = vec, [edge]
                todo.setdefault(node[0], []).append(node)
            else:
                self.score[node] = np.maximum(self.score[node], vec)
                self.into[node].append(edge)

        for k, (s, e) in enumerate(starts if starts is not None else [(lo, lo)]):
            unit = np.full(n, NONE)
            unit[k] = 0.0
            if e < hi:  # else the start is a stop
                reach(key(s, e), unit, (None, (s, e), unit))
        #: The states at ``hi`` with the best weight from each start.
        self.exits: dict[tuple[int, int], tuple[np.ndarray, list]] = {}
        for at in range(lo, hi):
            for node in todo.pop(at, ()):
                vec = self.score[node]
                for e in model.pieces_at(text, at):
                    if last and e > hi:
                        continue
                    # Within a node of a unigram model the piece before doesn't matter.
                    before = text[node[1]:at] if model.kind == BPE and node[1] < at else ""
                    w = model.weight(before, text[at:e])
                    if w == NONE:
                        continue
                    if e >= hi:
                        old = self.exits.get((at, e))
                        new = vec + w
                        self.exits[at, e] = (new, [(node, w)]) if old is None else (np.maximum(old[0], new), [*old[1], (node, w)])
                    else:
                        reach(key(at, e), vec + w, (node, (at, e), w))

    def path(self, start: int, stop: tuple[int, int]) -> list[str]:
        """The pieces after the start state up to the state ``stop``, on the best path."""
        out = [self.text[stop[0]:stop[1]]]
        edges = self.exits[stop][1]
        node = max(edges, key=lambda x: self.score[x[0]][start] + x[1])[0]
        while True:
            best, at = NONE, None
            for before, span, w in self.into[node]:
                v = w[start] if before is None else self.score[before][start] + w
                if v > best:
                    best, at = v, (before, span)
            before, span = at
            if before is None:
                return out[::-1]
            out.append(self.text[span[0]:span[1]])
            node = before


class Chunk:
    """One chunk of a normalised text: ``text[lo:hi]`` with a piece's length of the text on either side."""

    def __init__(self, model: Model, text: str, lo: int, hi: int, first: bool, last: bool):
        self.model, self.text, self.lo, self.hi, self.first, self.last = model, text, lo, hi, first, last
        self.starts = None if first else model.states(text, lo)
        if not last and hi - lo < model.longest:
            raise ValueError("a chunk must be as long as the longest piece")
        self.stops = [(-1, hi)] if last else model.states(text, hi)
        places = [k for k in range(lo + 1, hi) if text[k] == MARK and text[k - 1] != MARK] if model.words else []
        # The shared places; states at lo end before lo + longest, and pieces across them don't exist.
        self.a = lo if first else next((k for k in places if all(e <= k for _, e in self.starts)), None)
        self.b = next((k for k in reversed(places) if self.a is not None and k > self.a), None) if self.a is not None else None
        if self.b is None:
            self.a = None

    def _left(self):
        return Lattice(self.model, self.text, self.lo, self.a, self.starts, True)

    def _right(self):
        return Lattice(self.model, self.text, self.b, self.hi, None, self.last)

    def _all(self):
        return Lattice(self.model, self.text, self.lo, self.hi, self.starts, self.last)

    def matrix(self) -> np.ndarray:
        """Best weights from each start (rows) to each stop (columns), less what all paths share."""
        n = 1 if self.starts is None else len(self.starts)

        def columns(lattice, count):
            out = np.full((count, len(self.stops)), NONE)
            for k, stop in enumerate(self.stops):
                found = [v for (s, e), (v, _) in lattice.exits.items() if (e == self.hi if self.last else (s, e) == stop)]
                if found:
                    out[:, k] = np.max(found, axis=0)
            return out

        if self.a is None:
            return columns(self._all(), n)
        if self.first:
            left = np.zeros((1, 1))
        else:
            direct = np.array([0.0 if e == self.a else NONE for _, e in self.starts])
            found = [v for v, _ in self._left().exits.values()] if any(e < self.a for _, e in self.starts) else []
            left = np.max([direct, *found], axis=0)[:, None]
        return times(left, columns(self._right(), 1))

    def ids(self, start: int, stop: int) -> list[int]:
        """Ids after the start state up to the stop state."""
        model = self.model

        def end_of(lattice, row):
            if not self.last:
                return self.stops[stop]
            return max((x for x in lattice.exits if x[1] == self.hi), key=lambda x: (lattice.exits[x][0][row], -x[0]))

        if self.a is None:
            whole = self._all()
            return model.ids_of(whole.path(start, end_of(whole, start)))
        head: list[str] = []
        if not self.first and self.starts[start][1] < self.a:
            left = self._left()
            head = left.path(start, max(left.exits, key=lambda x: (left.exits[x][0][start], -x[0])))
        right = self._right()
        return [*model.ids_of(head), *model.whole(self.text[self.a:self.b]), *model.ids_of(right.path(0, end_of(right, 0)))]


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def product(ms: list[np.ndarray]) -> np.ndarray:
    while len(ms) > 1:
        ms = [times(*ms[k:k + 2]) if k + 1 < len(ms) else ms[k] for k in range(0, len(ms), 2)]
    return ms[0]


def best_states(ms: list[np.ndarray], start: int, stop: int) -> list[int]:
    """The states at all boundaries of a chain of matrices, between its first and last state."""
    ahead = [ms[0][start]]
    for m in ms[1:]:
        ahead.append((ahead[-1][:, None] + m).max(axis=0))
    out = [stop]
    for k in range(len(ms) - 1, 0, -1):
        out.append(int((ahead[k - 1] + ms[k][:, out[-1]]).argmax()))
    return [start, *out[::-1]]


def pack_matrix(m: np.ndarray) -> bytes:
    return np.array(m.shape, "<i4").tobytes() + zlib.compress(m.astype("<f8").tobytes(), 1)


def unpack_matrix(b: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(b[8:]), "<f8").reshape(np.frombuffer(b[:8], "<i4"))


def _id_list(ids: list[np.ndarray]) -> pa.ListArray:
    offsets = np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32), pa.int32()))


def slices(b: pa.RecordBatch, sizes: np.ndarray, most: int = 1 << 20):
    """``b`` in pieces of whole rows, each of about ``most`` characters or ids: what Python holds at a time."""
    part = (np.cumsum(sizes) - sizes) // most
    ends = np.r_[0, np.flatnonzero(part[1:] != part[:-1]) + 1, b.num_rows]
    for x, y in zip(ends[:-1], ends[1:]):
        if y > x:
            yield b.slice(x, y - x)


def _lengths(col: pa.Array) -> np.ndarray:
    """Of lists or strings, none of them null."""
    size = pc.list_value_length(col) if pa.types.is_list(col.type) else pc.utf8_length(col)
    return size.to_numpy(zero_copy_only=False).astype(np.int64)


def encode(docs: DataFrame, model: str, chunk: int = CHUNK, fan_in: int = FAN_IN, proto: bytes | None = None) -> DataFrame:
    """(doc_id, tag, text, ids) per row of ``docs`` (doc_id, text); ids as ``sentencepiece`` encodes the text.

    ``model``: a model file that every node has under this path. Texts of up to two chunks are encoded in the scan.
    Of larger ones every chunk is a row, dealt anew over all tasks, so that no task holds a giant document.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_tag("text").alias("tag"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    giant = F.char_length("text") > 2 * chunk

    def small(batches):
        sp = Model.get(model, proto).sp
        for whole in batches:
            for b in slices(whole, _lengths(whole.column(2))):
                ids = [np.array(sp.encode(t.as_py(), num_threads=1), np.int32) for t in b.column(2)]
                yield pa.RecordBatch.from_arrays([*b.columns, _id_list(ids)], names=["doc_id", "tag", "text", "ids"])

    shape = "doc_id long, tag binary, text string, ids array<int>"
    direct = d.where(~giant).mapInArrow(small, shape)

    def split(batches):
        m = Model.get(model, proto)
        side = m.longest
        for b in batches:
            for i, g, t in zip(*(c.to_pylist() for c in b.columns)):
                t = m.sp.normalize(t).replace(" ", MARK)
                n = max(1, len(t) // chunk)
                for at in range(0, n, 256):
                    ks = range(at, min(n, at + 256))
                    cut = [(k * chunk, len(t) if k == n - 1 else (k + 1) * chunk) for k in ks]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([i] * len(ks), pa.int64()), pa.array([g] * len(ks), pa.binary()), pa.array(ks, pa.int32()), pa.array([n] * len(ks), pa.int32()),
                         pa.array([min(lo, 2 * side) for lo, _ in cut], pa.int32()), pa.array([hi - max(0, lo - 2 * side) for lo, hi in cut], pa.int32()),
                         pa.array([t[max(0, lo - 2 * side):hi + 2 * side] for lo, hi in cut])], names=["doc_id", "tag", "k", "n", "lo", "hi", "part"])

    # Equal rows are encoded once; the result is joined to all of them.
    big = d.where(giant).dropDuplicates(["doc_id", "tag"])
    parts = cut_lineage(big.mapInArrow(split, "doc_id long, tag binary, k int, n int, lo int, hi int, part string").repartition("doc_id", "tag", "k"))

    def chunk_of(m, r) -> Chunk:
        return Chunk(m, r["part"], r["lo"], r["hi"], r["k"] == 0, r["k"] == r["n"] - 1)

    def matrices(batches):
        m = Model.get(model, proto)
        for b in batches:
            out = [pack_matrix(chunk_of(m, r).matrix()) for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out, pa.binary())], names=["doc_id", "tag", "k", "m"])

    key = ["doc_id", "tag"]
    ms = cut_lineage(parts.mapInArrow(matrices, "doc_id long, tag binary, k int, m binary").withColumn("blk", F.floor(F.col("k") / fan_in).cast("int")))

    def combine(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("k")
        return pd.DataFrame({"doc_id": x.doc_id[:1].values, "tag": x.tag[:1].values, "blk": x.blk[:1].values, "m": [pack_matrix(product([unpack_matrix(b) for b in x.m]))]})

    def settle(x: pd.DataFrame) -> pd.DataFrame:
        """A document's groups: at most the length of a string over chunk * fan_in."""
        x = x.sort_values("blk")
        s = best_states([unpack_matrix(b) for b in x.m], 0, 0)
        return pd.DataFrame({"doc_id": x.doc_id.values, "tag": x.tag.values, "blk": x.blk.values, "a": s[:-1], "b": s[1:]})

    def inner(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("k")
        s = best_states([unpack_matrix(b) for b in x.m], int(x.a.iloc[0]), int(x.b.iloc[0]))
        return pd.DataFrame({"doc_id": x.doc_id.values, "tag": x.tag.values, "k": x.k.values, "a": s[:-1], "b": s[1:]})

    blocks = ms.groupBy(*key, "blk").applyInPandas(combine, "doc_id long, tag binary, blk int, m binary")
    ends = cut_lineage(blocks.groupBy(*key).applyInPandas(settle, "doc_id long, tag binary, blk int, a int, b int"))
    same = lambda a, b, more=(): a.doc_id.eqNullSafe(b._id) & (a.tag == b._tag) & (a[more] == b[f"_{more}"] if more else F.lit(True))
    named = lambda x: x.withColumnsRenamed({"doc_id": "_id", "tag": "_tag", "blk": "_blk", "k": "_k"})
    ends = named(ends)
    states = cut_lineage(ms.join(ends, same(ms, ends, "blk")).select(*key, "blk", "k", "m", "a", "b").groupBy(*key, "blk").applyInPandas(inner, "doc_id long, tag binary, k int, a int, b int"))
    states = named(states)

    def trace(batches):
        m = Model.get(model, proto)
        for b in batches:
            out = [np.array(chunk_of(m, r).ids(r["a"], r["b"]), np.int32) for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), _id_list(out)], names=["doc_id", "tag", "k", "ids"])

    traced = parts.join(states, same(parts, states, "k")).select(*parts.columns, "a", "b").mapInArrow(trace, "doc_id long, tag binary, k int, ids array<int>")
    # A document's ids are one row again, as its text is.
    joined = traced.groupBy(*key).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("k", "ids"))), lambda x: x.ids)).alias("ids"))
    joined = named(joined)
    rest = d.where(giant)
    return direct.unionAll(rest.join(joined, same(rest, joined)).select("doc_id", "tag", "text", "ids"))


def text_of(sp, ids: pa.ListScalar) -> str:
    return sp.decode(ids.values.to_pylist()) if len(ids) else ""


def decode(ids: DataFrame, model: str, proto: bytes | None = None) -> DataFrame:
    """``ids`` (doc_id, tag, text, ids) with the column decoded: the text that the ids stand for."""

    def run(batches):
        sp = Model.get(model, proto).sp
        for whole in batches:
            for b in slices(whole, _lengths(whole.column(3))):
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([text_of(sp, x) for x in b.column(3)], pa.string())], names=["doc_id", "tag", "text", "ids", "decoded"])

    return ids.select("doc_id", "tag", "text", "ids").mapInArrow(run, "doc_id long, tag binary, text string, ids array<int>, decoded string")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def sentencepiece_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: every document's ids and what they decode to."""
    path = default_model()
    ids = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path)

    def digest(batches):
        # Decodes as ``decode`` does, without sending the texts through one more Python worker.
        sp = Model.get(path).sp
        for whole in batches:
            for b in slices(whole, _lengths(whole.column(3))):
                out = [(len(x), zlib.crc32(x.values.to_numpy().astype("<u4").tobytes()), text_of(sp, x)) for x in b.column(3)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([len(x[2]) for x in out], pa.int64()),
                     pa.array([hashlib.sha256(x[2].encode()).hexdigest() for x in out]), pa.array([x[2] == t.as_py() for x, t in zip(out, b.column(2))], pa.bool_())],
                    names=["doc_id", "n_ids", "ids_crc32", "n_chars", "decoded_sha256", "round_trip"])

    return ids.mapInArrow(digest, "doc_id long, n_ids long, ids_crc32 long, n_chars long, decoded_sha256 string, round_trip boolean")
