"""Packing documents into token windows with bounded space.

Each partition of the scan tokenises its documents and packs them online: it keeps at most ``open_windows`` windows
open, puts a piece where it leaves the least room, and when it fits nowhere takes the fullest window, fills it with the
head of the piece if that head has at least ``min_piece`` tokens, and emits it. The windows that stay open at the end
of a partition are leftovers; they are merged in rounds, each of which packs the leftovers of up to ``fan_in``
partitions in one task, until one task's are left, whose windows are filled up from the emptiest. So a task holds
``fan_in * open_windows`` windows at most, at any size of the input. Only leftovers carry token ids between tasks.

Defined results: a null or empty text is its end token alone; repeated rows, repeated or null doc_ids are packed like
other rows; extra columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import table

WINDOW, OPEN_WINDOWS, MIN_PIECE, FAN_IN, END_ID = 2048, 32, 16, 64, 1
#: Texts longer than this are tokenised in parts, cut where the tokenizer always ends a word.
PART_CHARS = 1 << 20
ROUND_BITS, TASK_BITS = 58, 34  # of a sequence_id: round, task, number in the task

_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                     ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()), ("open", pa.int64())])
_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary, open long"


@dataclass
class Piece:
    doc_id: int | None
    start: int
    doc_tokens: int
    ids: np.ndarray  # <u4

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return (Piece(self.doc_id, self.start, self.doc_tokens, self.ids[:n]),
                Piece(self.doc_id, self.start + n, self.doc_tokens, self.ids[n:]))


@dataclass
class Windows:
    """The open windows of one task."""

    window: int
    most: int
    min_piece: int
    open: list[list[Piece]] = field(default_factory=list)
    used: list[int] = field(default_factory=list)

    def put(self, piece: Piece) -> Iterator[list[Piece]]:
        """Places a piece; gives the windows that leave."""
        while len(piece.ids) >= self.window:
            head, piece = piece.cut(self.window)
            yield [head]
        while (n := len(piece.ids)):
            best = max((u for u in self.used if u + n <= self.window), default=None)
            if best is not None:
                at = self.used.index(best)
                self.open[at].append(piece)
                self.used[at] += n
                if self.used[at] == self.window:
                    yield self.take(at)
                return
            if len(self.open) < self.most:
                self.open.append([piece])
                self.used.append(n)
                return
            at = max(range(len(self.used)), key=self.used.__getitem__)
            room = self.window - self.used[at]
            if min(room, n - room) >= self.min_piece:
                head, piece = piece.cut(room)
                self.open[at].append(head)
            yield self.take(at)

    def take(self, at: int) -> list[Piece]:
        self.used.pop(at)
        return self.open.pop(at)

    def close(self) -> Iterator[list[Piece]]:
        """Fills the fullest windows from the emptiest until one partly filled window is left."""
        rest = [p for w in sorted(self.open, key=lambda w: -sum(len(p.ids) for p in w)) for p in w]
        now, used = [], 0
        for p in rest:
            while len(p.ids) >= self.window - used:
                head, p = p.cut(self.window - used)
                yield [*now, head]
                now, used = [], 0
            if len(p.ids):
                now.append(p)
                used += len(p.ids)
        if now:
            yield now


def _rows(windows: list[tuple[int, int | None, list[Piece]]], with_ids: bool) -> pa.RecordBatch:
    """(sequence, task that keeps it open or None, pieces) as rows; open windows always carry their ids."""
    out: list[list] = [[] for _ in _SCHEMA]
    for seq, task, pieces in windows:
        offset = 0
        for p in pieces:
            raw = p.ids.astype("<u4").tobytes()
            for col, x in zip(out, (p.doc_id, p.start, len(p.ids), zlib.crc32(raw), p.doc_tokens, seq, offset, raw if with_ids or task is not None else None, task)):
                col.append(x)
            offset += len(p.ids)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _SCHEMA)], schema=_SCHEMA)


def _packed(pieces: Iterator[Piece], state: Windows, base: int, task: int | None, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """Emitted windows as they leave; at the end the open ones, marked with ``task``, or closed if that is None."""
    seq, held, size = base, [], 0

    def done(ws, mark=None):
        nonlocal seq, held, size
        for w in ws:
            held.append((seq, mark, w))
            seq, size = seq + 1, size + len(w)

    for p in pieces:
        done(state.put(p))
        if size >= 4096:
            yield _rows(held, with_ids)
            held, size = [], 0
    if task is None:
        done(state.close())
    else:
        done(state.open, task)
    if held:
        yield _rows(held, with_ids)


def parts(text: str, most: int = PART_CHARS) -> Iterator[str]:
    """Pieces of a long text, cut only before a space between two letters: a byte-level tokenizer always ends a word there."""
    at = 0
    while len(text) - at > most:
        cut = at + most
        while cut + 1 < len(text) and not (text[cut] == " " and text[cut - 1].isalpha() and text[cut + 1].isalpha()):
            cut += 1
        if cut + 1 >= len(text):
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def byte_values() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable bytes are themselves, the others
    follow from 256 on in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Tokens:
    """A byte-level BPE tokenizer file, loaded once in each Python worker.

    Ids are those of ``tokenizers`` for the file with add_special_tokens=False. Ordinary texts go through tiktoken
    with the file's own vocabulary as ranks, which is several times faster; texts that hold one of the file's special
    strings or a very long run of white space go through ``tokenizers`` itself.
    """

    loaded: dict[str, Tokens] = {}
    long_space = re.compile(r"\s{4096}")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        self.special = [x.content for x in self.exact.get_added_tokens_decoder().values()]
        byte = byte_values()
        ranks = {bytes(map(byte.__getitem__, k)): v for k, v in self.exact.get_vocab(with_added_tokens=False).items() if k not in self.special}
        self.fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    @classmethod
    def get(cls, path: str) -> Tokens:
        if path not in cls.loaded:
            cls.loaded[path] = cls(path)
        return cls.loaded[path]

    def ids(self, text: str) -> list[int]:
        if any(x in text for x in self.special) or len(text) > 4096 and self.long_space.search(text):
            return self.exact.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def token_ids(tok: Tokens, text: str | None, end_id: int) -> np.ndarray:
    got = [np.array(tok.ids(p), "<u4") for p in parts(text or "")]
    return np.concatenate([*got, np.array([end_id], "<u4")])


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, open_windows: int = OPEN_WINDOWS, min_piece: int = MIN_PIECE,
         fan_in: int = FAN_IN, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids as little-endian uint32).

    ``tokenizer``: a tokenizers file that every node has under this path. ``with_ids=False`` leaves ids null, for
    callers that only need the layout.
    """

    def first(batches):
        task = TaskContext.get().partitionId()
        tok = Tokens.get(tokenizer)

        def pieces():
            for b in batches:
                for i, t in zip(b.column(0), b.column(1)):
                    ids = token_ids(tok, t.as_py(), end_id)
                    yield Piece(i.as_py(), 0, len(ids), ids)

        yield from _packed(pieces(), Windows(window, open_windows, min_piece), task << TASK_BITS, task, with_ids)

    def merge(rnd: int, last: bool):
        def run(batches):
            def pieces():
                nonlocal task
                for b in batches:
                    col = {n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)}
                    for k in range(b.num_rows):
                        now = col["open"][k] // fan_in
                        if now != task:
                            if task is not None:
                                raise ValueError("leftovers of two groups met in one stream")
                            task = now
                        yield Piece(col["doc_id"][k], col["start"][k], col["doc_tokens"][k], np.frombuffer(col["ids"][k], "<u4"))

            task = None
            todo = pieces()
            one = next(todo, None)
            if one is None:
                return
            base = (rnd << ROUND_BITS) | (task << TASK_BITS)

            def again():
                yield one
                yield from todo

            yield from _packed(again(), Windows(window, open_windows, min_piece), base, None if last else task, with_ids)

        return run

    rows = cut_lineage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(first, _DDL))
    done, rnd = rows.where("open is null"), 0
    while True:
        rnd += 1
        left = rows.where("open is not null")
        most = left.agg(F.max("open")).first()[0]
        if most is None:
            break
        groups = most // fan_in + 1
        # One group of leftovers a task, in an order that a retry repeats.
        dealt = left.withColumn("_g", F.floor(F.col("open") / fan_in).cast("int")).repartitionById(groups, F.col("_g"))
        dealt = dealt.sortWithinPartitions("sequence_id", "offset").drop("_g")
        rows = cut_lineage(dealt.mapInArrow(merge(rnd, groups == 1), _DDL))
        done = done.unionAll(rows.where("open is null"))
        if groups == 1:
            break
    return done.drop("open")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: the layout of all documents in windows of 2048."""
    return pack(table(spark, sf_dir, "documents"), default_tokenizer(), with_ids=False).drop("ids")
