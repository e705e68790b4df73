"""Toxicity by a learned lexicon, misspelling-tolerant lookup and context windows.

The lexicon is learned from labelled rows: words, and beginnings of words, that stand in toxic texts far more often than
chance allows for as many candidates. It is kept as a trie. A word of a text is looked up by walking the trie with the
word's Levenshtein automaton (one edit or swap, look-alike digits for letters free), so misspelled terms and beginnings
are caught; a kind of edit of a short term or a beginning counts unless it caught mostly other words in the texts
learned from. Each distinct word is looked up once in a worker. Hits are weighed in a window of the words around them: hits near
other hits weigh more, hits inside quotation marks or quoted lines are counted apart, as quotation and not as abuse. A
logistic regression over these few sums gives the score.

Defined results: null, empty and blank texts have no hits and get the score of a text without hits; a null doc_id is
scored, never learned from, and not held out; repeated rows are scored alike, and count once as labelled rows (the
higher label); without both labels among the rows to learn from every score is 0; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import table

#: Least documents behind a term, shortest term that any edit may change.
MIN_DOCS, MIN_FUZZY, WINDOW, CUT = 3, 5, 10, 0.3
PREFIXES = range(3, 9)
FUZZY_WEIGHT, QUOTED_WEIGHT, NEAR_WEIGHT = 0.5, 0.2, 0.5
_TOKEN = re.compile(r"[^\W_]+")
_QUOTED = re.compile(r'"[^"\n]+"|“[^”\n]+”|„[^“”\n]+[“”]|«[^»\n]+»|‹[^›\n]+›|‘[^’\n]+’(?!\w)|^[ \t]*>.*$', re.M)
LOOKS_LIKE = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
#: Kinds of one edit, and the trie's mark of a beginning (no token has it).
KINDS, BEGINNING = ("insertion", "deletion", "substitution", "swap", "end"), "_"
#: A worker keeps the answers for so many distinct words before it starts again.
MEMO = 300_000


@dataclass
class Lexicon:
    """Terms with their weights; every one is in the trie. ``refused``: (is a beginning, length, kind of edit) that
    caught mostly other words in the texts learned from. ``others``: words known from those texts that are no
    misspellings, though within one edit of a term."""

    words: dict[str, float]
    prefixes: dict[str, float]
    refused: frozenset[tuple[bool, int, str]] = frozenset()
    others: frozenset[str] = frozenset()

    def __post_init__(self):
        self.trie: dict = {}
        #: By (is a beginning, length), the beginnings and ends of half a term: one edit leaves one of both alone.
        self.heads: dict[tuple[bool, int], set[str]] = {}
        self.tails: dict[tuple[bool, int], set[str]] = {}
        for beginning, terms in ((False, self.words), (True, self.prefixes)):
            for w in terms:
                node = self.trie
                for c in w:
                    node = node.setdefault(c, {})
                node[BEGINNING if beginning else ""] = w
                key = beginning, len(w)
                if any((*key, kind) not in self.refused for kind in KINDS):
                    k = (len(w) - 1) // 2
                    self.heads.setdefault(key, set()).add(w[:k])
                    self.tails.setdefault(key, set()).add(w[len(w) - k:])

    def may_match(self, word: str) -> bool:
        """False only if no term of the trie is within one edit: spares nearly all words the walk."""
        if not word.isalpha():  # digits may stand for letters
            return True
        for (beginning, length), heads in self.heads.items():
            k = (length - 1) // 2
            if beginning:
                if len(word) >= length and (word[:k] in heads or any(word[length + d - k:length + d] in self.tails[beginning, length] for d in (-1, 0, 1))):
                    return True
            elif abs(len(word) - length) <= 1 and (word[:k] in heads or word[len(word) - k:] in self.tails[beginning, length]):
                return True
        return False


def _alike(x: str, y: str) -> bool:
    """Whether a text's character stands for a term's."""
    return x == y or y in LOOKS_LIKE.get(x, "")


def kind_of(word: str, term: str) -> str:
    """The kind of the one edit between ``word`` and ``term``."""
    if len(word) != len(term):
        return "insertion" if len(word) > len(term) else "deletion"
    return "substitution" if sum(not _alike(x, y) for x, y in zip(word, term)) == 1 else "swap"


def matches(trie: dict, word: str) -> list[tuple[bool, str, frozenset[str]]]:
    """(is a beginning, term, kinds) of all terms of the trie within one edit (insertion, deletion, substitution, swap) of
    ``word``, or, for beginnings, of a part that ``word`` begins with and is longer than. Kinds are those of the edits
    that do, none without an edit; "end" if a beginning's last letter alone is wrong.

    The automaton's states are bit sets: bit i of row e says that the trie path so far spells the word's first i
    characters with e edits.
    """
    n = len(word)
    at: dict[str, int] = {}
    for i, c in enumerate(word):
        for x in c + LOOKS_LIKE.get(c, ""):
            at[x] = at.get(x, 0) | 1 << i
    full = 1 << n
    out = []
    # (node, row 0, row 1, row 0 waiting for the second half of a swap)
    todo = [(trie, 1, 2 if n else 0, 0)]
    while todo:
        node, r0, r1, swap = todo.pop()
        for c, below in node.items():
            if c == "":
                if (r0 | r1) & full:
                    out.append((False, below, frozenset() if r0 & full else frozenset((kind_of(word, below),))))
                continue
            if c == BEGINNING:
                if n < len(below) or r0 & full:
                    continue
                if r0:
                    out.append((True, below, frozenset()))
                elif all(map(_alike, word, below[:-1])):
                    out.append((True, below, frozenset(("end",))))
                elif r1 & full - 1:
                    out.append((True, below, frozenset(kind_of(word[:i], below) for i in range(len(below) - 1, min(n, len(below) + 2)) if r1 >> i & 1)))
                continue
            m = at.get(c, 0)
            s0 = (r0 & m) << 1
            s1 = (r1 & m) << 1 | r0 | r0 << 1 | (swap & m) << 2
            s1 = (s1 | s0 << 1) & (full << 1) - 1
            if s0 | s1:
                # A swap reads the second character first, then the first.
                todo.append((below, s0, s1, r0 & m >> 1))
    return out


def fuzzy(trie: dict, word: str) -> str | None:
    """The whole term of the trie within one edit of ``word``; the least if several."""
    return min((term for beginning, term, _ in matches(trie, word) if not beginning), default=None)


class Lookup(dict):
    """word -> (weight, is fuzzy) or None."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon

    def __missing__(self, word: str):
        if len(self) >= MEMO:
            self.clear()
        got = self[word] = self.find(word)
        return got

    def find(self, word: str):
        x = self.lexicon
        if word in x.words:
            return x.words[word], False
        for k in PREFIXES:
            if len(word) > k and word[:k] in x.prefixes:
                return x.prefixes[word[:k]], False
        if word in x.others or not x.may_match(word):
            return None
        near = [(beginning, term) for beginning, term, kinds in matches(x.trie, word)
                if not kinds or any((beginning, len(term), kind) not in x.refused for kind in kinds)]
        if not near:
            return None
        beginning, term = min(near)
        return FUZZY_WEIGHT * (x.prefixes if beginning else x.words)[term], True


def measure(text: str | None, lookup: Lookup) -> tuple[float, float, float, int, int]:
    """(weight of abuse, weight of quotation, heaviest window, hits, words) of a whole text."""
    low = (text or "").lower()
    tokens = _TOKEN.findall(low)
    found = list(map(lookup.__getitem__, tokens))
    at = [i for i, x in enumerate(found) if x]
    if not at:
        return 0.0, 0.0, 0.0, 0, len(tokens)
    spans = [m.span() for m in _TOKEN.finditer(low)]
    quoted, q = [], [m.span() for m in _QUOTED.finditer(low)]
    k = 0
    for i in at:
        while k < len(q) and q[k][1] <= spans[i][0]:
            k += 1
        quoted.append(k < len(q) and q[k][0] <= spans[i][0])
    own = [found[i][0] * (QUOTED_WEIGHT if x else 1) for i, x in zip(at, quoted)]
    abuse = quotation = heaviest = 0.0
    a = b = 0
    window = 0.0
    for j, i in enumerate(at):
        while b < len(at) and at[b] <= i + WINDOW:
            window += own[b]
            b += 1
        while at[a] < i - WINDOW:
            window -= own[a]
            a += 1
        score = own[j] + NEAR_WEIGHT * max(0.0, window - own[j]) / WINDOW
        heaviest = max(heaviest, score)
        if quoted[j]:
            quotation += found[i][0]
        else:
            abuse += score
    return abuse, quotation, heaviest, len(at), len(tokens)


FEATURES = ["abuse", "quotation", "heaviest", "share"]


def features(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, FEATURES, n_hits, n_tokens per row; one pass over the whole texts, no shuffle."""

    def run(batches):
        lookup = Lookup(lexicon)
        for b in batches:
            out = [measure(t.as_py(), lookup) for t in b.column(1)]
            cols = [pa.array(x, pa.float64()) for x in (
                [math.log1p(o[0]) for o in out], [math.log1p(o[1]) for o in out], [o[2] for o in out], [math.log1p(100 * o[0] / max(1, o[4])) for o in out])]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols, pa.array([o[3] for o in out], pa.int64()), pa.array([o[4] for o in out], pa.int64())],
                                             names=["doc_id", *FEATURES, "n_hits", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES) + ", n_hits long, n_tokens long")


def learn_lexicon(rows: DataFrame) -> Lexicon:
    """From labelled ``rows`` (text, y). Words are counted once a text, in Spark; only the lexicon is collected. What
    bounds it is the evidence a term needs, the same rule for every size; no count of terms does.

    Copies of a text would make each of its rare words look like a term, so of rows with the same label and the same
    words in the same order (a 128-bit hash of them all) one is counted; every other text counts. Where that leaves a
    label fewer than MIN_DOCS texts, nothing could be learned from them, and all rows count.
    """
    words_of = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    rows = rows.select("y", F.coalesce(words_of, F.array().cast("array<string>")).alias("w"))
    rows = cut_lineage(rows.select("y", F.md5(F.array_join("w", " ").cast("binary")).alias("copy"), F.array_distinct("w").alias("w")))

    def sizes(t: DataFrame):
        return t.agg(F.count("*").alias("n"), F.sum("y").alias("pos")).first()

    single = rows.dropDuplicates(["y", "copy"])
    n = sizes(single)
    if not n.n or min(n.pos, n.n - n.pos) < MIN_DOCS:
        single, n = rows, sizes(rows)
    rows = single
    if not n.n or not n.pos or n.pos == n.n:
        return Lexicon({}, {})
    base = n.pos / n.n
    counts = cut_lineage(rows.select(F.explode("w").alias("term"), "y").groupBy("term").agg(F.count("*").alias("n"), F.sum("y").alias("pos")))
    chars = F.char_length("term")
    begins = counts.select(F.explode(F.transform(F.array(*[F.lit(k) for k in PREFIXES]), lambda k: F.when(chars > k, F.left("term", k)))).alias("term"), "n", "pos")
    begins = begins.where("term is not null").groupBy("term").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"), F.count("*").alias("kinds")).where("kinds > 1")

    def chosen(t: DataFrame) -> DataFrame:
        """Terms whose log-likelihood ratio against the base rate beats what the best of so many candidates reaches by chance."""
        tried = max(1, t.where(f"n >= {MIN_DOCS}").count())
        p = F.col("pos") / F.col("n")
        llr = F.col("pos") * F.log(p / base) + F.when(p < 1, (F.col("n") - F.col("pos")) * F.log((1 - p) / (1 - base))).otherwise(0.0)
        odds = F.log((F.col("pos") + 0.5) / (F.col("n") - F.col("pos") + 0.5) * ((1 - base) / base))
        return t.where(F.col("pos") >= MIN_DOCS).where(p > 0.5).withColumns({"llr": llr, "w": odds}).where(F.col("llr") > math.log(tried) + math.log(100))

    words = {r.term: float(r.w) for r in chosen(counts).select("term", "w").collect()}
    # Beginnings of a single word say no more than the word, and those under a shorter learned one no more than that.
    good = cut_lineage(chosen(begins.drop("kinds")).select("term", "w"))
    heads = F.transform(F.array(*[F.lit(k) for k in PREFIXES]), lambda k: F.when(chars > k, F.left("term", k)))
    nested = good.select("term", F.explode(heads).alias("head")).where("head is not null").join(good.select(F.col("term").alias("head")), "head").select("term").distinct()
    prefixes = {r.term: float(r.w) for r in good.join(nested, "term", "left_anti").collect()}
    return checked(counts, Lexicon(words, prefixes))


def checked(counts: DataFrame, lexicon: Lexicon) -> Lexicon:
    """The lexicon with what its misspellings would catch among the words learned from (term, n, pos): words that stand
    in MIN_DOCS texts, half of them or more not toxic, are words of their own; a kind of edit of short terms or of
    beginnings is refused where half or more of the texts with the other words it catches aren't toxic."""

    def run(batches):
        for b in batches:
            found = []
            for word, n, pos in zip(*(c.to_pylist() for c in b.columns)):
                if word in lexicon.words or any(len(word) > k and word[:k] in lexicon.prefixes for k in PREFIXES) or not lexicon.may_match(word):
                    continue
                for beginning, length, kind in {(m[0], len(m[1]), kind) for m in matches(lexicon.trie, word) for kind in m[2] or ("",)}:
                    found.append({"term": word, "n": n, "pos": int(pos), "beginning": beginning, "length": length, "kind": kind})
            yield pa.RecordBatch.from_pylist(found, pa.schema(
                [("term", pa.string()), ("n", pa.int64()), ("pos", pa.int64()), ("beginning", pa.bool_()), ("length", pa.int64()), ("kind", pa.string())]))

    caught = cut_lineage(counts.select("term", "n", "pos").mapInArrow(run, "term string, n long, pos long, beginning boolean, length long, kind string"))
    own = (F.col("n") >= MIN_DOCS) & (2 * F.col("pos") <= F.col("n"))
    tested = caught.where(~own & (F.col("kind") != "") & (F.col("beginning") | (F.col("length") < MIN_FUZZY)))
    refused = frozenset((r.beginning, r.length, r.kind) for r in
                        tested.groupBy("beginning", "length", "kind").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")).where("2 * pos <= n").collect())
    # The words that a kind still allowed would catch.
    allowed = caught.where(own)
    if refused:
        keys = F.concat_ws(" ", F.col("beginning").cast("int").cast("string"), F.col("length").cast("string"), "kind")
        allowed = allowed.where(~keys.isin([f"{int(b)} {n} {kind}" for b, n, kind in refused]))
    return Lexicon(lexicon.words, lexicon.prefixes, refused, frozenset(r.term for r in allowed.select("term").distinct().collect()))


def crc_mod(col) -> F.Column:
    return F.pmod(F.crc32(F.col(col).cast("string")), F.lit(4))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_hits) per row of ``docs``; learns from rows that aren't held out only."""
    held = F.coalesce(crc_mod("doc_id") == 2, F.lit(False))
    y = labels.where("doc_id is not null and toxic is not null").where(crc_mod("doc_id") != 2).groupBy("doc_id").agg(F.max("toxic").cast("double").alias("y"))
    lexicon = learn_lexicon(docs.select("doc_id", "text").join(y, "doc_id").dropDuplicates(["doc_id"]).select("text", "y"))
    f = cut_lineage(features(docs, lexicon))
    got = f.join(y, "doc_id").dropDuplicates(["doc_id"])
    both = got.agg(F.min("y"), F.max("y")).first()
    if both[0] is None or both[0] == both[1]:
        out = f.withColumn("score", F.lit(0.0))
    else:
        # Scores of texts are probabilities; the penalty keeps weights finite where the classes separate.
        prepare = VectorAssembler(inputCols=FEATURES, outputCol="x")
        model = LogisticRegression(featuresCol="x", labelCol="y", probabilityCol="p", rawPredictionCol="raw", predictionCol="class", regParam=1e-3, maxIter=50).fit(
            prepare.transform(got))
        out = model.transform(prepare.transform(f)).withColumn("score", vector_to_array("p")[1])
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "n_hits")


def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: a score for every document."""
    return score(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
