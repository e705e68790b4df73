import random
import re
from itertools import permutations

from leadlane.llm import filter_audit as A
from tests.conftest import SMOKE


def brute(docs, labels):
    """Applies each order to each part's documents, one filter after the other."""
    good, toxic = ({i for i, q, t in labels if i is not None and (q, t)[k] == 1} for k in (0, 1))
    least = {}
    for i, _, t in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))

    def fails(i, t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        return {f for f, x in zip("ABCDE", (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t)),
                                            i is not None and i > least[t])) if x}

    parts = {}
    for i, s, t in docs:
        parts.setdefault(s or "", []).append((i, fails(i, t or "")))
    out = {}
    for part, rows in parts.items():
        total = dict.fromkeys("ABCDE", 0)
        for o in permutations("ABCDE"):
            left = rows
            for s, f in enumerate(o, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                total[f] += len(gone)
                out[part, "".join(o), s] = [len(left), len(gone), sum(f in x[1] for x in rows) - len(gone), sum(x[1] == {f} for x in rows),
                                            sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone)]
        for o in permutations("ABCDE"):
            for s, f in enumerate(o, 1):
                out[part, "".join(o), s].append(total[f])
    return out


def check(spark, docs, labels):
    got = A.audit(A.mask_counts(docs, labels)).collect()
    found = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in got}
    assert len(found) == len(got)
    want = brute([(r.doc_id, r.source, r.text) for r in docs.collect()], [(r.doc_id, r.quality, r.toxic) for r in labels.collect()])
    assert found == want


def test_given_documents(spark):
    check(spark, spark.read.parquet(f"{SMOKE}/documents.parquet"), spark.read.parquet(f"{SMOKE}/labels.parquet"))


def test_planted_failures_and_a_hot_text(spark):
    rng = random.Random(5)
    text = lambda: " ".join(rng.choice(["w", "W", "é", "x#", "long"]) + str(rng.randrange(rng.choice([4, 400]))) for _ in range(rng.choice([3, 49, 50, 51, 90])))
    texts = [text() for _ in range(60)]
    rows = [(i, rng.choice(["a", "b", "", None]), rng.choice(texts)) for i in range(300)] + [(1000 + i, "a", "the same") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    labels = spark.createDataFrame([(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 1300, 3)], "doc_id long, quality int, toxic int")
    check(spark, docs, labels)


def test_odd_rows_and_empty(spark, odd_docs):
    more = spark.createDataFrame([(None, "s", "a"), (None, None, "a"), (3, "z", "a"), (2, "s", "A" * 60 + " 漢字 " * 60), (9, "s", None), (10, "s", "")], "doc_id long, source string, text string")
    docs = odd_docs.unionByName(more, allowMissingColumns=True)
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 1), (None, 1, 1), (10, None, None), (9, 1, 1)], "doc_id long, quality int, toxic int")
    check(spark, docs, labels)
    check(spark, docs, labels.limit(0))
    assert A.audit(A.mask_counts(docs.limit(0), labels)).count() == 0


def test_ranks_are_the_first_failing_step():
    orders, at, rank = A.ranks("ABC")
    for m in range(8):
        for o, order in enumerate(orders):
            assert rank[m, o] == min([k + 1 for k, f in enumerate(order) if m >> "ABC".index(f) & 1], default=4)
    assert [["ABC"[i] for i in x] for x in at] == [list(o) for o in orders]
