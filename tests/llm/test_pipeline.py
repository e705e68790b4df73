import re
from collections import defaultdict

import corpus_pipeline as P
from leadlane.llm import quality_rules as Q
from leadlane.llm.common import words
from leadlane.session import cut_lineage
from tests.conftest import SMOKE

from . import test_line_dedup, test_packing, test_quality_rules, test_simhash, test_suffix_dedup


def spans_out(text, spans):
    at = [m.start() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)] + [len(text)]
    drop = {k for k in spans}
    head = text[:at[0]]
    return head + "".join(text[at[k]:at[k + 1]] for k in range(len(at) - 1) if k not in drop)


def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet")
    kept = {r.doc_id for r in Q.quality_rules(spark, SMOKE).where("kept").collect()}
    rows = {r.doc_id: r.text for r in docs.collect()}
    assert all(test_quality_rules.brute(rows[i])[0] >= 50 for i in kept)
    columns = docs.columns
    for name, stage in P.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = cut_lineage(stage(spark, docs, SMOKE))
        assert docs.columns == columns
        got = {r.doc_id: r.text for r in docs.collect()}
        if name == "quality_rules":
            want = {i: t for i, t in before.items() if i in kept}
        elif name == "line_dedup":
            first = defaultdict(lambda: 1 << 62)
            key = lambda x: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x).translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
            for i, t in before.items():
                for x in t.split("\n"):
                    first[key(x)] = min(first[key(x)], i)
            want = {i: "\n".join(x for x in t.split("\n") if len(key(x)) < 10 or first[key(x)] == i) for i, t in before.items()}
        elif name == "simhash":
            fps = {i: test_simhash.brute_fp(t) for i, t in before.items()}
            label = test_simhash.brute_components(fps.values(), 2)
            least = defaultdict(lambda: 1 << 62)
            for i, f in fps.items():
                least[label[f]] = min(least[label[f]], i)
            want = {i: t for i, t in before.items() if least[label[fps[i]]] == i}
        else:
            shared = test_suffix_dedup.brute(list(before.items()))
            want = {i: spans_out(t, {k for k, f in shared.get(i, ()) if f != i}) if i in shared else t for i, t in before.items()}
            want = {i: t for i, t in want.items() if words(t) or t == before[i]}
        assert got == want, name
    test_packing.check(docs, P.STAGES[-1][1](spark, docs, SMOKE))


def test_run_equals_its_stages_and_odd_tables(spark, odd_docs, tmp_path):
    labels = spark.createDataFrame([(5, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    good = spark.createDataFrame([(i, " ".join(f"w{(k * (i + 3)) % 997}x{k}" for k in range(80))) for i in range(20, 24)], "doc_id long, text string")
    docs = odd_docs.unionByName(good, allowMissingColumns=True)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.doc_id for r in P.run(spark, str(tmp_path)).collect()} == {20, 21, 22, 23}
    docs.limit(0).write.parquet(str(tmp_path / "e/documents.parquet"))
    labels.limit(0).write.parquet(str(tmp_path / "e/labels.parquet"))
    assert P.run(spark, str(tmp_path / "e")).count() == 0
