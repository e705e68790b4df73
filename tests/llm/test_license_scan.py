import re

import pytest

from leadlane.llm import license_scan as L
from tests.conftest import SMOKE

MIT = f"""Copyright (c) 2020 Somebody

{L.SENTENCES['mit_grant'][0]}:

{L.SENTENCES['mit_notice'][0]}.

{L.SENTENCES['as_is'][0]}."""


def wrap(text, n):
    out = ""
    for w in text.split(" "):
        out += ("\n" if len(out) - out.rfind("\n") + len(w) > n else " ") * bool(out) + w
    return out


CASES = [
    (None, []), ("", []), (" \n ", []), ("no licence here. Nothing.", []),
    ("some words\nLicensed under the Apache License, Version 2.0.", ["Apache-2.0"]),
    ("a | table\nReleased under the MIT License.\nmore", ["MIT"]), ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0"]),
    ("licensed under the GNU General Public License version 2 or later!", ["GPL-2.0-or-later"]), ("Licensed under CC BY-NC 4.0. All rights reserved.", ["CC-BY-NC-4.0", "All-Rights-Reserved"]),
    ("# SPDX-License-Identifier: BSD-3-Clause\nx = 1", ["BSD-3-Clause"]), (MIT, ["MIT"]), (wrap(MIT, 60), ["MIT"]), (wrap(MIT.lower(), 30), ["MIT"]),
    ("\n * ".join([L.SENTENCES[k][0] + "." for k in ("bsd_intro", "bsd_source", "bsd_binary")]), ["BSD-2-Clause"]),
    ("\n * ".join([L.SENTENCES[k][0] + "." for k in ("bsd_intro", "bsd_source", "bsd_binary", "bsd_endorse")]), ["BSD-3-Clause"]),
    ("Some people say all rights reserved means nothing.", []), ("unlicensed under the MIT License", []),
    ("Released under the MIT License. Released under the MIT License.", ["MIT"]), ("word " * 200000, []),
]


def test_cases(spark):
    df = spark.createDataFrame([(i, t, 1, "x") for i, (t, _) in enumerate(CASES)], "doc_id long, text string, licenses int, lines string")
    got = {r.doc_id: r.licenses for r in L.scan(df).collect()}
    assert got == {i: want for i, (_, want) in enumerate(CASES)}
    assert L.scan(df.limit(0)).count() == 0


def brute(text, by_line):
    known = L.known_sentences()
    out = []
    for para in re.split(r"\n[^a-zA-Z0-9]*\n", text or "") if not by_line else (text or "").split("\n"):
        out += [known[s] for x in re.split(r"[.!?]+(?=\s|$)|:+(?=\s*(?:\n|$))", para) if (s := L.plain(x)) in known]
    return out


def test_given_documents(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMOKE}/documents.parquet").collect()}
    out = L.license_scan(spark, SMOKE).collect()
    assert len(out) == len(docs) and any(r.n_licenses for r in out)
    for r in out:
        ids = max(brute(docs[r.doc_id], False), brute(docs[r.doc_id], True), key=len)
        assert r.sentence_ids == ",".join(ids)
        # In these texts each notice is one sentence.
        found = {x.removeprefix("grant:").replace("reserved", "All-Rights-Reserved") for x in ids + brute(docs[r.doc_id], True)}
        assert set(r.licenses.split(",")) - {""} == found
        assert (r.license_class is None) == (not found)


def test_the_plan_is_native(spark):
    plan = L.license_scan(spark, SMOKE)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)


@pytest.mark.parametrize("rule, licence", L.RULES)
def test_every_rule_can_fire(rule, licence):
    assert all(p.rstrip("?") in set(L.known_sentences().values()) for p in rule)
