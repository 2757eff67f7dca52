"""What a reviewer found in round 4; each test failed before its finding was mended."""

import re

import pytest
from pyspark.sql import functions as F

from tagveil.functions import text as T
from tagveil.operators import detect, matching, redact, restore


def terms(spark, n):
    return spark.range(n).selectExpr("'Name ' || id as term", "'[[N_' || id || ']]' as tag", "id as ord")


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_f3_rules_are_made_without_sending_any_over_the_driver(spark):
    entries = terms(spark, 200)
    rules = restore.restore_rules(entries.selectExpr("tag", "term as value", "ord"))
    for made in (matching.term_rules(entries), rules):
        assert "SortMergeJoin" in executed(made) and "Broadcast" not in executed(made)
    assert sorted((r.label, r.source, r.anchor) for r in rules.collect()) == sorted((f"[[N_{i}]]", s, f"{i}") for i in range(200) for s in ("exact", "mangled"))


def test_f3_many_rules_meet_texts_where_they_lie(spark, monkeypatch):
    monkeypatch.setattr(matching, "MOST_SENT", 100)
    docs = spark.createDataFrame([(i, f"To Name {i} and name {i + 1}") for i in range(0, 300, 10)], "doc_id long, text string")
    for n, sent in ((90, True), (300, False)):
        found = redact.redact(docs, terms(spark, n))
        assert ("BroadcastHashJoin" in executed(found)) == sent
    assert {r.doc_id: r.redacted_text for r in found.collect()} == {i: f"To [[N_{i}]] and [[N_{i + 1}]]" for i in range(0, 300, 10)}


def test_f4_what_is_not_asked_for_is_not_made(spark):
    docs = spark.createDataFrame([(1, "Write to a@b.example.com, call 201-555-0100, then a@b.example.com"), (2, None), (3, "")], "doc_id long, text string")
    found = detect.analyze(docs, terms(spark, 3), names=lambda seen: seen.selectExpr("doc_id", "0 as s", "5 as e", "'PERSON' as label").where("length(text) > 5"))
    made = found.select("doc_id", "term", "n")._jdf.queryExecution().optimizedPlan().toString()
    assert T.ELLIPSIS not in made and "array_sort(" not in made
    text = docs.first().text

    def around(s, e):
        return ("…" if s > 40 else "") + text[max(0, s - 40) : e + 40] + ("…" if e + 40 < len(text) else "")

    want = {v: [around(m.start(), m.end()) for m in re.finditer(re.escape(v), text)] for v in ("a@b.example.com", "201-555-0100", "Write")}
    assert {r.term: (r.n, list(r.contexts)) for r in found.collect()} == {v: (len(c), c) for v, c in want.items()}


@pytest.mark.parametrize("most", [0, 50])
def test_f4_words_of_few_beginnings_are_searched_for(spark, monkeypatch, most):
    monkeypatch.setattr(matching, "MOST_TRIED", most)
    rules = matching.term_rules(spark.range(90).selectExpr("'Customer#' || lpad(id, 9, '0') as term", "'[[C_' || id || ']]' as tag", "id as ord").unionByName(spark.sql("select 'Kay' as term, '[[K]]' as tag, 100L as ord")))
    texts = ["Customer#000000007 x000000008 000000009x 0000000010 é000000011é 000000012é", "KAY kays Kay's k 000000013,000000013", "", "none", "Kİay Kay"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    both = rows.select(F.array_sort(matching._likely_in(F.col("text"), {matching.BY_RUN}, rules)).alias("a"), F.array_sort(matching._likely(matching.anchors_in(F.col("text"), {matching.BY_RUN}), rules)).alias("b"))
    assert all(r.a == r.b for r in both.collect()) and both.collect()[0].a == ["000000007", "000000011", "000000012"]
    made = both.select("a")._jdf.queryExecution().optimizedPlan().toString()
    assert ("filter(" in made) == (most == 0)
