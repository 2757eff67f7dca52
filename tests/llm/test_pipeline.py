from collections import Counter

import numpy as np
import pytest
from test_jaccard import plain_roots, plain_set

pytest.importorskip("tagveil.llm")
import corpus_pipeline
from tagveil.llm import jaccard, langid, mixing, packing, quality

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, docs, SF)
        after.write.parquet(f"{folder}/{k}")
        after = spark.read.parquet(f"{folder}/{k}")
        out.append((docs, after))
        docs = after
    return out


def test_columns_and_decisions(spark, stages):
    for before, after in stages[:-1]:
        assert before.columns == after.columns and before.dtypes == after.dtypes
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in stages[0][1].collect()}
    clean = [d for d, r in labels.items() if r.quality == 1 and r.toxic == 0]
    foul = [d for d, r in labels.items() if r.quality == 0 or r.toxic == 1]
    assert np.mean([d in kept for d in clean]) > 0.98 and np.mean([d in kept for d in foul]) < 0.15
    before, after = ({r.doc_id: r for r in x.collect()} for x in stages[1])
    assert len(after) > 0.98 * len(before)


def test_dedup_by_brute_force(stages):
    before, after = (x.collect() for x in stages[2])
    rows = sorted(before, key=lambda r: r.doc_id)
    roots, _ = plain_roots([plain_set(r.text) for r in rows])
    assert {r.doc_id for r in after} == {rows[i].doc_id for i in set(roots)} and len(after) < len(before)


def test_mix_and_packing(stages):
    before, after = stages[3]
    copies = {r.doc_id: r.copies for r in mixing.mix(before).collect() if r.copies}
    assert Counter(r.doc_id for r in after.collect()) == copies
    before, pieces = stages[4]
    assert sum(r.length for r in pieces.collect()) == sum(r.doc_tokens for r in packing.pack(before).where("start = 0").collect())


def test_run_and_entry(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, stages[4][1].collect()))


def test_stages_on_odd_rows(spark):
    rows = [(1, None, None, None, 0), (2, "", "en", "a", 0), (None, "the plain words of a text", "en", None, 5), *[(3, "it is the same text again and again here", "en", "a", 9)] * 20]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, _found string")
    labels = spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int")
    for got in (quality.kept(docs, labels), langid.kept(docs), jaccard.kept(docs, 5), mixing.mixed_rows(docs)):
        assert got.columns == docs.columns
        got.collect()
    once = jaccard.kept(docs, 5).collect()
    assert Counter(r.doc_id for r in once) == {1: 1, 3: 1, None: 1}
    assert {r.doc_id for r in langid.kept(docs).collect()} == {3, None}
    empty = docs.where("false")
    for got in (quality.kept(empty, labels), langid.kept(empty), jaccard.kept(empty, 5), mixing.mixed_rows(empty), packing.pack(empty)):
        assert got.count() == 0


def test_dedup_on_odd_rows(spark):
    """Null ids, repeated rows, equal ids with other texts, a very long text and names of columns like ours."""
    base = [f"w{i}" for i in range(60_000)]
    near = [*base[:30_000], "x", *base[30_001:]]
    texts = [" ".join(base), " ".join(near), "one two three four five six", "ONE  two three four\nfive six", None, "", " ", "other words stand here in a row"]
    rows = [(i if i % 4 else None, t) for i, t in enumerate(texts)] + [(5, "")] * 3 + [(None, "other words stand here in a row"), (5, "six more words that nobody else has")]
    docs = spark.createDataFrame([(d, t, 1, "x", 2, None) for d, t in rows], "doc_id long, text string, sid int, root string, n int, text_hash long")
    got = jaccard.kept(docs, 5)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id is None, r.doc_id or 0, (r.text or "")[:12])) for r in got.collect()) == [(False, 1, "w0 w1 w2 w3 "), (False, 2, "one two thre"), (False, 5, ""), (False, 5, "six more wor"), (False, 7, "other words ")]
    assert jaccard.kept(docs.where("false"), 5).count() == 0
