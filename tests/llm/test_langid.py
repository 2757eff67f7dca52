import zlib

import numpy as np
import pytest

pytest.importorskip("tagveil.llm")
from tagveil.llm import langid


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    rows = langid.identify(docs).collect()
    assert {r.doc_id for r in rows} == set(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 100 and np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_equals_naive_bayes_by_hand():
    texts, labels = [b"ab ba", b"cd", b"dc cd"], ["x", "y", "y"]
    counts = {}
    for t, x in zip(texts, labels, strict=True):
        counts.setdefault(x, np.zeros(langid.BUCKETS))
        np.add.at(counts[x], langid.grams([t])[0], 1)
    model = langid.Model(["x", "y"], np.log([1 / 3, 2 / 3]), np.stack([np.log((c + 0.5) / (c.sum() + 0.5 * langid.BUCKETS)) for c in (counts["x"], counts["y"])]))
    many = model.score([b"cd ab", b"dcd", b"", b"1 2", b"ab"])
    for t, lang, score in zip([b"cd ab", b"dcd", b"ab"], [many[0][i] for i in (0, 1, 4)], many[1][[0, 1, 4]], strict=True):
        total = [p + sum(model.log_prob[i][b] for b in langid.grams([t])[0]) for i, p in enumerate(model.log_prior)]
        assert lang == model.langs[int(np.argmax(total))]
        assert score == pytest.approx(1 / (1 + np.exp(min(total) - max(total))))
    assert many[0][2:4] == ["und", "und"]


def test_odd_rows(spark):
    rows = [(1, "le chat est là", "fr", 0.1), (2, "the cat is here", "en", 0.2), (3, None, "en", 0.3), (4, "", None, 0.0), (5, "123 ! \u0301", "fr", 0.0), (None, "the cat", "en", 0.0), (6, "the " * 300_000, None, 0.0), (6, "the " * 300_000, None, 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    got = langid.identify(docs).collect()
    assert len(got) == 8
    by = {r.doc_id: r for r in got}
    assert [by[k].lang_pred for k in (3, 4, 5)] == ["und"] * 3 and by[6].lang_pred == "en"
    assert langid.identify(docs.where("false")).count() == 0
    assert {r.lang_pred for r in langid.identify(docs.where("lang is null")).collect()} == {"und"}


def test_trained_table_and_predictions_by_dictionary(spark):
    """n-grams, counts and posteriors of the whole query by plain loops over characters."""
    import math
    import unicodedata
    import zlib
    from collections import Counter, defaultdict

    from tagveil.llm import registry

    sf = "/root/testdata/sf0.001"

    def buckets(text):
        out, shown = [], ""
        for c in text.lower():
            c = c if unicodedata.category(c)[0] in "LM" else " "
            shown += "" if c == " " and shown[-1:] == " " else c
        shown += "" if shown[-1:] == " " else " "
        for order in (1, 2, 3):
            for i in range(len(shown) - order + 1):
                h = order
                for k in range(order):
                    h = ((h ^ ord(shown[i + k])) * (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)[k]) & 0xFFFFFFFF
                    h ^= h >> 15
                out.append(h % langid.BUCKETS)
        return out

    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    counts, n_docs = defaultdict(Counter), Counter()
    for r in docs:
        if zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and r.text is not None and r.lang is not None:
            counts[r.lang].update(buckets(r.text))
            n_docs[r.lang] += 1
    rows = {r.doc_id: r for r in registry.QUERIES["op9_naive_bayes_langid"](spark, sf).collect()}
    assert set(rows) == {r.doc_id for r in docs}
    size = {k: sum(c.values()) for k, c in counts.items()}
    for r in docs[:60]:
        sums = {k: math.log(n_docs[k] / sum(n_docs.values())) + sum(math.log((c[b] + 0.5) / (size[k] + 0.5 * langid.BUCKETS)) for b in buckets(r.text)) for k, c in counts.items()}
        best = max(sorted(sums), key=sums.get)
        want = 1 / sum(math.exp(s - sums[best]) for s in sums.values())
        assert rows[r.doc_id].lang_pred == best and rows[r.doc_id].score == pytest.approx(want, abs=1e-6)


def test_many_languages_have_fewer_buckets(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_CELLS", 1 << 14)
    docs = spark.createDataFrame([(i, f"{'abcdefghij'[i % 8]}{'abcdefghij'[i % 8 + 1]} " * 5, f"l{i % 8}") for i in range(80)], "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert model.log_prob.shape == (8, 1 << 11) and model.score([b"ab ab ab"])[0] == ["l0"]
