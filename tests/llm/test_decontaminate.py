import hashlib
import re

import pytest

from tagveil.llm import decontaminate as D

DOCS = "doc_id long, text string, items int, _row string, spans string"
TEN = "Alpha beta gamma delta epsilon zeta eta theta iota kappa"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def windows_of(items):
    windows = {}
    for item, said in items:
        own = words(said)
        for i in range(max(1, len(own) - 9) if own else 0):
            windows.setdefault(tuple(own[i : i + 10]), set()).add("" if item is None else str(item))
    return windows


def brute(text, windows):
    doc = words(text)
    hit, owners = set(), set()
    for n in {len(w) for w in windows}:
        for j in range(len(doc) - n + 1):
            of = windows.get(tuple(doc[j : j + n]))
            if of:
                hit.update(range(j, j + n))
                owners |= of
    return len(doc), len(hit), len(owners), hashlib.sha256(",".join(sorted(owners)).encode()).hexdigest(), bool(hit)


ITEMS = [
    (1, TEN + " lambda mu"), (2, "two words"), (10, "Two, WORDS!"), (None, "no id here"), (3, None), (4, "... !!"), (5, "één ÉÉN 漢字 \x85nel 𝔘"),
    (2, "another text of the same item " + TEN), (7, "a a a"), (8, " ".join(f"w{i}" for i in range(9000))), (7, "a a a"),
]
TEXTS = [
    None, "", "...", "two words", "TWO-words two, words", "xtwo words", "two wordsx two\nwords", f"x {TEN}. y", f"x {TEN} lambda y", " ".join(TEN.split()[:9]), "no id here! no id  here", "één ÉÉN 漢字 \x85nel 𝔘 𝔘", "één één 漢字 \x85nel 𝔘",
    "a a a a b a a", " ".join(f"w{i}" for i in range(4050, 4200)) + " tail", "é" * 50 + " two words " + "漢" * 9,
    "filler text " * 60_000 + "two words " + "filler text " * 60_000, "of the same item alpha beta gamma delta epsilon zeta",
]


@pytest.fixture(params=[1 << 20, 3000])
def nodes(request, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_NODES", request.param)


def test_odd_rows(spark, nodes):
    rows = [(i if i % 3 else None, t, 1, "x", None) for i, t in enumerate(TEXTS)] + [(1, TEXTS[4], 2, None, None)] * 2
    docs, items = spark.createDataFrame(rows, DOCS), spark.createDataFrame(ITEMS, "item_id long, text string")
    known = windows_of(ITEMS)
    got = D.contamination(docs, items).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((doc_id, *brute(text, known))) for doc_id, text, *_ in rows)
    left = D.kept(docs, items)
    assert left.columns == docs.columns and sorted(map(str, left.collect())) == sorted(str(r) for r in docs.collect() if not brute(r.text, known)[4])


def test_spans_are_places_of_the_original(spark):
    docs = spark.createDataFrame([(i, t, 1, "x", None) for i, t in enumerate(TEXTS)], DOCS)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for row in D.found(docs, items, ["text"]).collect():
        said = [w for s in row.spans for w in words((row._row.text or "")[s.start : s.end])]
        assert len(said) == row.n_hit
        assert all(not re.match(r"[\x00-\x2F]", row._row.text[s.start]) for s in row.spans)
    clean = {r.doc_id: r.text for r in D.cleaned(docs, items).collect()}
    assert clean[4] == ""
    assert clean[7] == "x . y" and clean[6] == "two wordsx " and clean[0] is None and clean[15] == "é" * 50 + "  " + "漢" * 9


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "two words")], "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert D.contamination(docs.limit(0), items).collect() == []
    [row] = D.contamination(docs, items.limit(0)).collect()
    assert (row.n_words, row.n_hit, row.contaminated) == (2, 0, False)
    assert D.kept(docs, items).count() == 0


def test_whole_tables_by_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    known = windows_of(items.select("item_id", "text").collect())
    got = D.contamination(docs, items).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((r.doc_id, *brute(r.text, known))) for r in docs.collect())
