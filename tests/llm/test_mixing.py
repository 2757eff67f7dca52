import re
from collections import defaultdict

import pytest

pytest.importorskip("tagveil.llm")
from pyspark.sql import functions as F

from tagveil.llm import mixing


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        share = sum(weight[s] for s in names if s not in capped)
        now = {s: 3 * sizes[s] if s in capped else left * weight[s] / share for s in names}
        over = {s for s in names if s not in capped and now[s] > 3 * sizes[s]}
        if not over:
            return now
        capped |= over


def check(docs, rows):
    """All but the random numbers is done again in plain Python, with those of the operator."""
    sizes, of = defaultdict(int), defaultdict(list)
    for d in docs:
        n = len(re.findall(rb"[^\x20\x09-\x0d]+", (d.text or "").encode()))
        sizes[d.source] += n
    want = plain_targets(sizes) if sizes else {}
    source = {d.doc_id: d.source for d in docs}
    for r in rows:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s], rel=1e-9, abs=1e-6)
        assert r.taken == r.copies * r.size <= 3 * r.size
        of[s].append(r)
    for s, own in of.items():
        whole = int(want[s] / sizes[s] + 1e-9) if sizes[s] else 0
        assert {r.copies - whole for r in own} <= {0, 1}
        most = max(r.size for r in own)
        assert abs(sum(r.taken for r in own) - want[s]) <= max(1, most / 2)
    return of


def test_whole_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mix(docs).collect()
    of = check(docs.collect(), rows)
    assert len(rows) == 1000 and sorted(rows) == sorted(mixing.mix(docs.repartition(5)).collect())
    u = {r._id: r._u for r in mixing._marked(docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size")), F.col("doc_id"), F.col("source"), F.col("size")).collect()}
    for own in of.values():
        whole = min(r.copies for r in own)
        rest = own[0].target - whole * own[0].source_size
        words = sum(r.inclusion * r.size for r in own)
        assert words == pytest.approx(rest, rel=1e-6, abs=1e-6)
        order = sorted((0.0 if r.inclusion >= 1 else u[r.doc_id] / (1 - u[r.doc_id]) / (r.inclusion / (1 - r.inclusion)), u[r.doc_id], r) for r in own if r.inclusion > 0)
        front, total = [], 0
        for *_, r in order:
            if total + r.size > rest:
                break
            total += r.size
            front.append(r.doc_id)
        extra = {r.doc_id for r in own if r.copies > whole}
        at = len(front)
        behind = [r.doc_id for *_, r in order[at:] if r.size]
        assert set(front[: at - mixing.FRONT]) <= extra and len(extra - set(front) - set(behind[: mixing.OPEN])) <= 1
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(1, mixing.NEAR * own[0].target)


def test_small_sources_meet_their_targets(spark):
    """Ten documents a source: within two in a hundred, and no subset of those around the cut is nearer."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    of = check(docs.collect(), mixing.mix(docs).collect())
    assert len(of) > 5 and all(abs(sum(r.taken for r in own) / own[0].target - 1) <= 0.02 for own in of.values())
    made = spark.createDataFrame([(i, "w " * n, s) for i, (n, s) in enumerate([(150, "a"), (243, "a"), (261, "a"), (189, "a"), (453, "a"), (141, "a"), (2000, "a"), (1000, "b"), (10, "c"), (10, "c")])], "doc_id long, text string, source string")
    rows = [r for r in mixing.mix(made).collect() if r.doc_id < 7]
    whole = int(rows[0].target / rows[0].source_size)
    rest, free = rows[0].target - whole * rows[0].source_size, [r for r in rows if 0 < r.inclusion < 1]
    fixed = sum(r.size for r in rows if r.inclusion >= 1)
    best = min(abs(fixed + sum(r.size for k, r in enumerate(free) if chosen >> k & 1) - rest) for chosen in range(1 << len(free)))
    assert abs(sum(r.taken for r in rows) - rows[0].target) <= best + mixing.NEAR * rows[0].target


def test_sources_of_any_balance(spark):
    rows = [(i, "w " * (i % 50), s) for s, r in (("a", range(600)), ("b", range(600, 640)), ("\u00e9", range(640, 1000)), (None, range(1000, 1003))) for i in r]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    check(docs.collect(), mixing.mix(docs).collect())
    alone = docs.where("source = 'a'")
    assert {r.copies for r in mixing.mix(alone).collect()} == {1}


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (None, "x y", "a"), (3, "one two", None), *[(4, "same words here", "b")] * 300, *[(5, "n " * 7, "c")] * 40]
    docs = spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id long, text string, source string, size int, _in int")
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows) and {r.size for r in out if r.doc_id in (1, 2)} == {0}
    taken = sum(r.taken for r in out if r.doc_id == 4)
    target = next(r.target for r in out if r.doc_id == 4)
    assert abs(taken - target) <= 3
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns
    assert mixed.groupBy("doc_id").count().where("doc_id = 4").first()["count"] * 3 == taken
    assert mixing.mix(docs.where("false")).count() == mixing.mixed_rows(docs.where("false")).count() == 0


def test_mixed_rows_are_the_copies(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    copies = {r.doc_id: r.copies for r in mixing.mix(docs).collect() if r.copies}
    got = {r.doc_id: r["count"] for r in mixing.mixed_rows(docs).groupBy("doc_id").count().collect()}
    assert got == copies
