import hashlib
import random
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("tagveil.llm")
from tagveil.llm import fuzzy_digest as fd


def slow_levels(text, window=fd.WINDOW):
    out = []
    for i in range(len(text) - window + 1):
        counts = Counter(text[i : i + window])
        out.append(sum(int(fd._TERM[window][c]) for c in counts.values()) * fd.LEVELS // fd._FULL[window])
    return out


def slow_features(text):
    out = []
    scales = [(fd.WINDOW, fd.RUN, fd.LEAST_RUNS)] * (len(text) >= fd.WINDOW) + [(fd.SHORT_WINDOW, fd.SHORT_RUN, fd.SHORT_LEAST_RUNS)] * (len(text) < fd.SHORT)
    for window, run, least in scales:
        rank = fd.ranks(np.array(slow_levels(text, window)), window).tolist()
        wins = Counter(min(range(i, i + run), key=lambda j: (rank[j], j)) for i in range(len(rank) - run + 1))
        at = sorted(j for j, n in wins.items() if n >= least and rank[j] <= fd.LEVELS) or [rank.index(min(rank))]
        out += fd.hash_windows(np.frombuffer(text, np.uint8), np.array(at), window).tolist()
    return list(dict.fromkeys(out))


def test_levels_and_features_equal_counting():
    rng = random.Random(1)
    for n, letters in ((64, 3), (65, 2), (130, 256), (500, 20), (700, 1), (8, 2), (40, 5), (511, 4), (512, 4)):
        text = bytes(rng.randrange(letters) for _ in range(n))
        if n >= fd.WINDOW:
            assert fd.entropies(np.frombuffer(text, np.uint8)).tolist() == slow_levels(text)
        assert fd.features(text).tolist() == slow_features(text)


def test_short_texts_are_like_their_edited_ones_only():
    """A text of 40 to 600 bytes keeps some likeness when a quarter changes, also across the length from which smaller windows no longer count."""
    docs = [t for n in (40, 70, 100, 126, 300, 500, 520, 600) for t in (lorem(n, n), lorem(n, 1000 + n))]
    for text, other in zip(docs[::2], docs[1::2], strict=True):
        own, changed, far = (fd.Digest(t.encode()) for t in (text, fd.edited(text, other), other))
        assert own.n > 1 and 0.3 < own.likeness(changed) < 1 and own.likeness(far) < 0.2
    longer = fd.Digest((lorem(505, 505) + " abc def ghi").encode())
    assert fd.Digest(lorem(505, 505).encode()).likeness(longer) > 0.5 and longer.n < 160


def lorem(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9))) for _ in range(n))[:n]


def test_levels_of_a_shared_beginning():
    rng = random.Random(2)
    one = rng.randbytes(400)
    for keep in (0, 10, 63, 64, 65, 300, 400):
        for more in (b"", b"abc", rng.randbytes(90)):
            other = one[:keep] + more
            if len(other) >= 64:
                assert fd.levels_of(other, (keep, fd.levels_of(one))).tolist() == fd.levels_of(other).tolist()


def check(rows, docs):
    order = sorted(docs, key=lambda d: d[0])
    by = {r.doc_id: r for r in rows}
    assert len(by) == len(docs)
    for i, (doc_id, text) in enumerate(order):
        following = order[(i + 1) % len(order)][1]
        r, changed = by[doc_id], fd.edited(text, following)
        one, two, nxt = (fd.Digest(t.encode()) for t in (text, changed, following))
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (str(one), str(two))
        assert (r.near_edited, r.near_next) == (pytest.approx(one.likeness(two)), pytest.approx(one.likeness(nxt)))


@pytest.mark.parametrize("pieces", [1, 3, 50])
def test_whole_corpus(spark, pieces):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = fd.digests(docs, pieces).collect()
    check(rows, [(r.doc_id, r.text) for r in docs.collect()])
    assert np.mean([r.near_edited for r in rows]) > 0.6 and np.mean([r.near_next for r in rows]) < 0.05


def test_odd_rows(spark):
    big = (1 << 60) + 1
    texts = {1: "", 2: "abc", 3: "é" * 70, big: "x y z " * 60_000, big + 1: "x y z " * 59_999, big + 2: "Quick brown foxes " * 3}
    docs = spark.createDataFrame([(k, v or None, 1) for k, v in texts.items()], "doc_id long, text string, piece int")
    check(fd.digests(docs, 4).collect(), list(texts.items()))
    only = fd.digests(docs.where("doc_id = 2")).first()
    assert only.near_next == 1.0 and only.n_chars == 3
    more = docs.union(docs).union(spark.createDataFrame([(None, "a b c", 1)] * 2, docs.schema))
    rows = fd.digests(more, 5).collect()
    assert len(rows) == 14 and len({(r.doc_id, r.fingerprint) for r in rows}) == 7
    assert fd.digests(docs.where("false")).count() == 0


@pytest.mark.parametrize("pieces", [1, 4, 9])
def test_rows_without_an_id_are_spread_and_follow_each_other_by_hash(spark, pieces):
    texts = [lorem(90 + i, i) for i in range(40)] + ["", "a b c", "a b c"]
    docs = spark.createDataFrame([(None, t) for t in texts] + [(i, lorem(80, 500 + i)) for i in (5, 9, 1 << 60)], "doc_id long, text string")
    ordered = [(r.doc_id, r.text) for r in docs.selectExpr("*", "xxhash64(text) as h").orderBy("doc_id", "h", "text").collect()]
    rows = Counter((r.doc_id, r.fingerprint, r.edited_sha256, round(r.near_next, 9)) for r in fd.digests(docs, pieces).collect())
    want = Counter()
    for i, (doc_id, text) in enumerate(ordered):
        following = ordered[(i + 1) % len(ordered)][1]
        own = fd.Digest(text.encode())
        want[doc_id, str(own), hashlib.sha256(fd.edited(text, following).encode()).hexdigest(), round(own.likeness(fd.Digest(following.encode())), 9)] += 1
    assert rows == want
