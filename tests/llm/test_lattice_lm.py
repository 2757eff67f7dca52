import math
import resource
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("tagveil.llm")
from tagveil.llm import lattice_lm as lm
from tagveil.llm import unigram

PRIOR = lm.initial(unigram.DEFAULT_MODEL)
N = len(PRIOR.pieces)
STARTS = {p[1:]: i for i, p in enumerate(PRIOR.pieces) if p[0] == unigram.SPACE and len(p) > 1}
ONS = {p: i for i, p in enumerate(PRIOR.pieces) if p[0] != unigram.SPACE}


def ways(word, at=0):
    """All segmentations of a word, as lists of (weight number, added)."""
    if at == len(word):
        return [[]]
    table, shift = (ONS, N) if at else (STARTS, 0)
    out = []
    for end in range(at + 1, len(word) + 1):
        if word[at:end] in table:
            out += [[(table[word[at:end]] + shift, 0.0), *rest] for rest in ways(word, end)]
    if word[at] not in table:
        out += [[(2 * N + (at > 0), math.log(1 / 256) * len(word[at].encode())), *rest] for rest in ways(word, at + 1)]
    return out


def weight_of(way, weights):
    return math.exp(sum(weights[no] + more for no, more in way))


@pytest.mark.parametrize("word", ["the", "a", "thononwh", "réeux", "漢字x", "\U0001f600z", "x▁the"])
def test_marginal_is_the_sum_over_segmentations(word):
    lattice = PRIOR.lattice
    want = math.log(sum(weight_of(w, lattice.weights[:, 0]) for w in ways(word))) + lattice.stop[0]
    assert lattice.log_probabilities(["zz", word, "a"])[1, 0] == pytest.approx(want, rel=1e-9)
    assert lattice.by_window(word)[0] + lattice.stop[0] == pytest.approx(want, rel=1e-9)


def test_weights_add_up():
    weights, stop = PRIOR.lattice.weights[:, 0], PRIOR.lattice.stop[0]
    assert np.exp(weights[:N]).sum() + math.exp(weights[2 * N]) == pytest.approx(1)
    assert np.exp(weights[N : 2 * N]).sum() + math.exp(weights[2 * N + 1]) + math.exp(stop) == pytest.approx(1)


def expected_by_hand(word):
    """Expected pieces under the existing scores, by enumeration."""
    each = [(w, weight_of(w, PRIOR.lattice.weights[:, 0])) for w in ways(word)]
    total, out = sum(p for _, p in each), defaultdict(float)
    for way, p in each:
        for no, _ in way:
            out[no] += p / total
    return out


def test_expected_pieces_by_enumeration():
    words = ["thin", "ndré", "a"]
    edges = PRIOR.vocabulary.edges(words)
    share = lm.expected(edges, PRIOR.lattice.weights[:, 0])
    for k, word in enumerate(words):
        got = defaultdict(float)
        for no, x in zip(edges.weight[edges.word == k], share[edges.word == k], strict=True):
            got[int(no)] += x
        want = expected_by_hand(word)
        assert {no: pytest.approx(x) for no, x in want.items()} == {no: got[no] for no in want} and sum(got.values()) == pytest.approx(sum(want.values()))


def check(docs, rows):
    out = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in docs}
    counts = Counter()
    tokens = {d: [*(t or "").encode().lower().split(), b""] for d, t in docs}
    for d, _ in docs:
        if not out[d]:
            counts.update(tokens[d])
    n, v = sum(counts.values()), len(counts)
    assert len(rows) == len(docs)
    for r in rows:
        own = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[r.doc_id], len(own), sum(w in counts for w in own), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own))
        assert r.score < 0 and math.isfinite(r.score)
    return counts, n, v, tokens


def test_a_small_corpus_by_hand(spark):
    """Every number of the model by enumeration and plain counting."""
    made = [(1, "the thin cat, the cat", "en"), (2, "le chat", "fr"), (3, "Le le thin", "fr"), (5, "the ox", "en"), (6, "cat zq", None), (8, "", "en"), (14, "the thin le zyx", "en"), (15, None, "fr"), (27, "le ndré the", "fr"), (29, "ox", "xx")]
    docs = [(d, t) for d, t, _ in made]
    label = {d: x for d, _, x in made}
    rows = lm.score(spark.createDataFrame(made, "doc_id long, text string, lang string")).collect()
    counts, n, _, tokens = check(docs, rows)
    assert any(r.held_out for r in rows) and not all(r.held_out for r in rows)
    train = [d for d, _ in docs if zlib.crc32(str(d).encode()) % 7 != 2]
    labels = [x for x, _ in Counter(w for d in train for w in [label[d]] * len(tokens[d]) if label[d]).most_common()]
    cls = {d: labels.index(label[d]) + 1 if label[d] in labels else 0 for d, _ in docs}
    parts = {d: [] for d, _ in docs}
    for k in range(len(labels) + 1):
        own = Counter(w for d in train if cls[d] == k for w in tokens[d])
        size, ends = sum(own.values()), sum(cls[d] == k for d in train)
        pieces = np.concatenate([lm.PRIOR * PRIOR.weight, lm.PRIOR * PRIOR.weight, [1.0, 1.0, 1.0]])
        for w, times in own.items():
            for no, x in expected_by_hand(w.decode()).items() if w else ():
                pieces[no] += times * x
            pieces[2 * N + 2] += times if w else 0
        weights, stop = lm.normalised(PRIOR.pieces, pieces)
        share = lambda w: (own[w] + lm.SHARED_TOKENS * counts[w] / n) / (size + lm.SHARED_TOKENS)  # noqa: B023, E731
        for d, _ in docs:
            total = math.log10((ends + 1) / (len(train) + 1 + len(labels)))
            for w in tokens[d]:
                p = share(b"")
                if w:
                    p = (1 - lm.SHARE) * share(w) + lm.SHARE * (1 - share(b"")) * sum(weight_of(x, weights) for x in ways(w.decode())) * math.exp(stop)
                total += math.log10(p)
            parts[d].append(total)
    for r in rows:
        assert r.score == pytest.approx(math.log10(sum(10**x for x in parts[r.doc_id])), rel=1e-6), r.doc_id


def test_lang_is_no_input_of_a_score(spark):
    """One text under any label, known, unknown or none, has one score; held-out labels move nothing at all."""
    base = [(i, f"the cat {i % 7} sat", "en") if i % 2 else (i, f"le chat {i % 5} dort", "fr") for i in range(1, 80)]
    held = [i for i in range(100, 400) if zlib.crc32(str(i).encode()) % 7 == 2][:5]
    made = [(*r, 0) for r in base] + [(i, "the chat sat zq", x, 0) for i, x in zip(held, ("en", "fr", "de", None, "xx"), strict=True)]
    schema = "doc_id long, text string, lang string, lp int"
    rows = {r.doc_id: r.score for r in lm.score(spark.createDataFrame(made, schema)).collect()}
    assert len({rows[i] for i in held}) == 1
    other = [(i, t, "en" if i in held else x, z) for i, t, x, z in made]
    assert {r.doc_id: r.score for r in lm.score(spark.createDataFrame(other, schema)).collect()} == pytest.approx(rows, rel=1e-9)


def test_whole_corpus_loses_nothing_to_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = lm.score(docs).collect()
    check([(r.doc_id, r.text) for r in docs.collect()], rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "The the THE cat"), (4, "z" * 100_000), (5, "ünï   x"), (6, "cat " * 50_000)]
    frame = spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, block int")
    check(docs, lm.score(frame).collect())
    twice = lm.score(frame.union(frame)).collect()
    assert len(twice) == 12 and len(set(twice)) == 6
    assert lm.score(spark.createDataFrame([(None, "a b", 0)], frame.schema)).first().held_out is False
    assert lm.score(frame.where("false")).count() == 0
    only_held = frame.where("doc_id in (" + ",".join(str(i) for i in range(400) if zlib.crc32(str(i).encode()) % 7 == 2) + ")")
    assert all(math.isfinite(r.score) for r in lm.score(only_held).collect())
    many = spark.createDataFrame([(i, f"w{i} a", f"l{i:03}") for i in range(60)], "doc_id long, text string, lang string")
    assert lm.score(many).count() == 60


def test_a_very_long_word_takes_little_memory():
    lattice = PRIOR.lattice
    word = "thononwhé" * 30
    assert lattice.by_window(word)[0] == pytest.approx(lm.forward(PRIOR.vocabulary.edges([word]), lattice.weights)[-1, 0], rel=1e-9)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert math.isfinite(lattice.log_probabilities(["onthe" * 200_000])[0, 0])
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200 << 10
