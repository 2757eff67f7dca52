import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("tagveil.llm")
import corpus_pipeline
from tagveil.llm import jaccard


def plain_set(text, k=5):
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def plain_roots(sets):
    """Components of all pairs with Jaccard >= 0.8, by an inverted index over every shingle."""
    root, holders = list(range(len(sets))), defaultdict(list)

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    pairs = []
    for i, own in enumerate(sets):
        shared = Counter(j for s in own for j in holders[s]) if own else Counter({j: 0 for j in range(i) if not sets[j]})
        for j, n in shared.items():
            if 5 * n >= 4 * (len(own) + len(sets[j]) - n):
                pairs.append((i, j))
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for s in own:
            holders[s].append(i)
    return [find(i) for i in range(len(sets))], pairs


def kept_ids(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect())


def test_edited_texts_by_brute_force(spark):
    rng = random.Random(5)
    texts = [None, "", "one two", "One  two", "a b c d e"]
    for base in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice((30, 120, 400)))]
        texts.append(" ".join(words))
        for edits in range(1, 9):  # one changed word takes five shingles
            other = list(words)
            for at in rng.sample(range(len(words)), edits):
                other[at] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(other))
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [f"{passage} " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(n)) for n in range(1, 40)]
    rng.shuffle(texts)
    sets = [plain_set(t) for t in texts]
    roots, pairs = plain_roots(sets)
    assert sum(sets[i] != sets[j] for i, j in pairs) > 300
    assert kept_ids(spark, texts) == sorted(set(roots))


def test_corpus_by_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    roots, _ = plain_roots([plain_set(t) for _, t in rows])
    got = {r.doc_id for r in jaccard.kept(docs, 5).collect()}
    assert got == {rows[i][0] for i in set(roots)}


def test_hot_keys_in_blocks(spark):
    """Every set meets every other by one key; cut into blocks, the same pairs come out."""
    rng = random.Random(9)
    # sketches that rule nothing out, and (sid 11) one that does
    sketch = lambda sid: jaccard.sketch(np.arange(10, dtype=np.uint64) + np.uint64(100 * (sid == 11)))
    rows = [(key, sid, 10, rng.randrange(3), sid % 7, sketch(sid)) for key, sids in ((1, range(60)), (2, range(40, 100)), (3, [5, 6]), (4, [8])) for sid in sids]
    shared = spark.createDataFrame(rows, "key long, sid long, n int, pos int, root long, sketch binary").repartition(3)
    want = set()
    for key in (1, 2, 3, 4):
        own = [r for r in rows if r[0] == key]
        want |= {(min(a[1], b[1]), max(a[1], b[1])) for a in own for b in own if a[4] != b[4] and 11 not in (a[1], b[1]) and 9 * min(10 - a[3], 10 - b[3]) >= 80}
    for most in (4, 17, 1024):
        got = jaccard.left_pairs(shared, most).collect()
        assert len(got) == len(want) and {(r.a, r.b) for r in got} == want and all((r.root_a, r.root_b) == (r.a % 7, r.b % 7) for r in got)


def test_runs_over_batches():
    keys = np.repeat([3, 4, 7, 9, 10, 12], [1, 5, 1, 11, 2, 1]).astype(np.int64)
    for step in (1, 2, 3, 7, 100):
        batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + step]), pa.array(np.arange(i, min(i + step, len(keys))))], names=["key", "at"]) for i in range(0, len(keys), step)]
        got = [(k, run["at"].tolist()) for k, run in jaccard._runs(iter(batches))]
        assert got == [(k, np.flatnonzero(keys == k).tolist()) for k in (4, 9, 10)]
