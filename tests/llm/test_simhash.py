import random

import numpy as np
import pytest
import xxhash

pytest.importorskip("tagveil.llm")
from tagveil.llm import golay, simhash
from tagveil.llm.components import connected_components


def plain_fingerprint(text, k=4):
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum((sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) << b for b in range(64))


def brute_components(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps[:i]) <= 4):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_golay_code_is_perfect():
    words = np.arange(1 << 23, dtype=np.int32)
    assert (np.bincount(golay.decode(words)) == 2048).all()
    keys = golay.near_keys(words[::997])
    assert set((keys >= 0).sum(1)) == {1, 6}


def test_words_two_bits_apart_share_an_index():
    rng = random.Random(1)
    for width in (23, 22, 21):
        for _ in range(2000):
            word = rng.getrandbits(width)
            other = word
            for place in rng.sample(range(width), rng.randint(0, 2)):
                other ^= 1 << place
            a, b = golay.near_keys(np.array([word, other]), width)
            assert set(a[a >= 0]) & set(b[b >= 0])


def test_every_pair_within_four_bits_shares_a_key():
    rng = random.Random(2)
    for _ in range(3000):
        fp = rng.getrandbits(64)
        other = fp
        for place in rng.sample(range(64), rng.randint(0, 4)):
            other ^= 1 << place
        row, key = simhash.compound_keys(np.array([fp, other], np.uint64))
        assert set(key[row == 0]) & set(key[row == 1])


def test_whole_corpus_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = sorted((r.doc_id, r.text) for r in docs.collect())
    fps = [plain_fingerprint(t) for _, t in texts]
    roots = brute_components(np.array(fps, np.uint64))
    rows = sorted(simhash.near_duplicates(docs).collect())
    assert [(r.doc_id, r.fingerprint, r.component_id) for r in rows] == [(d, f"{f:016x}", texts[c][0]) for (d, _), f, c in zip(texts, fps, roots, strict=True)]


def test_chains_and_dense_groups(spark):
    rng = random.Random(3)
    base = rng.getrandbits(64)
    chain = [base]
    for _ in range(60):
        nxt = chain[-1]
        for place in rng.sample(range(64), 4):
            nxt ^= 1 << place
        chain.append(nxt)
    dense = list({(base ^ (1 << 63)) ^ sum(1 << p for p in rng.sample(range(12), rng.randint(0, 3))) for _ in range(200)})
    noise = [rng.getrandbits(64) for _ in range(300)]
    fps = np.array(sorted({*chain, *dense, *noise}), np.uint64)
    frame = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    rows = connected_components(simhash.similar_fingerprints(frame)).collect()
    got = {np.array([r.node]).view(np.uint64)[0]: r.root for r in rows}
    want = brute_components(fps)
    groups, mine = {}, {}
    for fp, w in zip(fps, want, strict=True):
        groups.setdefault(w, set()).add(fp)
        mine.setdefault(got.get(fp, ("own", fp)), set()).add(fp)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    texts = {1: None, 2: "", 3: "A b\tC d e", 4: "a B c  d E", 5: "x", 6: long, 7: long + " more", 8: "solo words here", 9: "ü" * 10}
    docs = spark.createDataFrame([(k, v, 0) for k, v in texts.items()] + [(5, "x", 0), (None, "a b c d e", 0)], "doc_id long, text string, fp int")
    rows = simhash.near_duplicates(docs).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 11 and by[1].fingerprint == "0" * 16 and by[2].component_id == 1
    assert by[4].component_id == by[None].component_id == 3 and by[7].component_id == 6
    assert all(int(by[k].fingerprint, 16) == plain_fingerprint(v or "") for k, v in texts.items())
    assert simhash.near_duplicates(docs.where("false")).count() == 0
