import hashlib
import random
import zlib

import pytest

from tagveil.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string, depth int, k1 string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows, rebuild=True):
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    convs = own
    if rebuild:
        convs = {}
        for c, turns in own.items():
            h = zlib.crc32(str(c).encode()) % 6
            convs[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        kids = children.get(node, [])
        leaves[node] = sum(leaves[k] for k in kids) if kids else 1
        saved[node] = sum(saved[k] for k in kids) + ((len(members[node]) - 1) * len(node[-1][1]) if node else 0)
    out = []
    for node, own_ in members.items():
        ends = ",".join(str(c) for c in sorted(own_) if len(convs[c]) == len(node))
        out.append((min(own_), len(node), min(members[node[:-1]]) if node else None, len(own_), len(children.get(node, [])), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    assert df.columns == list(COLUMNS)
    return sorted((tuple(r) for r in df.collect()), key=str)


def odd_rows():
    pick = random.Random(3)
    rows = [(None, 1, "user", "nobody's", 1, "x"), (300, None, None, None, None, None), (300, None, "user", None, 2, None), (300, 0, "user", "é漢𝔘", 1, None)]
    for c in [*range(0, 40), 100, 101, 107, 1000, 1001, 1002, 250]:
        n = pick.choice([1, 2, 3, 7, 9])
        rows += [(c, t if pick.random() < 0.9 else t // 2, pick.choice(["user", "assistant"]) if pick.random() < 0.3 else ("user", "assistant")[t % 2], pick.choice(["a", "bb", "", None, "hello there"]), 1, "k") for t in range(n)]
    rows += [(c, t, "user", f"same {t}", 1, "k") for c in range(2000, 2020) for t in range(8)]  # a group of copies
    rows += [(3000, t, "user", "long " * (t % 3), 1, "k") for t in range(300)]  # one long conversation
    rows += rows[10:14]  # repeated turns
    pick.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [1024, 3])
def test_odd_rows_by_brute_force(spark, block, monkeypatch):
    rows = odd_rows()
    turns, lengths = P.rebuilt(P.turns_of(spark.createDataFrame(rows, SCHEMA)))
    assert rows_of(P.trie(turns, lengths, block)) == brute(rows)


def test_conversations_as_they_are(spark):
    rows = odd_rows()
    assert rows_of(P.conversation_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows, rebuild=False)


def test_turnless_only_and_empty(spark):
    # h is over the number of turns and the family's first conversation is not there
    turnless = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 1)
    rows = [(turnless, 0, "user", "gone", 1, "x")]
    assert rows_of(P.rebuilt_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows) == [(turnless, 0, None, 1, 0, 1, 0, hashlib.sha256(str(turnless).encode()).hexdigest())]
    assert P.rebuilt_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert P.conversation_trie(spark.createDataFrame([(None, 1, "a", "b", 1, "c")], SCHEMA)).collect() == []


def test_very_long_texts(spark):
    rows = [(c, t, "user", "x" * 2_000_000 + str(t), 1, "k") for c in (400, 401, 402) for t in range(2)]
    assert rows_of(P.rebuilt_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_ends_in_several_runs(spark):
    ids = list(range(-700, 3000, 3))
    [row] = P.digests(spark.createDataFrame([(1, 2, c) for c in ids], "k1 long, k2 long, conv_id long")).collect()
    assert row.ends_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
