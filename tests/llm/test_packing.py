import zlib
from collections import defaultdict

import numpy as np
import pytest

pytest.importorskip("tagveil.llm")
from tagveil.llm import packing


def check(docs, rows, window, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.DEFAULT_TOKENIZER)
    ids = {k: [*t.encode(v or "", add_special_tokens=False).ids, 1] for k, v in texts.items()}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        assert zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
        assert r.doc_tokens == len(ids[r.doc_id]) and r.length > 0
        by_doc[r.doc_id].append((r.start, r.length))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(texts)
    for spans, total in [(s, len(ids[k])) for k, s in by_doc.items()] + [(s, None) for s in by_sequence.values()]:
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
        assert at == total if total else at <= window
    return [sum(n for _, n in s) for s in by_sequence.values()]


def test_whole_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = packing.pack(docs, group_tokens=100_000).collect()
    fills = check(docs, rows, 2048, {r.doc_id: r.text for r in docs.collect()})
    groups = len({r.sequence_id >> 32 for r in rows})
    assert groups > 3 and sum(f < 2048 for f in fills) <= groups
    assert rows and sorted(rows) == sorted(packing.pack(docs.repartition(7), group_tokens=100_000).collect())


def test_odd_rows(spark):
    texts = {1: None, 2: "", 3: "the cat " * 40_000, 4: "x" * 5000, 5: "A b é́ <|endoftext|>x 'S"}
    docs = spark.createDataFrame([(k, v, 9) for k, v in texts.items()], "doc_id long, text string, start int")
    check(docs, packing.pack(docs).collect(), 2048, texts)
    twice = packing.pack(docs.union(docs)).collect()
    assert sum(r.length for r in twice) == 2 * sum(r.length for r in packing.pack(docs).collect())
    assert packing.pack(docs.where("false")).count() == 0
    assert packing.pack(docs.where("doc_id = 4"), with_ids=True).first().ids[-4:] == b"\1\0\0\0"


def test_level_choice_is_the_least_sum_of_squares():
    rng = np.random.default_rng(3)
    packer = packing.Packer(32)
    for size in rng.integers(1, 33, 600):
        before = packer.levels.copy()
        best = None
        for h in range(0, 33 - size):
            if h and not before[h]:
                continue
            after = before.copy()
            after[h] -= h > 0
            if h + size < 32:
                after[h + size] += 1
            best = min(x for x in (best, (after**2).sum()) if x is not None)
        packer.place(int(size), None)
        if size < 32:
            assert (packer.levels**2).sum() == best
    assert all(len(o) == n for o, n in zip(packer.open, packer.levels, strict=True))


def test_every_word_of_the_corpus_equals_the_tokenizer():
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    texts = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"]).column(0).to_pylist()
    texts += ["é́a, ʼn ǅx. ɏɐ a'b it's 'tis x' ß! ﬁ <|startoftext|>, a\x01, \x01", "…a a… ª º µm ÷2 ×x", "The<|endoftext|>END <|endoftext|>"]
    own = packing.encoder(packing.DEFAULT_TOKENIZER)
    want = Tokenizer.from_file(packing.DEFAULT_TOKENIZER).encode_batch_fast(texts, add_special_tokens=False)
    for at in range(0, len(texts), 500):
        for got, e in zip(own.encode([t.encode() for t in texts[at : at + 500]]), want[at : at + 500], strict=True):
            assert np.frombuffer(got, own.kind).tolist() == e.ids


def test_every_code_point_equals_the_tokenizer(spark):
    from tokenizers import Tokenizer

    points = [chr(i) for i in range(1, 0x3000)]
    texts = points + [f"ab{c}cd {c}x, y{c}" for c in points] + ["Merhaba \u0130stanbul ve \u0130zmir", "\u0130", "D\u0130YARBAKIR, i\u0307x I\u0307"]
    own, model = packing.encoder(packing.DEFAULT_TOKENIZER), Tokenizer.from_file(packing.DEFAULT_TOKENIZER)
    want = model.encode_batch_fast(texts, add_special_tokens=False)
    for at in range(0, len(texts), 997):  # together and, below, one by one
        got = own.encode([t.encode() for t in texts[at : at + 997]])
        assert [np.frombuffer(g, own.kind).tolist() for g in got] == [e.ids for e in want[at : at + 997]]
    rows = dict(enumerate(texts[-3:]))
    check(None, packing.pack(spark.createDataFrame(list(rows.items()), "doc_id long, text string")).collect(), 2048, rows)


def test_a_word_that_the_rules_misjudge_is_encoded_alone():
    own = packing.Encoder(packing.DEFAULT_TOKENIZER)
    out = {}
    words = ["a", "\u0130", "zebra"]
    own._joined([w.encode() for w in words], b" ", lambda ids: own.ends[ids], 1, out)
    assert out == {w.encode(): own._ids(w.encode()).tobytes() for w in words}


def test_rows_without_an_id_and_equal_rows_spread(spark):
    words = "the cat sat on a mat and " * 60
    docs = spark.createDataFrame([(None, f"{words} {i}") for i in range(150)] + [(7, words)] * 300, "doc_id long, text string")
    rows = packing.pack(docs, group_tokens=20_000)
    sizes = {r.g: r.n for r in rows.selectExpr("sequence_id >> 32 as g", "length").groupBy("g").agg({"length": "sum"}).toDF("g", "n").collect()}
    assert len(sizes) > 4 and max(sizes.values()) < 3 * 20_000
    assert rows.where("doc_id = 7 and start = 0").count() == 300 and rows.where("doc_id is null and start = 0").count() == 150
    assert sorted(map(str, rows.collect())) == sorted(map(str, packing.pack(docs.repartition(5), group_tokens=20_000).collect()))
