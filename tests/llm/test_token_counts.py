import pytest

pytest.importorskip("tagveil.llm")
from hypothesis import given, settings
from hypothesis import strategies as st

from tagveil.llm import unigram
from tagveil.llm.token_counts import token_counts


def reference():
    from tokenizers import Tokenizer
    from tokenizers.models import Unigram
    from tokenizers.pre_tokenizers import Metaspace

    t = Tokenizer(Unigram(list(unigram.vocabulary(unigram.DEFAULT_MODEL)), 0, byte_fallback=True))
    t.pre_tokenizer = Metaspace()
    return t


REF = reference()
MODEL = unigram.viterbi(unigram.DEFAULT_MODEL)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aeintthe \n\t▁é漢<0x41>"), st.characters(blacklist_categories=["Cs"]))))
def test_equals_the_tokenizer(text):
    assert MODEL.text(text)[1] == len(REF.encode(text, add_special_tokens=False).ids)


def test_whole_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r.n_tokens for r in token_counts(docs).collect()}
    rows = docs.select("doc_id", "text").collect()
    want = REF.encode_batch([r.text for r in rows], add_special_tokens=False)
    assert got == {r.doc_id: len(e.ids) for r, e in zip(rows, want, strict=True)}


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (None, "ab ab", 1), (3, "x" * 200_000, 1), (3, "x" * 200_000, 1)], "doc_id long, text string, n_tokens int")
    rows = token_counts(docs).collect()
    assert sorted((r.doc_id or 0, r.n_words) for r in rows) == [(0, 2), (1, 0), (2, 0), (3, 1), (3, 1)]
    assert [r.n_tokens for r in rows if r.doc_id in (1, 2)] == [0, 0]
    assert token_counts(docs.where("false")).count() == 0


def test_a_word_of_five_million_characters_takes_little_memory():
    import resource

    from tagveil.llm import unigram

    model = unigram.viterbi(unigram.DEFAULT_MODEL)
    text = "onthe" * 1_000_000
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    words, pieces, score = model.text(text)
    assert words == 1 and 1_000_000 <= pieces <= 5_000_000 and score < 0
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200 << 10
