"""Token counts without tokens: count-only Viterbi over an Aho-Corasick automaton."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagveil.llm import unigram
from tagveil.llm.common import map_arrow, sub_batches, texts_of

_SCHEMA = "doc_id long, n_words long, n_tokens long, best_score double"


def token_counts(docs: DataFrame, model_file: str = unigram.DEFAULT_MODEL) -> DataFrame:
    """Pieces that the unigram tokenizer of ``model_file`` would give each whole text.

    Null and empty texts count 0 tokens; a word without blanks may be as long as it likes
    (the recursion is linear in it and remembers two numbers for each character of the longest
    piece); of segmentations that score the same the one whose last piece is longest counts,
    the tokenizer's rule; repeated rows repeat; an empty table gives no row; other columns are
    not looked at. Map-only, no shuffle.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = unigram.viterbi(model_file)
        for batch in sub_batches(batches):
            rows = [model.text(text.decode("utf-8", "replace")) for text in texts_of(batch)]
            words, tokens, scores = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(tokens, pa.int64()), pa.array(scores, pa.float64())], names=["doc_id", "n_words", "n_tokens", "best_score"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text")), count, _SCHEMA)
