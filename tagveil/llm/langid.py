"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts come from all labelled training documents: each task keeps one (language, bucket)
count table and sends its non-zero cells, which one shuffle adds up. The finished
log-probability matrix has a fixed number of buckets and a bounded number of languages and
is broadcast; batches of documents are scored in numpy without leaving flat arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagveil.llm.common import as_rows, chunks, doc_hash, give_back, map_arrow, resident, sub_batches, texts_of

BUCKETS, ORDERS = 1 << 17, (1, 2, 3)
SMOOTHING = 0.5
#: Cells of the matrix at most (a quarter of a gigabyte): with very many languages each has fewer buckets.
MOST_CELLS, LEAST_BUCKETS = 1 << 25, 1 << 10
UNDETERMINED = "und"
#: A document is rejected below this posterior, or if it is surely in another language than it says.
LEAST_SCORE, SURE_SCORE = 0.5, 0.999
FOLDS, HELD_OUT_FOLD = 4, 2
CHUNK_BYTES = 1 << 19
_FACTORS = tuple(np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))


@lru_cache(maxsize=1)  # a megabyte
def letters() -> np.ndarray:
    """2 for code points that are letters, 1 for combining marks, which stay with their letter, else 0."""
    import unicodedata

    return np.array([{"L": 2, "M": 1}.get(unicodedata.category(chr(i))[0], 0) for i in range(0x110000)], np.uint8)


def grams(texts: list[bytes], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, start of each text's buckets, has a letter?) of texts lower-cased, with runs of non-letters as one blank.

    Every text is framed by blanks, so it has grams even if empty; grams never join texts.
    """
    joined = "\0".join(t.decode("utf-8", "replace").replace("\0", " ").lower() for t in texts) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    ends = points == 0
    kind = letters()[points]
    letter = kind > 0
    text_no = np.cumsum(ends) - ends
    has_letter = np.bincount(text_no, kind == 2, minlength=len(texts)) > 0
    points = np.where(letter | ends, points, 32).astype(np.uint32)
    keep = np.ones(len(points), bool)
    keep[1:] = ~((points[1:] == 32) & (points[:-1] == 32))
    points, text_no = points[keep], text_no[keep]
    points = np.where(points == 0, 32, points).astype(np.uint32)
    out, where = [], []
    for order in ORDERS:
        n = len(points) - order + 1
        if n <= 0:
            continue
        code = np.full(n, order, np.uint32)
        for i in range(order):
            code = (code ^ points[i : n + i]) * _FACTORS[i]
            code ^= code >> np.uint32(15)
        inside = text_no[:n] == text_no[order - 1 :]
        out.append((code % np.uint32(buckets))[inside])
        where.append(text_no[:n][inside])
    # stable by text: each order's run is sorted already, so only the runs are merged
    text = np.concatenate(where)
    order_of = np.argsort(text, kind="stable")
    return np.concatenate(out)[order_of], np.searchsorted(text[order_of], np.arange(len(texts))), has_letter


@dataclass
class Model:
    langs: list[str]
    log_prior: np.ndarray
    log_prob: np.ndarray

    def score(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        """Language and posterior of each text."""
        buckets, starts, has_letter = grams(texts, self.log_prob.shape[1])
        sums = np.stack([np.add.reduceat(row[buckets], starts) for row in self.log_prob], 1) + self.log_prior
        best = sums.argmax(1)
        weight = np.exp(sums - sums.max(1, keepdims=True))
        score = weight[np.arange(len(texts)), best] / weight.sum(1)
        return [self.langs[b] if ok else UNDETERMINED for b, ok in zip(best, has_letter, strict=True)], np.where(has_letter, score, 0.0)


def train(docs: DataFrame, label: str = "lang") -> Model:
    """Fit on every row whose text and label are not null."""
    rows = docs.where(F.col("text").isNotNull() & F.col(label).isNotNull()).select("text", F.col(label).cast("string").alias("label"))
    n_langs = rows.select("label").distinct().count()
    buckets = BUCKETS
    while n_langs * buckets > MOST_CELLS:
        buckets >>= 1
    if buckets < LEAST_BUCKETS:
        raise ValueError(f"{n_langs} languages; is {label} the right column?")

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident("nothing", dict)
        tables: dict[str, np.ndarray] = {}
        for batch in sub_batches(batches, limit=CHUNK_BYTES):
            labels = np.array(batch.column("label").to_pylist(), object)
            texts = texts_of(batch)
            for lang in dict.fromkeys(labels):
                mine = [t for t, x in zip(texts, labels, strict=True) if x == lang]
                got = tables.setdefault(lang, np.zeros(buckets + 1, np.int64))
                got[:buckets] += np.bincount(grams(mine, buckets)[0], minlength=buckets)
                got[buckets] += len(mine)  # documents
        for lang, got in tables.items():
            cells = np.flatnonzero(got)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(cells), pa.string()), pa.array(cells, pa.int64()), pa.array(got[cells], pa.int64())], names=["label", "bucket", "n"])

    cells = map_arrow(rows, counts, "label string, bucket long, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n"))
    # the driver gets a fixed number of cells a language
    found = cells.toArrow()
    names = np.array(found.column("label").to_pylist(), object)
    langs = sorted(set(names))
    table = np.zeros((len(langs), buckets + 1), np.float64)
    at = {x: i for i, x in enumerate(langs)}
    table[[at[x] for x in names], found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    grams_, n_docs = table[:, :buckets], table[:, buckets]
    log_prob = np.log(grams_ + SMOOTHING) - np.log(grams_.sum(1, keepdims=True) + SMOOTHING * buckets)
    return Model(langs, np.log(n_docs / max(n_docs.sum(), 1)), log_prob)


_SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


def predict(docs: DataFrame, model: Model, held_out: Column) -> DataFrame:
    """Map-only scoring of every row of (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, limit=CHUNK_BYTES):
            langs, scores = shared.value.score(texts_of(batch)) if shared.value.langs else ([UNDETERMINED] * batch.num_rows, np.zeros(batch.num_rows))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), held_out.alias("held_out"), "text"), scored, _SCHEMA)


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the labelled documents of all folds but one and predict every document.

    A text that is null or has no letter is ``und`` with score 0, as is everything where no
    labelled document exists; a null doc_id is trained on (its fold is not the held-out one)
    and predicted; repeated rows count and return each time; of languages that score the same
    the first by name is taken; a very long text is read whole; an empty table gives no row;
    columns besides doc_id, text and lang are not looked at.
    """
    held_out = F.coalesce(F.pmod(doc_hash(), F.lit(FOLDS)) == HELD_OUT_FOLD, F.lit(False))
    model = train(docs.where(~held_out).select("text", "lang"))
    return predict(docs, model, held_out)


def kept(docs: DataFrame) -> DataFrame:
    """The documents whose language is known, with the columns of ``docs``.

    Learns from all labelled documents. Rejected are texts that are null, empty or without a
    letter, those of an uncertain language, and those that are surely not in the language of
    their label; the text stays in the JVM row and is read whole, however long. A null label
    or id rejects nothing; repeated rows are kept or rejected together; names of columns may
    clash with any of ours; an empty table gives no row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs.select("text", "lang")))

    @F.arrow_udf("lang string, score double")
    def guess(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        resident("nothing", dict)
        model = shared.value
        for texts in batches:
            langs, scores = [], []
            for part in chunks(texts, CHUNK_BYTES):
                some = model.score(part) if model.langs else ([UNDETERMINED] * len(part), np.zeros(len(part)))
                langs += some[0]
                scores += some[1].tolist()
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])
            give_back()

    found = as_rows(docs).withColumn("_found", guess(F.col("_row.text")))
    other = (F.col("_found.lang") != F.col("_row.lang")) & (F.col("_found.score") >= SURE_SCORE)
    keep = (F.col("_found.lang") != UNDETERMINED) & (F.col("_found.score") >= LEAST_SCORE) & ~F.coalesce(other, F.lit(False))
    return found.where(keep).select("_row.*")
