"""Benchmark decontamination: word windows of test items, found in documents by one Aho-Corasick automaton.

Items are normalised to words; every ten consecutive words, or a shorter item as a whole, are
a window. The automaton's letters are words: a document becomes a sequence of word numbers,
is walked once, and each match ends at the word that the walk is at. Word places are mapped
to code points of the original text.

The automaton is built from blocks of the benchmark of a bounded size. All known test sets
together are a few blocks; with more than one, a task keeps a few megabytes of texts at hand
and walks them with each block's automaton in turn, so memory does not grow with the items.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagveil.llm.common import CHUNK_BYTES, give_back, resident, sub_batches, texts_of
from tagveil.operators import spans as engine_spans

WINDOW = 10
#: Words of an item that stay together; longer items are cut, each piece with the words that its last window needs.
PIECE = 4096
#: Nodes of one automaton, about 100 bytes each.
BLOCK_NODES = 1 << 20
#: Bytes of texts that a task holds while it walks them with several automata.
HELD_BYTES = 32 << 20

_SMALL, _CAPITAL = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of a text to bytes of its words: small letters, and blanks for what is in no word.
_BYTES = bytes(b if b >= 0x80 or chr(b).isdigit() or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))

FOUND = "n_words long, n_hit long, spans array<struct<start:int,end:int>>, items array<string>"


class Windows:
    """The automaton of a block of items (id, words)."""

    def __init__(self, items: Sequence[tuple[str, str]], window: int):
        self.numbers: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], list[str]] = {}
        number = self.numbers.setdefault
        for item, words in items:
            own = [number(w, len(self.numbers) + 1) for w in words.encode().split()]
            for i in range(max(1, len(own) - window + 1)):
                owners.setdefault(tuple(own[i : i + window]), []).append(item)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, ids in owners.items():
            self.automaton.add_word(key, (len(key), tuple(dict.fromkeys(ids))))
        self.empty = not owners
        if owners:
            self.automaton.make_automaton()

    def matches(self, words: list[bytes]) -> Iterator[tuple[int, tuple[int, tuple[str, ...]]]]:
        """(last word, (words, items)) of every window of the words."""
        if self.empty or not words:
            return iter(())
        get = self.numbers.get
        return self.automaton.iter(tuple([get(w, 0) for w in words]))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_BYTES).split()


def offsets(text: bytes, first: np.ndarray, last: np.ndarray) -> list[dict[str, int]]:
    """Word places [first, last] as code points [start, end) of the text."""
    data = np.frombuffer(text, np.uint8)
    inside = np.frombuffer(text.translate(_BYTES), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return [{"start": int(a), "end": int(b)} for a, b in zip(points[edges[0::2][first]], points[edges[1::2][last]], strict=True)]


def marks(n_words: int, found: list[tuple[int, int]]) -> tuple[int, np.ndarray, np.ndarray]:
    """(words inside a window, first and last words of their runs) of windows (last word, words)."""
    change = np.zeros(n_words + 1, np.int64)
    ends, sizes = np.array(found, np.int64).T
    np.add.at(change, ends - sizes + 1, 1)
    np.add.at(change, ends + 1, -1)
    hit = np.cumsum(change)[:n_words] > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]])))
    return int(hit.sum()), edges[0::2], edges[1::2] - 1


def items_of(benchmark: DataFrame, columns: Sequence[str] = ("text",)) -> DataFrame:
    """(item, words): the pieces of each item's normalised texts, once each; an item without an id is called by an empty string."""
    texts = F.explode(F.array(*(F.col(f"`{c}`").cast("string") for c in columns)))
    each = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), texts.alias("said"))
    words = each.select("item", F.regexp_extract_all(F.translate("said", _CAPITAL, _SMALL), F.lit(_WORD), F.lit(0)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - WINDOW, F.lit(0)), F.lit(PIECE))
    return words.select("item", F.explode(F.transform(starts, lambda s: F.array_join(F.slice("w", s + 1, PIECE + WINDOW - 1), " "))).alias("words")).distinct()


def blocks(benchmark: DataFrame, columns: Sequence[str] = ("text",)) -> list[Broadcast]:
    """The items as broadcasts, each within ``BLOCK_NODES`` (give or take how evenly a hash deals them out)."""
    items = items_of(benchmark, columns)
    nodes = items.agg(F.sum(F.size(F.split("words", " ")) * WINDOW + 1)).first()[0] or 0
    n = -(-nodes // BLOCK_NODES)
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(n))) if n > 1 else items.withColumn("block", F.lit(0))
    send = benchmark.sparkSession.sparkContext.broadcast
    return [send([(r["item"], r["words"]) for r in dealt.where(F.col("block") == k).collect()]) for k in range(n)]


def found(docs: DataFrame, benchmark: DataFrame, keep: Sequence[str], columns: Sequence[str] = ("text",)) -> DataFrame:
    """(_row, n_words, n_hit, spans, items): every row of ``docs``, its columns ``keep`` in one, with what its text holds of the benchmark.

    ``spans`` are the runs of words inside windows, as code points of the text, ``items`` the
    ids of the items with such windows. A null or empty text has no words. Rows are judged one
    by one, so repeated rows, null ids and clashing names are no matter; a very long text is
    walked whole; without items nothing is found; an empty table gives no row.
    """
    sent, name = blocks(benchmark, columns), uuid.uuid4().hex
    wanted = list(dict.fromkeys([*keep, "text"]))
    limit = CHUNK_BYTES if len(sent) < 2 else HELD_BYTES

    def automaton(k: int) -> Windows:
        built = Windows(sent[k].value, WINDOW)
        if len(sent) > 1:
            sent[k].__dict__.pop("_value", None)  # the next block's items take its place
        return built

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for whole in batches:
                row = whole.column("_row")
                flat = pa.RecordBatch.from_arrays([row.field(c) for c in wanted], names=wanted)
                for batch in sub_batches(iter([flat]), limit=limit):
                    texts = texts_of(batch)
                    matches: list[list[tuple[int, int]]] = [[] for _ in texts]
                    owners: list[set[str]] = [set() for _ in texts]
                    sizes = [0] * len(texts)
                    for k in range(max(1, len(sent))):
                        windows = resident(f"windows {name} {k}", lambda k=k: automaton(k)) if sent else None
                        for i, text in enumerate(texts):
                            words = words_of(text)
                            sizes[i] = len(words)
                            if windows is not None:
                                for end, (size, ids) in windows.matches(words):
                                    matches[i].append((end, size))
                                    owners[i].update(ids)
                    hits, runs = [], []
                    for text, n, got in zip(texts, sizes, matches, strict=True):
                        hit, first, last = marks(n, got) if got else (0, None, None)
                        hits.append(hit)
                        runs.append(offsets(text, first, last) if got else [])
                    back = pa.StructArray.from_arrays([batch.column(c) for c in keep], fields=[batch.schema.field(c) for c in keep])
                    yield pa.RecordBatch.from_arrays(
                        [back, pa.array(sizes, pa.int64()), pa.array(hits, pa.int64()), pa.array(runs, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array([sorted(x) for x in owners], pa.list_(pa.string()))],
                        names=["_row", "n_words", "n_hit", "spans", "items"],
                    )
        finally:
            give_back()

    given = docs.select(F.struct(*(F.col(f"`{c}`") for c in wanted)).alias("_row"))
    row_type = given.select(F.struct(*(F.col(f"_row.`{c}`") for c in keep)).alias("_row")).schema["_row"].dataType.simpleString()
    return given.mapInArrow(rows, f"_row {row_type}, {FOUND}")


def kept(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose texts hold no window."""
    return found(docs, benchmark, docs.columns).where("n_hit = 0").select("_row.*")


def cleaned(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` with the runs of hit words cut out of their texts."""
    cut = F.transform("spans", lambda x: F.struct(x["start"].alias("s"), x["end"].alias("e"), F.lit("").alias("replacement")))
    out = found(docs, benchmark, docs.columns).withColumn("_clean", engine_spans.splice(F.col("_row.text"), cut))
    return out.select(*((F.col("_clean") if c == "text" else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans) of every row of ``docs``."""
    ids = F.array_sort("items")
    return found(docs, benchmark, ["doc_id"]).select(
        "_row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
