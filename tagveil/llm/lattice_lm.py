"""Subword lattice likelihood over an existing unigram vocabulary.

A word's lattice probability is the sum over all ways to write it in the vocabulary's pieces,
by a forward recursion in log space. The vocabulary's existing scores weight all
segmentations of every training word; the pieces that they expect there, added to the scores'
own weights, are the piece weights of each language (the vocabulary itself stays as it is).
In a language a token's probability is half its lattice probability and half its share of
the language's training tokens, and a text's the product over its tokens. A text's score is
the sum of these over all languages, each weighing what its share of the training documents
is: all scores add up to one over texts, and ``lang`` is no input of a score.

Nothing is gathered in one place: documents are coded against dictionaries of bounded
blocks, block words meet their corpus counts by word, and the scores return by block.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagveil.llm import unigram
from tagveil.llm.common import doc_hash, dropped, map_arrow, resident, stored, sub_batches, texts_of

FOLDS, HELD_OUT_FOLD = 7, 2
#: Bytes of text coded against one dictionary.
BLOCK_BYTES = 16 << 20
#: The lattice's share in a word's probability.
SHARE = 0.5
#: What a score's weight counts for beside the expected pieces, per piece of average weight.
PRIOR = 0.5
#: Tokens of all languages together that are added to a language's own, so that words seen in others are not strange.
SHARED_TOKENS = 1000.0
#: Shift of the rank in the weights that scores stand for (rank-frequency law).
RANK_SHIFT = 2.7
#: Pieces after which a word ends, before anything is learnt.
STOP_SHARE = 0.3
#: Prior weight of writing a character byte by byte.
ESCAPE_SHARE = 1e-4
#: Languages with weights of their own, by training tokens; all others, and documents without a label, are one class.
CLASSES = 15
#: Characters of a word that are worked on at once; longer words go by a window, and are learnt from in stretches.
LONG = 2000
#: Words of a batch of the recursion.
BATCH = 4000
#: The share of ends among tokens where nothing is learnt.
NO_END = 0.01
_NEVER = -1e30
_BYTE = math.log(1 / 256)


@dataclass
class Edges:
    """All pieces that fit somewhere in some words, by where they end: from node, to node, weight number, what is added."""

    src: np.ndarray
    dst: np.ndarray
    weight: np.ndarray
    extra: np.ndarray
    #: Bounds of the edges that end at the first, second ... character.
    steps: np.ndarray
    first: np.ndarray
    last: np.ndarray
    word: np.ndarray


class Vocabulary:
    """The pieces and their automaton. Weights are numbered: pieces that start words, pieces that go on, escapes at a start and later."""

    def __init__(self, pieces: list[str]):
        self.pieces, n = pieces, len(pieces)
        self.automaton = ahocorasick.Automaton()
        # what follows the space mark, so that a start is the same string as elsewhere
        for i, piece in enumerate(pieces):
            body = piece.removeprefix(unigram.SPACE)
            if body:
                have = self.automaton.get(body, (len(body), -1, -1))
                self.automaton.add_word(body, (have[0], i, have[2]) if piece[0] == unigram.SPACE else (have[0], have[1], n + i))
        self.automaton.make_automaton()
        self.longest = max(map(len, pieces))
        self.escapes = (2 * n, 2 * n + 1)

    def edges(self, words: list[str]) -> Edges:
        src, end, weight, extra, word_no = [], [], [], [], []
        base = 0
        lengths = np.array([len(w) for w in words], np.int64)
        for k, word in enumerate(words):
            alone = bytearray(len(word))
            for e, (length, first, later) in self.automaton.iter(word):
                no = first if e + 1 == length else later
                if no >= 0:
                    src.append(base + e + 1 - length)
                    end.append(e)
                    weight.append(no)
                    word_no.append(k)
                    if length == 1:
                        alone[e] = 1
            at = alone.find(0)
            while at >= 0:
                src.append(base + at)
                end.append(at)
                weight.append(self.escapes[at > 0])
                word_no.append(k)
                extra.append((len(src) - 1, _BYTE * len(word[at].encode("utf-8", "surrogatepass"))))
                at = alone.find(0, at + 1)
            base += len(word) + 1
        bases = np.concatenate([[0], np.cumsum(lengths + 1)])
        end_, no_ = np.array(end, np.int64), np.array(word_no, np.int64)
        added = np.zeros(len(src))
        if extra:
            places, values = zip(*extra, strict=True)
            added[list(places)] = values
        order = np.lexsort((no_, end_))
        dst = bases[no_] + end_ + 1
        steps = np.searchsorted(end_[order], np.arange(int(lengths.max(initial=0)) + 1))
        return Edges(np.array(src, np.int64)[order], dst[order], np.array(weight, np.int64)[order], added[order], steps, bases[:-1], bases[1:] - 1, no_[order])


def forward(edges: Edges, weights: np.ndarray) -> np.ndarray:
    """Log-probabilities (nodes x classes) of all ways to write each beginning; ``weights`` is (numbers x classes)."""
    alpha = np.zeros((int(edges.last[-1]) + 1, weights.shape[1]))
    for a, b in zip(edges.steps[:-1].tolist(), edges.steps[1:].tolist(), strict=True):
        dst = edges.dst[a:b]
        terms = alpha[edges.src[a:b]] + weights[edges.weight[a:b]] + edges.extra[a:b, None]
        cuts = np.flatnonzero(np.concatenate([[True], dst[1:] != dst[:-1]]))
        top = np.maximum.reduceat(terms, cuts, 0)
        spread = np.repeat(top, np.diff(np.append(cuts, b - a)), 0)
        alpha[dst[cuts]] = top + np.log(np.add.reduceat(np.exp(terms - spread), cuts, 0))
    return alpha


def expected(edges: Edges, weights: np.ndarray) -> np.ndarray:
    """For each edge, the share of its word's probability that runs over it, by one class's weights."""
    alpha = forward(edges, weights[:, None])[:, 0]
    beta = np.full(len(alpha), _NEVER)
    beta[edges.last] = 0.0
    own = weights[edges.weight] + edges.extra
    for a, b in zip(edges.steps[:-1].tolist()[::-1], edges.steps[1:].tolist()[::-1], strict=True):
        np.logaddexp.at(beta, edges.src[a:b], own[a:b] + beta[edges.dst[a:b]])
    return np.exp(alpha[edges.src] + own + beta[edges.dst] - alpha[edges.last][edges.word])


@dataclass
class Lattice:
    """Weights by class: each class's starts add up to one with the escape, its goings on with the escape and the stop."""

    vocabulary: Vocabulary
    #: (numbers x classes), and what ending a word weighs (classes).
    weights: np.ndarray
    stop: np.ndarray

    def log_probabilities(self, words: list[str]) -> np.ndarray:
        """(words x classes); words must not be empty."""
        out = np.empty((len(words), len(self.stop)))
        short = [i for i, w in enumerate(words) if len(w) <= LONG]
        for at in range(0, len(short), BATCH):
            some = short[at : at + BATCH]
            edges = self.vocabulary.edges([words[i] for i in some])
            out[some] = forward(edges, self.weights)[edges.last]
        for i, word in enumerate(words):
            if len(word) > LONG:
                out[i] = self.by_window(word)
        return out + self.stop

    def by_window(self, word: str) -> np.ndarray:
        """The recursion with no more memory than the longest piece needs."""
        size = self.vocabulary.longest + 1
        alpha = np.zeros((size, len(self.stop)))
        found, weights, escapes = self.vocabulary.automaton.iter(word), self.weights, self.vocabulary.escapes
        match = next(found, None)
        for e, char in enumerate(word):
            src, no, alone = [], [], False
            while match is not None and match[0] == e:
                length, first, later = match[1]
                own = first if e + 1 == length else later
                if own >= 0:
                    src.append((e + 1 - length) % size)
                    no.append(own)
                    alone |= length == 1
                match = next(found, None)
            if alone:
                terms = alpha[src] + weights[no]
            else:
                src.append(e % size)
                no.append(escapes[e > 0])
                terms = alpha[src] + weights[no]
                terms[-1] += _BYTE * len(char.encode("utf-8", "surrogatepass"))
            top = terms.max(0)
            alpha[(e + 1) % size] = top + np.log(np.exp(terms - top).sum(0))
        return alpha[len(word) % size]


def _prior(model_file: str) -> tuple[list[str], np.ndarray]:
    """Pieces that can occur in words, and weights from their scores (the negative rank), averaging one."""
    entries = [(p, s) for p, s in unigram.vocabulary(model_file) if not (p[0] == "<" and p[-1] == ">" and s == 0.0) and unigram.SPACE not in p[1:]]
    weight = 1 / (np.array([-s for _, s in entries]) + RANK_SHIFT)
    return [p for p, _ in entries], weight / weight.mean()


def normalised(pieces: list[str], counts: np.ndarray) -> tuple[np.ndarray, float]:
    """Log weights of one class, and of the stop, from counts of starts, goings on, escapes at a start, escapes later, stops."""
    n = len(pieces)
    starts = np.array([p[0] == unigram.SPACE and len(p) > 1 for p in pieces])
    s, o, (first, later, stop) = np.where(starts, counts[:n], 0.0), np.where(starts, 0.0, counts[n : 2 * n]), counts[2 * n :]
    of_start, of_on = s.sum() + first, o.sum() + later + stop
    with np.errstate(divide="ignore"):
        weights = np.concatenate([np.log(s / of_start), np.log(o / of_on), [math.log(first / of_start), math.log(later / of_on)]])
    return np.maximum(weights, _NEVER), math.log(stop / of_on)


@dataclass
class Prior:
    """What the existing scores say: their weights as counts, and the lattice of these alone."""

    pieces: list[str]
    weight: np.ndarray
    vocabulary: Vocabulary
    lattice: Lattice


def initial(model_file: str) -> Prior:
    def make() -> Prior:
        pieces, weight = _prior(model_file)
        n = len(pieces)
        vocabulary = Vocabulary(pieces)
        weights, stop = normalised(pieces, np.concatenate([weight, weight, [ESCAPE_SHARE * n, ESCAPE_SHARE * n, STOP_SHARE * n]]))
        return Prior(pieces, weight, vocabulary, Lattice(vocabulary, weights[:, None], np.array([stop])))

    return resident(f"lattice {model_file}", make)


_CODED = "block long, label string, word binary, code int, n long, doc_id long, held_out boolean, n_tokens long, codes binary"
_KINDS = [pa.int64(), pa.string(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary()]


def coded(docs: DataFrame) -> DataFrame:
    """Texts as codes of a dictionary of their block, and the blocks' dictionaries with training counts, in one table.

    Rows with a word are dictionary rows, the others documents. A block is what one task has
    read in one language of up to ``BLOCK_BYTES``; its number is made of the task's and a
    running one, and table and dictionary come from the same attempt.
    """
    names = [x.split()[0] for x in _CODED.split(", ")]

    def batch_of(rows_: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(rows_, k) for c, k in zip(names, _KINDS, strict=True)], names=names)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        for batch in sub_batches(batches, limit=BLOCK_BYTES):
            labels = batch.column("label").to_pylist()
            for label in dict.fromkeys(labels):
                own = batch.take(pa.array([i for i, x in enumerate(labels) if x == label]))
                block = part << 24 | made
                made += 1
                code: dict[bytes, int] = {b"": 0}
                sums: Counter[bytes] = Counter()
                lists, lengths = [], []
                for text, out in zip(texts_of(own), own.column("held_out").to_pylist(), strict=True):
                    words = text.lower().split()
                    words.append(b"")
                    if not out:
                        sums.update(words)
                    lists.append(np.array([code.setdefault(w, len(code)) for w in words], "<u4").tobytes())
                    lengths.append(len(words))
                n, d = len(code), own.num_rows
                yield batch_of(n, block=[block] * n, label=[label] * n, word=list(code), code=range(n), n=[sums[w] for w in code])
                yield batch_of(d, block=[block] * d, label=[label] * d, doc_id=own.column("doc_id"), held_out=own.column("held_out"), n_tokens=lengths, codes=lists)

    held_out = F.coalesce(F.pmod(doc_hash(), F.lit(FOLDS)) == HELD_OUT_FOLD, F.lit(False))
    label = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), label.alias("label"), "text"), rows, _CODED)


def _batches_of(batch: pa.RecordBatch) -> Iterator[tuple[list[str], list[list[dict]], list[int]]]:
    """Words with their counts by class, as stretches of bounded length; the list of numbers says which word a stretch is of."""
    words, by = batch.column("word").to_pylist(), batch.column("by").to_pylist()
    parts, of = [], []
    for i, word in enumerate(words):
        text = word.decode("utf-8", "replace")
        for at in range(0, len(text), LONG):
            parts.append(text[at : at + LONG])
            of.append(i)
    for at in range(0, len(parts), BATCH):
        yield parts[at : at + BATCH], by, of[at : at + BATCH]


def learn(counts: DataFrame, classes: int, model_file: str = unigram.DEFAULT_MODEL) -> Lattice:
    """Weights of each class from the pieces that the existing scores expect in its training tokens.

    ``counts`` has distinct words with their counts by class. Each task sends at most one
    number a piece and class; the driver gets their sums.
    """
    prior = initial(model_file)
    pieces, weight = prior.pieces, prior.weight
    size = 2 * len(pieces) + 3

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = initial(model_file)
        weights = own.lattice.weights[:, 0]
        every = np.zeros((classes, size))
        for batch in batches:
            for parts, by, of in _batches_of(batch):
                edges = own.vocabulary.edges(parts)
                share = expected(edges, weights)
                times = np.zeros((classes, len(parts)))
                for k, i in enumerate(of):
                    for x in by[i]:
                        times[x["cls"], k] = x["n"]
                for c in np.flatnonzero(times.any(1)):
                    every[c, : size - 1] += np.bincount(edges.weight, share * times[c][edges.word], minlength=size - 1)
                    every[c, size - 1] += times[c].sum()
        flat = every.ravel()
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(flat[at])], names=["at", "x"])

    seen = counts.where((F.col("c") > 0) & (F.length("word") > 0)).select("word", F.filter("by", lambda x: x["n"] > 0).alias("by"))
    found = map_arrow(seen, sums, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).toArrow()
    flat = np.zeros(classes * size)
    flat[found.column("at").to_numpy()] = found.column("x").to_numpy()
    added = np.concatenate([PRIOR * weight, PRIOR * weight, [1.0, 1.0, 1.0]])
    made = [normalised(pieces, row + added) for row in flat.reshape(classes, size)]
    return Lattice(prior.vocabulary, np.stack([w for w, _ in made], 1), np.array([s for _, s in made]))


@dataclass
class Totals:
    """Training tokens and ends (documents) by class."""

    tokens: np.ndarray
    ends: np.ndarray

    @property
    def all(self) -> int:
        return int(self.tokens.sum())

    def end_share(self) -> np.ndarray:
        return self.shares(self.ends, self.ends.sum()) if self.all else np.full(len(self.ends), NO_END)

    def shares(self, own, all_) -> np.ndarray:
        """A token's share in each class, from its counts there and in all."""
        return (own + SHARED_TOKENS * all_ / max(self.all, 1)) / (self.tokens + SHARED_TOKENS)

    def log_label(self) -> np.ndarray:
        """log10 share of each class among the documents."""
        return np.log10((self.ends + 1) / (self.ends.sum() + len(self.ends)))


def word_scores(counts: DataFrame, totals: Totals, lattice: Lattice) -> DataFrame:
    """(word, by, c) to (word, c, lp): log10 probabilities of every word in all classes, as 32-bit floats in a row."""
    shared = counts.sparkSession.sparkContext.broadcast((lattice.weights, lattice.stop, lattice.vocabulary.pieces))
    share = SHARE if totals.all else 1.0
    end = totals.end_share()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, stop, pieces = shared.value
        model = Lattice(resident(f"vocabulary {len(pieces)} {hash(tuple(pieces))}", lambda: Vocabulary(pieces)), weights, stop)
        for batch in batches:
            words, c = batch.column("word").to_pylist(), batch.column("c").to_numpy(zero_copy_only=False)
            own = np.zeros((len(words), len(stop)))
            for i, by in enumerate(batch.column("by").to_pylist()):
                for x in by:
                    own[i, x["cls"]] = x["n"]
            full = [i for i, w in enumerate(words) if w]
            log = np.zeros(own.shape)
            if full:
                log[full] = model.log_probabilities([words[i].decode("utf-8", "replace") for i in full])
            with np.errstate(divide="ignore"):
                seen, parts = np.log((1 - share) * totals.shares(own, c[:, None])), math.log(share) + np.log1p(-end) + log
            empty = np.array([not w for w in words])[:, None]
            lp = (np.where(empty, np.log(end), np.logaddexp(seen, parts)) / math.log(10)).astype("<f4")
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), pa.array([row.tobytes() for row in lp], pa.binary())], names=["word", "c", "lp"])

    return map_arrow(counts.select("word", "by", "c"), score, "word binary, c long, lp binary")


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _numbered(labels: list[str]) -> Column:
    """The class of a label: its place among the largest, else 0."""
    out = F.lit(0)
    for i, label in enumerate(labels):
        out = F.when(F.col("label") == label, i + 1).otherwise(out)
    return out.cast("int")


def score(docs: DataFrame, model_file: str = unigram.DEFAULT_MODEL) -> DataFrame:
    """Base and lattice log10 probability of every whole text.

    Null and empty texts are the end alone; a null doc_id counts as training; repeated rows
    count and return each time; equal texts have equal scores; training documents without a
    label, and those of labels beyond the ``CLASSES`` with most training tokens, are one class
    of their own; labels of held-out documents play no part; without training documents
    the lattice of the existing weights has it all; ties among labels go by the label. A word
    of any length is scored whole, in memory of the longest piece; in learning, words beyond
    ``LONG`` characters count in stretches. An empty table gives no row; columns besides
    doc_id, text and lang are not looked at, and lang may be missing.
    """
    table = stored(coded(docs))
    labels = table.where("word is not null and label is not null").groupBy("label").agg(F.sum("n").alias("n")).where("n > 0").orderBy(F.desc("n"), "label").limit(CLASSES)
    number = _numbered([r.label for r in labels.collect()])
    words = table.where("word is not null").select("block", number.alias("cls"), "word", "code", "n")
    by_class = words.select("word", "cls", "n").repartition("word").groupBy("word", "cls").agg(F.sum("n").alias("n"))
    counts = stored(by_class.groupBy("word").agg(F.collect_list(F.struct("cls", "n")).alias("by"), F.sum("n").alias("c")))
    each = counts.select(F.length("word").alias("size"), F.explode("by").alias("x")).groupBy("x.cls").agg(F.sum("x.n").alias("tokens"), F.sum(F.when(F.col("size") == 0, F.col("x.n")).otherwise(0)).alias("ends")).collect()
    classes = 1 + max((r.cls for r in each), default=0)
    totals = Totals(*(np.array([next((r[k] for r in each if r.cls == c), 0) for c in range(classes)], np.int64) for k in ("tokens", "ends")))
    tokens, distinct = totals.all, counts.where("c > 0").count()
    scores = stored(word_scores(counts, totals, learn(counts, classes, model_file)))
    dropped(counts)
    blocks = table.select("block").distinct().count()
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), blocks)
    known = words.select("block", "word", "code").join(scores, "word").select("block", "code", "c", "lp")
    texts = table.where("word is null").select(F.col("block").alias("text_block"), "doc_id", "held_out", "n_tokens", "codes")
    of_label = totals.log_label()

    def joined(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        code = right.column("code").to_numpy()
        c, lp = np.zeros(len(code), np.int64), np.zeros((len(code), classes), "<f4")
        c[code] = right.column("c").to_numpy()
        lp[code] = np.frombuffer(b"".join(right.column("lp").to_pylist()), "<f4").reshape(-1, classes)
        base = np.log10((c + 1) / (tokens + distinct + 1))
        lengths = left.column("n_tokens").to_numpy()
        codes = np.frombuffer(b"".join(left.column("codes").to_pylist()), "<u4")
        starts = np.cumsum(lengths) - lengths
        n_known, base_score = (np.add.reduceat(x[codes], starts) for x in ((c > 0).astype(np.int64), base))
        # one class at a time, so that a block's tokens are held once
        by_class = np.stack([np.add.reduceat(lp[:, k].astype(float)[codes], starts) + of_label[k] for k in range(classes)])
        top = by_class.max(0)
        own = top + np.log10(np.power(10.0, by_class - top).sum(0))
        n = left.num_rows
        return pa.table([left.column("doc_id"), left.column("held_out"), left.column("n_tokens"), pa.array(n_known, pa.int64()), pa.array([tokens] * n, pa.int64()), pa.array(base_score, pa.float64()), pa.array(own, pa.float64())], names=[x.split()[0] for x in _SCORES.split(", ")])

    return texts.repartition(parts, "text_block").groupBy("text_block").cogroup(known.repartition(parts, "block").groupBy("block")).applyInArrow(joined, _SCORES)
