"""Improbable-feature digests: rare byte windows in chained Bloom filters.

Every 64-byte window of a text has a rank by its entropy: running text crowds around one
level, and windows are the rarer the further they are from it, on either side; padding and
packed bytes at both ends say little and are left out. A window that is the rarest of
many runs of 64 consecutive windows is a feature. A short text has few such windows, so it
adds features of smaller windows, found in the same way. Features enter Bloom filters of fixed
size, a new one being chained on when one is full. Two digests are compared filter by
filter by their common bits, normalised by what chance gives and what equality would give.

Ranks are a fixed function of entropy, not counts of one corpus: digests of different corpora,
and of the same text on another day, must be comparable, and equal texts have equal digests.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagveil.llm.common import map_arrow, sub_batches, texts_of

WINDOW, RUN = 64, 64
#: Runs that a window must be the rarest of.
LEAST_RUNS = 16
#: Texts of fewer bytes add features of smaller windows; beside a longer text only their other features count, as the smaller set does.
SHORT = 512
SHORT_WINDOW, SHORT_RUN, SHORT_LEAST_RUNS = 8, 4, 2
#: Bits of a filter, bits set by a feature, features of a full filter.
FILTER_BITS, HASHES, FILTER_FEATURES = 2048, 5, 160
#: Share of the way from chance to equality that counts as nothing in common.
FLOOR = 0.2
#: Entropy in thousandths of the highest possible, and the classes its rarity is counted in.
LEVELS = 1000
CROWD, _LOW, _HIGH = {WINDOW: 620, SHORT_WINDOW: 915}, 100, {WINDOW: 990, SHORT_WINDOW: LEVELS}
CHUNK_BYTES = 1 << 20
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x94D049BB133111EB], np.uint64)


def _plogp(window: int) -> np.ndarray:
    """c/w log2(w/c) for c occurrences in a window of w bytes, in units whose sum is exact in integers."""
    c = np.arange(window + 1, dtype=float)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.nan_to_num(np.round(c / window * np.log2(window / c) * (1 << 20))).astype(np.int32)


_TERM = {w: _plogp(w) for w in (WINDOW, SHORT_WINDOW)}
#: log2(w) bits are the most that w bytes can have.
_FULL = {w: (w.bit_length() - 1) << 20 for w in (WINDOW, SHORT_WINDOW)}


def ranks(entropy: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Rank of windows by entropy level, the lower the rarer; 0 to 1000, 1001 for windows never taken.

    Running text crowds around ``CROWD``, so rarity grows with the distance from there; levels outside the limits (padding, tables, packed bytes) say little.
    """
    level = np.arange(LEVELS + 1)
    rank = LEVELS - np.abs(level - CROWD[window])
    rank[(level < _LOW) | (level > _HIGH[window])] = LEVELS + 1
    return rank.astype(np.int16)[entropy]


def entropies(data: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Entropy level of each window of one byte array, from running counts.

    Moving on by a byte changes two terms of the sum: that of the byte that leaves, by how
    often it occurs up to a window's length on, and that of the byte that enters, by how often
    it occurs as far back. Sorted by byte and place, both counts are ranges.
    """
    n, term = len(data), _TERM[window]
    total = np.empty(n - window + 1, np.int64)
    total[0] = term[np.bincount(data[:window], minlength=256)].sum()
    if n > window:
        order = np.argsort(data, kind="stable")
        kind = np.int32 if n < 1 << 22 else np.int64
        key = data[order].astype(kind) * kind(n + window) + order.astype(kind)
        low = np.searchsorted(key, key - kind(window - 1))
        index = np.arange(n)
        back, on = np.empty(n, np.int64), np.empty(n, np.int64)
        back[order] = index - low + 1
        on[order] = np.cumsum(np.bincount(low, minlength=n)) - index
        step = term[1:] - term[:-1]
        total[1:] = step[back[window:] - 1] - step[on[: n - window] - 1]
        np.cumsum(total, out=total)
    return total * LEVELS // _FULL[window]


def hash_windows(data: np.ndarray, at: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """A 64-bit hash of the windows that start at ``at``."""
    if not len(at):
        return np.zeros(0, np.uint64)
    words = data[at[:, None] + np.arange(window)].view("<u8")
    odd = _ODD[: window // 8]
    mixed = words * odd
    mixed ^= mixed >> np.uint64(29)
    h = (mixed * odd[::-1]).sum(1, dtype=np.uint64)
    for shift, odd in ((31, _ODD[0]), (27, _ODD[1]), (33, _ODD[2])):
        h ^= h >> np.uint64(shift)
        h *= odd
    return h ^ (h >> np.uint64(32))


def levels_of(text: bytes, like: tuple[int, np.ndarray] | None = None) -> np.ndarray:
    """Entropy levels of a text of a window's length at least; ``like``: a beginning shared with another text, and its levels."""
    data = np.frombuffer(text, np.uint8)
    shared = max(0, min(like[0] - WINDOW + 1, len(like[1]))) if like else 0
    if not shared:
        return entropies(data)
    return np.concatenate([like[1][:shared], entropies(data[shared:])]) if shared + WINDOW <= len(data) else like[1][: len(data) - WINDOW + 1]


def rarest(rank: np.ndarray, run: int, least: int) -> np.ndarray:
    """Places of the windows that are the leftmost rarest of at least ``least`` runs; the leftmost rarest of all if there is none."""
    n = len(rank)
    at = np.zeros(0, np.int64)
    if n >= run:
        # minima of (rank, place) by doubling
        bits, kind = (20, np.int32) if n < 1 << 20 else (40, np.int64)
        best = (rank.astype(kind) << kind(bits)) | np.arange(n, dtype=kind)
        step = 1
        while step < run:
            best = np.minimum(best[: len(best) - step], best[step:])
            step *= 2
        wins = np.bincount(best & kind((1 << bits) - 1), minlength=n)
        at = np.flatnonzero((wins >= least) & (rank <= LEVELS))
    return at if len(at) else np.array([int(rank.argmin())])


def features(text: bytes, level: np.ndarray | None = None) -> np.ndarray:
    """Hashes of a text's features in order of place, each once, those of smaller windows behind the others.

    A shorter text than a smaller window is padded to a window; no text has none.
    """
    if not text:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(text, np.uint8)
    if len(text) < SHORT_WINDOW:
        return hash_windows(np.frombuffer(text + bytes(WINDOW - len(text)), np.uint8), np.zeros(1, np.int64))
    hashes = np.zeros(0, np.uint64)
    if len(text) >= WINDOW:
        hashes = hash_windows(data, rarest(ranks(levels_of(text) if level is None else level), RUN, LEAST_RUNS))
    if len(text) < SHORT:
        at = rarest(ranks(entropies(data, SHORT_WINDOW), SHORT_WINDOW), SHORT_RUN, SHORT_LEAST_RUNS)
        hashes = np.concatenate([hashes, hash_windows(data, at, SHORT_WINDOW)])
    if len(hashes) > 1:
        _, once = np.unique(hashes, return_index=True)
        hashes = hashes[np.sort(once)]
    return hashes


class Digest:
    """Chained filters: a bit matrix and the features in each row."""

    def __init__(self, text: bytes, level: np.ndarray | None = None):
        hashes = features(text, level)
        n = len(hashes)
        chain = -(-n // FILTER_FEATURES)
        self.bits = np.zeros((chain, FILTER_BITS), bool)
        shifts = np.arange(HASHES, dtype=np.uint64) * np.uint64(11)
        places = (hashes[:, None] >> shifts) & np.uint64(FILTER_BITS - 1)
        self.bits[np.repeat(np.arange(n) // FILTER_FEATURES, HASHES), places.ravel().astype(np.int64)] = True
        self.sizes = np.bincount(np.arange(n) // FILTER_FEATURES, minlength=chain)[:chain]
        self.set = self.bits.sum(1)
        self.n = n

    def __str__(self) -> str:
        packed = np.packbits(self.bits, axis=1).tobytes()
        return f"{self.n}:{len(self.sizes)}:{base64.b64encode(packed).decode()}"

    def likeness(self, other: Digest) -> float:
        """Mean over the shorter digest's filters of the best normalised overlap with the other's, 0 to 1."""
        if not self.n or not other.n:
            return float(self.n == other.n)
        a, b = (self, other) if (len(self.sizes), self.n) <= (len(other.sizes), other.n) else (other, self)
        total, theirs = 0.0, b.bits.astype(np.float32).T
        for i in range(0, len(a.sizes), 64):
            mine = a.set[i : i + 64, None].astype(float)
            common = a.bits[i : i + 64].astype(np.float32) @ theirs
            most = np.minimum(mine, b.set)
            chance = mine * b.set / FILTER_BITS
            floor = chance + FLOOR * (most - chance)
            total += ((common - floor) / np.maximum(most - floor, 1e-9)).clip(0, 1).max(1).sum()
        return float(total / len(a.sizes))


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(text: str, following: str) -> str:
    """The last quarter of the characters (rounded down) gives way to the first as many of the next text, or all of it."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


def _row(doc_id: int | None, text: str, own: bytes, level: np.ndarray | None, digest: Digest, following: str, next_digest: Digest) -> tuple:
    changed = edited(text, following).encode("utf-8")
    like = None
    if level is not None and len(changed) >= WINDOW:
        like = levels_of(changed, (len(text[: len(text) - len(text) // 4].encode("utf-8")), level))
    other = digest if changed == own else Digest(changed, like)
    return doc_id, len(text), hashlib.sha256(changed).hexdigest(), str(digest), str(other), digest.likeness(other), digest.likeness(next_digest)


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by piece, own rows before the borrowed one, doc_id; each own row meets the row behind it."""
    names, kinds = [x.split()[0] for x in _SCHEMA.split(", ")], [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    waiting = None
    for batch in sub_batches(batches, limit=CHUNK_BYTES):
        out = []
        for borrowed, doc_id, own in zip(batch.column("borrowed").to_pylist(), batch.column("doc_id").to_pylist(), texts_of(batch), strict=True):
            if borrowed and waiting is None:
                continue  # equal to the borrowed row before it
            text = own.decode("utf-8", "replace")
            if waiting and waiting[2] == own:
                level, digest = waiting[3:5]
            else:
                level = levels_of(own) if len(own) >= WINDOW else None
                digest = Digest(own, level)
            if waiting:
                out.append(_row(*waiting, text, digest))
            waiting = None if borrowed else (doc_id, text, own, level, digest)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def digests(docs: DataFrame, pieces: int | None = None) -> DataFrame:
    """Fingerprint every whole text and its edited text (its last quarter replaced by the next document's start).

    Documents follow each other by doc_id (null first; equal ids by a hash of the text and the
    text, so repeated rows are neighbours and give equal values); after the last comes the
    first. A null text is empty; an empty text has the digest ``0:0:`` and is like another
    empty one only; a single document is its own next; an empty table gives no row; columns
    besides doc_id and text are not looked at.

    The documents are dealt into ranges of doc_id, those without one into ranges of the hash, and sorted, so the next one is the next row,
    and the first document of each range goes to the range before it as well. The bounds are
    few and any bounds give the same result, so approximate quantiles do. Tasks stream: they
    hold one document and its successor.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    pieces = pieces or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = docs.approxQuantile("doc_id", [i / pieces for i in range(1, pieces)], 0.2 / pieces) if pieces > 1 else []
    bounds = np.array(sorted({int(b) for b in found}), np.int64)

    @F.pandas_udf("int")
    def behind(ids: pd.Series) -> pd.Series:
        return pd.Series(pieces + np.searchsorted(bounds, ids, side="right"))

    # rows without an id go first, by even ranges of their hash
    no_id, h = F.col("doc_id").isNull(), F.xxhash64("text")
    piece = F.when(no_id, F.expr(f"cast(((xxhash64(text) >> 32) + 2147483648) * {pieces} div 4294967296 as int)")).otherwise(behind(F.coalesce("doc_id", F.lit(0))))

    def leading(rows: DataFrame, least: Column) -> DataFrame:
        return rows.select(piece.alias("piece"), least.alias("least")).groupBy("piece").agg(F.min("least").alias("least"))

    firsts = leading(docs.where(no_id), h).union(leading(docs.where(~no_id), F.col("doc_id"))).orderBy("piece").collect()
    if not firsts:
        return map_arrow(docs.select(F.lit(False).alias("borrowed"), "doc_id", "text"), _followed, _SCHEMA)
    first = {r.piece: r.least for r in firsts}
    before = dict(zip(first, [*first][-1:] + [*first][:-1], strict=True))

    @F.pandas_udf("array<struct<piece:int,borrowed:boolean>>")
    def places(place: pd.Series, key: pd.Series) -> pd.Series:
        out = []
        for p, k in zip(place.tolist(), key.tolist(), strict=True):
            own = {"piece": p, "borrowed": False}
            out.append([own, {"piece": before[p], "borrowed": True}] if first[p] == k else [own])
        return pd.Series(out)

    placed = docs.withColumn("place", F.explode(places(piece, F.coalesce("doc_id", h)))).select("place.piece", "place.borrowed", "doc_id", h.alias("h"), "text")
    dealt = placed.repartition("piece").sortWithinPartitions("piece", "borrowed", F.col("doc_id").asc_nulls_first(), "h", "text")
    return map_arrow(dealt.select("borrowed", "doc_id", "text"), _followed, _SCHEMA)
