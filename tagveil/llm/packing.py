"""Sum-of-squares online packing of token documents into fixed windows.

Documents are cut into full windows and a tail; each tail goes, as it arrives, to the open
window whose growth leaves the smallest sum of squared counts of partly filled windows by
fill level. The counts live in one level array; full windows leave at once. When a packing
group ends, its open windows are closed by moving the emptiest ones' pieces, cut where
needed, into the gaps of the fullest, so at most one window of a group is not full.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagveil.llm.common import map_arrow, resident, stored, sub_batches, texts_of

DEFAULT_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
WINDOW, END_ID = 2048, 1
#: Tokens that one packing group holds on average, and windows of a document's body in one row.
GROUP_TOKENS, ROW_WINDOWS = 1_000_000, 32
#: Share of a group that equal rows must make up together before they are dealt out one by one.
HEAVY = 1 / 8
CACHE_WORDS, CACHED_LENGTH = 800_000, 64
#: A control character that the tokenizer keeps as one id which nothing else gives.
_FENCE = b"\x01"
#: Latin letters up to U+024F in UTF-8, and marks that are no letter, digit or apostrophe. U+0130 is left out, as it folds to two characters.
_LATIN = re.compile(rb"((?:[a-z]|\xc3[\xa0-\xb6\xb8-\xbf]|\xc4[\x80-\xaf\xb1-\xbf]|[\xc5-\xc8][\x80-\xbf]|\xc9[\x80-\x8f])+)([!\"#$%&()*+,\-./:;=?@\[\\\]^_`{|}~]*)")


class Encoder:
    """Ids as little-endian bytes, by remembering blank-separated words.

    The tokenizer folds white space and case and never joins across white space, so a text's
    ids are those of its blank-separated parts one after the other (tested against whole
    texts). New words are encoded in one string, fenced by a control character.
    """

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        self.model, self.memory = Tokenizer.from_file(file), {}
        self.kind = np.dtype("<u2" if self.model.get_vocab_size() <= 1 << 16 else "<u4")
        (self.fence,) = self._ids(_FENCE)
        self.ends = np.zeros(self.model.get_vocab_size(), bool)
        self.ends[[i for piece, i in self.model.get_vocab().items() if piece.endswith("</w>")]] = True

    def _ids(self, text: bytes) -> np.ndarray:
        (found,) = self.model.encode_batch_fast([text.decode("utf-8", "replace")], add_special_tokens=False)
        return np.array(found.ids, self.kind)

    def words(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of each word.

        Latin letters are one piece and so end with the first id that ends a word; marks
        behind them are a piece of their own. Other words are fenced, and those that could
        mean more than themselves in a longer string go alone.
        """
        out: dict[bytes, bytes] = {}
        letters: set[bytes] = set()
        fenced: set[bytes] = set()
        both: list[tuple[bytes, bytes, bytes]] = []
        memory = self.memory
        for word in words:
            found = _LATIN.fullmatch(word)
            if found is None:
                fenced.add(word)
            elif tail := found[2]:
                both.append((word, found[1], tail))
                letters.add(found[1])
                fenced.add(tail)
            else:
                letters.add(word)
        known = {w: memory[w] for w in letters | fenced if w in memory}
        for word in [w for w in fenced if _FENCE in w or b"<|" in w]:
            out[word] = self._ids(word).tobytes()
        self._joined(sorted(letters - known.keys()), b" ", lambda ids: self.ends[ids], 1, out)
        self._joined(sorted(fenced - known.keys() - out.keys()), b" " + _FENCE + b" ", lambda ids: ids == self.fence, 0, out)
        known |= out
        for word, head, tail in both:
            out[word] = known[head] + known[tail]
        return out

    def _joined(self, words: list[bytes], between: bytes, ends: Callable[[np.ndarray], np.ndarray], own: int, out: dict[bytes, bytes]) -> None:
        """Encode words as one string; ``own``: an end belongs to its word (1) or stands between words (0)."""
        width = self.kind.itemsize
        for at in range(0, len(words), 50_000):
            some = words[at : at + 50_000]
            ids = self._ids(between.join(some))
            stops = (np.flatnonzero(ends(ids)) + own).tolist() + ([] if own else [len(ids)])
            if len(stops) != len(some) or own and stops[-1] != len(ids):  # a word that ends oftener than once: each by itself
                out |= {word: self._ids(word).tobytes() for word in some}
                continue
            data, start = ids.tobytes(), 0
            for word, stop in zip(some, stops, strict=True):
                out[word] = data[start * width : stop * width]
                start = stop + 1 - own

    def encode(self, texts: list[bytes]) -> list[bytes]:
        memory = self.memory
        if len(memory) > CACHE_WORDS:
            memory.clear()
        parts = [(text if b"<|" in text else text.lower()).split() for text in texts]
        seen: set[bytes] = set()
        for p in parts:
            seen.update(p)
        new = list(seen.difference(memory))
        memory |= self.words(new)
        out = [b"".join(map(memory.__getitem__, p)) for p in parts]
        for word in [w for w in new if len(w) > CACHED_LENGTH]:
            del memory[word]
        return out


def encoder(file: str) -> Encoder:
    return resident(f"encoder {file}", lambda: Encoder(file))


class Packer:
    """One group's packing. ``place`` takes pieces of at most a window; closed windows are returned as lists of (offset, piece)."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.levels = np.zeros(window + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(window + 1)]

    def place(self, size: int, piece) -> list | None:
        """Put a piece of ``size`` ids at the best level; the window, if that fills it."""
        c = self.window
        if size == c:
            return [(size, piece)]
        n = self.levels
        cost = 2 * (n[size:] - n[: c + 1 - size]) + 2  # what moving one window from h to h + size adds to the sum
        cost[c - size] -= 1  # a window that fills up is counted no longer
        cost[n[: c + 1 - size] == 0] = np.iinfo(np.int64).max
        cost[0] = 2 * n[size] + 1
        h = len(cost) - 1 - int(cost[::-1].argmin())  # of equals the fullest
        pieces = self.open[h].pop() if h else []
        n[h] -= h > 0
        pieces.append((size, piece))
        if h + size == c:
            return pieces
        n[h + size] += 1
        self.open[h + size].append(pieces)
        return None

    def close(self, cut) -> Iterator[list]:
        """The remaining windows; ``cut(piece, size)`` gives the first ``size`` ids and the rest."""
        windows = [[fill, pieces] for fill, level in enumerate(self.open) for pieces in level]
        self.open, self.levels[:] = [[] for _ in range(self.window + 1)], 0
        low, high = 0, len(windows) - 1
        while low < high:
            gap = self.window - windows[high][0]
            size, piece = windows[low][1].pop()
            if size > gap:
                head, rest = cut(piece, gap)
                windows[low][1].append((size - gap, rest))
                size, piece = gap, head
            windows[high][1].append((size, piece))
            windows[high][0] += size
            windows[low][0] -= size
            if windows[high][0] == self.window:
                yield windows[high][1]
                high -= 1
            if not windows[low][1]:
                low += 1
        if low == high:
            yield windows[low][1]


_ROWS = "doc_id long, start long, doc_tokens long, ids binary"
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def token_rows(docs: DataFrame, tokenizer: str = DEFAULT_TOKENIZER, end_id: int = END_ID, window: int = WINDOW) -> DataFrame:
    """Ids of each whole text and the end id, in rows of at most ``ROW_WINDOWS`` windows (2 bytes an id where the vocabulary allows)."""
    kind = encoder(tokenizer).kind
    width, end = kind.itemsize, np.array([end_id], kind).tobytes()
    step = width * window * ROW_WINDOWS

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        for batch in sub_batches(batches):
            out = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(texts_of(batch)), strict=True):
                ids += end
                out += [(doc_id, at // width, len(ids) // width, ids[at : at + step]) for at in range(0, len(ids), step)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "start", "doc_tokens", "ids"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text")), rows, _ROWS)


def numbered(rows: DataFrame, most_bytes: float) -> DataFrame:
    """Add ``content``, a hash of the ids, and ``nth``, which tells equal rows apart where they are many.

    Equal rows (id, place and ids) share a hash and so a group. Those that take up more than
    ``most_bytes`` together are few; they are counted, reduced to one and numbered.
    """
    names = ("doc_id", "start", "content")
    rows = rows.withColumn("content", F.xxhash64("ids"))
    heavy = rows.groupBy(*names).agg(F.count("*").alias("times"), F.sum(F.length("ids")).alias("size")).where((F.col("times") > 1) & (F.col("size") > most_bytes))
    heavy = stored(heavy.select(*(F.col(c).alias(f"heavy_{c}") for c in names), "times"))
    if heavy.isEmpty():
        return rows.withColumn("nth", F.lit(0))
    same = [F.col(c).eqNullSafe(F.col(f"heavy_{c}")) for c in names]
    marked = rows.join(heavy, same[0] & same[1] & same[2], "left").drop(*(f"heavy_{c}" for c in names))
    single = marked.where("times is null").drop("times").withColumn("nth", F.lit(0))
    several = marked.where("times is not null").dropDuplicates(list(names))
    return single.unionByName(several.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).drop("times"))


def pack(docs: DataFrame, tokenizer: str = DEFAULT_TOKENIZER, end_id: int = END_ID, window: int = WINDOW, group_tokens: int = GROUP_TOKENS, with_ids: bool = False) -> DataFrame:
    """Pack all documents; one row per piece, with its ids if asked for.

    Null and empty texts are one end id. Repeated rows and repeated or null doc_ids are
    documents of their own. Rows are dealt to groups by a hash of id, start and ids, the number
    of groups following the tokens, so a long document spreads over groups, as do documents
    without an id and rows that are equal in great numbers (``numbered``), and no group grows
    with the input; in a group the order is by that hash, so reruns agree. Of levels that cost
    the same the fullest is taken. A very long text is encoded as a whole and leaves in rows
    of ``ROW_WINDOWS`` windows. An empty table gives no row; columns besides doc_id and text
    are not looked at.
    """
    spark = docs.sparkSession
    rows = stored(token_rows(docs, tokenizer, end_id, window))
    total = rows.agg(F.sum(F.length("ids"))).first()[0] or 0
    kind = encoder(tokenizer).kind
    width = kind.itemsize
    groups = max(1, round(total / width / group_tokens))
    dealt = numbered(rows, group_tokens * HEAVY * width)
    dealt = dealt.withColumn("h", F.xxhash64(F.lit(5), "doc_id", "start", "content", "nth"))
    dealt = dealt.withColumn("g", F.pmod("h", F.lit(groups))).withColumn("h", F.xxhash64("h"))
    parts = min(groups, max(int(spark.conf.get("spark.sql.shuffle.partitions")), groups // 16))
    # groups are dealt out by range, as hashing a few of them would leave some tasks with several
    dealt = dealt.repartitionByRange(parts, "g").sortWithinPartitions("g", "h", "doc_id", "start", "nth", "ids")

    def cut(piece, size):
        doc_id, start, total, ids = piece
        return (doc_id, start, total, ids[: width * size]), (doc_id, start + size, total, ids[width * size :])

    names = [x.split()[0] for x in _PIECES.split(", ")] + ["ids"] * with_ids
    kinds = [pa.int64()] * 7 + [pa.binary()] * with_ids

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, packer, number, out = None, Packer(window), 0, []

        def emit(pieces: list) -> None:
            nonlocal number
            at = 0
            for size, (doc_id, start, total, ids) in pieces:
                ids = np.frombuffer(ids, kind).astype("<u4").tobytes()
                out.append((doc_id, start, size, zlib.crc32(ids), total, group << 32 | number, at, *[ids] * with_ids))
                at += size
            number += 1

        def batch_out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
            out.clear()
            return made

        for batch in batches:
            for g, doc_id, start, total, ids in zip(*(batch.column(c).to_pylist() for c in ("g", "doc_id", "start", "doc_tokens", "ids")), strict=True):
                if g != group:
                    if group is not None:
                        for pieces in packer.close(cut):
                            emit(pieces)
                    group, number = g, 0
                for at in range(0, len(ids), width * window):
                    piece = ids[at : at + width * window]
                    full = packer.place(len(piece) // width, (doc_id, start + at // width, total, piece))
                    if full:
                        emit(full)
                if len(out) >= 20_000:
                    yield batch_out()
        if group is not None:
            for pieces in packer.close(cut):
                emit(pieces)
        if out:
            yield batch_out()

    return map_arrow(dealt.select("g", "doc_id", "start", "doc_tokens", "ids"), packed, _PIECES + ", ids binary" * with_ids)
