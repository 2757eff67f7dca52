"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments. If two fingerprints differ in at most four
bits, then either some segment is equal in both and one of the other two differs in at most
two bits, or every segment differs, two of them in one bit (so a half of each is equal) and
the third in at most two. Segments that differ in at most two bits share an index of a
nearby Golay codeword, so both cases are equalities of compound keys. Fingerprints with
equal keys are compared; the links' components are the groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagveil.llm import golay
from tagveil.llm.common import as_rows, map_arrow, resident, stored, sub_batches, texts_of
from tagveil.llm.components import connected_components

SHINGLE, SEED, DISTANCE = 4, 42, 4
#: (lowest bit, width) of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Fingerprints of one key that are compared at once.
BLOCK = 2048


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of all word shingles in order, repeats included; a text of fewer words is one shingle."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    if n <= shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    joined = memoryview(b" ".join(words))
    starts = np.zeros(n + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1, out=starts[1:])
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[: n - shingle + 1].tolist(), (starts[shingle:] - 1).tolist(), strict=True)), np.uint64, n - shingle + 1)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Majority of each bit over the hashes of all word shingles, repeats included; 0 without words."""
    return majority(shingle_hashes(text, shingle))


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    if len(hashes) < 2:
        return int(hashes[0]) if len(hashes) else 0
    if len(hashes) < 2000:
        counts = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0)
    else:  # by bytes: 256 counts for each of the eight
        lanes = hashes.view(np.uint8).reshape(-1, 8)
        of_byte = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
        counts = np.concatenate([np.bincount(lanes[:, i], minlength=256) @ of_byte for i in range(8)])
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_hash, fp): the fingerprint as a signed long."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident("nothing", dict)
        for batch in sub_batches(batches):
            found = np.array([fingerprint(text, shingle) for text in texts_of(batch)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(found.view(np.int64))], names=["doc_id", "text_hash", "fp"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text"), rows, "doc_id long, text_hash long, fp long")


def compound_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every compound key of unsigned fingerprints."""
    whole = [(fps >> np.uint64(at)) & np.uint64((1 << width) - 1) for at, width in SEGMENTS]
    near = [golay.near_keys(w.astype(np.int64), width) for w, (_, width) in zip(whole, SEGMENTS, strict=True)]
    rows, keys = [], []

    def add(kind: int, exact: np.ndarray, codes: np.ndarray) -> None:
        row, column = np.nonzero(codes >= 0)
        # 24 bits at most of exact parts, 12 of the index, 5 of the kind
        keys.append((np.uint64(kind) << np.uint64(40)) | (exact[row] << np.uint64(12)) | codes[row, column].astype(np.uint64))
        rows.append(row)

    kind = 0
    for i, j in product(range(3), repeat=2):  # segment i equal, segment j within two bits
        if i != j:
            add(kind, whole[i], near[j])
            kind += 1
    for k in range(3):  # a half of each of two segments equal, segment k within two bits
        i, j = (x for x in range(3) if x != k)
        halves = []
        for s in (i, j):
            low = np.uint64(SEGMENTS[s][1] // 2)
            halves.append((whole[s] & ((np.uint64(1) << low) - np.uint64(1)), whole[s] >> low))
        for a, b in product(range(2), repeat=2):
            add(kind, (halves[0][a] << np.uint64(12)) | halves[1][b], near[k])
            kind += 1
    return np.concatenate(rows), np.concatenate(keys)


def spanning_links(fps: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Links that connect whatever is connected by pairs within ``distance``: a tree for each component.

    Breadth first from the least; every fingerprint is compared once with those not yet reached.
    """
    links, left = [], np.sort(fps)
    queue: list[int] = []
    while len(left):
        if not queue:
            queue, left = [int(left[0])], left[1:]
        here = queue.pop()
        close = np.bitwise_count(left ^ np.uint64(here)) <= distance
        if close.any():
            found = left[close].tolist()
            links += [(here, x) for x in found]
            queue += found
            left = left[~close]
    return links


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, fp) to links: each key's run, which may reach over batches, is compared within itself."""
    held_key: int | None = None
    held: list[np.ndarray] = []
    seen: set[tuple[int, int]] = set()

    def out() -> pa.RecordBatch:
        pairs = np.array(sorted(seen), np.uint64).reshape(-1, 2).view(np.int64)
        seen.clear()
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    def compare(run: np.ndarray) -> None:
        if len(run) > 1:
            seen.update(spanning_links(run))

    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column("key").to_numpy(zero_copy_only=False)
        fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        starts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
        first = 0
        if held and key[0] == held_key:  # the run goes on; its parts are put together once, when it ends
            held.append(fp[: starts[1]].copy())
            first = 1
        if first == len(starts) - 1:
            continue
        if held:
            compare(np.concatenate(held))
        held_key, held = int(key[-1]), [fp[starts[-2] :].copy()]
        whole, sizes = starts[first:-2], np.diff(starts)[first:-1]
        two = whole[sizes == 2]
        close = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= DISTANCE]
        seen.update(zip(fp[close].tolist(), fp[close + 1].tolist(), strict=True))
        for s, n in zip(whole[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            compare(fp[s : s + n])
        if len(seen) > 200_000:
            yield out()
    if held:
        compare(np.concatenate(held))
    if seen:
        yield out()


def similar_fingerprints(fps: DataFrame) -> DataFrame:
    """Distinct (fp) to links (a, b) whose components are those of all pairs within four bits."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                fp = batch.column("fp").slice(at, BLOCK).to_numpy(zero_copy_only=False)
                row, key = compound_keys(fp.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(fp[row])], names=["key", "fp"])

    keys = map_arrow(fps, keyed, "key long, fp long")
    # keys are nearly all distinct, so hashing them spreads evenly; only the runs of one key meet
    return map_arrow(keys.repartition("key").sortWithinPartitions("key", "fp"), _linked, "a long, b long").distinct()


def components(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_hash, fp, root, component_id) of every row; root is a fingerprint of the component."""
    marked = stored(fingerprints(docs, shingle))
    owners = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(similar_fingerprints(owners.select("fp")))
    of_root = owners.join(roots, owners.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    groups = of_root.groupBy("root").agg(F.min("least").alias("component_id"))
    named = of_root.join(groups, "root").select("fp", "root", "component_id")
    return marked.join(named, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Fingerprint and component of every document.

    Null and empty texts have fingerprint zero and are linked like any other; repeated rows
    return each time; a null doc_id never names a component unless all of it are null; a bit
    that half the hashes have is 0; a very long text is read whole; an empty table gives no
    row; columns besides doc_id and text are not looked at.
    """
    return components(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` that come first in their group, by ``found`` (root, doc_id, text_hash): least doc_id (null last), then text hash; of rows equal in both one stays."""
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_hash")).alias("m"))
    first = stored(first.select(F.col("m.doc_id").alias("_k_id"), F.col("m.text_hash").alias("_k_hash")))
    own = as_rows(docs).withColumn("_own_id", F.col("_row.doc_id").cast("long")).withColumn("_own_hash", F.xxhash64("_row.text"))
    same = F.col("_own_id").eqNullSafe(F.col("_k_id")) & (F.col("_own_hash") == F.col("_k_hash"))
    out = own.join(first, same, "left_semi")
    repeated = found.groupBy("doc_id", "text_hash").count().where("count > 1")
    if not repeated.isEmpty():  # the same id and text more than once: one row of them
        out = out.dropDuplicates(["_own_id", "_own_hash"])
    return out.select("_row.*")
