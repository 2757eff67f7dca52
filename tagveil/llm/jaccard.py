"""Near-duplicates by the Jaccard similarity of word-shingle sets, 0.8 or more, exactly (shingles and sets are known by 64-bit hashes).

The groups are found in two steps. First the fingerprints of whole texts meet by the Golay
keys of ``simhash``, and every set is tried with the one set that it shares most keys with;
what these propose is verified on the whole sets. That finds copies and nearly all edited
copies, but not all pairs of 0.8. So a prefix filter then proposes the pairs that are left,
between different components, and they are verified the same way.

Two sets so similar share at least 4/5 of each one's shingles. In any one order of all
shingles, the first they share is then among the first n - ceil(4n/5) + 1 of either set of n
(prefix filter), so equality of those keys misses no pair. The order puts shingles last that
a sample of documents finds common, which keeps the runs of one key short. It only steers the
work: the result is the same in every order. Bucket counts rule out most candidates, by a
bound; the rest are verified on the whole sets. The links' components are the groups.

A large group of near copies would give all its pairs; after the first step most of it is
one component, and only pairs in different components are left to try.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagveil.llm.common import dropped, map_arrow, resident, stored, sub_batches, texts_of
from tagveil.llm.components import connected_components
from tagveil.llm.simhash import keep_first, majority, shingle_hashes, similar_fingerprints

#: One of so many documents tells which shingles are common, at so many occurrences there; so many are known at most.
SAMPLE, OFTEN, MOST_COMMON = 16, 3, 50_000
#: Bytes that are sent to a Python worker at once.
SENT_BYTES = 8 << 20
#: Counts of a set's shingles by their low bits; a count at FULL says nothing.
BUCKETS, FULL = 256, 255
#: An odd factor that puts names of sets in another order.
RANK = np.uint64(0x9E3779B97F4A7C15)
#: Rows of a key above which all of them stay without a look at their partners.
LONG_RUN = 1024
#: Pairs of one key that are written at once.
BLOCK = 1 << 16


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """Distinct shingle hashes, sorted."""
    return np.unique(shingle_hashes(text, shingle))


def similar(shared: int, a: int, b: int) -> bool:
    """Jaccard similarity of 0.8 or more, in whole numbers: shared / (a + b - shared) >= 4/5."""
    return 9 * shared >= 4 * (a + b)


def prefix(found: np.ndarray, common: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The first n - ceil(4n/5) + 1 of a sorted set, by how often a shingle is in the sample, then by value."""
    n = len(found)
    count = np.zeros(n, np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, found), len(common) - 1)
        count = np.where(common[at] == found, often[at], 0)
    return found[np.argsort(count, kind="stable")[: n - (4 * n + 4) // 5 + 1]] if n else found


def sketch(found: np.ndarray) -> bytes:
    """Bucket counts; the sum of two sketches' lesser counts is never below the shingles shared."""
    counts = np.bincount((found & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
    return (counts if counts.max() < FULL else np.full(BUCKETS, FULL)).astype(np.uint8).tobytes()


def common_shingles(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, occurrences) of the sample's most common ones, by value."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident("nothing", dict)
        for batch in sub_batches(batches):
            for text in texts_of(batch):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text, shingle).view(np.int64))], names=["key"])

    sample = docs.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select("text").distinct()
    count = map_arrow(sample, rows, "key long").groupBy("key").count().where(F.col("count") >= OFTEN)
    top = count.orderBy(F.desc("count"), "key").limit(MOST_COMMON).collect()
    keys, often = np.array([r["key"] for r in top], np.int64).view(np.uint64), np.array([r["count"] for r in top], np.int64)
    order = np.argsort(keys)
    return keys[order], often[order]


def marked(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, text_hash, fp, sid, n, keys, sketch): the text's fingerprint; the set's name, size, prefix in its order and bucket counts."""
    common, often = common_shingles(docs, shingle)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident("nothing", dict)
        for batch in sub_batches(batches):
            fps, sids, sizes, keys, sketches = [], [], [], [], []
            for text in texts_of(batch):
                hashes = shingle_hashes(text, shingle)
                fps.append(majority(hashes))
                found = np.unique(hashes)
                sids.append(xxhash.xxh64_intdigest(found.tobytes()))
                sizes.append(len(found))
                keys.append(prefix(found, common, often).view(np.int64))
                sketches.append(sketch(found))
            ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (fps, sids)), pa.array(sizes, pa.int32()), lists, pa.array(sketches, pa.binary())], names=["doc_id", "text_hash", "fp", "sid", "n", "keys", "sketch"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text"), rows, "doc_id long, text_hash long, fp long, sid long, n int, keys array<long>, sketch binary")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """Rows sorted by key as (key, columns) of every key with two rows or more; a run may reach over batches and is put together once."""
    held: list[dict[str, np.ndarray]] = []

    def whole() -> Iterator[tuple[int, dict[str, np.ndarray]]]:
        if sum(len(x["key"]) for x in held) > 1:
            yield int(held[0]["key"][0]), {c: np.concatenate([x[c] for x in held]) for c in held[0]}
        held.clear()

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
        key = cols["key"]
        starts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]]).tolist()
        for k, (start, stop) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
            part = {c: x[start:stop] for c, x in cols.items()}
            if k == 0 and held and held[0]["key"][0] != key[0]:
                yield from whole()
            if k == 0 or stop == len(key):
                if k:
                    yield from whole()
                held.append({c: x.copy() for c, x in part.items()})
            else:
                yield from whole()
                if stop - start > 1:
                    yield int(key[start]), part
    yield from whole()


def _batched(parts: Iterator[list[np.ndarray]], names: list[str]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], names=names)

    for part in parts:
        held.append(part)
        n += len(part[0])
        if n >= BLOCK:
            yield out()
            held, n = [], 0
    if n:
        yield out()


def shared_keys(rows: DataFrame) -> DataFrame:
    """(key, sid, n, pos, lead) of the keys by which two sets or more can be similar, each set once a key.

    ``lead`` is one set of the key's run, the same where runs have the same sets, and the set itself where these two can't be similar by this key.
    """
    names = ["key", "sid", "n", "pos"]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[list[np.ndarray]]:
            for _, run in _runs(batches):
                at = np.unique(run["sid"], return_index=True)[1]
                if 1 < len(at) <= LONG_RUN:
                    n, pos = run["n"][at].astype(np.int64), run["pos"][at].astype(np.int64)
                    fits = 9 * np.minimum((n - pos)[:, None], (n - pos)[None, :]) >= 4 * (n[:, None] + n[None, :])
                    np.fill_diagonal(fits, False)
                    at = at[fits.any(1)]
                if len(at) > 1:
                    cols = [run[c][at] for c in names]
                    _, sid, n, pos = cols
                    first = int(np.argmin(sid.view(np.uint64) * RANK))
                    yield [*cols, np.where(_possible(n, pos, int(n[first]), int(pos[first])), sid[first], sid)]

        yield from _batched(each(), [*names, "lead"])

    keys = rows.select("sid", "n", F.posexplode("keys").alias("pos", "key")).select(*names)
    return map_arrow(keys.repartition("key").sortWithinPartitions("key"), found, "key long, sid long, n int, pos int, lead long")


def _possible(n: np.ndarray, pos: np.ndarray, own_n: int, own_pos: int) -> np.ndarray:
    """Whether a key at these places can be the first shared one of similar sets: enough shingles follow in both."""
    return 9 * np.minimum(n - pos, own_n - own_pos).astype(np.int64) >= 4 * (n.astype(np.int64) + own_n)


def star_pairs(shared: DataFrame) -> DataFrame:
    """(a, b): every set with the one set, of those that lead a key's run, that leads most of its keys."""
    led = shared.where("lead != sid").groupBy("lead", "sid").count()
    return led.groupBy("sid").agg(F.max(F.struct("count", "lead")).alias("m")).select(F.col("m.lead").alias("a"), F.col("sid").alias("b"))


def _shares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether sets with sketches x (a row each) can be similar to those with sketches y (a row each, or one for all)."""
    shared, sizes = np.minimum(x, y).sum(-1, dtype=np.int64), x.sum(-1, dtype=np.int64) + y.sum(-1, dtype=np.int64)
    return (9 * shared >= 4 * sizes) | (x[..., 0] == FULL) | (y[..., 0] == FULL)


def left_pairs(shared: DataFrame, most: int = LONG_RUN) -> DataFrame:
    """(a, b, root_a, root_b): all pairs of sets with a common key that are in different components and can be similar, with their components.

    ``shared`` has each set's sketch, which rules most pairs out where they meet, so that those
    are never rows. A key with more than ``most`` rows is cut into blocks; each two of its
    blocks are a task's work of their own, so that a common key is no task for all its pairs.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[list[np.ndarray]]:
            for _, run in _runs(batches):
                if (run["root"] == run["root"][0]).all():
                    continue
                across = len(np.unique(run["block"])) > 1  # two blocks: pairs within one are found where it meets itself
                sketches = np.frombuffer(b"".join(run["sketch"].tolist()), np.uint8).reshape(-1, BUCKETS)
                for i in range(len(run["sid"]) - 1):
                    rest = slice(i + 1, None)
                    ok = (run["root"][rest] != run["root"][i]) & _possible(run["n"][rest], run["pos"][rest], int(run["n"][i]), int(run["pos"][i]))
                    if across:
                        ok &= run["block"][rest] != run["block"][i]
                    at = i + 1 + np.flatnonzero(ok)
                    at = at[_shares(sketches[at], sketches[i])] if len(at) else at
                    if len(at):
                        sids, roots = ((np.full(len(at), run[c][i]), run[c][at]) for c in ("sid", "root"))
                        first = sids[0] < sids[1]
                        yield [np.where(first, *sids), np.where(first, *sids[::-1]), np.where(first, *roots), np.where(first, *roots[::-1])]

        yield from _batched(each(), ["a", "b", "root_a", "root_b"])

    hot = shared.groupBy("key").count().where(F.col("count") > most).select("key", F.ceil(F.col("count") / most).cast("int").alias("blocks"))
    cut = shared.join(hot, "key", "left").withColumn("block", F.when(F.col("blocks").isNull(), 0).otherwise(F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int")))
    other = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = cut.withColumn("other", other)
    name = F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other"))
    met = met.select(F.when(F.col("blocks").isNull(), F.col("key")).otherwise(name).alias("key"), "sid", "n", "pos", "root", "block", "sketch")
    return map_arrow(met.repartition("key").sortWithinPartitions("key"), rows, "a long, b long, root_a long, root_b long").distinct()


def likely(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (a, b) that the sketches (sid, sketch) do not rule out."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BUCKETS) for c in ("of_a", "of_b"))
                yield batch.select(["a", "b"]).filter(pa.array(_shares(x, y)))

    return map_arrow(_beside(pairs, sketches, "sketch"), rows, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """The pairs (a, b and other numbers) whose whole sets, of texts (sid, text), are similar."""
    names = pairs.columns

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident("nothing", dict)
        for whole in batches:
            for batch in sub_batches(iter([whole]), "of_a"):
                ok = []
                for x, y in zip(texts_of(batch, "of_a"), texts_of(batch, "of_b"), strict=True):
                    x, y = shingle_set(x, shingle), shingle_set(y, shingle)
                    ok.append(similar(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)))
                yield batch.select(names).filter(pa.array(ok, pa.bool_()))

    return map_arrow(_beside(pairs, texts, "text"), rows, ", ".join(f"{c} long" for c in names))


def _beside(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """The pairs with of_a and of_b: the column of either sid beside the pair."""
    of = [table.select(F.col("sid").alias(x), F.col(column).alias(f"of_{x}")) for x in ("a", "b")]
    return pairs.join(of[0], "a").join(of[1], "b").select(*pairs.columns, "of_a", "of_b")


def whole_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(sid, text) of wanted (sid, doc_id, text_hash)."""
    own = docs.select(F.col("doc_id").cast("long").alias("own_id"), F.xxhash64("text").alias("own_hash"), "text")
    found = own.join(wanted, F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_hash") == F.col("text_hash")))
    return found.select("sid", "text").dropDuplicates(["sid"])


def _kept_table(df: DataFrame) -> DataFrame:
    """Stored, in small batches to Python, and the shuffle files of what is no longer in use given back, as the rounds would pile them up."""
    spark, name = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(name)
    spark.conf.set(name, str(SENT_BYTES))
    try:
        out = stored(df)
    finally:
        spark.conf.set(name, was)
    gc.collect()
    spark.sparkContext._jvm.java.lang.System.gc()
    return out


def proposed(rows: DataFrame) -> DataFrame:
    """(a, b): sets of equal or near fingerprints, each fingerprint standing for its least set."""
    sets = rows.where("n > 0").select("fp", "sid").distinct()
    least = _kept_table(sets.groupBy("fp").agg(F.min("sid").alias("least")))
    same = sets.join(least, "fp").where("sid != least").select(F.col("least").alias("a"), F.col("sid").alias("b"))
    near = similar_fingerprints(least.select("fp"))
    of = [least.select(F.col("fp").alias(x), F.col("least").alias(f"of_{x}")) for x in ("a", "b")]
    return same.unionByName(near.join(of[0], "a").join(of[1], "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))).where("a != b")


def components(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, text_hash, root) of every row; root names the component."""
    rows = _kept_table(marked(docs, shingle))
    shared = _kept_table(shared_keys(rows.where("n > 0")))
    near = proposed(rows).unionByName(star_pairs(shared))
    first = _kept_table(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    wanted = shared.select("sid").unionByName(first.select(F.explode(F.array("a", "b")).alias("sid"))).distinct()
    of_shared = _kept_table(rows.select("sid", "doc_id", "text_hash", "sketch").join(wanted, "sid", "left_semi").groupBy("sid").agg(F.min(F.struct("doc_id", "text_hash", "sketch")).alias("m")).select("sid", "m.*"))
    texts = _kept_table(whole_texts(docs, of_shared.select("sid", "doc_id", "text_hash")))

    links = _kept_table(verified(likely(first, of_shared), texts, shingle))
    roots = connected_components(links)
    of_key = shared.join(roots, shared.sid == roots.node, "left").select("key", "sid", "n", "pos", F.coalesce("root", "sid").alias("root"))
    # only keys with sets of several components have pairs left
    mixed = of_key.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("key")
    of_key = of_key.join(mixed, "key", "left_semi").join(of_shared.select("sid", "sketch"), "sid")
    rest = _kept_table(verified(left_pairs(of_key), texts, shingle))
    if not rest.isEmpty():  # components that are linked become one; a set without links was one by itself
        joined = connected_components(rest.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))
        later = joined.select(F.col("node").alias("root"), F.col("root").alias("further"))
        alone = joined.join(roots.select("node"), "node", "left_anti")
        roots = _kept_table(roots.join(later, "root", "left").select("node", F.coalesce("further", "root").alias("root")).unionByName(alone))
    dropped(shared, of_shared, texts, first)
    of_rows = rows.select("doc_id", "text_hash", "sid")
    return of_rows.join(roots, of_rows.sid == roots.node, "left").select("doc_id", "text_hash", F.coalesce("root", "sid").alias("root"))


def kept(docs: DataFrame, shingle: int) -> DataFrame:
    """One document of each component, with the columns of ``docs``, as ``simhash.keep_first`` takes it.

    Null and empty texts have no shingle and are copies of each other; a very long text is
    compared whole. Of equal sets, and of rows equal in id and text, one document stays; null
    ids come last; names of columns may clash with any of ours; an empty table gives no row.
    """
    return keep_first(docs, _kept_table(components(docs, shingle).select("root", "doc_id", "text_hash")))
