"""The trie of conversations' shared prefixes, with sums over its subtrees by heavy paths.

A node is a distinct sequence of first turns. Its name is 128 bits: hashes of each turn and
its place, summed along the conversation, so that names come from running sums and no text
is put together. Conversations are numbered by ranges of the whole order and summed in
blocks of turns, so none needs a task of its own, however long.

Subtree sums go along heavy paths. Each node's child with the most conversations is its
heavy child; a path runs down heavy children to a leaf. A light child has at most half of its
parent's conversations, so no node is below more than log2(conversations) light ones. The
light nodes above a path are its level. From the deepest level up, each path's values are
suffix-summed in arrays, and what its top has got is added to the node it hangs from.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagveil.llm.common import dropped, stored
from tagveil.operators.order import numbered

#: Entries of an array that is summed at once.
BLOCK = 1024
#: Ids whose decimals are joined to one string before they are hashed.
CHUNK = 512
#: Conversations of a family share the first turns of its first one.
FAMILY, MOST_SHARED = 100, 6
_PIECES = ("s1", "s2", "s3", "s4")


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, num, t1, t2, chars): turns numbered through by conversation and turn (null first; equal ones by role, then text).

    A turn is known by two hashes of its role and text, null ones as empty. Rows without a
    conv_id belong to no conversation and are left out; repeated rows are turns of their own.
    """
    c = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *(F.coalesce(F.col(x).cast("string"), F.lit("")).alias(x) for x in ("role", "text")))
    named = c.withColumns({"t1": F.xxhash64("role", "text"), "t2": F.xxhash64(F.lit(2), "text", "role"), "chars": F.char_length("text").cast("long")})
    return numbered(named, ["conv_id", "turn", "role", "text"], "num", ["conv_id", "t1", "t2", "chars"])


def whole(turns: DataFrame) -> DataFrame:
    """(conv_id, at, t1, t2, chars, length) of ``turns_of``: every conversation as it is, ``at`` from 0."""
    sizes = turns.groupBy("conv_id").agg(F.min("num").alias("first"), F.count("*").alias("length"))
    return turns.join(sizes, "conv_id").select("conv_id", (F.col("num") - F.col("first")).alias("at"), "t1", "t2", "chars", "length")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, at, t1, t2, chars, length) and (conv_id, length): each conversation's first turns replaced by those of its family's first one."""
    sizes = turns.groupBy("conv_id").agg(F.min("num").alias("first"), F.count("*").alias("n"))
    firsts = turns.where(F.col("conv_id") % FAMILY == 0).join(sizes, "conv_id").where(F.col("num") - F.col("first") < MOST_SHARED)
    heads = firsts.groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("num", "t1", "t2", "chars"))).alias("shown"))
    shared = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(MOST_SHARED)).cast("int")
    known = sizes.withColumns({"h": shared, "base": F.col("conv_id") - F.col("conv_id") % FAMILY}).join(heads, "base", "left")
    head = F.coalesce(F.slice("shown", F.lit(1), F.col("h")), F.expr("cast(array() as array<struct<num:bigint,t1:bigint,t2:bigint,chars:bigint>>)"))
    known = known.withColumn("head", head).withColumn("m", F.size("head")).withColumn("length", F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    known = stored(known.select("conv_id", "first", "h", "m", "head", "length"))
    given = known.select("conv_id", "length", F.posexplode("head").alias("at", "t")).select("conv_id", F.col("at").cast("long").alias("at"), "t.t1", "t.t2", "t.chars", "length")
    own = turns.join(known.drop("head"), "conv_id").where(F.col("num") - F.col("first") >= F.col("h"))
    own = own.select("conv_id", (F.col("num") - F.col("first") - F.col("h") + F.col("m")).alias("at"), "t1", "t2", "chars", "length")
    return given.unionByName(own), known.select("conv_id", "length")


def running_sums(rows: DataFrame, key: str, values: tuple[str, ...], most: int, block: int = BLOCK) -> DataFrame:
    """Replace ``values`` by their sums over the rows of a key with the same or a lesser ``at`` (distinct, 0 to ``most`` - 1).

    Rows of a key lie in arrays of ``block`` places. Beyond one array, the arrays' sums are
    summed the same way and added.
    """
    rest = [c for c in rows.columns if c not in (key, "at")]
    each = F.array_sort(F.collect_list(F.struct("at", *rest)))
    blocks = rows.groupBy(key, F.expr(f"at div {block}").alias("block")).agg(each.alias("each"))
    sums = ",".join(f"{v}:bigint" for v in values)
    start = F.struct(F.struct(*(F.lit(0).cast("long").alias(v) for v in values)).alias("now"), F.expr(f"cast(array() as array<struct<{sums}>>)").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        now = F.struct(*((acc["now"][v] + x[v]).alias(v) for v in values))
        return F.struct(now.alias("now"), F.array_append(acc["out"], now).alias("out"))

    summed = blocks.withColumn("sums", F.aggregate("each", start, step, lambda acc: acc["out"]))
    before = {v: F.lit(0).cast("long") for v in values}
    if most > block:
        summed = stored(summed)
        own = summed.select(key, F.col("block").alias("at"), *(F.element_at("sums", -1)[v].alias(v) for v in values), *(F.element_at("sums", -1)[v].alias(f"own_{v}") for v in values))
        upto = running_sums(own, key, values, -(-most // block), block)
        summed = summed.join(upto.select(key, F.col("at").alias("block"), *((F.col(v) - F.col(f"own_{v}")).alias(f"before_{v}") for v in values)), [key, "block"])
        before = {v: F.col(f"before_{v}") for v in values}
    out = summed.select(key, *(before[v].alias(f"before_{v}") for v in values), F.explode(F.arrays_zip("each", "sums")).alias("x"))
    return out.select(key, "x.each.at", *(F.col(f"x.each.{c}").alias(c) for c in rest if c not in values), *((F.col(f"x.sums.{v}") + F.col(f"before_{v}")).alias(v) for v in values))


def _name(depth: Column, pieces: list[Column]) -> tuple[Column, Column]:
    return F.xxhash64(depth, *pieces), F.xxhash64(*reversed(pieces), depth)


def _root() -> tuple[Column, Column]:
    zero = F.lit(0).cast("long")
    return _name(zero, [zero] * 4)


def prefixes(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, depth, k1, k2, p1, p2, chars, ends): the names of every conversation's prefixes and of their parents."""
    most = (turns.agg(F.max("at")).first()[0] or 0) + 1
    a, b = F.xxhash64("at", "t1", "t2"), F.xxhash64("t2", "at", "t1")
    low = lambda c: c.bitwiseAND(0xFFFFFFFF)
    own = dict(zip(_PIECES, (low(a), F.shiftrightunsigned(a, 32), low(b), F.shiftrightunsigned(b, 32)), strict=True))
    pieced = turns.select("conv_id", "at", "chars", "length", *(v.alias(k) for k, v in own.items()), *(v.alias(f"own_{k}") for k, v in own.items()))
    summed = running_sums(pieced, "conv_id", _PIECES, most, block)
    k1, k2 = _name(F.col("at") + 1, [F.col(c) for c in _PIECES])
    p1, p2 = _name(F.col("at"), [F.col(c) - F.col(f"own_{c}") for c in _PIECES])
    return summed.select("conv_id", (F.col("at") + 1).alias("depth"), k1.alias("k1"), k2.alias("k2"), p1.alias("p1"), p2.alias("p2"), "chars", (F.col("at") + 1 == F.col("length")).alias("ends"))


def digests(ends: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256) of (k1, k2, conv_id): SHA-256 of each name's ids, ascending, in decimal, comma-joined.

    Ids are joined in short runs first; a name's runs then go through its hash in order, as they come.
    """
    run = F.floor(F.col("conv_id") / CHUNK).cast("long")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    runs = ends.groupBy("k1", "k2", run.alias("run")).agg(ids.alias("ids"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out = None, None, []
        for batch in batches:
            for k1, k2, text in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "ids")), strict=True):
                if (k1, k2) != now:
                    if now is not None:
                        out.append((*now, state.hexdigest()))
                    now, state = (k1, k2), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(text.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=["k1", "k2", "ends_sha256"])
                out = []
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, state.hexdigest())], names=["k1", "k2", "ends_sha256"])

    return runs.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "run").select("k1", "k2", "ids").mapInArrow(rows, "k1 long, k2 long, ends_sha256 string")


def nodes_of(found: DataFrame) -> DataFrame:
    """(k1, k2, conv_id, n_convs, depth, p1, p2, chars, n_children, light): the nodes below the root."""
    nodes = stored(found.groupBy("k1", "k2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *(F.min(c).alias(c) for c in ("depth", "p1", "p2", "chars"))))
    # conv_id and depth name a node as well; of equally large children the one with the least conv_id is heavy
    kids = stored(nodes.groupBy("p1", "p2").agg(F.count("*").alias("n_children"), F.max(F.struct("n_convs", (-F.col("conv_id")).alias("least"))).alias("most"), F.min("depth").alias("depth")))
    heavy = kids.select((-F.col("most.least")).alias("conv_id"), "depth", F.lit(False).alias("light"))
    counts = kids.select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), "n_children")
    out = nodes.join(counts, ["k1", "k2"], "left").join(heavy, ["conv_id", "depth"], "left")
    return stored(out.withColumns({"n_children": F.coalesce("n_children", F.lit(0)), "light": F.coalesce("light", F.lit(True))}))


def subtree_sums(found: DataFrame, nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """(k1, k2, depth, n_leaves, saved_tokens) of every node below the root, by heavy paths from the deepest level up."""
    leaves = nodes.where("n_children = 0").select("conv_id")
    own = nodes.select("k1", "k2", "light", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"))
    # a path is named by the conversation of its leaf, and is the end of it from the last light node on
    lines = stored(found.select("conv_id", "depth", "k1", "k2", "p1", "p2").join(leaves, "conv_id", "left_semi").join(own, ["k1", "k2"]))
    light = F.when(F.col("light"), F.col("depth"))
    tops = lines.groupBy("conv_id").agg(F.coalesce(F.max(light), F.lit(1)).alias("top"), F.max("depth").alias("bottom"), F.count(light).cast("int").alias("level"))
    paths = stored(lines.join(tops, "conv_id").where("depth >= top").select("conv_id", (F.col("bottom") - F.col("depth")).alias("at"), "depth", "k1", "k2", "p1", "p2", "n_leaves", "saved_tokens", (F.col("depth") == F.col("top")).alias("is_top"), "level"))
    dropped(lines)
    deepest, most = paths.agg(F.max("level"), F.max("at")).first()
    sums, hung = [], None
    for level in range(deepest if deepest is not None else -1, -1, -1):
        rows = paths.where(F.col("level") == level).drop("level")
        if hung is not None:
            rows = rows.join(hung, ["k1", "k2"], "left").withColumns({c: F.col(c) + F.coalesce(f"hung_{c}", F.lit(0)) for c in ("n_leaves", "saved_tokens")}).drop("hung_n_leaves", "hung_saved_tokens")
        done = stored(running_sums(rows, "conv_id", ("n_leaves", "saved_tokens"), most + 1, block))
        sums.append(done.select("k1", "k2", "depth", "n_leaves", "saved_tokens"))
        tops_ = done.where("is_top and depth > 1").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2"))
        hung = tops_.agg(F.sum("n_leaves").alias("hung_n_leaves"), F.sum("saved_tokens").alias("hung_saved_tokens"))
    out = sums[0] if sums else paths.select("k1", "k2", "depth", "n_leaves", "saved_tokens")
    for more in sums[1:]:
        out = out.unionByName(more)
    return out


def trie(turns: DataFrame, lengths: DataFrame, block: int = BLOCK) -> DataFrame:
    """The nodes of conversations (conv_id, at, t1, t2, chars, length) and their lengths (conv_id, length), turnless ones included.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).
    A node's turns are the first ``depth`` of its ``conv_id``, the least of its conversations.
    The root has depth 0 and no parent; without a conversation there is no node.
    """
    spark = lengths.sparkSession
    found = stored(prefixes(turns, block))
    nodes = nodes_of(found)
    sums = stored(subtree_sums(found, nodes, block))
    ends = found.where("ends").select("k1", "k2", "conv_id").unionByName(lengths.where("length = 0").select(_root()[0].alias("k1"), _root()[1].alias("k2"), "conv_id"))
    hashed = stored(digests(ends))
    least, n_convs = lengths.agg(F.min("conv_id"), F.count("*")).first()
    n_children, n_leaves, saved = sums.where("depth = 1").agg(F.count("*"), F.sum("n_leaves"), F.sum("saved_tokens")).first()
    value = lambda x: F.lit(x).cast("long")
    root = spark.range(1 if n_convs else 0).select(
        _root()[0].alias("k1"), _root()[1].alias("k2"), value(least).alias("conv_id"), value(0).alias("depth"), value(None).alias("parent_conv_id"), value(n_convs).alias("n_convs"),
        value(n_children).alias("n_children"), value(n_leaves or 1).alias("n_leaves"), value(saved or 0).alias("saved_tokens"),
    )
    above = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    below = nodes.where("depth > 1").join(above, ["p1", "p2"]).unionByName(nodes.where("depth = 1").withColumn("parent_conv_id", value(least)))
    full = below.join(sums.drop("depth"), ["k1", "k2"]).select(*root.columns).unionByName(root)
    out = full.join(hashed, ["k1", "k2"], "left")
    return out.select(*root.columns[2:], F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """``trie`` of the rebuilt conversations."""
    turns, lengths = rebuilt(turns_of(conversations))
    return trie(turns, lengths)


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """``trie`` of conversations as they are."""
    turns = whole(turns_of(conversations))
    return trie(turns, turns.select("conv_id", "length").distinct())
