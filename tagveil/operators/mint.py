"""Tag numbers: the lowest free ones of each prefix, given out in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagveil.functions import text as T
from tagveil.operators.order import numbered


#: Rows in a row that may meet what is known of their prefix in one task, as a power of two.
_BLOCK_BITS = 18


def clean_prefix(prefix: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(F.upper(prefix), "[^A-Z0-9]+", "_"), "^_+|_+$", ""), F.lit("")), F.lit("TAG"))


def tag_of(prefix: Column, number: Column) -> Column:
    return F.concat(F.lit("[["), prefix, F.lit("_"), number.cast("string"), F.lit("]]"))


def taken_numbers(taken: DataFrame) -> DataFrame:
    """(prefix, n), each once: the numbers of tags that have one."""
    number = F.regexp_extract("tag", r"^\[\[[A-Z0-9_]+_([1-9][0-9]{0,17})\]\]$", 1).try_cast("long")
    prefix = F.regexp_extract("tag", r"^\[\[([A-Z0-9_]+)_[1-9][0-9]{0,17}\]\]$", 1)
    return taken.select(prefix.alias("prefix"), number.alias("n")).where("n is not null").distinct()


def _within_prefix(rows: DataFrame, order: list, name: str) -> DataFrame:
    """Number rows from 1 within their prefix, by ranges of the whole order: a prefix may have all rows.

    Rows meet the place of their prefix's first one by block and prefix, so that no task has all rows of a prefix.
    """
    placed = numbered(rows, ["prefix", *order], "_pos").withColumn("_block", F.shiftright("_pos", _BLOCK_BITS))
    own = placed.groupBy("_block", "prefix").agg(F.min("_pos").alias("_first"))
    firsts = own.withColumn("_first", F.min("_first").over(W.partitionBy("prefix")))
    return placed.join(firsts, ["_block", "prefix"]).withColumn(name, F.col("_pos") - F.col("_first") + 1).drop("_block", "_pos", "_first")


def gaps(taken: DataFrame) -> DataFrame:
    """(prefix, free_below, upto): of the sorted taken numbers t_1 < t_2 ..., t_i - i free ones lie below t_i; ``upto`` is the last i with as many."""
    at = _within_prefix(taken_numbers(taken), ["n"], "i")
    return at.groupBy("prefix", (F.col("n") - F.col("i")).alias("free_below")).agg(F.max("i").alias("upto"))


def free_numbers(wanted: DataFrame, taken: DataFrame) -> DataFrame:
    """(prefix, k, number): the k-th free number of a prefix; ``wanted`` (prefix, k) has each k from 1 to a prefix's most, once.

    An as-of merge: a taken number goes behind as many wanted ones as there are free ones
    below it, and a wanted one's place in that order is its number.
    """
    at = _within_prefix(taken_numbers(taken), ["n"], "i")
    both = wanted.select("prefix", F.col("k").cast("long").alias("after"), F.lit(True).alias("wanted")).unionByName(at.select("prefix", (F.col("n") - F.col("i")).alias("after"), F.lit(False).alias("wanted")))
    merged = _within_prefix(both, ["after", F.col("wanted").desc()], "number")
    return merged.where("wanted").select("prefix", F.col("after").alias("k"), "number")


def mint(new: DataFrame, taken: DataFrame, scope: list[str], order: list) -> DataFrame:
    """Add ``tag`` to keys (``prefix`` and more) that need one: of a prefix, the k-th new key of a scope gets the k-th number that no ``taken`` tag has.

    Without a scope the whole table is numbered, by ranges. Within one, such as a document,
    keys are numbered there; documents share the free numbers, which are found once.
    """
    new = new.withColumn("prefix", clean_prefix(F.col("prefix")))
    keyed = new.withColumn("k", F.row_number().over(W.partitionBy(*scope, "prefix").orderBy(*order)).cast("long")) if scope else _within_prefix(new, order, "k")
    numbers = free_numbers(keyed.select("prefix", "k").distinct(), taken)
    return keyed.join(numbers, ["prefix", "k"]).withColumn("tag", tag_of(F.col("prefix"), F.col("number"))).drop("k", "number")


def next_tag(wanted: DataFrame, taken: DataFrame) -> DataFrame:
    """(ord, type) typed in by hand to (ord, type, tag): the type's prefix and the lowest free numbers, tags in any case counted as taken."""
    new = wanted.withColumn("prefix", T.prefix_of_type(F.col("type")))
    return mint(new, taken.select(F.upper("tag").alias("tag")), [], ["ord"]).select("ord", "type", "tag")
