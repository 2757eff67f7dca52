"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Every source gets a target number of words. The whole times that it goes into the target
are certain copies of each of its documents; the rest is a sample without repeats, of fixed
size in words. A document's inclusion probability follows the root of its size class,
capped at one; its rank is its random odds divided by its inclusion odds, and the sample is
the front of that order. What its last whole document leaves open is closed by redrawing
the few documents around the cut, so that their words come as near to the target as they can.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagveil.llm.common import WORD_REGEX, stored

WEIGHTS = (5, 2, 1)
MAX_REPEATS, SHARE = 3, 1.0
#: Slices of the order (uniform in the share of odds) that are counted before one is sorted.
SLICES = 4096
SEED = 20_011
#: Documents before and behind the cut that are redrawn to meet the target; all their subsets are tried.
FRONT, OPEN = 6, 7
#: A target met to this share is met: of the subsets that do, the one with fewest changes to the order's front is taken.
NEAR = 0.001
#: Copies this near to a whole number are that number.
WHOLE = 1e-9


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_REGEX)), F.lit(0)).cast("long")


def _marked(docs: DataFrame, doc_id: Column, source: Column, size: Column) -> DataFrame:
    """Add size, size class and a random number made from id and size alone."""
    out = docs.withColumn("_size", size).withColumn("_source", source.cast("string"))
    out = out.withColumn("_class", F.floor(F.log2(F.greatest("_size", F.lit(1)).cast("double"))).cast("int"))
    out = out.withColumn("_hash", F.xxhash64(F.lit(SEED), doc_id, F.col("_size")))
    return out.withColumn("_id", doc_id).withColumn("_u", (F.col("_hash").bitwiseAND(F.lit((1 << 52) - 1)) + 0.5) / float(1 << 52))


def _filled(total: Column, cap: Column, weight: Column, order: W) -> Column:
    """The level at which ``min(cap, level * weight)`` adds up to ``total``.

    With the first rows of the order (by cap/weight) at their caps, the rest share what is
    left; the right number of capped rows gives the highest such level.
    """
    before = order.rowsBetween(W.unboundedPreceding, -1)
    rest = F.sum(weight).over(order.rowsBetween(0, W.unboundedFollowing))
    return F.when(rest > 0, (total - F.coalesce(F.sum(cap).over(before), F.lit(0))) / rest)


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, share: float = SHARE) -> DataFrame:
    """(_source, _size) sums of each source to its weight and target; one row a source.

    Sources by code point, null last, take the weights in turn. What a source's cap leaves
    over goes to the others by weight, until none is above its cap.
    """
    ranked = sizes.withColumn("_rank", F.row_number().over(W.orderBy(F.col("_source").asc_nulls_last())))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.col("_rank") - 1) % len(weights) + 1).cast("int"))
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ranked = ranked.withColumn("_weight", weight).withColumn("_cap", (F.col("_size") * max_repeats).cast("double")).withColumn("_total", F.sum("_size").over(every) * F.lit(float(share)))
    ranked = ranked.withColumn("_level", _filled(F.col("_total"), F.col("_cap"), F.col("_weight"), W.orderBy(F.col("_cap") / F.col("_weight"), "_rank")))
    return ranked.withColumn("_target", F.least("_cap", F.max("_level").over(every) * F.col("_weight"))).select("_source", F.col("_size").alias("_source_size"), "_rank", "_weight", "_target")


@dataclass
class Plan:
    """What the decisions need."""

    #: By source and size class: whole copies, inclusion probability, target.
    rates: DataFrame
    #: By source: the slice of the cut, the key of the last document before it, the keys put in and left out by the redraw.
    cuts: DataFrame
    #: Keys of equal rows around the cut, of which ``_take`` are in the sample.
    ties: DataFrame
    any_ties: bool


def _ranked(marked: DataFrame, rates: DataFrame) -> DataFrame:
    of = rates.withColumnRenamed("_source", "_r_source").withColumnRenamed("_class", "_r_class")
    out = marked.join(of, F.col("_source").eqNullSafe(F.col("_r_source")) & (F.col("_class") == F.col("_r_class"))).drop("_r_source", "_r_class")
    odds = F.col("_u") / (1 - F.col("_u"))
    # certain documents first (0), impossible ones never (null)
    out = out.withColumn("_q", F.when(F.col("_pi") >= 1, F.lit(0.0)).when(F.col("_pi") > 0, odds / (F.col("_pi") / (1 - F.col("_pi")))))
    return out.withColumn("_slice", F.least(F.floor(F.col("_q") / (1 + F.col("_q")) * SLICES), F.lit(SLICES - 1)).cast("int"))


_ORDER = ("_q", "_u", "_hash", "_id", "_size")


def _movable() -> Column:
    """Certain documents stay, impossible ones and those without a word are no help."""
    return (F.col("_q") > 0) & (F.col("_size") > 0)


def _redrawn(keys: DataFrame, extra: DataFrame, cuts: DataFrame) -> DataFrame:
    """(_rank, _key, _all, _take, _now) of the keys around each cut: how many of its equal rows are taken before and after the redraw.

    ``keys`` are the documents around the cuts, ``extra`` at most one more a source. At most
    FRONT + OPEN + 1 of a source's are redrawn, and every subset of them is a row of its own.
    """
    key = F.struct(*_ORDER).alias("_key")
    units = lambda df, low, high: df.select("_rank", key, "_all", "_take", F.explode(F.sequence(low, high)).alias("_unit"))
    taken, still = keys.where("_take > 0"), keys.where("_take < _all")
    taken = units(taken, F.greatest(F.lit(1), F.col("_take") - FRONT + 1), F.col("_take"))
    still = units(still, F.col("_take") + 1, F.least(F.col("_all"), F.col("_take") + OPEN))
    taken = taken.withColumn("_no", F.row_number().over(W.partitionBy("_rank").orderBy(F.desc("_key"), F.desc("_unit")))).where(F.col("_no") <= FRONT)
    still = still.withColumn("_no", F.row_number().over(W.partitionBy("_rank").orderBy("_key", "_unit"))).where(F.col("_no") <= OPEN)
    more = units(extra, F.lit(1).cast("long"), F.lit(1).cast("long")).withColumn("_no", F.lit(0))
    both = taken.withColumn("_in", F.lit(True)).unionByName(still.withColumn("_in", F.lit(False))).unionByName(more.withColumn("_in", F.lit(False)))
    both = both.dropDuplicates(["_rank", "_key", "_unit"])
    most = FRONT + OPEN + 1
    sets = both.groupBy("_rank").agg(F.array_sort(F.collect_list(F.struct("_key", "_unit", "_in", "_all", "_take"))).alias("_units")).join(cuts.select("_rank", "_gap", "_goal"), "_rank")
    size = lambda i: F.coalesce(F.get(F.col("_units"), i)["_key"]["_size"], F.lit(0))
    is_in = lambda i: F.coalesce(F.get(F.col("_units"), i)["_in"], F.lit(False))
    at_first = sum((F.when(is_in(i), 1 << i).otherwise(0) for i in range(1, most)), F.when(is_in(0), 1).otherwise(0))
    tried = sets.select("_rank", "_gap", "_goal", at_first.alias("_at_first"), *(size(i).alias(f"_s{i}") for i in range(most)), F.explode(F.expr("sequence(0, (1 << size(_units)) - 1)")).alias("_set"))
    change = F.lit(0)
    for i in range(most):
        change = change + F.col(f"_s{i}") * (F.col("_set").bitwiseAND(1 << i) - F.col("_at_first").bitwiseAND(1 << i)) / (1 << i)
    off = F.abs(F.col("_gap") - change)
    far = F.greatest(off - F.col("_goal") * NEAR, F.lit(0.0))
    best = tried.groupBy("_rank").agg(F.min(F.struct(far.alias("far"), F.bit_count(F.col("_set").bitwiseXOR(F.col("_at_first"))).alias("changes"), off.alias("off"), "_set")).alias("m"))
    each = sets.join(best, "_rank").select("_rank", F.col("m._set").alias("_set"), F.posexplode("_units").alias("_bit", "u"))
    each = each.withColumn("_change", F.expr("cast((_set >> _bit) & 1 as int)") - F.col("u._in").cast("int"))
    return each.groupBy("_rank", F.col("u._key").alias("_key"), F.col("u._all").alias("_all"), F.col("u._take").alias("_take")).agg((F.first("u._take") + F.sum("_change")).alias("_now"))


def plan(marked: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, share: float = SHARE) -> Plan:
    """Fix rates, cuts and the documents redrawn around them from the marked documents (ids and sizes only)."""
    classes = stored(marked.groupBy("_source", "_class").agg(F.sum("_size").alias("_words")))
    by_source = targets(classes.groupBy("_source").agg(F.sum("_words").alias("_size")), weights, max_repeats, share)
    ratio = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(0.0)
    by_source = by_source.withColumn("_whole", F.floor(ratio + WHOLE).cast("int")).withColumn("_rest", F.greatest(F.lit(0.0), F.col("_target") - F.col("_whole") * F.col("_source_size")))
    by_source = by_source.withColumn("_rest", F.when(F.col("_rest") > WHOLE * F.col("_source_size"), F.col("_rest")).otherwise(0.0))
    of = stored(by_source).withColumnRenamed("_source", "_of")
    rates = classes.join(of, F.col("_source").eqNullSafe(F.col("_of"))).drop("_of")
    # at most 63 classes a source; the longest documents reach certainty first
    root = F.pow(F.lit(2.0), F.col("_class") / 2)
    level = _filled(F.col("_rest"), F.col("_words"), F.col("_words") * root, W.partitionBy("_rank").orderBy(F.col("_class").desc()))
    rates = rates.withColumn("_level", level).withColumn("_pi", F.least(F.lit(1.0), F.coalesce(F.max("_level").over(W.partitionBy("_rank")), F.lit(0.0)) * root))
    rates = stored(rates.withColumn("_pi", F.when(F.col("_pi") > 1 - WHOLE, 1.0).otherwise(F.col("_pi"))).drop("_level", "_words"))
    ranked = stored(_ranked(marked, rates))
    slices = ranked.where(F.col("_slice").isNotNull()).groupBy("_rank", "_slice").agg(F.sum("_size").alias("_words"), F.count_if(_movable()).alias("_n"), F.first("_rest").alias("_rest"), F.first("_target").alias("_goal"))
    # at most SLICES rows a source
    before = W.partitionBy("_rank").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    reach = slices.select("*", F.coalesce(F.sum("_words").over(before), F.lit(0)).alias("_before"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n_before"))
    reach = stored(reach)
    cuts = reach.where(F.col("_before") <= F.col("_rest")).groupBy("_rank").agg(F.max(F.struct("_slice", "_before", "_n_before", "_n", "_goal")).alias("m"))
    cuts = stored(cuts.select("_rank", F.col("m._slice").alias("_cut"), F.col("m._before").alias("_before"), F.col("m._n_before").alias("_c_before"), F.col("m._n").alias("_c_n"), F.col("m._goal").alias("_goal")))
    # only the slice that the cut is in gets sorted: about one document in SLICES
    running = F.sum("_size").over(W.partitionBy("_rank").orderBy(*_ORDER).rowsBetween(W.unboundedPreceding, 0))
    at = ranked.join(cuts, "_rank").where(F.col("_slice") == F.col("_cut")).withColumn("_in", F.col("_before") + running <= F.col("_rest"))
    at = stored(at.groupBy("_rank", *_ORDER).agg(F.count("*").alias("_all"), F.count_if("_in").alias("_take"), F.first("_rest").alias("_rest"), F.first("_before").alias("_before")))
    last = at.groupBy("_rank").agg(
        F.max(F.when(F.col("_take") == F.col("_all"), F.struct(*_ORDER))).alias("_last"),
        (F.first("_rest") - F.first("_before") - F.sum(F.col("_take") * F.col("_size"))).alias("_gap"),
    )
    cuts = stored(cuts.join(last, "_rank"))
    # the slices that hold the last documents before the cut's and the first behind it
    near = (F.col("_n_before") + F.col("_n") > F.col("_c_before") - FRONT) & (F.col("_n_before") < F.col("_c_before") + F.col("_c_n") + OPEN)
    around = reach.join(cuts, "_rank").where(near & (F.col("_slice") != F.col("_cut"))).select("_rank", "_slice", F.col("_slice") < F.col("_cut"))
    around = around.toDF("_rank", "_slice", "_whole_in")
    beside = ranked.where(_movable()).join(around, ["_rank", "_slice"]).groupBy("_rank", "_whole_in", *_ORDER).agg(F.count("*").alias("_all"))
    beside = beside.withColumn("_take", F.when(F.col("_whole_in"), F.col("_all")).otherwise(0)).drop("_whole_in")
    keys = stored(at.where(_movable()).select("_rank", *_ORDER, "_all", "_take").unionByName(beside))
    # one more, from all that are open: the one nearest to the gap
    above = ranked.where(_movable()).join(cuts.select("_rank", "_cut", "_gap"), "_rank").where((F.col("_slice") > F.col("_cut")) & (F.abs(F.col("_size") - F.col("_gap")) < F.col("_gap")))
    above = above.groupBy("_rank").agg(F.min(F.struct(F.abs(F.col("_size") - F.col("_gap")).alias("off"), *_ORDER)).alias("m")).select("_rank", "m.*").drop("off")
    above = ranked.join(above, ["_rank", *(c for c in _ORDER if c != "_id")], "left_semi").groupBy("_rank", *_ORDER).agg(F.count("*").alias("_all")).withColumn("_take", F.lit(0).cast("long"))
    chosen = stored(_redrawn(keys, above, cuts))
    moved = chosen.where("_all = 1").groupBy("_rank").agg(
        F.collect_list(F.when(F.col("_now") > F.col("_take"), F.col("_key"))).alias("_put_in"), F.collect_list(F.when(F.col("_now") < F.col("_take"), F.col("_key"))).alias("_left_out")
    )
    split = at.where(~_movable() & (F.col("_take") > 0) & (F.col("_take") < F.col("_all"))).select("_rank", F.struct(*_ORDER).alias("_key"), F.col("_take").alias("_now"))
    ties = chosen.where("_all > 1").select("_rank", "_key", "_now").unionByName(split)
    ties = stored(ties.withColumnRenamed("_now", "_take"))
    return Plan(rates, stored(cuts.select("_rank", "_cut", "_last").join(moved, "_rank", "left")), ties, not ties.isEmpty())


def decide(marked: DataFrame, made: Plan) -> DataFrame:
    """Add ``_copies`` to each marked row; columns besides the marks go along untouched."""
    rows = _ranked(marked, made.rates).withColumn("_key", F.struct(*_ORDER)).join(made.cuts, "_rank", "left")
    front = (F.col("_slice") < F.col("_cut")) | ((F.col("_slice") == F.col("_cut")) & (F.col("_key") <= F.col("_last")))
    named = lambda keys: F.coalesce(F.exists(keys, lambda k: k == F.col("_key")), F.lit(False))
    taken = (F.coalesce(front, F.lit(False)) & ~named("_left_out")) | named("_put_in")
    rows = rows.withColumn("_extra", taken.cast("int"))
    if made.any_ties:  # equal rows around the cut: they are numbered, the others pass by
        ties = made.ties.select(F.col("_rank").alias("_t_rank"), F.col("_key").alias("_t_key"), F.col("_take"))
        rows = rows.join(ties, (F.col("_rank") == F.col("_t_rank")) & F.col("_key").eqNullSafe(F.col("_t_key")), "left").drop("_t_rank", "_t_key")
        number = F.row_number().over(W.partitionBy("_rank", "_key").orderBy("_size"))
        tied = rows.where("_take is not null").withColumn("_extra", (number <= F.col("_take")).cast("int"))
        rows = rows.where("_take is null").unionByName(tied)
    return rows.withColumn("_copies", F.col("_whole") + F.col("_extra"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Sizes, targets and words taken of every document.

    Null and empty texts have size 0 and take no words; null sources are one source, the
    last; a null doc_id is ranked like any; repeated rows are documents of their own, taken
    in any order as they are equal; ties of rank go by random number, id and size; an empty
    table gives no row; columns besides doc_id, source and text are not looked at.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source"), word_count(F.col("text")).alias("size"))
    marked = stored(_marked(own, F.col("doc_id"), F.col("source"), F.col("size")).drop("source"))
    rows = decide(marked, plan(marked, weights))
    return rows.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_copies") * F.col("_size")).alias("taken"), F.col("_copies").alias("copies"), F.col("_pi").alias("inclusion"))


def mixed_rows(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of ``docs``.

    The plan is made from ids and sizes alone; the texts are read once more and decided upon
    by comparing keys, without a shuffle while the plan's tables are small enough to send.
    """
    kept = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    own = docs.select(kept, F.col("doc_id").cast("long").alias("_doc_id"), F.col("source").alias("_own_source"), word_count(F.col("text")).alias("_words_of"))
    marked = _marked(own, F.col("_doc_id"), F.col("_own_source"), F.col("_words_of")).drop("_doc_id", "_own_source", "_words_of")
    made = plan(stored(marked.drop("_row")), weights)
    rows = decide(marked, made).where("_copies > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy"))
    return rows.select("_row.*")
