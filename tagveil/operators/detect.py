"""Suggestions: what of a text may be sensitive, in layers, with counts, contexts and tags."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagveil.functions import text as T
from tagveil.functions.patterns import Pattern, catalogue
from tagveil.operators import matching, spans
from tagveil.operators.mint import clean_prefix, free_numbers, gaps, tag_of
from tagveil.sources.scratch import dealt, stored

MOST_CONTEXTS = 5
#: Gaps between taken numbers that an expression holds.
MOST_GAPS = 500
DICTIONARY_WEIGHT = 1000
RANK = {"dictionary": 3, "pattern": 2, "ner": 1}
# Labels of name models, the types shown and the prefixes of their tags.
NAME_LABELS = {"PERSON": ("person", "PERSON"), "ORG": ("company", "COMPANY"), "GPE": ("place", "PLACE"), "FAC": ("place", "PLACE")}

#: A name model: documents (doc_id, text) to (doc_id, s, e, label).
NameModel = Callable[[DataFrame], DataFrame]


def _marked(number: int, p: Pattern, context: bool = False) -> Callable[[Column], Column]:
    def mark(x: Column) -> Column:
        around = [T.context_snippet(F.col("text"), x["s"], x["e"]).alias("context")] if context else []
        return F.struct(F.lit(number).alias("pat_ord"), F.lit(p.type).alias("type"), clean_prefix(F.lit(p.prefix)).alias("prefix"), x["s"].alias("s"), x["e"].alias("e"), x["t"].alias("t"), *around)

    return mark


def pattern_spans(docs: DataFrame, patterns: tuple[Pattern, ...] | None = None, context: bool = False) -> DataFrame:
    """(doc_id, row_key, pat_ord, type, prefix, s, e, t), all patterns in one pass over the texts, overlaps kept; with what stands around if asked for."""
    patterns = catalogue() if patterns is None else patterns
    found = [F.transform(spans.pattern_spans(F.col("text"), p), _marked(i, p, context)) for i, p in enumerate(patterns)]
    return matching.keyed(docs).where("text is not null").select("doc_id", "row_key", F.explode(F.concat(*found)).alias("m")).select("doc_id", "row_key", "m.*")


# --- within a row -------------------------------------------------------------------------
#
# A document's spans stay an array in its row. They are sorted once; runs of equal keys are
# slices of the sorted array, so that grouping is linear and nothing is shuffled.


def _bound(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of a value that is made once, however often ``fn`` uses it."""
    return F.transform(F.array(value), fn)[0]


def _runs(rows: Column, key: tuple[str, ...], make: Callable[[Column, Column, Column], Column]) -> Column:
    """``make(rows, start, stop)`` of each run of rows with an equal key; ``rows`` are sorted by it."""

    def of(a: Column) -> Column:
        new = lambda i: (i == 0) | ~reduce(and_, (F.get(a, i)[k].eqNullSafe(F.get(a, i - 1)[k]) for k in key))
        starts = F.when(F.size(a) > 0, F.filter(F.sequence(F.lit(0), F.size(a) - 1), new)).otherwise(F.expr("cast(array() as array<int>)"))
        return _bound(starts, lambda st: F.transform(st, lambda s, j: make(a, s, F.coalesce(F.get(st, j + 1), F.size(a)))))

    return _bound(F.sort_array(rows), of)


def _counted(found: Column, key: tuple[str, ...], order: tuple[str, ...], rest: tuple[str, ...]) -> Column:
    """Spans by key: the first one's columns, how many, and the places of the first ones, by ``order``."""
    fields = tuple(dict.fromkeys((*key, *order, *rest, "s", "e")))

    def group(a: Column, start: Column, stop: Column) -> Column:
        places = F.transform(F.slice(a, start + 1, F.least(stop - start, F.lit(MOST_CONTEXTS))), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))
        return F.struct(*(F.get(a, start)[c].alias(c) for c in fields if c != "e"), (stop - start).cast("long").alias("n"), places.alias("places"))

    return _runs(F.transform(found, lambda x: F.struct(*(x[c].alias(c) for c in fields))), key, group)


def _numbered(groups: Column, order: tuple[str, ...], fields: tuple[str, ...], start: Column | None = None) -> Column:
    """Add ``k``: a group's place by ``order`` among those of its prefix, on from ``start`` (a map by prefix)."""
    fields = tuple(dict.fromkeys(("prefix", *order, *fields)))

    def run(a: Column, first: Column, stop: Column) -> Column:
        before = F.coalesce(F.element_at(start, F.get(a, first)["prefix"]), F.lit(0)) if start is not None else F.lit(0)
        return F.transform(F.slice(a, first + 1, stop - first), lambda x, i: F.struct(*(x[c].alias(c) for c in fields), (before + i + 1).cast("long").alias("k")))

    return F.flatten(_runs(F.transform(groups, lambda x: F.struct(*(x[c].alias(c) for c in fields))), ("prefix",), run))


def _suggested(source: str, x: Column, term: Column, type_: Column, tag: Column | None = None) -> Column:
    """One row of a layer, the fields in the order by which equal terms are preferred."""
    text = lambda c: F.lit(None).cast("string") if c is None else c
    k = x["k"] if tag is None else F.lit(None).cast("long")
    prefix = x["prefix"] if tag is None else F.lit(None).cast("string")
    pat_ord = x["pat_ord"] if source == "pattern" else F.lit(0)
    return F.struct(
        F.lower(term).alias("folded"), F.lit(-RANK[source]).alias("rank"), pat_ord.alias("pat_ord"), x["s"].alias("s"), term.alias("term"), type_.alias("type"), F.lit(source).alias("source"),
        text(tag).alias("tag"), prefix.alias("prefix"), k.alias("k"), x["n"].alias("n"), x["places"].alias("places"),
    )


def pattern_layer(text: Column, patterns: tuple[Pattern, ...]) -> Column:
    """What the forms find in a text, each value once, numbered by prefix."""
    found = _bound(spans.facts(text), lambda known: F.concat(*(F.transform(spans.pattern_spans(text, p, known), _marked(i, p)) for i, p in enumerate(patterns))))
    counted = _counted(found, ("type", "t"), ("pat_ord", "s"), ("prefix",))
    return F.transform(_numbered(counted, ("pat_ord", "s"), ("t", "type", "n", "places")), lambda x: _suggested("pattern", x, x["t"], x["type"]))


def dictionary_layer(matches: Column) -> Column:
    """Saved terms among a text's matches, overlaps resolved among them only."""
    rows = F.transform(matches, lambda x: F.struct(x["label"].alias("label"), F.lower(x["t"]).alias("folded"), x["s"].alias("s"), x["e"].alias("e"), x["t"].alias("t")))
    return F.transform(_counted(rows, ("label", "folded"), ("s",), ("t",)), lambda x: _suggested("dictionary", x, x["t"], F.lit("saved"), x["label"]))


def name_layer(text: Column, proposed: Column, by_pattern: Column) -> Column:
    """A model's proposals (s, e, label): one tag a name in small letters, whatever its labels, on from the numbers of the text's patterns."""
    kinds = F.create_map(*(x for k, v in NAME_LABELS.items() for x in (F.lit(k), F.struct(F.lit(v[0]).alias("type"), F.lit(v[1]).alias("prefix")))))
    cut = F.transform(proposed, lambda x: F.struct(x["label"].alias("label"), x["s"].alias("s"), x["e"].alias("e"), T.name_strip(F.substring(text, x["s"] + 1, x["e"] - x["s"])).alias("t")))
    kept = F.filter(cut, lambda x: x["label"].isin(*NAME_LABELS) & _is_name(x["t"]))
    rows = F.transform(kept, lambda x: x.withField("folded", F.lower(x["t"])))
    counted = _counted(rows, ("label", "folded"), ("s",), ("t",))
    first = _runs(F.transform(counted, lambda x: F.struct(x["folded"].alias("folded"), x["s"].alias("s"), x["label"].alias("label"))), ("folded",), lambda a, start, _: F.get(a, start))
    wanted = F.transform(first, lambda x: F.struct(F.element_at(kinds, x["label"])["prefix"].alias("prefix"), x["s"].alias("s"), x["folded"].alias("folded")))
    prefixes = F.array_distinct(F.transform(by_pattern, lambda x: x["prefix"]))
    used = F.map_from_entries(F.transform(prefixes, lambda p: F.struct(p, F.size(F.filter(by_pattern, lambda x: x["prefix"] == p)))))
    numbers = F.map_from_entries(F.transform(_numbered(wanted, ("s",), ("folded",), used), lambda x: F.struct(x["folded"], F.struct(x["prefix"].alias("prefix"), x["k"].alias("k")))))

    def named(numbers: Column) -> Column:
        def one(x: Column) -> Column:
            found = F.element_at(numbers, x["folded"])
            whole = F.struct(found["prefix"].alias("prefix"), found["k"].alias("k"), x["s"].alias("s"), x["n"].alias("n"), x["places"].alias("places"))
            return _suggested("ner", whole, x["t"], F.element_at(kinds, x["label"])["type"])

        return F.transform(counted, one)

    return _bound(numbers, named)


def merged(layers: Column) -> Column:
    """Of equal terms in any case, the highest layer's first one stays; by layer, then count, then term."""
    best = _runs(layers, ("folded",), lambda a, start, _: F.get(a, start))
    fields = ("term", "type", "source", "tag", "prefix", "k", "places")
    return F.sort_array(F.transform(best, lambda x: F.struct(x["rank"].alias("rank"), (-x["n"]).alias("less"), x["folded"].alias("folded"), *(x[c].alias(c) for c in fields), x["n"].alias("n"))))


# --- tables -------------------------------------------------------------------------------


def _is_name(t: Column) -> Column:
    return (F.length(t) >= 2) & ~T.is_form_label(t)


def kept_names(names: DataFrame) -> DataFrame:
    """Proposals (doc_id, s, e, t, label) with known labels, stripped; form labels and single characters are out."""
    stripped = names.where(F.col("label").isin(*NAME_LABELS)).withColumn("t", T.name_strip(F.col("t")))
    return stripped.where(_is_name(F.col("t"))).withColumn("folded", F.lower("t"))


def taken_of(tags: DataFrame, prefixes: Iterable[str]) -> DataFrame:
    """Of the tags in use those with one of these prefixes; no other stands in the way of their numbers."""
    own = F.regexp_extract("tag", r"^\[\[([A-Z0-9_]+)_[1-9][0-9]{0,17}\]\]$", 1)
    return tags.where(F.array_contains(F.array(*(clean_prefix(F.lit(p)) for p in prefixes)), own))


def with_numbers(rows: DataFrame, taken: DataFrame) -> DataFrame:
    """Fill in ``tag`` of rows that have a prefix and k: the k-th number of the prefix that no taken tag has.

    What is taken is known by its gaps. Up to ``MOST_GAPS`` of them go into the rows'
    expression; with more, numbers are found by merging and joined by (prefix, k).
    """
    found = gaps(taken).limit(MOST_GAPS + 1).collect()
    if len(found) <= MOST_GAPS:
        below: dict[str, list] = {}
        for g in sorted(found):
            below.setdefault(g["prefix"], []).append((g["free_below"], g["upto"]))
        number = F.col("k")
        for prefix, steps in below.items():
            passed = F.array(*(F.struct(F.lit(f).cast("long").alias("f"), F.lit(u).cast("long").alias("u")) for f, u in steps))
            last = F.element_at(F.filter(passed, lambda x: x["f"] < F.col("k")), -1)["u"]
            some = F.lit(steps[0][0]).cast("long") < F.col("k")
            number = F.when((F.col("prefix") == prefix) & some, F.col("k") + last).otherwise(number)
        return rows.withColumn("tag", F.coalesce("tag", tag_of(F.col("prefix"), number)))
    rows = stored(rows)  # read twice
    pairs = rows.where("k is not null").groupBy("prefix").agg(F.max("k").alias("k")).select("prefix", F.explode(F.sequence(F.lit(1).cast("long"), "k")).alias("k"))
    joined = rows.join(free_numbers(pairs, taken), ["prefix", "k"], "left")
    return joined.withColumn("tag", F.coalesce("tag", tag_of(F.col("prefix"), F.col("number")))).drop("number")


def contexts(text: Column, places: Column) -> Column:
    """What stands around each of a suggestion's places; made behind the layers, so that nothing is made where it is not asked for."""
    return _bound(F.length(text), lambda length: F.transform(places, lambda x: T.context_snippet(text, x["s"], x["e"], length=length)))


def _exploded(rows: DataFrame, layer: Column) -> DataFrame:
    found = rows.select("doc_id", "text", F.explode(layer).alias("x"))
    return found.select("doc_id", "x.*", contexts(F.col("text"), F.col("x.places")).alias("contexts")).drop("places")


def detect_patterns(docs: DataFrame, taken: DataFrame, patterns: tuple[Pattern, ...] | None = None) -> DataFrame:
    """Pattern layer of each document: (doc_id, term, type, source, tag, n, contexts, pat_ord, s)."""
    found = _exploded(docs.where("text is not null"), pattern_layer(F.col("text"), catalogue() if patterns is None else patterns))
    return with_numbers(found, taken).select("doc_id", "term", "type", "source", "tag", "n", "contexts", "pat_ord", "s")


def detect_dictionary(docs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Dictionary layer: saved terms (term, tag, ord): (doc_id, term, type, source, tag, n, contexts, pat_ord, s)."""
    found = matching.matches(docs, matching.term_rules(dictionary, DICTIONARY_WEIGHT, "dictionary")).where(F.size("matches") > 0)
    return _exploded(found, dictionary_layer(F.col("matches"))).select("doc_id", "term", "type", "source", "tag", "n", "contexts", "pat_ord", "s")


def analyze(docs: DataFrame, dictionary: DataFrame, include_money: bool = False, names: NameModel | None = None, custom: tuple[Pattern, ...] = (), patterns: tuple[Pattern, ...] | None = None) -> DataFrame:
    """All suggestions of each document, ranked: (doc_id, pos, term, type, source, tag, n, contexts, checked).

    Documents are told apart by id and text: of a repeated id each text has suggestions of
    its own, also where the id is null, and rows equal in both are one document. Null and
    empty texts have none; columns besides doc_id and text are not looked at; an empty table
    gives no row. A name model sees row keys in place of ids. Rows that come with a
    ``row_key`` are documents of their own, none is compared with another.
    """
    patterns = catalogue(include_money, custom) if patterns is None else patterns
    told_apart = "row_key" in docs.columns
    seen = docs = matching.keyed(docs.select("doc_id", "text", *(["row_key"] if told_apart else [])).where("text is not null"))
    if not told_apart:
        # dealt out by row_key for this, texts meet their rules where they are; for their keys repeated ones need not go
        docs = dealt(docs, "row_key").dropDuplicates(["row_key"])
    text = F.col("text")
    found = matching.matches(docs, matching.term_rules(dictionary, DICTIONARY_WEIGHT, "dictionary"), seen)
    found = found.withColumn("by_pattern", pattern_layer(text, patterns))
    layers = [dictionary_layer(F.col("matches")), F.col("by_pattern")]
    if names is not None:
        seen = docs.select(F.col("row_key").alias("doc_id"), "text")
        proposed = names(seen).groupBy(F.col("doc_id").alias("row_key")).agg(F.collect_list(F.struct(F.col("s").cast("int").alias("s"), F.col("e").cast("int").alias("e"), "label")).alias("proposed"))
        found = found.join(proposed, "row_key", "left")
        none = F.expr("cast(array() as array<struct<s:int,e:int,label:string>>)")
        layers.append(name_layer(text, F.coalesce("proposed", none), F.col("by_pattern")))
    ranked = found.select("doc_id", "text", F.posexplode(merged(F.concat(*layers))).alias("at", "x"))
    ranked = ranked.select("doc_id", (F.col("at") + 1).alias("pos"), "x.*", contexts(text, F.col("x.places")).alias("contexts")).drop("places")
    prefixes = {p.prefix for p in patterns} | ({prefix for _, prefix in NAME_LABELS.values()} if names is not None else set())
    taken = taken_of(dictionary.select("tag"), sorted(prefixes))
    return with_numbers(ranked, taken).select("doc_id", "pos", "term", "type", "source", "tag", "n", "contexts", (F.col("source") != "ner").alias("checked"))
