"""Spans of a text: extraction, overlap resolution, splicing. Offsets count code points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagveil.functions.patterns import Pattern

#: Marks around values; texts that hold one of them are walked without.
_OPEN, _CLOSE = "\x01", "\x02"
SPAN = "struct<s:int,e:int,t:string>"
CANDIDATE = "struct<s:int,e:int,t:string,weight:int,ord:bigint,label:string,source:string,replacement:string>"


def each(rows: DataFrame, keep: list[str], array: Column, name: str) -> DataFrame:
    """One row an element of an array that is costly to make; no element is null.

    Below a plain ``explode`` Spark puts a filter on the array's size, which makes the array two times more.
    """
    return rows.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def walk(text: Column, regex: Column) -> Column:
    """array<struct<s,e,t>> of a regex with two groups (what comes before, value), match after match.

    The group before each value starts where the last match ended, so running lengths are
    the offsets; no marks are put into the text and no character is special.
    """
    pairs = F.arrays_zip(F.regexp_extract_all(text, regex, F.lit(1)).alias("before"), F.regexp_extract_all(text, regex, F.lit(2)).alias("value"))
    start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<{SPAN}>)").alias("spans"))

    def step(acc: Column, pair: Column) -> Column:
        s = acc["at"] + F.length(pair["before"])
        e = s + F.length(pair["value"])
        return F.struct(e.alias("at"), F.array_append(acc["spans"], F.struct(s.alias("s"), e.alias("e"), pair["value"].alias("t"))).alias("spans"))

    return F.aggregate(pairs, start, step, lambda acc: acc["spans"])


def marked_walk(text: Column, regex: Column | str) -> Column:
    """Like ``walk`` in one search: values get a mark on both sides, and the pieces between marks are counted.

    ``regex`` has groups for what is matched before the value and the value. Only for texts
    without the two marks.
    """
    pieces = F.split(F.regexp_replace(text, regex if isinstance(regex, Column) else F.lit(regex), F.lit(f"$1{_OPEN}$2{_CLOSE}")), _OPEN, -1)

    def step(acc: Column, piece: Column) -> Column:
        value = F.substring_index(piece, _CLOSE, 1)
        e = acc["at"] + F.length(value)
        return F.struct((acc["at"] + F.length(piece) - 1).alias("at"), F.array_append(acc["spans"], F.struct(acc["at"].alias("s"), e.alias("e"), value.alias("t"))).alias("spans"))

    def counted(found: Column) -> Column:
        start = F.struct(F.length(found[0]).alias("at"), F.expr(f"cast(array() as array<{SPAN}>)").alias("spans"))
        return F.aggregate(F.slice(found, F.lit(2), F.size(found)), start, step, lambda acc: acc["spans"])

    # as a lambda's argument the pieces are made once, though used three times
    return F.transform(F.array(pieces), counted)[0]


def facts(text: Column) -> Column:
    """What is to be known of a text before it is searched: does it hold a mark, is it ASCII only, its length."""
    length = F.char_length(text)
    return F.struct((text.contains(_OPEN) | text.contains(_CLOSE)).alias("held"), (F.octet_length(text) == length).alias("plain"), length.alias("length"))


def pattern_spans(text: Column, pattern: Pattern, known: Column | None = None) -> Column:
    """Valid spans of a catalogue pattern; texts without what it needs are not searched at all. ``known`` are the text's ``facts``, where they are at hand."""
    empty = F.expr(f"cast(array() as array<{SPAN}>)")
    known = facts(text) if known is None else known
    held, plain = known["held"], known["plain"]
    spans = F.when(held, walk(text, F.lit(pattern.walk))).when(plain, marked_walk(text, pattern.ascii_parts)).otherwise(marked_walk(text, pattern.parts))
    if pattern.needs:
        spans = F.when(text.contains(pattern.needs), spans).otherwise(empty)
    return F.filter(spans, lambda x: pattern.valid(x["t"])) if pattern.valid else spans


def quick(regex: Column, plain: Column) -> Column:
    """A rule's regex for a text: where both are ASCII only, the faster ASCII classes and letters mean the same as ``(?iU)``."""
    ascii_only = plain & regex.startswith("(?iU)") & (F.octet_length(regex) == F.char_length(regex))
    return F.when(ascii_only, F.concat(F.lit("(?i)"), F.substring(regex, F.lit(6), F.length(regex)))).otherwise(regex)


def rule_spans(text: Column, regex: Column, known: Column | None = None) -> Column:
    """Spans of a rule's regex (flags in front are allowed), empty matches left out. ``known`` are the text's ``facts``, where they are at hand."""
    known = facts(text) if known is None else known
    held, regex = known["held"], quick(regex, known["plain"])
    walked = walk(text, F.concat(F.lit(r"(?s)\G(.*?)("), regex, F.lit(")")))
    found = F.when(held, walked).otherwise(marked_walk(text, F.concat(F.lit("()("), regex, F.lit(")"))))
    return F.filter(found, lambda x: x["e"] > x["s"])


def resolve_overlaps(candidates: Column) -> Column:
    """The spans that a left-to-right sweep takes: by start, the longest, the heaviest, the first rule; each from the last end on."""
    keyed = F.transform(candidates, lambda x: F.struct(x["s"].alias("k1"), (x["s"] - x["e"]).alias("k2"), (-x["weight"]).alias("k3"), x["ord"].alias("k4"), x.alias("x")))
    start = F.struct(F.lit(0).alias("end"), F.expr(f"cast(array() as array<{CANDIDATE}>)").alias("taken"))

    def step(acc: Column, k: Column) -> Column:
        return F.when(k["k1"] >= acc["end"], F.struct(k["x"]["e"].alias("end"), F.array_append(acc["taken"], k["x"]).alias("taken"))).otherwise(acc)

    return F.aggregate(F.sort_array(keyed), start, step, lambda acc: acc["taken"])


def splice(text: Column, spans: Column) -> Column:
    """The text with each span (sorted, apart from each other) replaced by its ``replacement``, taken literally."""
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, x["s"] - acc["at"])
        return F.struct(x["e"].alias("at"), F.concat(acc["out"], F.array(gap, x["replacement"])).alias("out"))

    whole = F.aggregate(spans, start, step, lambda acc: F.array_join(F.array_append(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))), ""))
    return F.when(F.size(spans) > 0, whole).otherwise(text)
