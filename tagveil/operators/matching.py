"""Rules from a table against a table of texts.

A text stays in one row from the rules' choice to the rewriting; rows are told apart by a
hash of id and text, so repeated and missing ids are no matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as ty

from tagveil.functions import text as T
from tagveil.operators import spans
from tagveil.sources.scratch import stored

#: What a rule is looked up by: a run of ASCII letters and digits, two such runs in a row, or so many characters in a row, not all (or, from ANY on, maybe all) of those.
BY_RUN, GRAMS, BY_PAIR, ANY = 0, (3, 2, 1), 5, 10
#: Rules that may share a word before those with two words in a row are looked up by such a pair, or three characters before more in a row are.
MOST_SHARED = 8
#: How many characters in a row rules are looked up by whose three are shared by too many.
LONGER = (4, 6, 8)
#: Rules that texts hold in their expression instead of meeting them by a join.
MOST_HELD = 64
#: Rules that may be sent whole to every task, over the driver.
MOST_SENT = 100_000
#: Beginnings of keys that an expression holds, to leave out a text's words that begin no rule's key.
MOST_STARTS = 1000
#: Beginnings that a search tries at each word of a text.
MOST_TRIED = 50
_RUN = "[0-9a-z]+"
_STRINGS = "array<string>"


def keyed(docs: DataFrame) -> DataFrame:
    """Add ``row_key``; rows equal in id and text share it, and whatever is found by it is true of both. One that the rows come with is kept."""
    return docs if "row_key" in docs.columns else docs.withColumn("row_key", F.xxhash64("doc_id", "text"))


def _runs(folded: Column) -> Column:
    return F.regexp_extract_all(folded, F.lit(_RUN), F.lit(0))


def _grams(folded: Column, n: int, every: bool) -> Column:
    """Characters in a row, at every place. Without tag brackets: what remains never reaches over the edge of a tag."""
    odd = "" if every else rf"(?=\S{{0,{n - 1}}}[^0-9a-z\s])"
    found = F.regexp_extract_all(folded, F.lit(rf"(?U)(?=(\S{{{n}}})){odd}"), F.lit(1))
    return found if n == 1 else F.filter(found, lambda x: ~(x.contains("[") | x.contains("]")))


def _pairs(folded: Column) -> Column:
    """Two ASCII runs with only blanks between them, at every place. As tags have brackets, no pair reaches over the edge of one."""
    found = F.regexp_extract_all(folded, F.lit(r"(?U)(?<![0-9a-z])(?=([0-9a-z]+\s+[0-9a-z]+)(?![0-9a-z]))"), F.lit(1))
    return F.transform(found, lambda x: F.regexp_replace(x, r"(?U)\s+", " "))


def unsent(rows: DataFrame) -> DataFrame:
    """The rows, to be met where they lie: a join by shuffle, never by sending them whole over the driver.

    What Spark takes for their size is that of compressed files, before one row is made many: millions of rows may pass for a few megabytes.
    """
    return rows.hint("merge")


def sendable(rules: DataFrame) -> DataFrame:
    """Stored rules, left to Spark while they are few, else unsent."""
    return rules if rules.count() <= MOST_SENT else unsent(rules)


def anchored(rules: DataFrame) -> DataFrame:
    """Replace ``keys`` (strings that every match of a rule holds, folded) by ``anchor``: the one that the fewest rules have, then the longest.

    Rules whose words are all shared by more than ``MOST_SHARED`` rules are looked up by a
    pair of words in a row instead, where they have one (``pairs``), so that texts with a
    common word do not meet all rules with it; those known by three characters in a row by more.
    """
    # keys go without the rules they are of, which are met again by a hash of them
    rules = rules.withColumn("rule_key", F.xxhash64(*(c for c in rules.columns if c not in ("keys", "pairs"))))
    both = F.col("keys")
    if "pairs" in rules.columns:
        both = F.concat("keys", F.when(F.col("kind").isin(BY_RUN, GRAMS[0], ANY + GRAMS[0]), F.col("pairs")).otherwise(F.expr(f"cast(array() as {_STRINGS})")))
    each = spans.each(rules, ["rule_key", "ord", "kind"], F.array_distinct(both), "key")
    often = each.groupBy("key").agg(F.count("*").alias("n"))
    paired = F.col("key").contains(" ") & (F.col("kind") == BY_RUN)
    longer = F.col("kind").isin(GRAMS[0], ANY + GRAMS[0]) & (F.length("key") > GRAMS[0])
    # a word comes before any pair unless too many share it
    rank = F.struct(F.when(paired | longer, 1).when(F.col("n") > MOST_SHARED, 2).otherwise(0).alias("late"), "n", (-F.length("key")).alias("l"), "key", paired.alias("paired"), longer.alias("longer"), "rule_key")
    best = each.join(unsent(often), "key").groupBy("ord").agg(F.min(rank).alias("m")).select("m.rule_key", F.col("m.key").alias("anchor"), "m.paired", "m.longer")
    out = rules.drop("keys", "pairs").dropDuplicates(["rule_key"]).join(unsent(best), "rule_key").drop("rule_key")
    kind = F.when(F.col("paired"), BY_PAIR).when(F.col("longer"), F.col("kind") - GRAMS[0] + F.length("anchor")).otherwise(F.col("kind"))
    return out.withColumn("kind", kind).drop("paired", "longer")


def keys_of(term: Column, whole_word: bool = True) -> tuple[Column, Column]:
    """(kind, keys) of a term.

    ASCII runs are whole words of every text that a whole-word rule matches, as its bounds
    and gaps are no ASCII letters or digits. Other terms, which may stand within longer
    words, are known by three characters in a row, or by two or one if they are shorter.
    """
    folded = T.fold(term)
    base = 0 if whole_word else ANY
    kind, keys = F.lit(base + 1), _grams(folded, 1, not whole_word)
    for n in (2, 3):
        found = _grams(folded, n, not whole_word)
        kind, keys = F.when(F.size(found) > 0, base + n).otherwise(kind), F.when(F.size(found) > 0, found).otherwise(keys)
    if whole_word:
        runs = _runs(folded)
        kind, keys = F.when(F.size(runs) > 0, BY_RUN).otherwise(kind), F.when(F.size(runs) > 0, runs).otherwise(keys)
    return kind, keys


def term_rules(entries: DataFrame, weight: int = 0, source: str = "term", ignore_case: bool = True, whole_word: bool = True) -> DataFrame:
    """(term, tag, ord) to rules: (ord, regex, term, label, replacement, weight, source, kind, anchor). Blank terms give none."""
    kind, keys = keys_of(F.col("term"), whole_word)
    folded = T.fold(F.col("term"))
    longer = F.concat(*(_grams(folded, n, not whole_word) for n in LONGER))
    rules = entries.select(
        F.col("ord").cast("long").alias("ord"),
        T.bounded_regex(F.col("term"), ignore_case, whole_word).alias("regex"),
        F.col("term"),
        F.col("tag").alias("label"),
        F.col("tag").alias("replacement"),
        F.lit(weight).alias("weight"),
        F.lit(source).alias("source"),
        kind.alias("kind"),
        keys.alias("keys"),
        (F.when(kind == BY_RUN, _pairs(folded)).otherwise(longer) if whole_word else longer).alias("pairs"),
    )
    return anchored(rules)


def kinds_of(rules: DataFrame) -> set[int]:
    """Which kinds of keys the rules need from the texts."""
    return {r.kind for r in rules.select("kind").distinct().collect()}


def anchors_in(text: Column, kinds: set[int]) -> Column:
    """Distinct keys of a text by which rules of these kinds can be found."""
    folded = T.fold(text)
    found = [_runs(folded)] if BY_RUN in kinds else []
    found += [_pairs(folded)] if BY_PAIR in kinds else []
    found += [_grams(folded, n, ANY + n in kinds) for n in (*LONGER, *GRAMS) if {n, ANY + n} & kinds]
    return F.array_distinct(F.concat(*found)) if found else F.expr(f"cast(array() as {_STRINGS})")


def with_rules(docs: DataFrame, rules: DataFrame, kinds: set[int] | None = None, seen: DataFrame | None = None) -> DataFrame:
    """Add ``rules``, an array of those whose anchor the text holds (null if none does).

    Up to ``MOST_HELD`` rules go into the rows' expression, and no text is moved. Beyond that
    it is an equality join of the texts' distinct keys with the rules' anchors; Spark may send the
    rules to the texts up to ``MOST_SENT`` and shuffles by key beyond that. Keys and rules
    travel without the texts, which are joined with their rules once, and keys that begin like
    no rule's anchor do not travel at all. Rows dealt out by a ``row_key`` of their own stay
    where they are. ``seen`` (row_key, text) may give the texts where they are cheaper to read
    for their keys, repeated ones among them.
    """
    docs, rules = keyed(docs), stored(rules)
    few = rules.limit(MOST_HELD + 1).collect()
    if len(few) <= MOST_HELD:
        return docs.withColumn("rules", _held(F.col("text"), few, rules.schema))
    kinds = kinds_of(rules) if kinds is None else kinds
    keys = spans.each(docs if seen is None else seen, ["row_key"], _likely_in(F.col("text"), kinds, rules), "anchor")
    rule = F.struct(*(c for c in rules.columns if c not in ("anchor", "kind")))
    # a key that is never null asks for no filter on the texts' rows, so that both readings of them can share one exchange
    keys = keys.withColumn("row_key", F.coalesce("row_key", F.lit(0)))
    hits = keys.join(sendable(rules), "anchor").groupBy("row_key").agg(F.collect_set(rule).alias("rules"))
    return docs.join(hits, "row_key", "left")


def _literal(value: object, kind: ty.DataType) -> Column:
    if isinstance(kind, ty.StructType) and value is not None:
        return F.struct(*(_literal(value[f.name], f.dataType).alias(f.name) for f in kind.fields))
    if isinstance(kind, ty.ArrayType) and value is not None:
        return F.array(*(_literal(x, kind.elementType) for x in value)).cast(kind)
    return F.lit(value).cast(kind)


def _held(text: Column, rules: list[Row], schema: ty.StructType) -> Column:
    """Those of a few collected rules whose anchor the text holds; null if there is none."""
    kept = ty.StructType([f for f in schema.fields if f.name not in ("anchor", "kind")])
    pairs = ty.StructType([schema["anchor"], ty.StructField("rule", kept)])
    every = _literal([{"anchor": r["anchor"], "rule": r} for r in rules], ty.ArrayType(pairs))
    # a set of all anchors leaves the text's few
    known = F.filter(anchors_in(text, {r["kind"] for r in rules}), lambda key: key.isin([r["anchor"] for r in rules]))
    met = F.transform(F.array(known), lambda found: F.filter(every, lambda r: F.array_contains(found, r["anchor"])))[0]
    return F.transform(F.array(met), lambda m: F.when(F.size(m) > 0, F.transform(m, lambda r: r["rule"])))[0]


def _likely(keys: Column, rules: DataFrame) -> Column:
    """A text's keys without those that begin like no rule's anchor of that length, as far as an expression can hold the beginnings."""
    n, starts = _starts(rules)
    return F.filter(keys, lambda key: _start(key, n).isin(starts)) if n else keys


def _likely_in(text: Column, kinds: set[int], rules: DataFrame) -> Column:
    """The same of all keys of a text; words of few beginnings are searched for, others are not even cut out."""
    n, starts = _starts(rules)
    if kinds == {BY_RUN} and n and len(starts) <= MOST_TRIED:
        forms = sorted((start, int(length) - len(start)) for length, start in (x.split(" ") for x in starts))
        regex = f"(?<![0-9a-z])(?:{'|'.join(f'{start}[0-9a-z]{{{more}}}' for start, more in forms)})(?![0-9a-z])"
        return F.array_distinct(F.regexp_extract_all(T.fold(text), F.lit(regex), F.lit(0)))
    keys = anchors_in(text, kinds)
    return F.filter(keys, lambda key: _start(key, n).isin(starts)) if n else keys


def _start(key: Column, n: int) -> Column:
    return F.concat(F.length(key).cast("string"), F.lit(" "), F.substring(key, 1, n))


def _starts(rules: DataFrame) -> tuple[int, list[str]]:
    """(n, beginnings of n characters, with the length, that the rules' anchors have); n is 0 if there are too many."""
    for n in (4, 3, 2, 1):
        found = rules.select(_start(F.col("anchor"), n).alias("start")).distinct().limit(MOST_STARTS + 1).collect()
        if len(found) <= MOST_STARTS:
            return n, [r["start"] for r in found]
    return 0, []


def candidates_of(text: Column, rules: Column) -> Column:
    """Every rule's own matches in a text, before any is preferred over another."""

    def of(rule: Column, known: Column) -> Column:
        return F.transform(spans.rule_spans(text, rule["regex"], known), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["t"].alias("t"), *(rule[c].alias(c) for c in ("weight", "ord", "label", "source", "replacement"))))

    found = F.transform(F.array(spans.facts(text)), lambda known: F.flatten(F.transform(rules, lambda rule: of(rule, known))))[0]
    return F.coalesce(found, F.expr(f"cast(array() as array<{spans.CANDIDATE}>)"))


def with_candidates(ruled: DataFrame) -> DataFrame:
    """Add ``candidates``: those of the row's text by the row's rules."""
    return ruled.withColumn("candidates", candidates_of(F.col("text"), F.col("rules")))


def candidates(docs: DataFrame, rules: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and whatever else) with their candidates."""
    return with_candidates(with_rules(docs, rules, seen=seen)).drop("rules")


def matches(docs: DataFrame, rules: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Every row of ``docs`` with ``matches``, what a sweep over the candidates takes; an empty array where there is none."""
    return candidates(docs, rules, seen).withColumn("matches", spans.resolve_overlaps(F.col("candidates"))).drop("candidates")


def exploded(found: DataFrame, column: str = "matches", context: bool = False) -> DataFrame:
    """One row a span: doc_id, row_key, s, e, t, label, source, weight, ord, and what stands around it if asked for."""
    rows = F.col(column)
    if context:  # cut while the text is at hand, so that it need not travel
        rows = F.transform(rows, lambda x: x.withField("context", T.context_snippet(F.col("text"), x["s"], x["e"])))
    names = ["s", "e", "t", "label", "source", "weight", "ord", *(["context"] if context else [])]
    return spans.each(found, ["doc_id", "row_key"], rows, "m").select("doc_id", "row_key", *(f"m.{c}" for c in names))


def rewritten(found: DataFrame) -> DataFrame:
    """(doc_id, new_text, n_matches) of every row of ``matches``; texts without any come back as they are."""
    return found.select("doc_id", spans.splice(F.col("text"), F.col("matches")).alias("new_text"), F.size("matches").cast("long").alias("n_matches"))
