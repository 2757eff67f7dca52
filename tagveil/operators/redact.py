"""Redaction: confirmed terms become tags, and nothing is released while one of them is left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagveil.functions import text as T
from tagveil.operators import matching, spans
from tagveil.operators.order import numbered
from tagveil.sources.scratch import stored


def clean_entries(entries: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """(term, tag, ord) stripped and normalised; blanks dropped; of terms equal in small letters the first stays."""
    scope = scope or []
    clean = entries.withColumn("term", T.strip(F.col("term"))).withColumn("tag", T.normalize_tag(F.col("tag"))).where("term != '' and tag != ''")
    first = F.row_number().over(W.partitionBy(*scope, F.lower("term")).orderBy("ord"))
    return clean.withColumn("nth", first).where("nth = 1").drop("nth")


def tag_values(entries: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """(tag, value, ord): a shared tag stands for the last of its terms and keeps the first one's place."""
    return entries.groupBy(*(scope or []), "tag").agg(F.max_by("term", "ord").alias("value"), F.min("ord").alias("ord"))


def job_tags(found: DataFrame) -> DataFrame:
    """(tag, n) over all documents of a redaction: used tags only."""
    return spans.each(found, [], F.col("matches"), "m").groupBy(F.col("m.label").alias("tag")).agg(F.count("*").alias("n"))


def tag_counts(found: DataFrame) -> DataFrame:
    """(doc_id, tag, n) of matches."""
    return spans.each(found, ["doc_id"], F.col("matches"), "m").groupBy("doc_id", F.col("m.label").alias("tag")).agg(F.count("*").alias("n"))


def mapping_entries(counts: DataFrame, values: DataFrame) -> DataFrame:
    """(doc_id, tag, value, n): tags that were used, with what they stand for."""
    return counts.join(values, "tag").select("doc_id", "tag", "value", "n")


def leaks(outputs: DataFrame, entries: DataFrame) -> DataFrame:
    """(doc_id, term): whole-word terms that the new texts (doc_id, new_text) still hold. Existence only, no spans."""
    texts = outputs.withColumnRenamed("new_text", "text")
    ruled = matching.with_rules(texts, matching.term_rules(entries))
    left = F.filter("rules", lambda r: F.regexp_like("text", spans.quick(r["regex"], F.octet_length("text") == F.char_length("text"))))
    return spans.each(ruled, ["doc_id"], F.transform(left, lambda r: r["term"]), "term")


def gate(outputs: DataFrame, entries: DataFrame) -> DataFrame:
    """(doc_id, ok, leaked) of every row of new texts (doc_id, new_text), each judged in its own row."""
    texts = outputs.withColumnRenamed("new_text", "text")
    ruled = matching.with_rules(texts, matching.term_rules(entries))
    left = F.filter("rules", lambda r: F.regexp_like("text", spans.quick(r["regex"], F.octet_length("text") == F.char_length("text"))))
    leaked = F.coalesce(F.array_sort(F.transform(left, lambda r: r["term"])), F.expr("cast(array() as array<string>)"))
    return ruled.select("doc_id", leaked.alias("leaked")).select("doc_id", F.coalesce(F.size("leaked") == 0, F.lit(False)).alias("ok"), "leaked")


def _with_followers(rules: DataFrame, kinds: set[int]) -> DataFrame:
    """Add ``also``: the rules (term, regex) that a rule's tag may give something to find.

    What a redacted text holds is left of the old text or is in a tag, and anchors never
    reach over a tag's edge; so a text's own rules and these are all that can match it.
    """
    own = rules.withColumn("at", F.explode_outer(matching.anchors_in(F.col("label"), kinds)))
    other = rules.select(F.col("anchor").alias("at"), F.struct("term", "regex").alias("check"))
    rule = F.struct(*rules.columns)
    met = own.join(matching.sendable(other), "at", "left").groupBy("ord").agg(F.min(rule).alias("rule"), F.collect_set("check").alias("also"))
    return met.select("rule.*", "also")


def redact(docs: DataFrame, entries: DataFrame) -> DataFrame:
    """One row a document: (doc_id, ok, n_matches, redacted_text, leaked).

    ``entries`` (term, tag, ord) are cleaned first. Matching, rewriting and the leak check
    happen in the text's own row, so each row is judged by its own text whatever its id:
    null ids, repeated ids and repeated rows all have their own verdict. A text is released
    only where the check has found nothing; without a verdict it is held back. Null and
    empty texts come back as they are, with nothing matched; an empty table gives no row.
    """
    return judged(found_in(docs, clean_entries(entries)))


def with_checks(docs: DataFrame, clean: DataFrame) -> DataFrame:
    """Add ``rules``, those that the row's text may match, and ``checks``, the terms that its rewritten text is to be tested for."""
    rules = stored(matching.term_rules(clean))
    kinds = matching.kinds_of(rules)
    ruled = matching.with_rules(docs, _with_followers(rules, kinds), kinds)
    checks = F.array_distinct(F.flatten(F.transform("rules", lambda r: F.array_append(r["also"], F.struct(r["term"].alias("term"), r["regex"].alias("regex"))))))
    return ruled.withColumn("checks", F.coalesce(checks, F.expr("cast(array() as array<struct<term:string,regex:string>>)")))


def left_of(checks: Column, new_text: Column) -> Column:
    """The terms of ``checks`` that a rewritten text still holds, sorted."""
    left = F.filter(checks, lambda c: F.coalesce(F.regexp_like(new_text, c["regex"]), F.lit(False)))
    return F.array_sort(F.transform(left, lambda c: c["term"]))


def found_in(docs: DataFrame, clean: DataFrame) -> DataFrame:
    """The rows of ``docs`` with ``matches`` and ``checks``."""
    found = matching.with_candidates(with_checks(docs, clean)).withColumn("matches", spans.resolve_overlaps(F.col("candidates")))
    return found.drop("candidates", "rules")


def judged(found: DataFrame) -> DataFrame:
    """Rewrite the rows of ``found_in`` and release those in which no term is left."""
    new = found.select("doc_id", "checks", spans.splice(F.col("text"), F.col("matches")).alias("new_text"), F.size("matches").cast("long").alias("n_matches"))
    out = new.withColumn("leaked", left_of(F.col("checks"), F.col("new_text")))
    ok = F.coalesce(F.size("leaked") == 0, F.lit(False))
    return out.select("doc_id", ok.alias("ok"), "n_matches", F.when(ok, F.col("new_text")).alias("redacted_text"), "leaked")


def guide_order(tag: str = "tag") -> list[Column]:
    """Longest tags first, as a replacement by hand must go."""
    return [F.length(tag).desc(), F.col(tag)]


def guide_lines(entries: DataFrame, scope: str = "doc_id") -> DataFrame:
    """(scope, pos, line) of the readable guide's table: padded tag, value and count."""
    own = W.partitionBy(scope)
    tag_width, value_width = F.max(F.length("tag")).over(own) + 2, F.max(F.length("value")).over(own) + 2
    count = F.concat(F.lit("("), F.col("n").cast("string"), F.when(F.col("n") == 1, " occurrence)").otherwise(" occurrences)"))
    line = F.concat(F.lit("  "), F.rpad(F.col("tag"), F.col("tw"), F.lit(" ")), F.lit("->  "), F.rpad(F.col("value"), F.col("vw"), F.lit(" ")), count)
    return entries.withColumn("tw", tag_width).withColumn("vw", value_width).withColumn("pos", F.row_number().over(own.orderBy(*guide_order()))).select(scope, "pos", line.alias("line"))


def guide_text(lines: DataFrame, source: Column, generated: Column, scope: str = "doc_id") -> DataFrame:
    """(scope, guide): the whole note."""
    head = F.concat(F.lit("REDACTION MAPPING: "), source, F.lit("\nGenerated "), generated, F.lit("\n\nReplace the tags below in this order (longer tags first) to put the values back.\n\n"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    return lines.groupBy(scope).agg(body.alias("body")).select(scope, F.concat(head, "body", F.lit("\n\nThis file holds the values that were taken out. Keep it where it is.\n")).alias("guide"))


def mapping_json(entries: DataFrame, source: Column, generated: Column, scope: str = "doc_id") -> DataFrame:
    """(scope, json): the mapping as one JSON object, entries in guide order."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct((-F.length("tag")).alias("k"), "tag", "value", F.col("n").alias("count")))), lambda x: F.struct(x["tag"].alias("tag"), x["value"].alias("value"), x["count"].alias("count")))
    return entries.groupBy(scope).agg(listed.alias("entries")).select(scope, F.to_json(F.struct(source.alias("source"), generated.alias("generated"), "entries")).alias("json"))


def output_names(files: DataFrame, saved: int) -> DataFrame:
    """(file_id, name, hide_name) to redacted and restored file names; hidden ones are numbered, by their numeric id, on from the saved mappings."""
    hidden = numbered(files.where("hide_name").select("file_id"), ["file_id"]).withColumn("hide_name", F.lit(True))
    base = T.base_name(F.col("name"))
    named = files.join(hidden, ["file_id", "hide_name"], "left")
    job = F.concat(F.lit("redacted-job-"), (F.col("pos") + F.lit(saved)).cast("string"), F.lit(".docx"))
    return named.select("file_id", F.when(F.col("hide_name"), job).otherwise(F.concat(base, F.lit("_redacted.docx"))).alias("redacted_name"), F.concat(base, F.lit("_restored.docx")).alias("restored_name"))
