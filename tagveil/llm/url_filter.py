"""URL verdicts: rules by host and path, and link-graph propagation where no rule fits.

Trust starts at hosts whose pages rules allow and follows links (personalised PageRank);
distrust starts at hosts whose pages rules block and follows links backwards, to those that
point there. Hosts are linked by their pages' links and, both ways, with the domain above
them, so hosts of one domain meet there. A host is blocked if its share of distrust is above
its share of trust.
DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagveil.llm.common import dropped, stored

#: (host, path, verdict); a rule holds for its host and all below it, where the path starts so.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
DAMPING, SETTLED = 0.85, 1e-4
#: Rounds of the propagation between two cuts of the lineage; the first of every three such blocks ends with an extrapolation.
ROUNDS_AT_ONCE, BLOCKS_A_LEAP = 4, 3
#: Rounds after which something must be wrong (each leaves at most the damping's share of the change).
MOST_ROUNDS = 1000
#: Distrust over trust above which a host is blocked.
THRESHOLD = 1.0
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BASE = r"""(?i)<base\b[^>]*\bhref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)"""
_RELATIVE = r"""(?i)\b(?:href|src|action)\s*=\s*["']?(?!\s*(?:[a-z][a-z0-9+.-]*:|//))"""
_LINK = r"""(?i)\b(?:href|src|action)\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)"""


def host_of(url: Column) -> Column:
    """What stands after the first :// up to a slash, question mark, hash or the end; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _CAPITALS, _SMALL), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rules_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame([(h, p, v, h + p) for h, p, v in rules], "rule_host string, rule_path string, rule_verdict string, rule string")


#: The host itself and every host above it.
_SUFFIXES = "transform(sequence(1, length(host) - length(replace(host, '.', '')) + 1), i -> substring_index(host, '.', -i))"


def ruled(places: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path) to (host, path, rule, rule_verdict): the longest rule that fits, by equality of host suffixes."""
    distinct = places.select("host", "path").distinct()
    fits = distinct.withColumn("rule_host", F.explode(F.expr(_SUFFIXES))).join(rules, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    best = fits.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "rule_verdict")).alias("m"))
    return best.select("host", "path", "m.rule", "m.rule_verdict")


def domain_links(hosts: DataFrame) -> DataFrame:
    """(src, dst) between each host and the domain above it, and so on up to the domain of two labels, both ways."""
    names = hosts.where(~F.col("host").rlike(r"^[0-9.:\[\]]*$")).withColumn("up", F.expr(f"slice({_SUFFIXES}, 2, length(host))"))
    steps = F.filter(F.arrays_zip(F.slice("up", F.lit(2), F.size("up")).alias("src"), F.col("up").alias("dst")), lambda x: x["src"].isNotNull())
    found = names.where(F.size("up") > 1).select(F.explode(steps).alias("e")).select("e.src", "e.dst").distinct()
    return found.unionByName(found.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def page_links(pages: DataFrame) -> DataFrame:
    """(src, dst) of the links in pages (host, html): those that name a host, and relative ones where the page's base is another host."""
    small = lambda c: F.translate(c, _CAPITALS, _SMALL)
    absolute = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1))).alias("dst")).select("src", small("dst").alias("dst"))
    based = pages.where(F.col("html").rlike(_BASE)).select(F.col("host").alias("src"), small(F.regexp_extract("html", _BASE, 1)).alias("dst"), F.regexp_count("html", F.lit(_RELATIVE)).alias("n"))
    return absolute.unionByName(based.where("n > 0").select("src", "dst"))


def host_edges(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """(src, dst, weight) between different hosts: links in the html, counted, and those between a host and the domains above it.

    ``pages`` has host and html, ``hosts`` the hosts of pages. Links are counted map-side,
    so a host with very many pages is a few rows in the shuffle.
    """
    links = page_links(pages).where("src != dst and src != '' and dst != ''").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    known = hosts.select("host").unionByName(links.select(F.col("dst").alias("host"))).distinct()
    both = links.unionByName(domain_links(known).withColumn("weight", F.lit(1.0)))
    return both.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, settled: float = SETTLED) -> DataFrame:
    """(host, kind, mass): ``seeds`` has the same columns; kind ``trust`` follows edges, ``distrust`` runs against them.

    Mass at hosts without a way on starts anew at the seeds; that only scales the fixed
    point, so each kind is normalised at the end. Ends when a round reaches no new host and
    moves next to nothing, so hosts however many links from a seed have their mass.

    Links both ways make mass swing to and fro, which plain rounds damp by the damping alone.
    Power extrapolation takes that part of the error out at a stroke. No mass falls below
    what plain rounds gave it, as these only ever add, and plain rounds have the last word.
    """
    out = edges.groupBy("src").agg(F.sum("weight").alias("all_out"))
    into = edges.groupBy("dst").agg(F.sum("weight").alias("all_in"))
    forth = edges.join(out, "src").select(F.col("src").alias("host"), F.col("dst").alias("to"), F.lit("trust").alias("kind"), (F.col("weight") / F.col("all_out")).alias("share"))
    back = edges.join(into, "dst").select(F.col("dst").alias("host"), F.col("src").alias("to"), F.lit("distrust").alias("kind"), (F.col("weight") / F.col("all_in")).alias("share"))
    arcs = stored(forth.unionByName(back))
    total = seeds.groupBy("kind").agg(F.sum("mass").alias("all"))
    start = stored(seeds.join(total, "kind").where("all > 0").select("host", "kind", (F.col("mass") / F.col("all") * (1 - damping)).alias("mass")))

    def onwards(now: DataFrame) -> DataFrame:
        sent = arcs.join(now, ["host", "kind"]).select(F.col("to").alias("host"), "kind", (F.col("mass") * F.col("share") * damping).alias("mass"))
        return sent.unionByName(start)

    now, held, reached = start, None, start.count()
    zero, decay = F.lit(0.0), damping**ROUNDS_AT_ONCE
    for block in range(MOST_ROUNDS // ROUNDS_AT_ONCE):
        first = now.select("host", "kind", zero.alias("mass"), zero.alias("old"), F.col("mass").alias("first"))
        for _ in range(ROUNDS_AT_ONCE - 1):
            now = onwards(now).groupBy("host", "kind").agg(F.sum("mass").alias("mass"))
        last = onwards(now).select("host", "kind", "mass", zero.alias("old"), zero.alias("first"))
        last = last.unionByName(now.select("host", "kind", zero.alias("mass"), F.col("mass").alias("old"), zero.alias("first"))).unionByName(first)
        after = stored(last.groupBy("host", "kind").agg(*(F.sum(c).alias(c) for c in ("mass", "old", "first"))))
        dropped(held)
        held = after
        moved, n = after.agg(F.sum(F.abs(F.col("mass") - F.col("old"))), F.count("*")).first()
        now = after.select("host", "kind", "mass")
        if n == reached and (moved or 0.0) < settled * (1 - damping):
            break
        reached = n
        if block % BLOCKS_A_LEAP == 0:
            now = after.select("host", "kind", F.greatest("mass", (F.col("mass") - decay * F.col("first")) / (1 - decay)).alias("mass"))
    else:
        raise RuntimeError("the propagation did not settle")
    every = now.groupBy("kind").agg(F.sum("mass").alias("all"))
    return now.join(every, "kind").select("host", "kind", (F.col("mass") / F.col("all")).alias("mass"))


def judge(pages: DataFrame, rules: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Host, path, rule and verdict of every page.

    Null urls and those without :// have an empty host and path, which no rule fits and no
    link reaches: they are allowed. Hosts that neither trust nor distrust reaches are
    allowed. ``found_by`` tells whether a rule, rules on the host's own pages, links alone or
    nothing speak to a page. Null html has no links; very long html is searched whole; repeated pages count and return each time; of rules
    equally long the last by code point wins; an empty table gives no row; columns besides
    page_id, url and html are not looked at.
    """
    placed = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    marked = stored(placed.drop("html").join(ruled(placed, rules), ["host", "path"], "left"))
    by_host = stored(marked.groupBy("host").agg(F.count_if(F.col("rule_verdict") == "allow").cast("double").alias("trust"), F.count_if(F.col("rule_verdict") == "block").cast("double").alias("distrust")))
    seeds = by_host.where("host != ''").select("host", F.explode(F.expr("map('trust', trust, 'distrust', distrust)")).alias("kind", "mass")).where("mass > 0")
    found = propagate(stored(host_edges(placed, by_host.select("host"))), seeds)
    scores = stored(found.groupBy("host").agg(F.sum(F.when(F.col("kind") == "trust", F.col("mass")).otherwise(0.0)).alias("trust"), F.sum(F.when(F.col("kind") == "distrust", F.col("mass")).otherwise(0.0)).alias("distrust")))
    own = by_host.select("host", (F.col("trust") + F.col("distrust") > 0).alias("seeded"))
    out = marked.join(own, "host").join(scores, "host", "left").withColumn("trust", F.coalesce("trust", F.lit(0.0))).withColumn("distrust", F.coalesce("distrust", F.lit(0.0)))
    by_links = F.when(F.col("distrust") > F.col("trust") * threshold, "block").otherwise("allow")
    found_by = F.when(F.col("rule").isNotNull(), "rule").when(F.col("seeded") & (F.col("host") != ""), "own pages").when(F.col("trust") + F.col("distrust") > 0, "links").otherwise("none")
    return out.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", by_links).alias("verdict"), "trust", "distrust", found_by.alias("found_by"))
