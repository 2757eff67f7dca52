"""Corpora derived from the driver's tables, written once in SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tagveil.functions.patterns import STATES
from tagveil.sources.scratch import dealt

_STATES = STATES.replace("|", "")
_STATE = f"substr('{_STATES}', cast(1 + 2 * (c_custkey % 51) as int), 2)"


def _digits(number: str, width: int) -> str:
    return f"lpad(cast({number} as string), {width}, '0')"


#: A letter about an order, holding every kind of value; some only in some letters.
LETTER = " || ".join([
    "'Dear ' || c_name || ' of ' || n_name || ', your account no: '", _digits("c_custkey", 5), "'-' || cast(o_orderkey as string)",
    "'. Invoice #: INV-' || cast(o_orderkey as string) || ' totals $' || cast(cast(o_totalprice as decimal(12,2)) as string)",
    "'.\n' || 'Write to c' || cast(c_custkey as string) || '@mail' || cast(c_custkey % 7 as string) || '.example.com'",
    "' or call (' || cast(200 + c_custkey % 700 as string) || ') 555-'", _digits("o_orderkey % 10000", 4),
    "case when o_orderkey % 3 = 0 then '; SSN 123-45-' || " + _digits("o_orderkey % 10000", 4) + " else '; EIN ' || " + _digits("o_orderkey % 90 + 10", 2) + " || '-' || " + _digits("o_orderkey * 17 % 10000000", 7) + " end",
    "'; routing ' || " + _digits("o_orderkey * 104729 % 1000000000", 9),
    "case when o_orderkey % 4 = 0 then '; card 4' || " + _digits("o_orderkey * 7919 % 1000000000000000", 15) + " || ' ok' else '; IBAN DE' || " + _digits("o_orderkey % 100", 2) + " || " + _digits("o_orderkey * 31337", 18) + " end",
    "'; ship to Town, ' || " + _STATE + " || ' ' || " + _digits("10000 + c_custkey % 80000", 5) + " || case when o_orderkey % 2 = 0 then '-' || " + _digits("o_orderkey % 10000", 4) + " else '' end",
    "'; see https://shop.example.com/o/' || cast(o_orderkey as string) || '?c=1 for ' || c_name || '. ' || n_name",
])

_LETTER_TABLES = "from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey"
LETTERS_SQL = f"select o_orderkey as doc_id, {LETTER} as text, c_custkey, c_name, n_name {_LETTER_TABLES}"
_LETTER_ROWS = f"select o_orderkey, o_totalprice, c_custkey, c_name, n_name {_LETTER_TABLES}"

#: Odd spellings of names, to be normalised.
SPELLING = "case cast(c_custkey % 5 as int) when 0 then '  ' || lower(c_name) || '. ' when 1 then '[[' || c_mktsegment || ' ' || cast(c_custkey as string) || ']]' when 2 then upper(c_mktsegment) || '_' || c_name when 3 then ' o' || chr(39) || c_name || ' & co. ' else c_mktsegment || '\t ' || c_name || '--' end"
SPELLINGS_SQL = f"select c_custkey as id, {SPELLING} as raw from customer"

#: Values of all sorts, to guess their type.
VALUE = "case cast(c_custkey % 8 as int) when 0 then 'a' || cast(c_custkey as string) || '@x.example' when 1 then '123-45-' || lpad(cast(c_custkey % 10000 as string), 4, '0') when 2 then '(555) 010-' || lpad(cast(c_custkey % 10000 as string), 4, '0') when 3 then c_mktsegment || ' Holdings' when 4 then 'Nordic Trading ' || cast(c_custkey as string) when 5 then ' ' when 6 then 'Jane ' || c_mktsegment else c_name || ' Inc.' end"
VALUES_SQL = f"select c_custkey as id, {VALUE} as value from customer"

#: Drafts with tags as they come back: whole, mangled, unknown.
DRAFT = "'Order for ' || case cast(o_orderkey % 4 as int) when 0 then '[[CUST_' || cast(o_custkey as string) || ']]' when 1 then '**[[CUST_' || cast(o_custkey as string) || ']]**' when 2 then '[[ cust ' || cast(o_custkey as string) || ' ]]' else '[[CUST_0_' || cast(o_orderkey % 9 as string) || ']]' end || ' and [[CUST_' || cast(o_custkey as string) || ']].'"
DRAFTS_SQL = f"select o_orderkey as doc_id, o_custkey, {DRAFT} as text from orders"

#: Dictionaries of two sides with keys that differ in spelling only.
BASE_SQL = "select c_name as term, '[[OLD_' || cast(c_custkey as string) || ']]' as tag, case when c_custkey % 3 = 0 then 'manual' else 'redaction' end as source, c_custkey as ord from customer where c_custkey % 2 = 0"
INCOMING_SQL = "select upper(c_name) || '.' as term, '[[NEW_' || cast(c_custkey as string) || ']]' as tag, 'redaction' as source, c_custkey as ord from customer where c_custkey % 3 = 0"

#: Saved mappings: one a user, newest entry by event.
SAVED_SQL = "select user_id, event_id, '[[' || upper(event_type) || '_' || cast(event_id % 50 as string) || ']]' as tag, cast(value as string) as val from events"

_FRAMES = {
    "letters": (LETTERS_SQL, ("orders", "customer", "nation")), "spellings": (SPELLINGS_SQL, ("customer",)), "values_": (VALUES_SQL, ("customer",)),
    "drafts": (DRAFTS_SQL, ("orders",)), "base_": (BASE_SQL, ("customer",)), "incoming": (INCOMING_SQL, ("customer",)),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived corpus as a DataFrame; columns that a query does not use are never read."""
    sql, tables = _FRAMES[name]
    if name == "letters":
        # letters are a hundred times their tables, which come in too few pieces for them; dealt out before the texts are made
        rows = spark.sql(_braced(_LETTER_ROWS, tables), **{t: table(spark, sf_dir, t) for t in tables})
        return dealt(rows, "o_orderkey").selectExpr("o_orderkey as doc_id", f"{LETTER} as text", "c_custkey", "c_name", "n_name")
    return spark.sql(_braced(sql, tables), **{t: table(spark, sf_dir, t) for t in tables})


def _braced(sql: str, tables: tuple[str, ...]) -> str:
    import re

    body = sql.replace("{", "{{").replace("}", "}}").replace("\\", "\\\\").replace("\n", "\\n").replace("\t", "\\t")
    return re.sub(rf"\b(from|join) ({'|'.join(tables)})\b", r"\1 {\2}", body)


def with_sql(name: str) -> str:
    """A WITH item for DuckDB."""
    return f"{name} as ({_FRAMES[name][0]})"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


