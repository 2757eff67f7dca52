"""The review list: rows (doc_id, pos, term, tag, checked) that a person looks through before redaction."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagveil.functions import text as T


def filtered(rows: DataFrame, *wanted: str) -> DataFrame:
    """Rows whose term or tag holds one of ``wanted``, whatever the case; a blank one is held by all."""
    small = [F.lit(w.strip().lower()) for w in wanted]
    return rows.where(reduce(or_, (F.lower(c).contains(w) for c in ("term", "tag") for w in small)))


def counts(rows: DataFrame) -> DataFrame:
    """(doc_id, selected, declined)."""
    return rows.groupBy("doc_id").agg(F.count_if("checked").alias("selected"), F.count_if(~F.col("checked")).alias("declined"))


def added(rows: DataFrame, typed: DataFrame) -> DataFrame:
    """(doc_id, pos, term, source, checked) of terms (doc_id, term) typed in by hand, to stand before the list; those that it has in another spelling are refused."""
    key = T.norm_key_ui(F.col("term"))
    new = typed.withColumn("key", key).where("key != ''").join(rows.select("doc_id", key.alias("key")), ["doc_id", "key"], "left_anti")
    return new.select("doc_id", F.lit(0).alias("pos"), "term", F.lit("manual").alias("source"), F.lit(True).alias("checked"))
