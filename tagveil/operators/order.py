"""Row numbers over a whole table without one task for all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagveil.sources.scratch import stored

#: An id of a row counts from 0 in the low bits and has its partition above them.
_ROW_BITS = 33


def numbered(rows: DataFrame, order: list[Column | str], name: str = "pos", keep: list[str] | None = None) -> DataFrame:
    """Add ``name``, 1 for the first row by ``order``; ``keep`` names the columns that stay (all).

    The table is dealt out by ranges of the whole order, so rows with equal leading columns
    may lie in several ranges, sorted there and stored with their places: one pass over
    ``rows``. Each range goes on from the rows counted in those before it. Rows equal in the
    whole order are numbered in any order, once; an empty table stays empty.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = stored(placed.select(*(rows.columns if keep is None else keep), "_at"))
    part = F.shiftright("_at", _ROW_BITS).cast("int")
    starts, total = [], 0
    counts = {r["part"]: r["count"] for r in placed.groupBy(part.alias("part")).count().collect()}
    for k in range(max(counts, default=0) + 1):
        starts.append(total)
        total += counts.get(k, 0)
    start = F.get(F.array(*(F.lit(n).cast("long") for n in starts)), part)
    return placed.withColumn(name, start + F.col("_at").bitwiseAND((1 << _ROW_BITS) - 1) + 1).drop("_at")
