"""Gapless positions of rows in an order, without bringing them to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.plans.storage import materialize


def ordered(rows: DataFrame, order: list, label: str = "ordered") -> DataFrame:
    """The rows with `place`, gapless from 0 in the order of all rows; in an order that starts with a key, the rows of a key are neighbours.

    Rows are dealt by ranges, sorted within them and written once. A row's place is its number within its range and the
    rows of the ranges before it, which are counted by one row a range. Rows that tie in `order` stand in one of the orders that it allows.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = materialize(dealt.withColumn("place", F.monotonically_increasing_id()), label)
    part = F.shiftright("place", 33)
    counts = numbered.groupBy(part.alias("part")).count()
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # over one row for each range
    first = counts.select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    out = numbered.withColumn("part", part).join(F.broadcast(first), "part")
    out = out.withColumn("place", F.col("first") + F.col("place").bitwiseAND((1 << 33) - 1)).select(*rows.columns, "place")
    out.scratch = numbered.scratch
    return out


def renumbered(rows: DataFrame, keys: list[str], order: list, name: str) -> DataFrame:
    """The rows with `name`, gapless from 1 within each key in the given order, however large a key is."""
    placed = ordered(rows, [*keys, *order])
    first = placed.groupBy(*keys).agg(F.min("place").alias("first_place"))
    out = placed.join(first, keys).withColumn(name, (F.col("place") - F.col("first_place") + 1).cast("int"))
    return out.select(*dict.fromkeys([*rows.columns, name]))
