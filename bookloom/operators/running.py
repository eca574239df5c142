"""Running sums and row numbers over a whole table, without a task that sees all rows.

A window without bounds on its partition sorts a whole group in one task. Here a group is cut by
ranges of the ordering first: the totals of ranges are small, their running sums are offsets, and
the rows of a range are numbered or summed by themselves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import stage

DIGITS = (10, 16, 16, 16)  # bits of a whole number, lowest first, that ranges are made of


def _shifted(column: str | Column, bits: int) -> Column:
    return F.call_function("shiftright", column, F.lit(bits))


def sums_before(
    rows: DataFrame, keys: Sequence[str], at: str, value: str, digits: Sequence[int] = DIGITS
) -> DataFrame:
    """``rows`` with ``before``: the sum of ``value`` over the rows of the same keys with a smaller ``at``.

    ``at`` is a whole number, negative ones included; ``keys`` and ``at`` together name a row.
    Numbers that agree beyond their lowest digit form a range; the totals of ranges are summed in
    the same way by the next digit. So a window holds at most two to the power of a digit's bits
    rows, whatever the number of rows of a key, if the digits cover ``at``. Rows without any
    before them get 0; no rows give none. ``rows`` is read once per digit, so stage what is costly.
    """
    if not digits:
        own = Window.partitionBy(*keys).orderBy(at)
        summed = F.sum(value).over(own.rowsBetween(Window.unboundedPreceding, -1))
        return rows.withColumn("before", F.coalesce(summed, F.lit(0)).cast("bigint"))
    ranged = rows.selectExpr("*", f"shiftright({at}, {digits[0]}) as _range")
    totals = ranged.groupBy(*keys, "_range").agg(F.sum(value).alias("_total"))
    offsets = sums_before(
        totals.withColumnRenamed("_range", "_at"), keys, "_at", "_total", digits[1:]
    ).select(*keys, F.col("_at").alias("_range"), F.col("before").alias("_offset"))
    within = sums_before(ranged, [*keys, "_range"], at, value, ())
    return (
        within.join(offsets, [*keys, "_range"])
        .withColumn("before", F.col("before") + F.col("_offset"))
        .select(*rows.columns, "before")
    )


def numbered(rows: DataFrame, order: Sequence[str], name: str = "number") -> DataFrame:
    """``rows`` with their number (from 0) by ``order``, staged. Equal rows are numbered as they come.

    The rows are sorted by range; the number of a row is its place in its range plus the sizes of
    the ranges before it, of which there are as many as there are shuffle partitions.
    """
    placed = stage(
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_place", F.monotonically_increasing_id()),
        "numbered",
    )
    # Such an id is the number of its partition, then that of the row in 33 bits.
    placed = placed.withColumn("_range", _shifted("_place", 33))
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )
    own = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(offsets), "_range").select(
        *rows.columns, (own + F.col("_offset")).alias(name)
    )
