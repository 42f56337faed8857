"""Positions and running totals of any number of rows, also of one group, without a task that sorts a group.

Rows are range-partitioned by group and order. What each partition holds of each group, summed up over the partitions,
gives the group's total before it; the rest is added up inside of the partition. A hot group spreads over many partitions. The
partitions are written to the shared checkpoint folder, since both steps must see the same ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from maldure.tables import checkpoint


def ranked(rows: DataFrame, order: Sequence[Column], name: str = "rank", within: Sequence[str] = ()) -> DataFrame:
    """Positions from 1 in the given order, of all rows or within each group; null groups are one."""
    keys = [F.col(k).asc() for k in within] + list(order)
    placed = checkpoint(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_p", F.shiftright("_at", 33)).withColumn("_i", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    held = placed.groupBy("_p", *within).agg(F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_from"))
    before = F.sum("_n").over((W.partitionBy(*within) if within else W.partitionBy(F.lit(0))).orderBy("_p")) - F.col("_n")
    first = _keyed(held.withColumn("_first", before - F.col("_from")), within, "_first")
    # without groups there is one row per partition
    out = placed.join(first if within else F.broadcast(first), _same(within)).withColumn(name, (F.col("_first") + F.col("_i") + 1).cast("long"))
    return out.drop("_p", "_i", "_at", "_first", "_q", *[f"_w{i}" for i in range(len(within))])


def running_totals(rows: DataFrame, within: Sequence[str], order: Sequence[str], amount: str) -> DataFrame:
    """``rows`` with ``_upto``, the sum of ``amount`` up to and with each row, and ``_total``, that of its group. The order must be strict."""
    placed = checkpoint(rows.repartitionByRange(*within, *order).withColumn("_p", F.spark_partition_id()))
    own = W.partitionBy(*within)
    held = placed.groupBy("_p", *within).agg(F.sum(amount).alias("_n"))
    held = held.withColumn("_before", F.sum("_n").over(own.orderBy("_p")) - F.col("_n")).withColumn("_total", F.sum("_n").over(own))
    inside = placed.withColumn("_in", F.sum(amount).over(W.partitionBy("_p", *within).orderBy(*order)))
    out = inside.join(_keyed(held, within, "_before", "_total"), _same(within)).withColumn("_upto", F.col("_before") + F.col("_in"))
    return out.drop("_p", "_q", "_in", "_before", *[f"_w{i}" for i in range(len(within))])


def _keyed(held: DataFrame, within: Sequence[str], *values: str) -> DataFrame:
    return held.select(F.col("_p").alias("_q"), *[F.col(k).alias(f"_w{i}") for i, k in enumerate(within)], *values)


def _same(within: Sequence[str]) -> Column:
    same = F.col("_p") == F.col("_q")
    for i, k in enumerate(within):
        same = same & F.col(k).eqNullSafe(F.col(f"_w{i}"))
    return same
