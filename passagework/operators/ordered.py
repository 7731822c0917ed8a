"""Positions and neighbours in an order over all rows, whatever share of them one key has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize

#: Rows of a stretch in which neighbours are looked up by a window.
STRETCH = 20_000


def positions(rows: DataFrame, order: list[str | Column], name: str = "_position") -> DataFrame:
    """Rows with their place, counted from 0, in an order over the whole table; nulls come first.

    The rows are parted by sampled ranges of the order, so that a document or group with a third of
    them is spread like any other, and each part is sorted on its own. What precedes a part is the
    sum of the counts of those before it, one number for each part. Only rows that are equal in
    ``order`` can't be parted. The sorted rows are written once, so the ranges are the same for both uses.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    made = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = rows.repartitionByRange(parts, *made).sortWithinPartitions(*made)
    # the lower 33 bits of the id count the rows of a partition
    placed = ranged.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    placed = materialize(placed, "ordered")
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    # one row for each partition
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return placed.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def stretches(rows: DataFrame, position: str = "_position", size: int | None = None) -> DataFrame:
    """Rows with ``_stretch`` and ``_own``: each stretch of positions, and beside it the row before and the row after it.

    A window over a stretch sees the neighbours of all its own rows; rows that aren't ``_own`` are to be dropped after it.
    """
    size = STRETCH if size is None else size
    at, own = F.col(position), F.floor(F.col(position) / size)
    also = F.array_compact(F.array(F.lit(0), F.when((at % size == 0) & (at > 0), -1), F.when(at % size == size - 1, 1)))
    return rows.withColumn("_shift", F.explode(also)).withColumn("_stretch", own + F.col("_shift")).withColumn("_own", F.col("_shift") == 0).drop("_shift")
