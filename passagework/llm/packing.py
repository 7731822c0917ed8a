"""Problem 8: items into containers of fixed capacity by variable-capacity best fit."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .encoding import token_counts, vocabulary_path

CAPACITY = 2048
#: Permitted container sizes and what a container costs on top of its size, in the same unit.
SIZES = (256, 512, 1024, 2048)
OVERHEAD = 8
#: Pieces packed together; packing quality is settled long before, and a group fits in a task's memory.
PIECES_AT_ONCE = 50_000


class _Left:
    """How many items of each length are still to be placed, with a bit for each length there is."""

    def __init__(self, lengths: list[int], top: int) -> None:
        self.times, self.present, self.total = [0] * (top + 1), 0, sum(lengths)
        for n in lengths:
            self.times[n] += 1
            self.present |= 1 << n

    def take(self, n: int) -> None:
        self.times[n] -= 1
        self.total -= n
        if not self.times[n]:
            self.present &= ~(1 << n)

    def filling(self, room: int) -> int:
        """What the longest items that still fit, one after the other, would put into a room."""
        filled, used, present = 0, {}, self.present & ~1
        while room and (fitting := present & ((2 << room) - 1)):
            n = fitting.bit_length() - 1
            if self.times[n] <= used.get(n, 0):
                present &= ~(1 << n)
                continue
            fit = min(room // n, self.times[n] - used.get(n, 0))
            used[n] = used.get(n, 0) + fit
            filled += fit * n
            room -= fit * n
        return filled


def best_fit(items: list[tuple], sizes: tuple[int, ...] = SIZES, overhead: int = OVERHEAD) -> list[tuple[int, int]]:
    """``(container, size)`` for each item ``(length, ...)``, none longer than the largest size.

    Items go from the longest to the shortest into the open container with the least room that
    still holds them. If there is none, every permitted size that holds the item is tried on what is
    left: it would be filled by the longest remaining items that fit, but for what the rooms that
    are open already will take. The size of least cost, itself and ``overhead``, for each unit it
    would hold is opened. At the end each container shrinks to the least permitted size that holds
    its contents. Items of length 0 join the first container.
    """
    sizes = tuple(sorted(sizes))
    top = sizes[-1]
    order = sorted(range(len(items)), key=lambda i: -items[i][0])
    left = _Left([x[0] for x in items], top)
    at_room: list[list[int]] = [[] for _ in range(top + 1)]
    open_rooms = spare = 0  # bit r: some container has room r; the sum of all rooms
    filled: list[int] = []
    where = [0] * len(items)

    def cost(size: int, need: int) -> tuple[float, int]:
        held = need + min(left.filling(size - need), max(0, left.total - spare))
        return (size + overhead) / max(1, held), -size

    for i in order:
        need = items[i][0]
        left.take(need)
        if need == 0 and filled:
            continue
        fitting = open_rooms >> need
        if fitting:
            room = need + (fitting & -fitting).bit_length() - 1
            container = at_room[room].pop()
            if not at_room[room]:
                open_rooms &= ~(1 << room)
            spare -= room
        else:
            room = min((s for s in sizes if s >= need), key=lambda s: cost(s, need))
            container = len(filled)
            filled.append(0)
        filled[container] += need
        where[i] = container
        room -= need
        spare += room
        at_room[room].append(container)
        open_rooms |= 1 << room
    shrunk = [next(s for s in sizes if s >= f) for f in filled]
    return [(c, shrunk[c]) for c in where]


def pack(items: DataFrame, key: str = "doc_id", length: str = "n_tokens", capacity: int = CAPACITY, sizes: tuple[int, ...] = SIZES, pieces_at_once: int = PIECES_AT_ONCE) -> DataFrame:
    """Place all items; ``(key, piece, start, length, bucket, container, capacity)``.

    An item longer than ``capacity`` is divided into pieces of ``capacity`` and a rest; no other
    is. Pieces are counted and spread by a hash of key and piece over buckets of about
    ``pieces_at_once``, so that no source, length or long item can fill one, and each bucket is packed by :func:`best_fit` on its
    own: a bucket leaves room in its last containers only. Null lengths and keys are dropped,
    length 0 is placed, an empty table gives no rows. Containers are numbered within a bucket.
    """
    sizes = tuple(s for s in sizes if s < capacity) + (capacity,)
    n = F.col(length)
    pieces = (
        items.filter(n.isNotNull() & F.col(key).isNotNull())
        .select(F.col(key), n.cast("long").alias("_n"), F.posexplode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.floor((n - 1) / capacity)))).alias("piece", "_at"))
        .select(key, "piece", (F.col("_at") * capacity).alias("start"), F.least(F.lit(capacity).cast("long"), F.col("_n") - F.col("_at") * capacity).alias("length"))
    )
    total = items.filter(n.isNotNull() & F.col(key).isNotNull()).agg(F.coalesce(F.sum(F.greatest(F.lit(1), F.ceil(n / capacity))), F.lit(0))).first()[0]
    buckets = max(1, -(-int(total) // pieces_at_once))
    schema = f"{key} {items.schema[key].dataType.simpleString()}, piece int, start long, length long, bucket int, container int, capacity int"

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values([key, "piece"], ignore_index=True)
        placed = best_fit(list(zip(batch["length"].tolist())), sizes)
        batch["container"] = [c for c, _ in placed]
        batch["capacity"] = [s for _, s in placed]
        return batch[[key, "piece", "start", "length", "bucket", "container", "capacity"]]

    return pieces.withColumn("bucket", F.pmod(F.xxhash64(key, "piece"), F.lit(buckets)).cast("int")).groupBy("bucket").applyInPandas(run, schema)


def _packed(spark: SparkSession, d: str) -> DataFrame:
    from ..session import materialize

    sizes = materialize(token_counts(table(spark, d, "documents"), vocabulary_path()), "sizes")
    return pack(sizes)


def found(spark: SparkSession, d: str) -> DataFrame:
    """p8_found: documents that the packing had to divide."""
    return _packed(spark, d).filter("piece > 0").select("doc_id").distinct()


def containers(spark: SparkSession, d: str) -> DataFrame:
    """p8_containers: what each container holds and leaves over."""
    return (
        _packed(spark, d).groupBy("bucket", "container", "capacity")
        .agg(F.count("*").alias("items"), F.sum("length").alias("tokens")).withColumn("unused", F.col("capacity") - F.col("tokens"))
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p8_found": found,
    "p8_placement": _packed,
    "p8_containers": containers,
}
SQL: dict[str, str] = {}
