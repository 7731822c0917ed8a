"""Joins and de-duplication that stay safe when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side is broadcast only if it was measured and has at most so many rows and bytes.
BROADCAST_ROWS, BROADCAST_BYTES = 2_000_000, 32 << 20
#: Copies of each small-side row, and parts of each hot key, beyond that.
SALTS = 16
_FIXED = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def fits_broadcast(side: DataFrame, counted: int | None = None) -> bool:
    """Whether a side may be broadcast, by rows and by bytes.

    Columns of fixed width need the number of rows only, which is taken from ``counted`` if it is
    given; others are measured by the length of their text, in the pass that counts.
    """
    wide = [f.name for f in side.schema.fields if not isinstance(f.dataType, _FIXED)]
    if counted is not None and (counted > BROADCAST_ROWS or not wide):
        return counted <= BROADCAST_ROWS and counted * 8 * len(side.columns) <= BROADCAST_BYTES
    text = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in wide), F.lit(0))
    n, size = side.agg(F.count("*"), F.coalesce(F.sum(text.cast("long")), F.lit(0))).first()
    return n <= BROADCAST_ROWS and size + n * 8 * len(side.columns) <= BROADCAST_BYTES


def semi_or_anti(left: DataFrame, keys: DataFrame, on: list[str], how: str, counted: int | None = None, spread: Column | None = None) -> DataFrame:
    """``left_semi`` or ``left_anti`` join with distinct ``keys``, which are broadcast only within the bounds.

    Beyond them both sides are shuffled. If ``left`` may have many rows of one key, ``spread`` salts
    it: each key is repeated for every salt, so the rows of a hot key are the work of many tasks.
    """
    if fits_broadcast(keys, counted):
        return left.join(F.broadcast(keys), on, how)
    return left.join(keys, on, how) if spread is None else _salted(left, keys, on, spread, how)


def join_bounded(left: DataFrame, right: DataFrame, on: list[str], spread: Column, how: str = "inner", counted: int | None = None) -> DataFrame:
    """Join a large ``left`` that may be skewed on ``on`` with a smaller ``right`` of unique keys.

    ``right`` is measured: within the bounds it is broadcast; beyond them every row of ``right`` is
    repeated once for each salt and ``left`` is salted by ``spread``, so that a key with a third
    of all rows is handled by many tasks. ``how`` can be any join that keeps no row of ``right`` by itself.
    """
    if fits_broadcast(right, counted):
        return left.join(F.broadcast(right), on, how)
    return _salted(left, right, on, spread, how)


def _salted(left: DataFrame, right: DataFrame, on: list[str], spread: Column, how: str) -> DataFrame:
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).join(copies, [*on, "_salt"], how).drop("_salt")


def once_per_key(df: DataFrame, key: str, newest: str | None = None) -> DataFrame:
    """Each key once, without moving the rows whose key comes once.

    Records delivered again repeat all their fields, so the common case is a table with few
    repeated keys. Only the key column is read to find them; rows with other keys pass
    unshuffled, and only repeated keys are reduced: to the row with the greatest ``newest``,
    else to any one, since they are equal. If more keys come again than can be broadcast, all
    rows are reduced by their keys. Rows with a null key are no records and go.
    """
    repeated = df.groupBy(key).count().filter(F.col("count") > 1).select(key)
    n = repeated.count()
    known = df.filter(F.col(key).isNotNull())
    if n == 0:
        return known
    if not fits_broadcast(repeated, n):
        return _reduced(known, key, newest)
    small = F.broadcast(repeated)
    return known.join(small, key, "left_anti").unionByName(_reduced(known.join(small, key, "left_semi"), key, newest).select(*known.columns))


def _reduced(df: DataFrame, key: str, newest: str | None) -> DataFrame:
    if newest is None or newest not in df.columns:
        return df.dropDuplicates([key])
    rest = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(newest)).alias("_row"))
    return best.select(key, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)
