"""Problem 3: groups of nearly equal texts by min-max hashing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..operators.keyed import join_bounded, once_per_key, semi_or_anti
from ..session import materialize, table
from .encoding import by_size
from .words import numbered, runs, words_of

#: Words of a shingle, words a text needs, and the similarity from which two texts are linked.
SHINGLE, LEAST_WORDS, LEAST_SIMILARITY = 3, 20, 0.6
#: Bands and values in a band. A pair of similarity s misses all bands with probability (1 - s^5)^80: 0.0015 at 0.6, 0.00001 at 0.67.
BANDS, ROWS = 80, 5
#: Members up to which all pairs of a bucket are candidates, and further values by which larger buckets are divided.
SMALL_BUCKET, REFINEMENTS = 48, 12
#: Members of a block, and rows of a partition, where a divided part is compared block against block.
BLOCK, BLOCK_ROWS = 1024, 40_000
#: Entries (text, band) of a partition of buckets on average, and entries that a map task packs at once.
ENTRIES, PACKED_AT_ONCE = 2_000_000, 1_000_000
#: A bucket is hot from so many members, or from this part of all texts if that is more; a sample of one in so many texts shows it.
HOT_ROWS, HOT_PART, HOT_SAMPLE = 1_000_000, 10_000, 1024
#: Members of a block of a group whose pairs one task writes.
PAIR_BLOCK = 2_000
_PRIME_SEED = 77_003


def _multipliers(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, n, dtype=np.uint32)


def minmax(shingles: np.ndarray, per_text: np.ndarray, values: int, seed: int = _PRIME_SEED) -> np.ndarray:
    """``values`` min-max hashes of each text's shingles; texts without shingles are left out.

    Each permutation gives two values, its minimum and its maximum, so half as many permutations
    are evaluated as min-wise hashing needs; for each of the two the chance of agreement is the
    similarity, and the estimate over both is unbiased with a lower variance. Shingles are random
    numbers already, of which the upper half is permuted.
    """
    some = per_text > 0
    starts = (np.cumsum(per_text) - per_text)[some]
    out = np.empty((values, int(some.sum())), np.uint32)
    if not out.size:
        return out.T
    a, b = _multipliers((values + 1) // 2, seed)
    upper = (shingles >> np.uint64(32)).astype(np.uint32)
    hashed = np.empty_like(upper)
    with np.errstate(over="ignore"):
        for p in range(len(a)):
            np.bitwise_xor(upper, b[p], out=hashed)
            np.multiply(hashed, a[p], out=hashed)
            np.minimum.reduceat(hashed, starts, out=out[2 * p])
            if 2 * p + 1 < values:
                np.maximum.reduceat(hashed, starts, out=out[2 * p + 1])
    return out.T


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    keys = np.zeros((len(signature), bands), np.uint64)
    with np.errstate(over="ignore"):
        for r in range(rows):
            keys = (keys ^ signature[:, r : bands * rows : rows].astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
            keys ^= keys >> np.uint64(32)
        keys = (keys + np.arange(bands, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return keys.view(np.int64)


def _shingled(ids: np.ndarray, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, shingles and their number for texts of enough words."""
    words, counts = numbered(texts)
    enough = counts >= LEAST_WORDS
    if not enough.all():
        words, ids, counts = words[np.repeat(enough, counts)], ids[enough], counts[enough]
    shingles, per_text = runs(words, counts, SHINGLE)
    return ids, shingles, per_text


def pack_entries(keys: np.ndarray, ids: np.ndarray, parts: int) -> Iterator[tuple[int, bytes]]:
    """``(part, bytes)``: entries by the part that their key belongs to, nine bytes each if the ids lie close enough.

    The upper bits of a key choose the part and the lower 40 are kept, so that two buckets become
    one by chance only, which costs a comparison and loses nothing.
    """
    keys = keys.view(np.uint64)
    part = ((keys >> np.uint64(40)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    bounds = np.searchsorted(part[order], np.arange(parts + 1))
    short = keys[order].view(np.uint8).reshape(-1, 8)[:, :5]
    ids = ids[order]
    for p in np.flatnonzero(np.diff(bounds)).tolist():
        own = ids[bounds[p] : bounds[p + 1]]
        base = int(own.min())
        narrow = int(own.max()) - base < 2**32
        head = np.array([len(own), base, narrow], np.int64).tobytes()
        yield p, head + short[bounds[p] : bounds[p + 1]].tobytes() + ((own - base).astype(np.uint32) if narrow else own).tobytes()


def unpack_entries(part: int, packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Keys, with the part in their upper bits, and ids of one row of :func:`pack_entries`."""
    n, base, narrow = np.frombuffer(packed, np.int64, 3).tolist()
    keys = np.zeros((n, 8), np.uint8)
    keys[:, :5] = np.frombuffer(packed, np.uint8, 5 * n, 24).reshape(n, 5)
    ids = np.frombuffer(packed, np.uint32 if narrow else np.int64, n, 24 + 5 * n).astype(np.int64)
    return keys.view(np.int64).ravel() | np.int64(part << 40), ids + base if narrow else ids


def bucket_pairs(keys: np.ndarray, ids: np.ndarray, small: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidate pairs of buckets, and a mask of rows in buckets too large for all pairs.

    A larger bucket gives the pairs of its least member with all others only.
    """
    small = SMALL_BUCKET if small is None else small
    order = np.argsort(keys, kind="stable")
    again = np.zeros(len(keys) + 1, bool)
    again[1:-1] = keys[order][1:] == keys[order][:-1]
    # most entries are alone in their bucket
    order = order[again[1:] | again[:-1]]
    order = order[np.lexsort((ids[order], keys[order]))]
    mask = np.zeros(len(keys), bool)
    keys, ids = keys[order], ids[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(keys)))
    group = np.repeat(np.arange(len(start)), size)
    position = np.arange(len(keys)) - start[group]
    large = size[group] > small
    hub = large & (position > 0)
    a, b = [ids[start[group[hub]]]], [ids[hub]]
    for step in range(1, min(small, int(size.max(initial=1)))):
        first = np.flatnonzero(~large & (position + step < size[group]))
        if not len(first):
            break
        a.append(ids[first])
        b.append(ids[first + step])
    mask[order] = large
    return np.concatenate(a), np.concatenate(b), mask


def _longs(**columns: np.ndarray | None) -> pa.RecordBatch:
    """Columns of longs; those given as None are null."""
    n = max(len(c) for c in columns.values() if c is not None)
    return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()) if c is None else pa.array(c, pa.int64()) for c in columns.values()], list(columns))


def _signatures(batches: Iterator[pa.RecordBatch], values: int, seed: int = _PRIME_SEED) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and min-max values of all texts that have enough words."""
    for batch in batches:
        all_ids, all_texts = np.asarray(batch.column("id")), batch.column("text").to_pylist()
        for part in by_size(all_texts):
            ids, shingles, per_text = _shingled(all_ids[part], all_texts[part])
            if len(ids):
                yield ids, minmax(shingles, per_text, values, seed)


def _hot_keys(texts: DataFrame, most: int) -> np.ndarray:
    """Keys of buckets that a task can't be given whole, found in a sample of the texts that serves nothing else.

    There are ``2 * HOT_PART * BANDS`` of them at most, whatever the number of texts.
    """
    least = max(HOT_ROWS, most // HOT_PART)
    if most < least // 2:
        return np.zeros(0, np.int64)

    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, values in _signatures(batches, BANDS * ROWS):
            yield _longs(key=band_keys(values).ravel())

    sampled = texts.filter(F.pmod(F.xxhash64("id", F.lit(_PRIME_SEED)), F.lit(HOT_SAMPLE)) == 0).mapInArrow(keys_of, "key long")
    hot = sampled.groupBy("key").count().filter(F.col("count") >= max(2, least // 2 // HOT_SAMPLE)).select("key")
    return np.sort(np.asarray(hot.toArrow().column("key").combine_chunks(), np.int64))


def links(texts: DataFrame, similarity: float = LEAST_SIMILARITY, most: int | None = None) -> DataFrame:
    """``(a, b)``, a < b: linked pairs among ``(id, text)`` rows, none of whose texts come twice.

    1. One pass makes min-max signatures, whose bands are the keys of buckets. A map task sorts its
       entries by the part of the buckets they go to and packs them, so that the shuffle moves a
       few large rows. The number of parts follows ``most``, a bound of the number of texts (they
       are counted if it is None), so that a part holds about ``ENTRIES`` entries at any size.
    2. Pairs of a bucket are candidates. A bucket of more than ``SMALL_BUCKET`` members gives the
       pairs with its least member and is divided by each of ``REFINEMENTS`` further values, in
       whose buckets the same holds again: texts of similarity 0.6 miss all of those with a
       chance of 0.4^12.
    3. Candidates are verified by their whole sets of shingles.
    4. A divided bucket that is still large, and whose members the links of step 3 don't all connect,
       is compared whole (:func:`_across`): what its members agree on may be a template's words only.
       Of two components that are alike there, one link is given.

    Entries of a bucket that is too large for a task (:func:`_hot_keys`) aren't packed: the least
    member is found by a combined aggregation and joined with :func:`join_bounded`, so that no task
    holds them all. Every text is still in all its buckets.
    """
    spark = texts.sparkSession
    texts = texts.select(F.col("id").cast("long").alias("id"), "text")
    most = texts.count() if most is None else most
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-most * BANDS // ENTRIES))
    hot = spark.sparkContext.broadcast(_hot_keys(texts, most))

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        ids: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            k, i = np.concatenate(keys), np.concatenate(ids)
            keys.clear()
            ids.clear()
            if len(hot.value):
                burns = np.isin(k, hot.value)
                if burns.any():
                    n = int(burns.sum())
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(n) % parts, pa.int32()), pa.nulls(n, pa.binary()), pa.array(k[burns]), pa.array(i[burns])], ["part", "packed", "key", "id"])
                    k, i = k[~burns], i[~burns]
            rows = list(pack_entries(k, i, parts))
            for start in range(0, len(rows), 256):
                some = rows[start : start + 256]
                none = pa.nulls(len(some), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in some], pa.int32()), pa.array([x for _, x in some], pa.binary()), none, none], ["part", "packed", "key", "id"])

        for own, values in _signatures(batches, BANDS * ROWS):
            keys.append(band_keys(values).ravel())
            ids.append(np.repeat(own, BANDS))
            if sum(map(len, keys)) >= PACKED_AT_ONCE:
                yield from flush()
        if keys:
            yield from flush()

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = []
        for batch in batches:
            apart = batch.filter(batch.column("key").is_valid())
            if apart.num_rows:
                yield _longs(a=np.asarray(apart.column("id")), b=None, key=np.asarray(apart.column("key")), hot=np.ones(apart.num_rows, np.int64))
            entries += [unpack_entries(p, x) for p, x in zip(batch.column("part").to_pylist(), batch.column("packed").to_pylist(), strict=True) if x is not None]
        if not entries:
            return
        keys, ids = (np.concatenate(c) for c in zip(*entries, strict=True))
        del entries
        a, b, large = bucket_pairs(keys, ids)
        if len(a):
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
            for start in range(0, len(pairs), 100_000):
                yield _longs(a=pairs[start : start + 100_000, 0], b=pairs[start : start + 100_000, 1], key=None, hot=None)
        if large.any():
            yield _longs(a=ids[large], b=None, key=keys[large], hot=None)

    packed = texts.mapInArrow(signed, "part int, packed binary, key long, id long").repartitionById(parts, "part")
    pieces = materialize(packed.mapInArrow(paired, "a long, b long, key long, hot long"), "buckets")
    candidates = pieces.filter("b is not null").select("a", "b")
    divide = pieces.filter("key is not null").select("key", F.col("a").alias("id"))
    if len(hot.value):
        burning = pieces.filter("hot is not null").select("key", F.col("a").alias("id"))
        hubs = burning.groupBy("key").agg(F.min("id").alias("hub"))
        apart = join_bounded(burning, hubs, ["key"], F.col("id"), counted=len(hot.value))
        candidates = candidates.unionByName(apart.filter("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")))
    members = large = None
    if divide.limit(1).count():
        members, large, divided = _divided(texts, divide)
        candidates = candidates.unionByName(divided)
    likely = candidates.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    likely = materialize(likely, "likely")
    ids = likely.select(F.col("a").alias("id")).unionByName(likely.select(F.col("b").alias("id"))).distinct()
    involved = semi_or_anti(texts, ids, ["id"], "left_semi")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [alike(x, y) >= similarity - 1e-12 for x, y in zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    both = likely.join(involved.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(involved.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    linked = both.select("a", "b", "ta", "tb").mapInArrow(verified, "a long, b long")
    if large is None or not large.limit(1).count():
        return linked
    linked = materialize(linked, "linked")
    return linked.unionByName(_across(texts, linked, members, large, similarity))


def _divided(texts: DataFrame, divide: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The parts of large buckets, divided by further min-max values, those parts that are still large, and candidates."""
    spark = texts.sparkSession

    def further(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, values in _signatures(batches, REFINEMENTS, _PRIME_SEED + 2):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(values.astype(np.int64).tolist(), pa.list_(pa.int64()))], ["id", "more"])

    ids = divide.select("id").distinct()
    values = semi_or_anti(texts, ids, ["id"], "left_semi").mapInArrow(further, "id long, more array<long>")
    parts = (
        divide.distinct().join(values, "id").select("id", "key", F.posexplode("more").alias("at", "value"))
        .select(F.xxhash64("key", "at", "value").alias("key"), "id")
    )
    parts = materialize(parts, "divided")
    # large parts are joined to their least member, by combined aggregations; small parts give all pairs
    sizes = parts.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("hub")).filter("n > 1")
    sizes = materialize(sizes, "parts")
    large = sizes.filter(F.col("n") > SMALL_BUCKET)
    stars = join_bounded(parts, large.select("key", "hub"), ["key"], F.col("id")).filter("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b"))
    few = join_bounded(parts, sizes.filter(F.col("n") <= SMALL_BUCKET).select("key", "n"), ["key"], F.col("id"))
    total = sizes.filter(F.col("n") <= SMALL_BUCKET).agg(F.sum("n")).first()[0] or 0

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(np.asarray(b.column("key")), np.asarray(b.column("id"))) for b in batches if b.num_rows]
        if rows:
            a, b, _ = bucket_pairs(*(np.concatenate(c) for c in zip(*rows, strict=True)))
            yield _longs(a=a, b=b)

    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // ENTRIES))
    return parts, large.select("key", "n"), stars.unionByName(few.select("key", "id").repartition(n, "key").mapInArrow(paired, "a long, b long"))


def links_of_block(ids: np.ndarray, labels: np.ndarray, sets: list[np.ndarray], first: np.ndarray, second: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """For each two labels, one pair of a row in ``first`` and a row in ``second`` that are alike, by all their shingles."""
    size = np.array([len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, column = np.repeat(np.arange(len(sets)), size), np.where(times > 1, np.cumsum(times > 1) - 1, -1)[column]
    row, column = row[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(first), len(second)), np.float32)
    # shingles by slices, so that the matrix stays small
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, 2 * BLOCK):
        lo, hi = np.searchsorted(column, [start, start + 2 * BLOCK])
        has = np.zeros((len(sets), 2 * BLOCK), np.float32)
        has[row[lo:hi], column[lo:hi] - start] = 1
        common += has[first] @ has[second].T
    either = size[first][:, None] + size[second][None, :] - common.astype(np.float64)
    x, y = np.nonzero((common >= (similarity - 1e-12) * either) & (labels[first][:, None] != labels[second][None, :]))
    x, y = first[x], second[y]
    _, one = np.unique(np.stack([np.minimum(labels[x], labels[y]), np.maximum(labels[x], labels[y])], 1), axis=0, return_index=True)
    return ids[x[one]], ids[y[one]]


def _across(texts: DataFrame, linked: DataFrame, parts: DataFrame, large: DataFrame, similarity: float) -> DataFrame:
    """``(a, b)``: links between members of a large part that ``linked`` doesn't connect.

    Members of one component need no comparison. A part with members of several is divided into
    salted blocks, and every block is compared with every other by whole sets of shingles, so a
    part with a large share of the rows is the work of many tasks. Parts of the same members
    are compared once.
    """
    labels = materialize(connected_components(linked).select(F.col("node").alias("id"), F.col("component").alias("label")), "labels")
    member = join_bounded(parts, large, ["key"], F.col("id")).join(labels, "id", "left").select("key", "n", "id", F.coalesce("label", "id").alias("label"))
    member = materialize(member, "across")
    mixed = (
        member.groupBy("key", "n").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.bit_xor(F.xxhash64("id")).alias("_print"), F.sum(F.col("id").cast("decimal(38,0)")).alias("_sum"))
        .filter("lo < hi").groupBy("n", "_print", "_sum").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("_blocks"))
    )
    mixed = materialize(mixed, "mixed")
    open_ = materialize(join_bounded(member.select("key", "id", "label"), mixed, ["key"], F.col("id")), "open")
    total = open_.agg(F.sum("_blocks")).first()[0]
    spark = texts.sparkSession
    if not total:
        return spark.createDataFrame([], "a long, b long")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_ids, all_texts = np.asarray(batch.column("id")), batch.column("text").to_pylist()
            for part in by_size(all_texts):
                ids, shingles, per_text = _shingled(all_ids[part], all_texts[part])
                if len(ids):
                    sets = [np.unique(s).tobytes() for s in np.split(shingles, np.cumsum(per_text)[:-1])]
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], ["id", "s"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        whole = pa.Table.from_batches(rows)
        key, i, j, own, ids, labels = (whole.column(c).to_numpy() for c in ("key", "i", "j", "own", "id", "label"))
        order = np.lexsort((own, j, i, key))
        new = (np.diff(key[order]) != 0) | (np.diff(i[order]) != 0) | (np.diff(j[order]) != 0)
        for at in np.split(order, np.flatnonzero(new) + 1):
            first, second = np.flatnonzero(own[at] == i[at]), np.flatnonzero(own[at] == j[at])
            if not len(first) or not len(second) or labels[at].min() == labels[at].max():
                continue
            sets = [np.frombuffer(s, np.uint64) for s in whole.column("s").take(pa.array(at)).to_pylist()]
            a, b = links_of_block(ids[at], labels[at], sets, first, second, similarity)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], ["a", "b"])

    sets = semi_or_anti(texts, open_.select("id").distinct(), ["id"], "left_semi").mapInArrow(shingled, "id long, s binary")
    blocks = (
        open_.join(sets, "id").withColumn("own", F.pmod(F.xxhash64("id", F.lit(_PRIME_SEED)), F.col("_blocks")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .select("key", F.least("own", "_other").alias("i"), F.greatest("own", "_other").alias("j"), "own", "id", "label", "s")
    )
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BLOCK_ROWS))
    return blocks.repartition(n, "key", "i", "j").mapInArrow(compared, "a long, b long").distinct()


def alike(x: str, y: str) -> float:
    """The number of shingles that two texts share, divided by the number that occur in either."""
    p, q = words_of(x), words_of(y)
    a, b = set(zip(p, p[1:], p[2:], strict=False)), set(zip(q, q[1:], q[2:], strict=False))
    shared = len(a & b)
    return shared / (len(a) + len(b) - shared) if a or b else 0.0


def groups(chunks: DataFrame, key: str = "chunk_index", text: str = "text", similarity: float = LEAST_SIMILARITY) -> DataFrame:
    """``(key, group)`` for each record in a group of two or more; ``group`` is its least key.

    Records are linked if their texts have at least 20 words and a similarity, on runs of three
    words, of at least ``similarity``; a group is all that is connected. Equal texts are one text
    for the search: the least key stands for all copies, which join its group without being
    compared, so that copies with a third of all rows cost no more than one of them. Null, empty
    and short texts are in no group; a repeated key counts once; rows with a null key are dropped.
    """
    rows = chunks.select(F.col(key).cast("long").alias("id"), text).filter(F.col(key).isNotNull() & (F.length(text) >= 2 * LEAST_WORDS - 1)).withColumnRenamed(text, "text")
    prints = rows.select("id", F.xxhash64("text").alias("h1"), F.hash("text").alias("h2"))
    least = prints.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.max("id").alias("last")).filter("rep <> last").select("h1", "h2", "rep")
    least = materialize(least, "copied")
    copies = join_bounded(prints, least, ["h1", "h2"], F.col("id")).filter("id <> rep").select("id", "rep").distinct()
    copies = materialize(copies, "copies")
    n_copies = copies.count()
    single = semi_or_anti(rows, copies.select("id"), ["id"], "left_anti", counted=n_copies) if n_copies else rows
    single = once_per_key(single, "id")
    # a bound of the number of texts, which takes no reading of them
    linked = materialize(connected_components(links(single, similarity, chunks.count())).withColumnRenamed("node", "id").withColumnRenamed("component", "group"), "components")
    if not n_copies:
        return linked.select(F.col("id").alias(key), "group")
    # copies of texts with enough words; a representative without links is a group with its copies
    copied_texts = materialize(semi_or_anti(rows, copies.select(F.col("rep").alias("id")).distinct(), ["id"], "left_semi"), "copied")
    wordy = copied_texts.filter(F.size(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0))) >= LEAST_WORDS).select("id").distinct()
    wordy = materialize(wordy, "wordy")
    copied = join_bounded(copies, wordy.withColumnRenamed("id", "rep"), ["rep"], F.col("id"), "left_semi")
    named = wordy.join(linked, "id", "left").select(F.col("id").alias("rep"), F.coalesce("group", "id").alias("group"))
    joined = join_bounded(copied, named, ["rep"], F.col("id")).select("id", "group")
    return linked.unionByName(joined).unionByName(named.select(F.col("rep").alias("id"), "group")).distinct().select(F.col("id").alias(key), "group")


def pairs_of(members: DataFrame, key: str, group: str = "group") -> DataFrame:
    """``(key_a, key_b)``, a < b: all pairs of a group's members, of which each comes once.

    A group of more than ``PAIR_BLOCK`` members is cut into blocks, and each task joins one block
    with one other, so that the pairs of a group with a third of all rows are written by many tasks.
    """
    sizes = members.groupBy(group).agg(F.ceil(F.count("*") / PAIR_BLOCK).cast("int").alias("_blocks"))
    sized = join_bounded(members.select(key, group), sizes, [group], F.col(key)).withColumn("_block", F.pmod(F.xxhash64(key), F.col("_blocks")).cast("int"))
    a = sized.select(F.col(key).alias(f"{key}_a"), group, F.col("_block").alias("_i"), F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_j"))
    b = sized.select(F.col(key).alias(f"{key}_b"), group, F.col("_block").alias("_j"), F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_i"))
    return a.join(b, [group, "_i", "_j"]).filter(F.col(f"{key}_a") < F.col(f"{key}_b")).select(f"{key}_a", f"{key}_b")


def found(spark: SparkSession, d: str) -> DataFrame:
    """p3_found: all pairs of records in the same group."""
    return pairs_of(materialize(groups(table(spark, d, "chunks")), "members"), "chunk_index")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p3_found": found,
    "p3_groups": lambda spark, d: groups(table(spark, d, "chunks")),
}
_LINKED = r"""WITH RECURSIVE w AS (SELECT DISTINCT ON (chunk_index) chunk_index AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM chunks WHERE chunk_index IS NOT NULL AND text IS NOT NULL),
    s AS MATERIALIZED (SELECT id, list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS sh FROM w WHERE len(ws) >= 20),
    u AS MATERIALIZED (SELECT id, unnest(sh) AS x FROM s),
    o AS (SELECT a.id AS a, b.id AS b, count(*) AS n FROM u a JOIN u b ON a.x = b.x AND a.id < b.id GROUP BY 1, 2),
    l AS MATERIALIZED (SELECT a, b FROM o JOIN s p ON p.id = a JOIN s q ON q.id = b WHERE n >= 0.6 * (len(p.sh) + len(q.sh) - n)),
    e AS (SELECT a, b FROM l UNION SELECT b, a FROM l), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)"""
SQL: dict[str, str] = {
    "p3_found": f"{_LINKED} SELECT CAST(a AS BIGINT) AS chunk_index_a, CAST(b AS BIGINT) AS chunk_index_b FROM r WHERE a < b",
    "p3_groups": f'{_LINKED} SELECT CAST(a AS BIGINT) AS chunk_index, CAST(least(a, min(b)) AS BIGINT) AS "group" FROM r GROUP BY a',
}
