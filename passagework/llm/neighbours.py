"""Problem 2: the most similar vectors for every vector, by stable projections and kd-trees."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.keyed import fits_broadcast, join_bounded, semi_or_anti
from ..session import materialize, table

#: Dimensions of the sketch that neighbours are searched in, and bits of a coordinate.
SKETCH, BITS = 128, 4
#: Trees, the coordinates each has to split on, and the vectors a leaf holds on average, at most.
TREES, COORDINATES, LEAF = 12, 16, 2048
#: Vectors a leaf holds on average, at most, where neighbours of any cosine are sought.
WIDE_LEAF = 8192
#: Vectors on whose projections the trees' splits are fitted; every vector is put into every tree.
FIT_ON = 1 << 16
#: Confidence of the chi-square stopping test.
CONFIDENCE = 0.9
#: Rows of (vector, tree) in a partition of the search.
ROWS_AT_ONCE = 400_000
_SEED = 20_231


def chi_square(p: float, m: int) -> float:
    """The quantile of the chi-square distribution with ``m`` degrees of freedom (Wilson and Hilferty)."""
    return m * (1 - 2 / (9 * m) + NormalDist().inv_cdf(p) * (2 / (9 * m)) ** 0.5) ** 3


def projections(dim: int, trees: int) -> tuple[np.ndarray, np.ndarray]:
    """Gaussian, hence 2-stable, projections: one for the sketch, and one for each tree's coordinates.

    A projected squared distance is the true one times a chi-square variable over its dimensions.
    """
    rng = np.random.default_rng(_SEED)
    sketch = rng.standard_normal((dim, SKETCH)) / SKETCH**0.5
    coordinates = rng.standard_normal((dim, trees * COORDINATES)) / COORDINATES**0.5
    return sketch.astype(np.float32), coordinates.astype(np.float32)


def fit_tree(points: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Splits of a kd-tree in level order: the widest coordinate at its median, ``depth`` levels deep."""
    axes, cuts = np.zeros((1 << depth) - 1, np.int16), np.zeros((1 << depth) - 1, np.float32)
    members = [np.arange(len(points))]
    for node in range(len(axes)):
        own = points[members[node]]
        if len(own) > 1:
            axes[node] = int(np.argmax(own.var(0)))
            cuts[node] = np.median(own[:, axes[node]])
        right = own[:, axes[node]] > cuts[node] if len(own) else np.zeros(0, bool)
        members += [members[node][~right], members[node][right]]
    return axes, cuts


def leaf_of(points: np.ndarray, tree: tuple[np.ndarray, np.ndarray], depth: int) -> np.ndarray:
    """The number of the leaf that each point falls into."""
    axes, cuts = tree
    node = np.zeros(len(points), np.int64)
    rows = np.arange(len(points))
    for _ in range(depth):
        node = 2 * node + 1 + (points[rows, axes[node]] > cuts[node])
    return node - ((1 << depth) - 1)


def quantize(sketches: np.ndarray) -> np.ndarray:
    """Sketches of unit vectors, two coordinates in a byte; the steps span three deviations either way."""
    step = 6 / SKETCH**0.5 / (1 << BITS)
    q = np.clip(np.floor(sketches / step) + (1 << BITS - 1), 0, (1 << BITS) - 1).astype(np.uint8)
    return q[:, 0::2] << BITS | q[:, 1::2]


def dequantize(packed: np.ndarray) -> np.ndarray:
    """The sketches at the middle of their steps."""
    step = 6 / SKETCH**0.5 / (1 << BITS)
    out = np.empty((len(packed), SKETCH), np.float32)
    out[:, 0::2], out[:, 1::2] = packed >> BITS, packed & ((1 << BITS) - 1)
    return (out - ((1 << BITS - 1) - 0.5)) * np.float32(step)


def near_in_leaf(sketches: np.ndarray, radius2: float, k: int, confidence: float = CONFIDENCE, block: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs ``i < j`` of a leaf's points that the stopping test doesn't exclude.

    Neighbours of a point are meant in the order of projected distance, for all points of a block at
    once: taking them one by one until the test stops gives what lies below the distance at which it
    stops, so one product of matrices stands for that many searches. The search stops where the
    test holds that a farther one is within ``radius2`` with a probability below 1 - confidence;
    if ``4 k`` neighbours came before, also where none farther is likely to be nearer than the
    k-th, since a projected distance is off by no more than the spread of the chi-square. Both
    bounds allow for rounding to the steps, which is all there is between vectors closer than a step.
    """
    rounding = SKETCH * 2 * (6 / SKETCH**0.5 / (1 << BITS)) ** 2 / 12
    bound = radius2 * chi_square(confidence, SKETCH) / SKETCH + rounding
    spread = chi_square(0.99, SKETCH) / chi_square(0.01, SKETCH)
    norms = (sketches**2).sum(1)
    for start in range(0, len(sketches), block):
        part = sketches[start : start + block]
        d2 = norms[start : start + block, None] + norms[None, :] - 2 * (part @ sketches.T)
        close = d2 <= bound
        full = np.flatnonzero(close.sum(1) > 4 * k + 1)
        for row in full:
            kth = np.partition(d2[row], k + 1)[k + 1]
            close[row] &= d2[row] <= max(kth, 0) * spread + rounding
        i, j = np.nonzero(close)
        i += start
        keep = i != j
        yield np.minimum(i[keep], j[keep]), np.maximum(i[keep], j[keep])


def nearest_in_leaf(x: np.ndarray, k: int, block: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(i, j, cosine)``: each of a leaf's vectors with its ``k`` nearest, whatever their cosine; ties go to the smaller ``j``."""
    wide = x.astype(np.float64)
    norm = np.sqrt(np.einsum("ij,ij->i", wide, wide))
    del wide
    inverse = (1 / norm).astype(np.float32)
    for start in range(0, len(x), block):
        part = x[start : start + block]
        own = np.arange(start, start + len(part))
        rough = (part @ x.T) * inverse
        rough[np.arange(len(part)), own] = -np.inf
        # a few more than k, since single precision orders them only roughly
        most = min(k + 6, len(x) - 1)
        if most < 1:
            return
        j = np.sort(np.argpartition(-rough, most - 1, axis=1)[:, :most], 1)
        cosine = np.einsum("id,ijd->ij", part.astype(np.float64), x[j].astype(np.float64)) / (norm[own][:, None] * norm[j])
        best = np.argsort(-cosine, axis=1, kind="stable")[:, :k]
        yield np.repeat(own, best.shape[1]), np.take_along_axis(j, best, 1).ravel(), np.take_along_axis(cosine, best, 1).ravel()


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float32).reshape(-1, dim)


def usable(vectors: DataFrame, dim: int, key: str, embedding: str) -> DataFrame:
    """Rows with a key and a vector of ``dim`` values, none null, not all zero."""
    v = F.col(embedding)
    return vectors.select(key, embedding).filter(
        # the search for NaN gives null if a value is null
        F.col(key).isNotNull() & (F.size(v) == dim) & ~F.array_contains(v, F.lit(float("nan")).cast(vectors.schema[embedding].dataType.elementType))
        & ((F.array_max(v) != 0) | (F.array_min(v) != 0)) & (F.array_max(v) < float("inf")) & (F.array_min(v) > float("-inf"))
    )


def neighbours(vectors: DataFrame, k: int = 10, min_cosine: float | None = 0.75, dim: int = 384, key: str = "chunk_index", embedding: str = "embedding",
               trees: int = TREES, leaf: int | None = None, confidence: float = CONFIDENCE) -> DataFrame:
    """``(key, neighbour, cosine)``: up to ``k`` most similar others of each usable vector, of at least ``min_cosine``.

    Each vector is projected by stable (Gaussian) projections to a sketch and to the coordinates of
    several kd-trees. Splits are medians of a bounded sample, so that dense regions get more leaves and
    leaves stay about equal whatever the clusters are. In its leaf of every tree a point's projected
    neighbours are taken in order until a chi-square test stops the search; what is left, a few
    pairs for each vector, is verified by the exact cosine. Only sketches of 64 bytes are
    shuffled; vectors move only for pairs to verify.

    Equal vectors are searched once: of a group of copies one represents all, so a group with a
    third of the rows costs no more than any other; of each group the first ``k + 1`` keys are
    neighbours for all its members. Ties go to the smaller key. Null, short, all-zero and
    non-finite vectors take no part; a repeated key comes once; rows with a null key are dropped.
    One pass over the vectors gives a number for each, by which keys that come again and copies are
    found; after it the vectors are read to reduce keys that come again, to fit, to place and to verify.
    Below ``min_cosine`` nothing is sought: there the projected order says little. If it is None, every
    vector gets its ``k`` neighbours whatever their cosine: the trees have wider leaves, the vectors
    themselves are shuffled, and each leaf is searched by exact cosines.
    """
    leaf = leaf or (WIDE_LEAF if min_cosine is None else LEAF)
    spark = vectors.sparkSession
    rows = usable(vectors, dim, key, embedding).withColumnRenamed(key, "id").withColumnRenamed(embedding, "v")
    prints = materialize(rows.select("id", F.xxhash64("v").alias("h")).groupBy("id").agg(F.min("h").alias("h"), F.count("*").alias("times")), "prints")
    n_keys, n_again = prints.agg(F.count("*"), F.count_if(F.col("times") > 1)).first()
    if n_again:
        again = prints.filter("times > 1").select("id")
        few = fits_broadcast(again, n_again)
        # of unlike vectors with one key, the one that its print is of
        reduced = (semi_or_anti(rows, again, ["id"], "left_semi", counted=n_again) if few else rows).groupBy("id").agg(F.min_by("v", F.xxhash64("v")).alias("v"))
        reduced = materialize(reduced, "again")
        rows = semi_or_anti(rows, again, ["id"], "left_anti", counted=n_again).unionByName(reduced) if few else reduced
    groups = prints.groupBy("h").agg(F.min("id").alias("rep"), F.count("*").alias("size")).filter("size > 1")
    groups = materialize(groups, "groups")
    n_groups, n_members = groups.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    members = join_bounded(prints.select("id", "h"), groups, ["h"], F.col("id"), counted=n_groups).select("id", "rep", "size")
    members = materialize(members, "members") if n_groups else members
    copies = members.filter("id <> rep").select("id")
    single = semi_or_anti(rows, copies, ["id"], "left_anti", counted=n_members - n_groups) if n_groups else rows

    n = n_keys - (n_members - n_groups)
    # one split at least, so that small tables take the same way as large ones
    depth = max(1, int(np.ceil(np.log2(max(1, n) / leaf))))
    sketch, coordinates = projections(dim, trees)

    def unit(batch: pa.RecordBatch) -> np.ndarray:
        x = _matrix(batch.column("v"), dim)
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    every = max(1, -(-n // FIT_ON))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = np.round(unit(batch) @ coordinates * 4096).astype(np.int16)
            yield pa.RecordBatch.from_arrays([pa.array([p.tobytes() for p in points], pa.binary())], ["p"])

    if n:
        sample = single.filter(F.pmod(F.xxhash64("id", F.lit(_SEED)), F.lit(every)) == 0).select("v").mapInArrow(project, "p binary").toArrow()
        points = np.frombuffer(b"".join(sample.column("p").to_pylist()), np.int16).reshape(-1, trees, COORDINATES).astype(np.float32) / 4096
    else:
        points = np.zeros((0, trees, COORDINATES), np.float32)
    fitted = [fit_tree(points[:, t], depth) for t in range(trees)]
    shared = spark.sparkContext.broadcast((sketch, coordinates, fitted))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, coordinates, fitted = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit(batch)
            packed = quantize(x @ sketch)
            points = (x @ coordinates).reshape(len(x), trees, COORDINATES)
            leaves = np.stack([leaf_of(points[:, t], fitted[t], depth) for t in range(trees)], 1)
            keys = (np.arange(trees) << 40) + leaves
            ids = np.repeat(np.asarray(batch.column("id")), trees)
            blob = np.repeat(packed, trees, axis=0)
            data = pa.py_buffer(np.ascontiguousarray(blob).tobytes())
            fixed = pa.Array.from_buffers(pa.binary(), len(blob), [None, pa.py_buffer((np.arange(len(blob) + 1) * blob.shape[1]).astype(np.int32).tobytes()), data])
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel(), pa.int64()), pa.array(ids, pa.int64()), fixed], ["leaf", "id", "s"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(np.asarray(b.column("leaf")), np.asarray(b.column("id")), b.column("s")) for b in batches if b.num_rows]
        if not parts:
            return
        leaves, ids = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        packed = np.concatenate([np.frombuffer(b"".join(p[2].to_pylist()), np.uint8).reshape(-1, SKETCH * BITS // 8) for p in parts])
        order = np.argsort(leaves, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(leaves[order])) + 1):
            for i, j in near_in_leaf(dequantize(packed[group]), 2 - 2 * min_cosine, k, confidence):
                if len(i):
                    a, b = ids[group[i]], ids[group[j]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def place_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, coordinates, fitted = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            points = (unit(batch) @ coordinates).reshape(batch.num_rows, trees, COORDINATES)
            for t in range(trees):
                leaves = leaf_of(points[:, t], fitted[t], depth)
                yield pa.RecordBatch.from_arrays([pa.array((t << 40) + leaves, pa.int64()), batch.column("id"), batch.column("v")], ["leaf", "id", "v"])

    def search_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(np.asarray(b.column("leaf")), np.asarray(b.column("id")), _matrix(b.column("v"), dim)) for b in batches if b.num_rows]
        if not parts:
            return
        leaves, ids, x = (np.concatenate([p[c] for p in parts]) for c in range(3))
        del parts
        order = np.lexsort((ids, leaves))
        for group in np.split(order, np.flatnonzero(np.diff(leaves[order])) + 1):
            for i, j, cosine in nearest_in_leaf(x[group], k):
                yield pa.RecordBatch.from_arrays([pa.array(ids[group[i]]), pa.array(ids[group[j]]), pa.array(cosine)], ["a", "b", "c"])

    def within_bound() -> DataFrame:
        """Links both ways of at least ``min_cosine``."""
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n * trees // ROWS_AT_ONCE))
        placed = single.select(F.col("id").cast("long").alias("id"), "v").mapInArrow(place, "leaf long, id long, s binary").repartition(parts, "leaf")
        pairs = materialize(placed.mapInArrow(search, "a long, b long").distinct(), "pairs")

        ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
        involved = materialize(semi_or_anti(single.select(F.col("id").cast("long").alias("id"), "v"), ids, ["id"], "left_semi"), "involved")
        both = pairs.join(involved.select(F.col("id").alias("a"), F.col("v").alias("va")), "a").join(involved.select(F.col("id").alias("b"), F.col("v").alias("vb")), "b")

        def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, y = _matrix(batch.column("va"), dim).astype(np.float64), _matrix(batch.column("vb"), dim).astype(np.float64)
                cosine = np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))
                good = cosine >= min_cosine
                a, b = np.asarray(batch.column("a"))[good], np.asarray(batch.column("b"))[good]
                yield pa.RecordBatch.from_arrays([pa.array(np.append(a, b)), pa.array(np.append(b, a)), pa.array(np.tile(cosine[good], 2))], ["a", "b", "c"])

        return both.select("a", "b", "va", "vb").mapInArrow(verify, "a long, b long, c double")

    if min_cosine is None:
        # a partition holds a few leaves; links of all trees are united
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), trees << depth)
        placed = single.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<float>").alias("v")).mapInArrow(place_whole, "leaf long, id long, v array<float>").repartition(parts, "leaf")
        nearest = placed.mapInArrow(search_whole, "a long, b long, c double").groupBy("a", "b").agg(F.max("c").alias("c"))
    else:
        nearest = within_bound()
    if not n_groups:
        found = nearest
    else:
        nearest = materialize(nearest, "links")
        small = members.filter(F.col("size") <= k)
        order = W.partitionBy("rep").orderBy("id")
        first = materialize(members.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= k + 1).select("rep", F.col("id").cast("long").alias("copy")), "first")
        n_first = first.count()
        own = join_bounded(members, first, ["rep"], F.col("id"), counted=n_first).filter("id <> copy").select(F.col("id").cast("long").alias("a"), F.col("copy").alias("b"), F.lit(1.0).alias("c"))
        large = members.filter((F.col("size") > k) & (F.col("id") == F.col("rep"))).select(F.col("rep").cast("long").alias("a"))
        # a representative's links hold for its copies, unless those already fill all places
        spread = nearest.join(large, "a", "left_anti").join(small.select(F.col("rep").cast("long").alias("a"), F.col("id").cast("long").alias("_own")), "a", "left")
        spread = spread.select(F.coalesce("_own", "a").alias("a"), "b", "c").join(first.select(F.col("rep").cast("long").alias("b"), "copy"), "b", "left").select("a", F.coalesce("copy", "b").alias("b"), "c")
        found = own.unionByName(spread)
    best = W.partitionBy("a").orderBy(F.col("c").desc(), "b")
    return found.withColumn("_rank", F.row_number().over(best)).filter(F.col("_rank") <= k).select(F.col("a").alias(key), F.col("b").alias("neighbour"), F.col("c").alias("cosine"))


def found(spark: SparkSession, d: str) -> DataFrame:
    """p2_found: pairs of which one is among the other's 10 most similar, with a cosine of at least 0.75."""
    near = neighbours(table(spark, d, "document_chunks"))
    return near.select(F.least("chunk_index", "neighbour").alias("chunk_index_a"), F.greatest("chunk_index", "neighbour").alias("chunk_index_b")).distinct()


def all_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """p2_neighbours: the 10 most similar of every usable vector, whatever their cosine, rounded to 6 decimals."""
    return neighbours(table(spark, d, "document_chunks"), min_cosine=None).withColumn("cosine", F.round("cosine", 6))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p2_found": found,
    "p2_neighbours": all_neighbours,
}
_NEAR = """WITH idx AS MATERIALIZED (SELECT DISTINCT ON (chunk_index) chunk_index, CAST(embedding AS DOUBLE[]) AS v FROM document_chunks
        WHERE chunk_index IS NOT NULL AND len(embedding) = 384 AND (list_max(embedding) <> 0 OR list_min(embedding) <> 0)),
    near AS (SELECT a.chunk_index AS a, b.chunk_index AS b, list_cosine_similarity(a.v, b.v) AS c FROM idx a, idx b WHERE a.chunk_index <> b.chunk_index)"""
SQL: dict[str, str] = {
    "p2_found": f"""{_NEAR}, best AS (SELECT * FROM near WHERE c >= 0.75 QUALIFY row_number() OVER (PARTITION BY a ORDER BY c DESC, b) <= 10)
        SELECT DISTINCT CAST(least(a, b) AS BIGINT) AS chunk_index_a, CAST(greatest(a, b) AS BIGINT) AS chunk_index_b FROM best""",
    "p2_neighbours": f"""{_NEAR} SELECT CAST(a AS BIGINT) AS chunk_index, CAST(b AS BIGINT) AS neighbour, round(c, 6) AS cosine FROM near QUALIFY row_number() OVER (PARTITION BY a ORDER BY c DESC, b) <= 10""",
}
