"""Exact search over uniform vectors, the sizes and queries of the published harness: python bench_search.py [SIZE...]

Prints a JSON line for each size: seconds to write the index, milliseconds a query in a batch of 300 at k = 10 and 50, and the
median and 90th percentile of single queries, each of which is a Spark job of its own.
"""

from __future__ import annotations

import json
import os
import sys
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from passagework.operators import vector
from passagework.session import local_session, materialize

DIM, QUERIES, SINGLE = 384, 300, 20


def main(sizes: list[int]) -> None:
    """Measure each size."""
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, 8)
    for size in sizes:
        rng = np.random.default_rng(42)
        parts = [(start, min(20_000, size - start), int(rng.integers(1 << 30))) for start in range(0, size, 20_000)]

        def vectors(batches):
            for batch in batches:
                for start, n, seed in zip(*(batch.column(c).to_pylist() for c in ("start", "n", "seed")), strict=True):
                    x = np.random.default_rng(seed).uniform(-1, 1, (n, DIM)).astype(np.float32)
                    flat = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * DIM, pa.int32()), pa.array(x.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(start, start + n), pa.int32()), flat], ["chunk_index", "embedding"])

        start = time.perf_counter()
        index = materialize(spark.createDataFrame(parts, "start int, n int, seed int").repartition(len(parts)).mapInArrow(vectors, "chunk_index int, embedding array<float>"), "uniform")
        out: dict[str, object] = {"vectors": size, "load_s": round(time.perf_counter() - start, 2)}
        q = np.random.default_rng(7).uniform(-1, 1, (QUERIES, DIM)).astype(np.float32)
        queries = materialize(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id int, embedding array<float>"), "asked")
        for k in (10, 50):
            seconds = []
            for _ in range(2):
                start = time.perf_counter()
                vector.search(queries, index, k, DIM).write.format("noop").mode("overwrite").save()
                seconds.append(time.perf_counter() - start)
            out[f"batch_ms_per_query_k{k}"] = round(min(seconds) / QUERIES * 1000, 2)
        single = []
        for i in range(SINGLE):
            start = time.perf_counter()
            vector.search_one(index.select("chunk_index", F.col("embedding")), q[i].tolist(), 10).collect()
            single.append((time.perf_counter() - start) * 1000)
        single.sort()
        out |= {"single_ms_p50": round(single[SINGLE // 2]), "single_ms_p90": round(single[int(0.9 * (SINGLE - 1))])}
        print(json.dumps(out), flush=True)


if __name__ == "__main__":
    main([int(x) for x in sys.argv[1:]] or [1_000, 10_000, 100_000, 250_000])
