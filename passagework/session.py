"""Session settings, the shared folder for intermediate tables, and table access."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Intermediate tables written by this process, deleted when it ends.
_written: list[tuple[SparkSession, str]] = []


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, app: str = "passagework") -> SparkSession:
    """A single-machine session for tests and benchmarks; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``, or where that is unset (tests) a temporary one."""
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    present = context._jsc.sc().getCheckpointDir()
    if present.isDefined():
        return present.get().rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="passagework-")
    context.setCheckpointDir(made)
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage, so a lost executor costs a re-read and no recomputation, and a plan
    that uses the rows twice computes them once. The files go when the process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_remove_all)
    _written.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_shared(spark: SparkSession, name: str, content: bytes) -> str:
    """Write a small file in the shared folder; its path. It goes when the process ends."""
    path = f"{shared_dir(spark)}/tables/{name}"
    if not _written:
        atexit.register(_remove_all)
    _written.append((spark, path))
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(content)
    finally:
        out.close()
    return path


def release(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`materialize` once nothing reads it any more."""
    for name in df.inputFiles()[:1]:
        folder = os.path.dirname(name)
        for item in [x for x in _written if folder.split(":", 1)[-1].lstrip("/") == x[1].split(":", 1)[-1].lstrip("/")]:
            _remove(*item)
            _written.remove(item)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 - the session may be gone at exit
        pass


def _remove_all() -> None:
    for spark, path in _written:
        _remove(spark, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory, in at least as many partitions as there are cores.

    A small file is one split; the text operators are bound by computation, so such a table is
    spread once. One that already has a split for each core is read as it is.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores else df
