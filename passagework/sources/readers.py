"""Sources: files to fingerprint, JSON lines with strict or lenient rules, pages to blocks, and the extraction cache."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.keyed import join_bounded

#: The fields a vector store loads; the schema is never inferred.
INDEX_SCHEMA = "chunk_index int, text string, source_document string, page_number int, embedding array<float>"
PAGE = "array<struct<page_number:int,width:double,height:double,blocks:array<struct<text:string,page_number:int,bbox:array<double>,block_type:string,font_size:double,is_bold:boolean>>>>"
Extractor = Callable[[bytes], list[dict]]


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def find_files(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """``(path, name, fingerprint, bytes)`` of the folder's own files, by name; the fingerprint is the SHA-256 of the content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "false").load(folder)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("fingerprint"), F.col("length").alias("bytes")).orderBy("name")


def read_index(spark: SparkSession, path: str, dim: int = 384) -> tuple[DataFrame, DataFrame]:
    """Rows of a JSON-lines index, and ``(loaded, skipped)``; blank lines are neither.

    A line is skipped if it isn't JSON, lacks one of five typed fields, or its vector has another
    size. A number in place of a text, or a fraction in place of an integer, isn't of the type.
    """
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", INDEX_SCHEMA, {"mode": "PERMISSIVE"}).alias("r"))
    # the parser takes a number for a string, so the two texts must be quoted in the line
    texts_quoted = F.col("value").rlike(r'"text"\s*:\s*"') & F.col("value").rlike(r'"source_document"\s*:\s*"')
    fields = [F.col(f"r.{c}") for c in ("chunk_index", "text", "source_document", "page_number", "embedding")]
    good = texts_quoted
    for f in fields:
        good = good & f.isNotNull()
    good = F.coalesce(good & (F.size("r.embedding") == dim) & F.forall("r.embedding", lambda x: x.isNotNull()), F.lit(False))
    marked = parsed.withColumn("_good", good)
    return marked.filter("_good").select("r.*"), marked.agg(F.count_if("_good").alias("loaded"), F.count_if(~F.col("_good")).alias("skipped"))


def read_records(spark: SparkSession, path: str, schema: str | T.StructType, strict: bool = True) -> DataFrame:
    """JSON lines with an explicit schema; a missing file is an empty table. ``strict`` fails on the first bad line, else it gives nulls."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def read_numbered(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with ``_line_number``, counted from 1 with blank lines, and ``_fields``, the keys that a record has.

    Lines are numbered by their order in the files, and files by their names: the lines of each split of a
    file are counted first, and what precedes a split, one number for each, is added.
    """
    lines = spark.read.text(path).select("value", F.input_file_name().alias("_f"), F.input_file_block_start().alias("_b"), F.monotonically_increasing_id().alias("_i"))
    counts = lines.groupBy("_f", "_b").agg(F.count("*").alias("_n"), F.min("_i").alias("_first"))
    offsets = counts.select("_f", "_b", "_first", F.coalesce(F.sum("_n").over(W.orderBy("_f", "_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    numbered = join_bounded(lines, offsets, ["_f", "_b"], F.col("_i")).withColumn("_line_number", F.col("_before") + F.col("_i") - F.col("_first") + 1)
    full = numbered.filter(F.trim("value") != "")
    return full.select("_line_number", F.map_keys(F.from_json("value", "map<string,string>")).alias("_fields"), F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("_line_number", "_fields", "r.*")


def flatten_pages(pages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Blocks of pages, in order; a block without a page takes its page's, and blocks without text go. ``layout_blocks`` come before ``blocks``."""
    names = [F.col(c) for c in ("layout_blocks", "blocks") if c in pages.columns]
    each = pages.select(*keep, F.col("page_number").alias("_page"), F.posexplode(F.coalesce(*names)).alias("position", "b"))
    return each.filter(F.trim("b.text") != "").select(*keep, "position", F.coalesce("b.page_number", "_page").alias("page_number"), F.trim("b.text").alias("text"), "b.bbox", F.coalesce("b.block_type", F.lit("paragraph")).alias("block_type"), "b.font_size", F.coalesce("b.is_bold", F.lit(False)).alias("is_bold"))


def probe_cache(manifest: DataFrame, cache: DataFrame) -> DataFrame:
    """The manifest with ``cache_status``: ``hit``, ``miss``, or ``invalid`` for an entry that contradicts itself.

    Entries are keyed by version and fingerprint. An entry is invalid if it names another
    document, has no page count, or, where it has pages, another number of them.
    """
    key = ["extraction_version", "source_fingerprint"]
    pages = F.size("pages") if "pages" in cache.columns else F.col("page_count")
    entries = cache.groupBy(*key).agg(F.max_by(F.struct(F.col("source_document").alias("d"), F.col("page_count").alias("n"), pages.alias("p")), F.lit(1)).alias("_e"))
    valid = F.col("_e.n").isNotNull() & (F.col("_e.n") == F.col("_e.p")) & (F.col("_e.d") == F.col("source_document"))
    status = F.when(F.col("_e").isNull(), "miss").when(F.coalesce(valid, F.lit(False)), "hit").otherwise("invalid")
    return manifest.join(entries, key, "left").withColumn("cache_status", status).drop("_e")


def cache_stats(probed: DataFrame) -> DataFrame:
    """``(hits, misses)``; an invalid entry is a miss."""
    return probed.agg(F.count_if(F.col("cache_status") == "hit").alias("hits"), F.count_if(F.col("cache_status") != "hit").alias("misses"))


def extract(files: DataFrame, version: str, make: Callable[[], Extractor]) -> DataFrame:
    """Cache entries for files ``(name, fingerprint, content)``: pages by a pluggable extractor, made once in each task."""
    schema = f"extraction_version string, source_document string, source_fingerprint string, page_count int, pages {PAGE}"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extractor = make()
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                pages = extractor(row["content"])
                rows.append({"extraction_version": version, "source_document": row["name"], "source_fingerprint": row["fingerprint"], "page_count": len(pages), "pages": pages})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, arrow)

    return files.select("name", "fingerprint", "content").mapInArrow(run, schema)


def load_or_extract(spark: SparkSession, folder: str, cache_path: str, version: str, make: Callable[[], Extractor], pattern: str = "*.pdf") -> tuple[DataFrame, DataFrame]:
    """Pages of the folder's files, from the cache where it holds them, and the probe's result for each file.

    Only files without a valid entry are read whole and extracted; their entries are added to the
    cache, a Parquet table partitioned by version, beside what it has.
    """
    from ..session import materialize

    manifest = find_files(spark, folder, pattern).select("path", F.col("name").alias("source_document"), F.col("fingerprint").alias("source_fingerprint"), F.lit(version).alias("extraction_version"))
    empty = f"extraction_version string, source_document string, source_fingerprint string, page_count int, pages {PAGE}"
    cache = spark.read.schema(empty).parquet(cache_path) if exists(spark, cache_path) else spark.createDataFrame([], empty)
    probed = materialize(probe_cache(manifest, cache), "probe")
    content = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "content")
    todo = content.join(probed.filter("cache_status <> 'hit'"), "path").select(F.col("source_document").alias("name"), F.col("source_fingerprint").alias("fingerprint"), "content")
    fresh = materialize(extract(todo, version, make), "extracted")
    fresh.write.mode("append").partitionBy("extraction_version").parquet(cache_path)
    hits = cache.join(probed.filter("cache_status = 'hit'").select("extraction_version", "source_fingerprint").distinct(), ["extraction_version", "source_fingerprint"], "left_semi")
    return hits.unionByName(fresh), probed


def read_document(spark: SparkSession, path: str) -> dict | None:
    """One small JSON document, such as a run's statistics; None if it isn't there."""
    if not exists(spark, path):
        return None
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def read_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The records of a file that is one JSON array, such as a set of questions."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def parse_requests(requests: DataFrame, dim: int, column: str = "value", default_k: int = 5) -> DataFrame:
    """Search requests as ``embedding``, ``top_k`` and ``error``, null for a valid one.

    Errors: ``empty``, ``invalid JSON``, ``no embedding`` for a missing, null or non-numeric one,
    ``wrong dimension``, and ``invalid top_k`` for one that isn't an integer; a missing top_k is the default.
    """
    raw = F.trim(F.coalesce(F.col(column), F.lit("")))
    parsed = F.from_json(raw, "embedding array<double>, top_k string, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    e, k = parsed["embedding"], parsed["top_k"]
    given = F.get_json_object(raw, "$.top_k")
    error = (
        F.when(raw == "", "empty").when(F.get_json_object(raw, "$").isNull(), "invalid JSON")
        .when(e.isNull() | F.coalesce(F.exists(e, lambda x: x.isNull()), F.lit(False)), "no embedding").when(F.size(e) != dim, "wrong dimension")
        .when(given.isNotNull() & ~given.rlike(r"^-?\d+$"), "invalid top_k")
    )
    return requests.select("*", e.alias("embedding"), F.coalesce(F.when(k.rlike(r"^-?\d+$"), k.cast("int")), F.lit(default_k)).alias("top_k"), error.alias("error"))
