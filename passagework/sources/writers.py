"""Sinks: JSON lines and single documents, put in place by a rename, and run statistics."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _replace(spark: SparkSession, staged: str, path: str) -> None:
    jvm = spark.sparkContext._jvm
    source, target = jvm.org.apache.hadoop.fs.Path(staged), jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(target, True)
    if target.getParent() is not None:
        fs.mkdirs(target.getParent())
    if not fs.rename(source, target):
        raise OSError(f"{path} could not be put in place")


def write_jsonl(df: DataFrame, path: str) -> None:
    """A folder of JSON lines, complete or not there: it is written beside its place and renamed. Null fields stay, as null."""
    staged = f"{path}.{uuid.uuid4().hex}.part"
    df.write.option("ignoreNullFields", "false").json(staged)
    _replace(df.sparkSession, staged, path)


def write_json(spark: SparkSession, value: dict, path: str) -> None:
    """One indented JSON document, complete or not there."""
    staged = f"{path}.{uuid.uuid4().hex}.part"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(staged)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write((json.dumps(value, ensure_ascii=False, indent=2) + "\n").encode())
    finally:
        out.close()
    _replace(spark, staged, path)


def hits_json(hits: DataFrame, by: str, rank: str = "rank") -> DataFrame:
    """``(by, results)``: each query's hits as one JSON array, in order."""
    item = F.struct(F.col(rank).alias("r"), F.struct(F.col("score"), F.col("text"), F.col("source_document"), F.col("page_number")).alias("h"))
    return hits.groupBy(by).agg(F.to_json(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["h"])).alias("results"))


def _nested(blocks: DataFrame, by: list[str], order: str, **extra: Column) -> DataFrame:
    has = set(blocks.columns)
    fields = [F.col(n) if n in has else F.lit(None).cast(k).alias(n) for n, k in (("text", "string"), ("page_number", "int"), ("bbox", "array<double>"), ("block_type", "string"), ("font_size", "double"), ("is_bold", "boolean"), ("metadata", "map<string,string>"))]
    item = F.struct(F.col(order).alias("_at"), F.struct(*fields).alias("b"))
    rows = blocks.groupBy(*by).agg(F.array_sort(F.collect_list(item), lambda x, y: F.when(x["_at"] < y["_at"], -1).when(x["_at"] > y["_at"], 1).otherwise(0)).alias("_items"), *[v.alias(k) for k, v in extra.items()])
    return rows.withColumn("blocks", F.transform("_items", lambda x: x["b"])).drop("_items")


def nested_pages(blocks: DataFrame, document: str = "doc", page: str = "page_number", order: str = "reading_order") -> DataFrame:
    """``(document, page_number, width, height, text, blocks)``: the blocks of each page in order, and the page's text derived from them."""
    rows = _nested(blocks, [document, page], order, width=F.max("width"), height=F.max("height"))
    text = F.array_join(F.filter(F.transform("blocks", lambda b: F.coalesce(b["text"], F.lit(""))), lambda t: t != ""), "\n\n")
    return rows.select(document, F.col(page).alias("page_number"), "width", "height", F.trim(text).alias("text"), "blocks")


def nested_sections(blocks: DataFrame, document: str = "doc", order: str = "reading_order") -> DataFrame:
    """``(document, section_id, title, level, page_numbers, blocks)`` of blocks that have a section_id and a section_title (:func:`.layout.sections`)."""
    rows = _nested(blocks, [document, "section_id"], order, title=F.first("section_title"))
    pages = F.array_sort(F.array_distinct(F.filter(F.transform("blocks", lambda b: b["page_number"]), lambda p: p.isNotNull() & (p != 0))))
    return rows.select(document, "section_id", "title", F.lit(1).alias("level"), pages.alias("page_numbers"), "blocks")


class Stages:
    """Wall times of a run's stages, and its statistics as one document."""

    def __init__(self) -> None:
        self.seconds: dict[str, float] = {}

    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        """Time a stage."""
        start = time.monotonic()
        try:
            yield
        finally:
            self.seconds[name] = round(self.seconds.get(name, 0.0) + time.monotonic() - start, 4)

    def document(self, counts: dict[str, int], cache: dict[str, int], generated_at: str) -> dict:
        """Counts, cache figures and timings."""
        return {"generated_at": generated_at, **counts, "cache": cache, "timings_seconds": {**self.seconds, "total": round(sum(self.seconds.values()), 4)}}
