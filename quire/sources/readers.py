"""Readers of extractor output, and the chunk sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..scratch import materialize, path_exists

BLOCK = "type string, text string, text_level int, page_idx int, img_path string, img_caption array<string>, chart_caption array<string>, table_caption array<string>, code_caption array<string>, table_body string, list_items array<string>, items array<string>, code_body string, bbox array<double>"
PERSISTED = ["document_id", "sequence_id", "chunk_type", "heading_path", "markdown", "plain_text", "page_start", "page_end", "token_count"]


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Typed blocks of JSON files, each an array: document_id (the file's name), block (from 0), and the block's fields."""
    raw = spark.read.text(path, wholetext=True).withColumn("document_id", F.regexp_extract(F.input_file_name(), "([^/]+)$", 1))
    block = "array<struct<" + ", ".join(":".join(x.split()) for x in BLOCK.split(", ")) + ">>"
    return raw.select("document_id", F.posexplode(F.from_json("value", block)).alias("block", "b")).select("document_id", "block", "b.*")


def find_blocks(spark: SparkSession, path: str) -> DataFrame:
    """folder, path of each folder's block list: a file named *_content_list.json, else content_list.json."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*content_list.json").option("recursiveFileLookup", "true").load(path).select("path")
    named = F.col("path").endswith("_content_list.json")
    return files.groupBy(F.regexp_replace("path", "/[^/]+$", "").alias("folder")).agg(F.min_by("path", F.struct(~named, "path")).alias("path"))


def largest_by_folder(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """folder, path of the largest file that matches in each folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "length")
    return files.groupBy(F.regexp_replace("path", "/[^/]+$", "").alias("folder")).agg(F.max_by("path", "length").alias("path"))


def images(spark: SparkSession, path: str) -> DataFrame:
    """path, length of image files in a folder and below."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return files.where(F.lower("path").rlike("\\.(png|jpe?g|gif|webp|bmp|svg)$"))


def uploads(spark: SparkSession, path: str, cap: int) -> DataFrame:
    """path, accepted: files up to a size that say early on that they are PDF."""
    files = spark.read.format("binaryFile").load(path)
    head = F.substring("content", 1, 1024).cast("string")
    return files.select("path", ((F.col("length") <= cap) & F.contains(head, F.lit("%PDF-"))).alias("accepted"))


def page_batches(documents: DataFrame, size: int) -> DataFrame:
    """Ranges of pages, from 0, both ends in: document_id, first, last; one open range where pages are unknown or few."""
    known = documents.where(F.col("pages") > size).withColumn("first", F.explode(F.expr(f"sequence(0, pages - 1, {size})")))
    split = known.select("document_id", "first", F.least(F.col("first") + size - 1, F.col("pages") - 1).alias("last"))
    whole = documents.where(F.col("pages").isNull() | (F.col("pages") <= size)).select("document_id", F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))
    return split.unionByName(whole)


def merge_batches(batches: DataFrame) -> DataFrame:
    """Blocks of page batches (document_id, start, block, page_idx) as one sequence: pages shifted, order kept."""
    return batches.withColumn("page_idx", F.col("page_idx") + F.col("start")).withColumn("order_key", F.struct("start", "block"))


#: Folders that stored chunks are dealt to, by a hash of their document.
BUCKETS = 64


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Replaces the chunks of the documents that chunks holds; others stay. Only their buckets are read and written again."""
    spark = chunks.sparkSession
    keep = [c for c in PERSISTED if c in chunks.columns]
    fresh = chunks.select(*keep, F.pmod(F.xxhash64("document_id"), F.lit(BUCKETS)).cast("int").alias("bucket"))
    if path_exists(spark, path):
        fresh = materialize(fresh, "chunks")
        touched = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]  # BUCKETS at most
        stored = spark.read.schema(fresh.schema).parquet(path).where(F.col("bucket").isin(touched))
        fresh = materialize(fresh.unionByName(stored.join(fresh.select("document_id").distinct(), "document_id", "left_anti")), "chunks")
    fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
