"""Payloads parsed once when they land: a table whose JSON is a shredded VARIANT, read by path.

A landed page keeps its payload and gets two parsed columns: `tree`, the JSON of a JSON page (also where it stands inside
HTML), and `node`, the JobPosting node of an HTML page. Spark shreds what the rows of a file have in common into Parquet
columns, so files hold one board type each, and a reader that asks for a path reads that path's columns alone. Listings,
counts and structured data are all read from this table; nothing parses a payload again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, VariantType

from postingworks.functions.scale import SALTS
from postingworks.sources import json_boards, jsonld

# how Spark writes and reads variants by path; defaults of Spark, stated as the table relies on them
SHREDDED = {"spark.sql.variant.writeShredding.enabled": "true", "spark.sql.variant.inferShreddingSchema": "true",
            "spark.sql.variant.allowReadingShredded": "true", "spark.sql.variant.pushVariantIntoScan": "true"}


def parsed(pages: DataFrame) -> DataFrame:
    """`pages(board_type, payload, ..)` with `tree` and `node`; a payload is parsed for what its first character says."""
    is_page = F.ltrim("payload").startswith("<")
    cut = [name for name, board in json_boards.JSON_BOARDS.items() if board.cut]
    tree = F.when(F.col("board_type").isin(*cut) | ~is_page, json_boards.payload_tree())
    return pages.withColumn("tree", tree).withColumn("node", F.when(is_page, jsonld.job_posting(F.col("payload"))))


def land(pages: DataFrame, path: str, *, spread: str | None = None) -> None:
    """Parses the pages and appends them to the table at `path`, a folder per board type; a type of any size is many files.

    Pages are dealt by `spread`, or by all columns that can be hashed: many pages may have the same payload. What still
    meets in one task, like copies of a whole page, is split by the runtime.
    """
    spark = pages.sparkSession
    for key, value in SHREDDED.items():
        spark.conf.set(key, value)
    by = [spread] if spread else [f.name for f in pages.schema if isinstance(f.dataType, AtomicType) and not isinstance(f.dataType, VariantType)]
    salted = pages.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(SALTS)))
    parsed(salted.hint("rebalance", "board_type", "_salt").drop("_salt")).write.mode("append").partitionBy("board_type").parquet(path)


def landed(spark: SparkSession, path: str) -> DataFrame:
    for key, value in SHREDDED.items():
        spark.conf.set(key, value)
    return spark.read.parquet(path)


def listings(table: DataFrame, as_of: Column, types: list[str] | None = None) -> DataFrame:
    """Postings of the JSON boards; other board types' folders are not read."""
    types = list(types or json_boards.JSON_BOARDS)
    return json_boards.postings_of_trees(table.where(F.col("board_type").isin(*types)).withColumnRenamed("tree", "_tree"), as_of, types)


def counts(table: DataFrame) -> DataFrame:
    """Pages with `n`, the number of postings their payload lists."""
    return json_boards.count_in_trees(table.withColumnRenamed("tree", "_tree"))


def structured(table: DataFrame, as_of: Column) -> DataFrame:
    """HTML pages with what their JobPosting node says: ld_title, ld_location, ld_posted, ld_description."""
    return jsonld.read_nodes(table.where(F.ltrim("payload").startswith("<")).withColumnRenamed("node", "_node"), as_of, "payload")
