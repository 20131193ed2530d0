"""Other landed files: logs, caches, trackers, description documents."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_json_lines(spark: SparkSession, path: str, schema: str, key: str = "id") -> DataFrame:
    """JSON lines with torn or foreign lines skipped: rows that do not parse or lack the key."""
    rows = (spark.read.schema(f"{schema}, _bad string").option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_bad").json(path))
    return rows.where(F.col(key).isNotNull() & F.col("_bad").isNull()).drop("_bad")


def read_optional(spark: SparkSession, path: str, schema: str, kind: str = "parquet") -> DataFrame:
    """A table that may not exist yet: empty with its declared columns when the path holds nothing."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.schema(schema).format(kind).load(path) if there else spark.createDataFrame([], schema)


def read_tracker(spark: SparkSession, path: str, columns: Mapping[str, str | None]) -> DataFrame:
    """A CSV tracker with a header in the user's own words: `columns` maps company, role, location, link, status to it.

    Unmapped columns are null. The byte order mark some spreadsheets write is dropped from the header. `ord` orders rows
    by file name, then by place in the file.
    """
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"))
    raw = raw.select(*[F.col(f"`{c}`").alias(c.lstrip("﻿")) for c in raw.columns], place.alias("_place"))
    named = [(F.col(f"`{source}`") if source else F.lit(None).cast("string")).alias(name) for name, source in columns.items()]
    return raw.select(*named, F.col("_place").alias("ord"),
                      F.concat_ws(":", F.col("_place.file"), F.col("_place.line").cast("string")).alias("key"))


_FAILURE = r"! (.+?) description for (.+?): [^\n]*"
_TOTALS = r"done: [^\n]*? (\d+) closed, (\d+) reopened,"


def log_failures(lines: DataFrame) -> DataFrame:
    """Distinct (company, role) pairs whose description failed, from run log lines `lines(line_no, value)`."""
    hit = lines.where(F.col("value").rlike(_FAILURE))
    return hit.select(F.regexp_extract("value", _FAILURE, 1).alias("company"),
                      F.regexp_extract("value", _FAILURE, 2).alias("role")).distinct()


def log_totals(lines: DataFrame) -> DataFrame:
    """One row: finished, and the closed and reopened counts of the last counter line."""
    hit = F.col("value").rlike(_TOTALS)
    last = F.max_by(F.when(hit, F.col("value")), F.when(hit, F.col("line_no")))
    return lines.agg(F.bool_or(hit).alias("finished"), last.alias("_l")).select(
        F.coalesce("finished", F.lit(False)).alias("finished"), F.regexp_extract("_l", _TOTALS, 1).try_cast("int").alias("closed"),
        F.regexp_extract("_l", _TOTALS, 2).try_cast("int").alias("reopened"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Description documents: (key, role, company, location, link, body), one file each."""
    raw = spark.read.text(path, wholetext=True).select(
        F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.txt$", 1).alias("key"), "value")
    return parse_documents(raw)


def parse_documents(raw: DataFrame) -> DataFrame:
    head = F.split("value", "\n", 6)
    return raw.select("key", head[0].alias("role"), head[1].alias("company"),
                      F.regexp_replace(head[2], "^Location: ?", "").alias("location"),
                      F.regexp_replace(head[3], "^Link: ?", "").alias("link"), F.coalesce(F.get(head, 5), F.lit("")).alias("body"))
