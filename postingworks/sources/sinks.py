"""Writers: whole-table replacement, append logs, partial refresh, document export."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from postingworks.functions import fixed_values as fv
from postingworks.functions.scale import lookup
from postingworks.functions.text import description_key
from postingworks.operators.views import queue_order

_POINTER = "CURRENT"


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def current_version(spark: SparkSession, folder: str) -> tuple[str, str] | None:
    """(folder, note) of the version readers see."""
    pointer, fs = _path(spark, f"{folder}/{_POINTER}")
    if not fs.exists(pointer):
        return None
    version, _, note = spark.read.text(f"{folder}/{_POINTER}").first()["value"].partition(" ")
    return f"{folder}/{version}", note


def write_text(spark: SparkSession, path: str, text: str) -> None:
    file, fs = _path(spark, path)
    out = fs.create(file, True)
    out.write(bytearray(text.encode()))
    out.close()


def move_pointer(spark: SparkSession, folder: str, version: str, note: str = "") -> None:
    """Readers of the folder see `version` from now on: one rename over the old pointer."""
    pointer, fs = _path(spark, f"{folder}/{_POINTER}")
    write_text(spark, f"{folder}/NEXT-{version}", f"{version} {note}")
    fresh, _ = _path(spark, f"{folder}/NEXT-{version}")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    options = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    options[0] = hadoop.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(pointer.toUri() if pointer.toUri().getScheme() else fs.getUri()).rename(fresh, pointer, options)


def replace_tables(tables: dict[str, DataFrame], folder: str, note: str = "") -> str:
    """Writes a new version of several tables and then moves one pointer.

    Readers see all the old tables or all the new ones, so a crash never marks a posting seen without its row. The old
    version stays readable for jobs that started from it.
    """
    spark = next(iter(tables.values())).sparkSession
    version = f"v-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{version}/{name}")
    move_pointer(spark, folder, version, note)
    return f"{folder}/{version}"


def read_table(spark: SparkSession, folder: str, name: str, schema: StructType | str) -> DataFrame:
    """A table of the current version, or an empty one when there is no version yet or it lacks the table."""
    version = current_version(spark, folder)
    if version:
        table, fs = _path(spark, f"{version[0]}/{name}")
        if fs.exists(table):
            return spark.read.schema(schema).parquet(f"{version[0]}/{name}")
    return spark.createDataFrame([], schema)


def append_log(rows: DataFrame, path: str, day: str = "on") -> None:
    rows.write.mode("append").partitionBy(day).parquet(path)


def refresh_partly(old: DataFrame, new: DataFrame, unverified: DataFrame) -> DataFrame:
    """Rows of boards not cleanly read this run stay, all others are replaced."""
    keep = unverified.select("company").distinct()
    return lookup(old, keep, ["company"], ["posting_id"], "left_semi").unionByName(
        lookup(new, keep, ["company"], ["posting_id"], "left_anti"))


def shown(queue: DataFrame) -> DataFrame:
    return queue.where("state in ('new', 'opt_only') and closed_on is null")


def document_text(text: Column) -> Column:
    """A description document: role, company, place, link, blank line, body."""
    def line(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(""))
    return F.concat_ws("\n", line("role"), line("company"), F.concat(F.lit("Location: "), line("location")),
                       F.concat(F.lit("Link: "), line("link")), F.lit(""), text)


def export_documents(queue: DataFrame, descriptions: DataFrame, old: DataFrame) -> DataFrame:
    """The document set after a run: (key, document, change).

    Shown rows with a readable text get a document unless they have one; documents of rows no longer shown are removed.
    """
    rows = shown(queue).withColumn("key", description_key(F.col("id")))
    kept = old.join(rows.select("key"), "key", "left_semi").select("key", "document", F.lit("kept").alias("change"))
    todo = rows.join(old.select("key"), "key", "left_anti").join(descriptions, "id")
    fresh = todo.where(F.length("description") >= fv.MIN_DESCRIPTION_CHARS).select(
        "key", document_text(F.col("description")).alias("document"), F.lit("written").alias("change"))
    gone = old.join(rows.select("key"), "key", "left_anti").select("key", F.lit(None).cast("string").alias("document"),
                                                                 F.lit("removed").alias("change"))
    return kept.unionByName(fresh).unionByName(gone)


def export_queue(queue: DataFrame, path: str) -> None:
    """The queue as JSON lines in reading order; the files' names keep the order."""
    queue.orderBy(*queue_order()).write.json(path)
