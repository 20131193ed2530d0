"""Board snapshots as a stream: counts, duplicate removal and the queue's liveness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from postingworks.functions.scale import lookup
from postingworks.operators.lifecycle import update_liveness
from postingworks.sources.sinks import current_version, read_table, replace_tables

CLOCK = "company string, last_run date"


def board_counts(sightings: DataFrame, late: str = "2 days", width: str = "1 day") -> DataFrame:
    """Rows per board and tumbling window; rows later than the watermark are dropped. `sightings(ts, company, ..)`."""
    return (sightings.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "company")
            .agg(F.count(F.lit(1)).alias("rows"), F.approx_count_distinct("posting_id").alias("postings"))
            .select(F.col("w.start").alias("start"), "company", "rows", "postings"))


def distinct_sightings(sightings: DataFrame, late: str = "2 days") -> DataFrame:
    """Each posting once per board and run within the watermark, however often its file is delivered."""
    return sightings.withWatermark("ts", late).dropDuplicatesWithinWatermark(["company", "posting_id", "run_date"])


def _apply_run(spark: SparkSession, folder: str, schema: StructType, rows: DataFrame, day, note: str) -> None:
    """One run day: boards whose clock is already at or past the day are late and change nothing."""
    queue = read_table(spark, folder, "queue", schema)
    clock = read_table(spark, folder, "clock", CLOCK)
    as_of = F.lit(day).cast("date")
    today = rows.where(F.col("run_date") == as_of)
    late = clock.where(F.col("last_run") >= as_of).select("company")
    fresh = lookup(today, late, ["company"], ["posting_id"], "left_anti")
    # a board's marker row carries its completeness and type; posting rows carry an id
    boards = fresh.groupBy("company").agg(
        F.coalesce(F.bool_and("complete"), F.lit(True)).alias("complete"), F.max("board_type").alias("board_type"),
        F.count("posting_id").alias("n_jobs"))
    listing = fresh.where("posting_id is not null").select("company", "posting_id")
    after = update_liveness(queue, listing, boards, as_of).drop("event")
    moved = (clock.unionByName(boards.select("company", as_of.alias("last_run")))
             .groupBy("company").agg(F.max("last_run").alias("last_run")))
    replace_tables({"queue": after, "clock": moved}, folder, note)


def apply_snapshots(batch: DataFrame, batch_id: int, folder: str, schema: StructType) -> None:
    """Applies a micro-batch of snapshot rows (company, posting_id, run_date, complete, board_type) to the queue.

    The run days of a batch are applied in order. Queue and clocks move together behind one pointer whose note names the
    batch and day, so a replayed batch continues where it stopped.
    """
    spark = batch.sparkSession
    version = current_version(spark, folder)
    done_batch, _, done_day = (version[1] if version else "").partition("/")
    if done_batch and int(done_batch) > batch_id:
        return
    # the days of one batch: a handful of values
    days = [r["run_date"] for r in batch.select("run_date").distinct().orderBy("run_date").collect()]
    for day in days:
        if done_batch and int(done_batch) == batch_id and day.isoformat() <= done_day:
            continue
        _apply_run(spark, folder, schema, batch, day, f"{batch_id}/{day.isoformat()}")


def follow_snapshots(snapshots: DataFrame, queue: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Starts the stream that keeps the queue under `folder` up to date; `queue` is its first content."""
    spark = queue.sparkSession
    if current_version(spark, folder) is None:
        replace_tables({"queue": queue, "clock": spark.createDataFrame([], CLOCK)}, folder)
    schema = queue.schema
    return (snapshots.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
            .foreachBatch(lambda df, i: apply_snapshots(df, i, folder, schema)).start())
