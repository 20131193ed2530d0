"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def bound(value: Column, build) -> Column:
    """`build(value)` with `value` computed once, however often `build` uses it."""
    return F.transform(F.array(value), build)[0]


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else unchanged."""
    return F.translate(text, UPPER, LOWER)


def hex_text(text: Column) -> Column:
    """SHA-256 of the UTF-8 bytes, lowercase hex."""
    return F.sha2(text.cast("binary"), 256)


def earlier(values: Column, zero: Column, merge, block: int = 64) -> Column:
    """For each place of an array, its earlier values merged by an associative `merge` with the neutral value `zero`.

    Values are merged per block of places first, so the work stays near linear in the array's length.
    """
    kind = "array<bigint>"

    def with_values(v: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / block).cast("int"))
        totals = F.transform(blocks, lambda b: F.aggregate(F.slice(v, b * block + 1, block), zero, merge))

        def with_totals(t: Column) -> Column:
            before = F.transform(blocks, lambda b: F.aggregate(F.slice(t, F.lit(1), b), zero, merge))
            return bound(before, lambda p: F.transform(v, lambda x, i: merge(F.get(p, F.floor(i / block).cast("int")), F.aggregate(
                F.slice(v, F.floor(i / block).cast("int") * block + 1, i % block), zero, merge))))

        return bound(totals, with_totals)

    return F.when(F.size(values) > 0, bound(values.cast(kind), with_values)).otherwise(F.array().cast(kind))


def prefix_sums(values: Column) -> Column:
    """The sum of all earlier values, for each place of an array of whole numbers."""
    return earlier(values, F.lit(0).cast("bigint"), lambda a, x: a + x)


def prefix_maxima(values: Column) -> Column:
    """The greatest of all earlier values, 0 at least, for each place of an array of whole numbers."""
    return earlier(values, F.lit(0).cast("bigint"), lambda a, x: F.greatest(a, x))


def each_copy(rows: DataFrame, copies: str) -> DataFrame:
    """`rows` as often as their column `copies` says, without it; made in bounded steps, however many there are."""
    step = 10_000
    parts = rows.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col(copies) - 1) / step))))
    left = F.least(F.col(copies) - F.col("_part") * step, F.lit(step))
    return parts.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), left))).drop("_part", "_copy", copies)


def drop_unused(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files of finished jobs that nothing refers to any more.

    The first collection frees what Python held, the second what that held in turn; the cleaner works meanwhile.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
