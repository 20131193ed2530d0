"""Joins and rankings that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 32
BLOCK_ROWS = 100_000
FEW_KEYS = 10_000


def spread(df: DataFrame) -> DataFrame:
    """`df` over all cores when its scan has fewer splits than there are cores, as it is otherwise.

    A small table often sits in one row group, which one task would read and process alone. A large table has more
    splits than cores and is not moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def is_short(per_key: DataFrame) -> bool:
    """Whether a table has so few rows that every task can hold it; at most one row more than that is counted."""
    return per_key.limit(FEW_KEYS + 1).count() <= FEW_KEYS


def lookup(fact: DataFrame, per_key: DataFrame, keys: Sequence[str], spread: Sequence[str], how: str = "left",
           salts: int = SALTS, short: bool = False) -> DataFrame:
    """`fact` joined to a table with one row per key, each key of `fact` spread over `salts` partitions.

    `per_key` holds one row per board or group; its copies cost far less than a hot key in one task. When it is small
    the runtime broadcasts it after checking its size, but only when `fact` has been moved; where it is known to be `short`
    (see `is_short`), `fact` stays where it is.
    """
    if short:
        return fact.join(F.broadcast(per_key), [*keys], how)
    salted = fact.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    copies = per_key.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")


def numbered(df: DataFrame, keys: Sequence[str], blocks: dict[str, Column], order: Sequence[Column],
             name: str = "rank") -> DataFrame:
    """Position 1, 2, .. of each row inside its key group, without sorting a whole group in one task.

    `blocks` are ascending coarse parts of the order, each holding a bounded number of rows: rows are counted per
    block, the counts give every block its offset, and only single blocks are sorted.
    """
    names = list(blocks)
    staged = df
    for column, expression in blocks.items():
        staged = staged.withColumn(column, expression)
    counts = staged.groupBy(*keys, *names).agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(*keys, *names, (F.sum("_n").over(
        Window.partitionBy(*keys).orderBy(*names).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_offset"))
    inside = staged.withColumn("_place", F.row_number().over(Window.partitionBy(*keys, *names).orderBy(*order)))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*keys, *names)]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    return (inside.alias("a").join(offsets.alias("b"), condition)
            .select("a.*", (F.col("_place") + F.col("_offset")).cast("bigint").alias(name)).drop("_place", *names))


def ord_block(ord_column: str = "ord") -> Column:
    return F.floor(F.col(ord_column) / BLOCK_ROWS)


def first_row(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """The first row per key in `order`, reduced map-side before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_row")).select(*keys, "_row.*")
            .select(*df.columns))


def last_row(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """The last row per key in `order`, reduced map-side before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(*keys, "_row.*")
            .select(*df.columns))
