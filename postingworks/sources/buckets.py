"""State tables cut into buckets of boards, of which a run rewrites only those that its boards fall into.

A table's rows lie under `<table>/<version>/bucket=<n>`, where n is a hash of the board; a manifest names the version of every
bucket of every table, and one pointer names the manifest. A run reads the buckets of its boards, writes their new rows as a
new version and moves the pointer last. All other files stay as they are, readers see the old manifest or the new one, and
jobs that began with the old one go on reading its files until `drop_unreferenced`.

A board's rows share a bucket, but a bucket is many files, dealt by posting, so a board with a large share of all rows is
written by many tasks. There is one writer at a time: a run that finds the pointer moved since it began writes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from postingworks.functions.scale import SALTS, is_short, lookup
from postingworks.operators.lifecycle import update_liveness
from postingworks.sources.sinks import _path, current_version, move_pointer, write_text

BUCKETS = 256


class Moved(RuntimeError):
    """The pointer was moved by another run."""


def bucket_of(company: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(company), F.lit(buckets)).cast("int")


def manifest(spark: SparkSession, folder: str) -> dict:
    """{"buckets": their number, "tables": {table: {bucket: version}}} of the version readers see."""
    version = current_version(spark, folder)
    if version is None:
        return {"buckets": 0, "tables": {}}
    return json.loads(spark.read.text(f"{version[0]}.json", wholetext=True).first()["value"])


def _written(spark: SparkSession, path: str) -> list[int]:
    """The buckets a version has rows in."""
    folder, fs = _path(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return [int(n.removeprefix("bucket=")) for n in names if n.startswith("bucket=")]


def _write(rows: DataFrame, folder: str, name: str, key: str, buckets: int, spread: list[str]) -> dict[str, str]:
    """A new version of the rows' buckets: {bucket: version}."""
    version = f"v-{uuid.uuid4().hex}"
    marked = rows.withColumn("bucket", bucket_of(F.col(key), buckets))
    salt = F.pmod(F.xxhash64(*spread), F.lit(SALTS)) if spread else F.lit(0)
    marked.repartition("bucket", salt).write.partitionBy("bucket").parquet(f"{folder}/{name}/{version}")
    return {str(b): version for b in _written(rows.sparkSession, f"{folder}/{name}/{version}")}


def _point(spark: SparkSession, folder: str, content: dict, began: tuple[str, str] | None, note: str) -> None:
    version = f"m-{uuid.uuid4().hex}"
    write_text(spark, f"{folder}/{version}.json", json.dumps(content))
    if current_version(spark, folder) != began:
        raise Moved(f"{folder} was changed by another run")
    move_pointer(spark, folder, version, note)


def create(tables: dict[str, DataFrame], folder: str, *, key: str = "company", spread: tuple[str, ...] = ("posting_id",),
           buckets: int = BUCKETS, note: str = "") -> None:
    """First content of the tables, each with a column `key`."""
    spark = next(iter(tables.values())).sparkSession
    began = current_version(spark, folder)
    content = {name: _write(df, folder, name, key, buckets, [c for c in spread if c in df.columns]) for name, df in tables.items()}
    _point(spark, folder, {"buckets": buckets, "tables": content}, began, note)


def touched_buckets(spark: SparkSession, folder: str, boards: DataFrame, key: str = "company") -> list[int]:
    """Buckets of some boards; at most as many numbers as there are buckets come to the driver."""
    known = manifest(spark, folder)
    if not known["buckets"]:
        return []
    return sorted(r["b"] for r in boards.select(bucket_of(F.col(key), known["buckets"]).alias("b")).distinct().collect())


def read(spark: SparkSession, folder: str, name: str, schema: StructType | str, buckets: list[int] | None = None) -> DataFrame:
    """A table, or some of its buckets, as the current manifest has it."""
    where = manifest(spark, folder)["tables"].get(name, {})
    paths = [f"{folder}/{name}/{version}/bucket={b}" for b, version in where.items() if buckets is None or int(b) in buckets]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def rewrite(spark: SparkSession, folder: str, boards: DataFrame, change: Callable[[dict[str, DataFrame]], dict[str, DataFrame]],
            schemas: dict[str, StructType | str], *, key: str = "company", spread: tuple[str, ...] = ("posting_id",),
            note: str = "") -> list[int]:
    """Rewrites the rows of `boards` (distinct values of `key`): `change` gets their rows of each table and returns the new
    ones of the tables that change. Rows of other boards in the same buckets are carried over. Returns the buckets."""
    began, known = current_version(spark, folder), manifest(spark, folder)
    mine = touched_buckets(spark, folder, boards, key)
    if not mine:
        return []
    keys = boards.select(key).distinct()
    short = is_short(keys)
    old = {name: read(spark, folder, name, schema, mine) for name, schema in schemas.items()}
    new = change({name: lookup(df, keys, [key], [c for c in spread if c in df.columns] or [key], "left_semi", short=short) for name, df in old.items()})
    content = {name: dict(where) for name, where in known["tables"].items()}
    for name, rows in new.items():
        others = lookup(old[name], keys, [key], [c for c in spread if c in old[name].columns] or [key], "left_anti", short=short)
        fresh = _write(others.unionByName(rows), folder, name, key, known["buckets"], [c for c in spread if c in rows.columns])
        kept = {b: v for b, v in content.get(name, {}).items() if int(b) not in mine}
        content[name] = {**kept, **fresh}
    _point(spark, folder, {"buckets": known["buckets"], "tables": content}, began, note)
    return mine


def apply_liveness(spark: SparkSession, folder: str, schema: StructType | str, listing: DataFrame, boards: DataFrame, as_of: Column,
                   verdicts: DataFrame | None = None, note: str = "") -> list[int]:
    """One run over the table `queue`: only boards read with postings are looked at and only their buckets are written."""
    read_boards = boards.where("n_jobs > 0")
    short = is_short(read_boards)
    return rewrite(spark, folder, read_boards.select("company"), lambda t: {"queue": update_liveness(
        t["queue"], lookup(listing, read_boards.select("company").distinct(), ["company"], ["posting_id"], "left_semi", short=short),
        read_boards, as_of, verdicts, short=short).drop("event")}, {"queue": schema}, note=note)


def drop_unreferenced(spark: SparkSession, folder: str) -> list[str]:
    """Deletes versions of buckets and manifests that the current manifest doesn't name; returns their paths."""
    current, known = current_version(spark, folder), manifest(spark, folder)
    used = {f"{name}/{v}/bucket={b}" for name, where in known["tables"].items() for b, v in where.items()}
    dropped = []
    for name in known["tables"]:
        top, fs = _path(spark, f"{folder}/{name}")
        for version in fs.listStatus(top):
            mine = [f"{name}/{version.getPath().getName()}/bucket={b}" for b in _written(spark, version.getPath().toString())]
            gone = [m for m in mine if m not in used]
            for path in [name + "/" + version.getPath().getName()] if len(gone) == len(mine) else gone:
                fs.delete(_path(spark, f"{folder}/{path}")[0], True)
                dropped.append(path)
    top, fs = _path(spark, folder)
    for file in fs.listStatus(top):
        if file.getPath().getName().startswith("m-") and f"{folder}/{file.getPath().getName()}" != f"{current[0]}.json":
            fs.delete(file.getPath(), False)
            dropped.append(file.getPath().getName())
    return sorted(dropped)
