"""Run results landed as shard files: one JSON object per file, keyed by company."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

JOB = "struct<id:string,title:string,location:string,url:string,posted:string,posted_source:string,site:string,desc:string>"


# the largest text that Spark reads as one JSON value
LARGEST_VALUE = 128 << 20


def read_shards(spark: SparkSession, path: str, layout: str = "file") -> tuple[DataFrame, DataFrame]:
    """(rows, bad files): rows(file, company, row VARIANT, fingerprint).

    `layout` "file" reads each file as one object; "lines" reads one object per line, which Spark splits, so a shard may have
    any size. A value that is no JSON object, or too large to be read as one, is an error row and never dropped silently.
    """
    if layout not in ("file", "lines"):
        raise ValueError(f"layout must be file or lines, not {layout}")
    texts = spark.read.text(path, wholetext=layout == "file").where("value <> ''" if layout == "lines" else "true")
    raw = texts.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.octet_length("value").alias("size"),
                       F.try_variant_get(F.try_parse_json("value"), "$", "map<string,variant>").alias("m"))
    bad = raw.where("m is null").select("file", F.when(F.col("size") >= LARGEST_VALUE, F.concat(
        F.lit("shard too large to read as one object: "), F.col("size").cast("string"), F.lit(" bytes"))).otherwise(
        "shard must be an object").alias("error"))
    rows = raw.where("m is not null").select("file", F.explode("m").alias("company", "row"))
    return rows.withColumn("fingerprint", F.sha2(F.to_json("row"), 256)), bad


def merge_last(rows: DataFrame) -> DataFrame:
    """One row per company; the file latest by name wins."""
    return rows.groupBy("company").agg(F.max_by(F.to_json("row"), "file").alias("_j")).select(
        "company", F.try_parse_json("_j").alias("row"))


def merge_checked(rows: DataFrame) -> DataFrame:
    """One row per company; copies that differ are replaced by an error. Adds `conflict`.

    Equality is decided on row digests, which shrink map-side, never by gathering the copies.
    """
    merged = rows.groupBy("company").agg(F.max_by(F.to_json("row"), "file").alias("_j"),
                                         (F.min("fingerprint") != F.max("fingerprint")).alias("conflict"))
    error = F.lit('{"jobs":null,"complete":null,"err":"conflicting shard results"}')
    return merged.select("company", F.try_parse_json(F.when(F.col("conflict"), error).otherwise(F.col("_j"))).alias("row"), "conflict")


def for_companies(companies: DataFrame, merged: DataFrame) -> DataFrame:
    """Every configured company with its result; one absent from all shards is an error."""
    missing = F.try_parse_json(F.lit('{"jobs":null,"complete":null,"err":"shard result missing"}'))
    return companies.select("company").distinct().join(merged.select("company", "row"), "company", "left").withColumn(
        "row", F.coalesce("row", missing))


def result_facts(results: DataFrame) -> DataFrame:
    """Per company: err, complete (null unless a truth value), jobs_ok (a list whose ids are filled texts), n_jobs, secs."""
    def get(path: str, kind: str):
        return F.try_variant_get("row", path, kind)
    jobs = get("$.jobs", "array<variant>")
    kind = lambda v: F.schema_of_variant(v)
    id_ok = lambda j: F.coalesce((kind(F.try_variant_get(j, "$.id", "variant")) == "STRING") & (
        F.trim(F.try_variant_get(j, "$.id", "string")) != ""), F.lit(False))
    return results.select(
        "company", get("$.err", "string").alias("err"),
        F.when(kind(get("$.complete", "variant")) == "BOOLEAN", get("$.complete", "boolean")).alias("complete"),
        F.coalesce(F.forall(jobs, id_ok), F.lit(False)).alias("jobs_ok"), F.coalesce(F.size(jobs), F.lit(-1)).alias("n_jobs"),
        get("$.secs", "double").alias("secs"))


def result_jobs(results: DataFrame) -> DataFrame:
    """Listed postings of every company, in order. `has_desc` tells an empty description from one never listed."""
    rows = results.select("company", F.posexplode(F.try_variant_get("row", "$.jobs", "array<variant>")).alias("ord", "j"))
    def get(name: str):
        return F.try_variant_get("j", f"$.{name}", "string")
    keys = F.map_keys(F.try_variant_get("j", "$", "map<string,variant>"))
    return rows.select(
        "company", get("id").alias("posting_id"), get("title").alias("title"), F.coalesce(get("location"), F.lit("")).alias("location"),
        get("url").alias("url"), F.try_to_date(F.substring(get("posted"), 1, 10), "yyyy-MM-dd").alias("posted"),
        get("posted_source").alias("posted_source"), get("site").alias("site"), get("desc").alias("desc"),
        F.coalesce(F.array_contains(keys, "desc"), F.lit(False)).alias("has_desc"), F.col("ord").cast("bigint").alias("ord"))
