"""Posting-shaped tables derived from the given tables, whole.

Every fixture is one SELECT that means the same in Spark SQL and in the checking
engine, so a query and its check start from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from postingworks.functions.scale import spread

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
AS_OF = "1999-06-01"

_CITY = """CASE o_custkey % 9 WHEN 0 THEN 'New York, NY' WHEN 1 THEN 'Boston' WHEN 2 THEN 'Jersey City, NJ'
  WHEN 3 THEN 'Buffalo, NY' WHEN 4 THEN 'London' WHEN 5 THEN 'Albany, NY; Stamford, CT' WHEN 6 THEN 'Chicago | Remote'
  WHEN 7 THEN '' ELSE 'Rochester, NY' END"""

FIXTURES = {
    # parts read as postings: brand = company, name and type = title
    "postings": f"""
SELECT p_brand AS company,
  CASE WHEN p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') THEN 'workday' WHEN p_brand IN ('Brand#4', 'Brand#5') THEN 'icims'
       ELSE 'greenhouse' END AS board_type,
  CAST(p_partkey AS STRING) AS posting_id,
  CONCAT(CASE WHEN p_size > 40 THEN 'Senior  ' WHEN p_size < 5 THEN 'Spring 2027 Intern ' ELSE '' END, p_name, ' ', LOWER(p_type)) AS title,
  CASE p_size % 16 WHEN 0 THEN 'New York, NY' WHEN 1 THEN 'Ontario, CA' WHEN 2 THEN 'Ontario' WHEN 3 THEN 'Mexico City, Mexico'
    WHEN 4 THEN 'Santa Fe, New Mexico' WHEN 5 THEN 'Dublin' WHEN 6 THEN 'OH-Dublin-Site' WHEN 7 THEN 'Athens, GA' WHEN 8 THEN 'Athens'
    WHEN 9 THEN 'Headquarters' WHEN 10 THEN 'Wellington, nz' WHEN 11 THEN 'IND HYDB 18' WHEN 12 THEN 'Toronto, ON' WHEN 13 THEN 'M5V 2T6'
    WHEN 14 THEN '3 Locations (Paris)' ELSE 'São Paulo' END AS location,
  CONCAT('https://jobs.example.com/', p_brand, '/', CAST(p_partkey AS STRING), '?utm_source=x') AS url,
  CAST('1999-01-01' AS DATE) + CAST(p_size AS INT) AS posted, p_partkey AS ord, p_size
FROM part""",
    # orders read as the queue: priority = company (five companies, so each key is hot)
    "queue": f"""
SELECT CONCAT(o_orderpriority, ':', CAST(o_orderkey AS STRING)) AS id, o_orderpriority AS company,
  CAST(o_orderkey AS STRING) AS posting_id, CONCAT('Analyst ', CAST(o_custkey % 40 AS STRING), ' R', CAST(10000 + o_orderkey AS STRING)) AS role,
  {_CITY} AS location, CONCAT('https://x.example.com/job/', CAST(o_orderkey AS STRING), '/') AS link,
  CASE WHEN o_totalprice < 60000 THEN NULL ELSE CAST(o_orderdate AS DATE) - CAST(o_custkey % 40 AS INT) END AS posted,
  CASE WHEN o_totalprice < 60000 THEN NULL WHEN o_custkey % 2 = 0 THEN 'approx' ELSE 'exact' END AS posted_source,
  (o_custkey % 11 = 0) AS posted_reverified,
  CASE WHEN o_totalprice < 90000 THEN 'failed' ELSE 'ok' END AS description_status, 'main' AS site,
  CAST(o_orderdate AS DATE) AS first_seen,
  CASE WHEN o_orderstatus = 'F' THEN 'OPT Only' WHEN o_totalprice > 450000 THEN 'Blocked' ELSE 'Unclear' END AS sponsorship_status,
  'as read' AS sponsorship_evidence,
  CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE CAST(o_custkey % 12 AS INT) END AS experience, '' AS experience_evidence,
  CASE o_custkey % 5 WHEN 0 THEN 'Unclear' WHEN 1 THEN '$90,000 - $120,000' WHEN 2 THEN 'from $85,000' WHEN 3 THEN '$45/hr (~$93.6k/yr)'
    ELSE NULL END AS salary,
  CASE o_custkey % 5 WHEN 2 THEN 'salary: from $85,000' ELSE '' END AS salary_evidence,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'new' WHEN '2-HIGH' THEN CASE WHEN o_custkey % 2 = 0 THEN 'new' ELSE 'applied' END
    WHEN '3-MEDIUM' THEN CASE WHEN o_custkey % 3 = 0 THEN 'opt_only' ELSE 'new' END
    WHEN '4-NOT SPECIFIED' THEN CASE WHEN o_custkey % 3 = 1 THEN 'auto_blocked' ELSE 'shortlisted' END ELSE 'dismissed' END AS state,
  (o_orderdate < CAST('1996-01-01' AS DATE)) AS first_run,
  CAST(o_orderdate AS DATE) + CAST(o_custkey % 60 AS INT) AS last_seen_live, CAST(o_custkey % 3 AS INT) AS miss_count,
  CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) + CAST(o_custkey % 90 AS INT) END AS closed_on,
  CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_custkey % 4 = 0 THEN 'manual' ELSE 'removed' END END AS closed_reason,
  CAST(o_custkey % 2 AS INT) AS repost_count, CAST(NULL AS STRING) AS repost_of, CAST(NULL AS DATE) AS reposted_on,
  CONCAT(o_orderpriority, ':', CAST(o_orderkey AS STRING)) AS lineage_root, CAST(o_orderdate AS DATE) AS lineage_first_seen,
  'Unclear' AS ghost_status, '' AS ghost_evidence, o_orderkey AS ord,
  (o_totalprice > 400000) AS alert_pending, CAST(1 + o_custkey % 3 AS INT) AS alert_attempts,
  CAST(o_custkey % 6 AS INT) AS enrich_attempts,
  CASE WHEN o_custkey % 5 = 0 THEN CAST('{AS_OF}' AS DATE) + 1 END AS enrich_next,
  CAST(NULL AS DATE) AS posted_before_refresh, FALSE AS posted_est, CAST(NULL AS STRING) AS origin, o_custkey, o_totalprice
FROM orders""",
    # what the boards list today: orders that are not finished
    "listing": f"""
SELECT o_orderpriority AS company, CAST(o_orderkey AS STRING) AS posting_id,
  CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) - CAST(o_custkey % 40 AS INT) + CAST(o_custkey % 5 AS INT) END AS posted,
  o_orderkey AS ord
FROM orders WHERE o_orderstatus = 'O' OR o_totalprice > 300000""",
    # one row per board of the queue's companies
    "boards": """
SELECT o_orderpriority AS company, o_orderpriority <> '3-MEDIUM' AS complete,
  CASE WHEN o_orderpriority IN ('1-URGENT', '3-MEDIUM') THEN 'workday' WHEN o_orderpriority = '2-HIGH' THEN 'oracle' ELSE 'greenhouse' END AS board_type,
  CAST(CASE WHEN o_orderpriority = '5-LOW' THEN 0 ELSE COUNT(*) END AS BIGINT) AS n_jobs,
  CAST(CASE WHEN o_orderpriority = '5-LOW' THEN 'HTTP 500' END AS STRING) AS err
FROM orders GROUP BY o_orderpriority""",
    # events read as daily sightings of postings on boards
    "sightings": """
SELECT event_type AS company, CAST(user_id AS STRING) AS posting_id, CAST(ts AS DATE) AS run_date, event_id AS ord, value AS secs
FROM events""",
    # customers read as employers
    "employers": """
SELECT CAST(c_custkey AS INT) AS ord, c_name AS company, c_mktsegment AS segment, c_nationkey AS nation, c_acctbal AS balance FROM customer""",
}


def names_used(sql: str, known) -> list[str]:
    return [n for n in known if re.search(rf"\b{n}\b", sql)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wide_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows cost much work each, over all cores even when it is one small file."""
    return spread(table(spark, sf_dir, name))


def select(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A SELECT over the given tables, run by Spark."""
    args = {n: table(spark, sf_dir, n) for n in names_used(sql, TABLES)}
    marked = sql
    for n in args:
        marked = re.sub(rf"\b(FROM|JOIN)\s+{n}\b", rf"\1 {{{n}}}", marked)
    return spark.sql(marked, **args)


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return select(spark, sf_dir, FIXTURES[name])


def with_fixtures(sql: str, **more: str) -> str:
    """Checking SQL with the fixtures it names as leading common tables."""
    parts = {**FIXTURES, **more}
    found = [n for n in parts if re.search(rf"\b(FROM|JOIN)\s+{n}\b", sql) or any(
        re.search(rf"\b(FROM|JOIN)\s+{n}\b", body) for m, body in parts.items() if m != n and re.search(rf"\b(FROM|JOIN)\s+{m}\b", sql))]
    if not found:
        return sql
    heads = ", ".join(f"{n} AS ({parts[n]})" for n in found)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {heads}, {body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {heads}, {body[5:]}"
    return f"WITH {heads} {body}"
