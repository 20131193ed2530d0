"""Filling gaps of older queue rows without ever making one worse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postingworks.functions import fixed_values as fv
from postingworks.functions.dates import floor_artifact
from postingworks.functions.pay import annual_bounds, is_partial, is_stated
from postingworks.functions.scale import lookup
from postingworks.functions.text import alnum_key

_CLASSIFIED = ("salary", "salary_evidence", "experience", "experience_evidence", "status")


def wants_salary() -> Column:
    return ~is_stated(F.col("salary")) | is_partial(F.col("salary"), F.col("salary_evidence"))


def rows_with_gaps(queue: DataFrame, all_states: bool = False) -> DataFrame:
    """Open rows that lack a salary (or name one bound only) or years of experience; decided rows only on request."""
    rows = queue.where("closed_on is null")
    if not all_states:
        rows = rows.where(~F.coalesce(F.col("state"), F.lit("")).isin("applied", "dismissed"))
    return rows.where(wants_salary() | F.col("experience").isNull())


def last_cached(cache: DataFrame) -> DataFrame:
    """The last cached result per row id: `cache(id, ord, status, salary, ...)`."""
    return cache.groupBy("id").agg(F.max_by(F.struct(*_CLASSIFIED), "ord").alias("_c")).select("id", "_c.*")


def still_to_read(targets: DataFrame, cache: DataFrame) -> DataFrame:
    return targets.join(cache.select("id").distinct(), "id", "left_anti")


def salary_improvement(old: Column, old_evidence: Column, new: Column) -> Column:
    """Why `new` is strictly better than the stored salary, null when it is not."""
    o, n = annual_bounds(old), annual_bounds(new)
    full = new.contains(" - ") & ~new.startswith("from ") & ~new.startswith("up to ")
    inside = (n["low"] * 0.999 <= o["low"]) & (o["low"] <= n["high"] * 1.001)
    return (F.when(~is_stated(new), None).when(~is_stated(old), "salary N/A->value")
            .when(is_partial(old, old_evidence) & full & F.coalesce(inside, F.lit(False)), "salary lower-bound->range"))


def proposed_changes(targets: DataFrame, cache: DataFrame) -> DataFrame:
    """Change rows (id, company, field, old, new, evidence, kind) for rows whose re-read found more."""
    read = last_cached(cache).where("status = 'ok'").select(
        "id", *[F.col(c).alias(f"n_{c}") for c in _CLASSIFIED if c != "status"])
    rows = targets.join(read, "id")
    kind = F.when(wants_salary(), salary_improvement(F.col("salary"), F.col("salary_evidence"), F.col("n_salary")))
    salary = F.when(kind.isNotNull(), F.struct(
        F.lit("salary").alias("field"), F.col("salary").alias("old"), F.col("n_salary").alias("new"),
        F.coalesce("n_salary_evidence", F.lit("")).alias("evidence"), kind.alias("kind")))
    years = F.when(F.col("experience").isNull() & F.col("n_experience").isNotNull(), F.struct(
        F.lit("experience").alias("field"), F.lit(None).cast("string").alias("old"),
        F.col("n_experience").cast("string").alias("new"), F.coalesce("n_experience_evidence", F.lit("")).alias("evidence"),
        F.lit("experience N/A->value").alias("kind")))
    return rows.select("id", "company", F.explode(F.array_compact(F.array(salary, years))).alias("c")).select(
        "id", "company", "c.*")


def patch(queue: DataFrame, changes: DataFrame) -> DataFrame:
    """Queue with the change rows applied; each row has at most one change per field."""
    def field(name: str, what: str) -> Column:
        return F.max(F.when(F.col("field") == name, F.col(what)))

    wide = changes.groupBy("id").agg(
        field("salary", "new").alias("_s"), field("salary", "evidence").alias("_se"),
        field("experience", "new").cast("int").alias("_x"), field("experience", "evidence").alias("_xe"))
    new = {"salary": F.coalesce("_s", "salary"), "salary_evidence": F.coalesce("_se", "salary_evidence"),
           "experience": F.coalesce("_x", "experience"), "experience_evidence": F.coalesce("_xe", "experience_evidence")}
    return queue.join(wide, "id", "left").select(*[new[c].alias(c) if c in new else F.col(c) for c in queue.columns])


def change_report(changes: DataFrame, companies: DataFrame) -> DataFrame:
    """Changes per board type, one column per kind."""
    kinds = ["salary N/A->value", "salary lower-bound->range", "experience N/A->value"]
    types = companies.select("company", "board_type").distinct()
    typed = lookup(changes, types, ["company"], ["id"]).withColumn("board_type", F.coalesce("board_type", F.lit("?")))
    return (typed.groupBy("board_type").pivot("kind", kinds).count().fillna(0)
            .withColumnsRenamed({kinds[0]: "salary_na_to_value", kinds[1]: "salary_lower_bound_to_range",
                                 kinds[2]: "experience_na_to_value"}))


def reclassify(queue: DataFrame, reread: DataFrame, from_status: str = "Unclear") -> DataFrame:
    """Queue after re-reading rows of one class: `reread(id, new_status, new_evidence)`.

    Finding no wording proves nothing, so Unclear never overturns Blocked or OPT Only; the state follows only from
    new, auto_blocked and opt_only. Adds `flipped`.
    """
    rows = queue.join(reread, "id", "left")
    flips = ((F.col("sponsorship_status") == from_status) & F.col("new_status").isNotNull()
             & (F.col("new_status") != F.col("sponsorship_status")))
    if from_status != "Unclear":
        flips = flips & (F.col("new_status") != "Unclear")
    flips = F.coalesce(flips, F.lit(False))
    target = F.when(F.col("new_status") == "Blocked", "auto_blocked").when(F.col("new_status") == "OPT Only", "opt_only")
    moves = flips & target.isNotNull() & F.col("state").isin("new", "auto_blocked", "opt_only")
    new = {"sponsorship_status": F.when(flips, F.col("new_status")).otherwise(F.col("sponsorship_status")),
           "sponsorship_evidence": F.when(flips, F.col("new_evidence")).otherwise(F.col("sponsorship_evidence")),
           "state": F.when(moves, target).otherwise(F.col("state"))}
    return rows.select(*[new[c].alias(c) if c in new else F.col(c) for c in queue.columns], flips.alias("flipped"))


def repair_floor_dates(queue: DataFrame, companies: DataFrame, details: DataFrame) -> DataFrame:
    """Queue with false floor dates of the relative-date type replaced by the detail date, or emptied.

    `details(id, detail_posted, detail_source)`. Other types give exact dates, so the same gap there is a coincidence.
    """
    types = companies.where(F.col("board_type") == fv.RELATIVE_DATE_TYPE).select("company").distinct().withColumn(
        "_relative", F.lit(True))
    rows = lookup(queue, types, ["company"], ["id"]).join(details, "id", "left")
    fake = F.coalesce("_relative", F.lit(False)) & floor_artifact(F.col("posted"), F.col("first_seen"))
    found = F.col("detail_posted").isNotNull()
    new = {"posted": F.when(fake, F.col("detail_posted")).otherwise(F.col("posted")),
           "posted_source": F.when(fake & found, F.col("detail_source")).otherwise(F.col("posted_source"))}
    return rows.select(*[new[c].alias(c) if c in new else F.col(c) for c in queue.columns])


def names_to_probe(candidates: DataFrame, companies: DataFrame, tried: DataFrame, as_of: Column) -> DataFrame:
    """Distinct candidate names not polled yet and not tried within 30 days, in order of mention."""
    keyed = candidates.groupBy("name").agg(F.min("ord").alias("ord")).withColumn("_k", alnum_key(F.col("name")))
    polled = companies.select(alnum_key(F.col("company")).alias("_k")).distinct()
    recent = (tried.where(F.datediff(as_of, F.col("tried_on")) < fv.RETRY_AFTER_DAYS)
              .select(alnum_key(F.col("name")).alias("_k")).distinct())
    return keyed.join(polled, "_k", "left_anti").join(recent, "_k", "left_anti").drop("_k").orderBy("ord")


def candidate_counts(cards: DataFrame) -> DataFrame:
    """Employers by number of cards, most first."""
    return cards.groupBy("company").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("ord")).orderBy(F.desc("n"), "ord")


def read_success(rows: DataFrame, per_type: int, min_chars: int = fv.MIN_DESCRIPTION_CHARS) -> DataFrame:
    """Share of readable descriptions in a sample of `per_type` rows of every board type (the probe's sample size)."""
    from pyspark.sql import Window
    sample = rows.withColumn("_n", F.row_number().over(Window.partitionBy("board_type").orderBy("ord"))).where(
        F.col("_n") <= per_type)
    return sample.groupBy("board_type").agg(
        F.count_if(F.length("description") >= min_chars).alias("ok"), F.count(F.lit(1)).alias("tried"))
