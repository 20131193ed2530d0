"""Title and location rules, with the rule that drops a posting."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postingworks.functions import fixed_values as fv
from postingworks.functions import terms as tm
from postingworks.functions import text as tx
from postingworks.functions.spans import let


@dataclass(frozen=True)
class UnlessRule:
    """Drops a title with any of `terms` unless it also holds any of `unless`."""
    terms: tuple[str, ...]
    unless: tuple[str, ...]


@dataclass(frozen=True)
class FilterRules:
    title_include: tuple[str, ...] = ()
    title_exclude: tuple[str, ...] = ()
    title_exclude_unless: tuple[UnlessRule, ...] = ()
    locations_include: tuple[str, ...] = ()
    locations_exclude: tuple[str, ...] = ()

    def location_only(self) -> FilterRules:
        return FilterRules(locations_include=self.locations_include, locations_exclude=self.locations_exclude)

    def title_only(self) -> FilterRules:
        return replace(self, locations_include=(), locations_exclude=())

    def as_json(self) -> str:
        """Sorted-key JSON of the rules, the input of their signature."""
        return json.dumps(asdict(self), sort_keys=True)


def is_season_title(title: Column) -> Column:
    return tx.collapse(title).rlike("(?i)" + fv.SEASON_TITLE)


def _excludes(rules: FilterRules) -> tuple[list[str], list[str]]:
    every = list(rules.title_exclude)
    return every, [t for t in every if t.lower() not in fv.SEASON_EXEMPT_TERMS]


def _title(title: Column, body) -> Column:
    """`body(t)` for the collapsed title `t.text` and its seasonal flag `t.season`, both computed once."""
    collapsed = tx.collapse(title)
    return let(collapsed, lambda text: let(
        F.struct(text.alias("text"), F.coalesce(text.rlike("(?i)" + fv.SEASON_TITLE), F.lit(False)).alias("season")), body))


def _included(t: Column, rules: FilterRules) -> Column:
    return t["season"] | tm.contains_any(t["text"], rules.title_include) if rules.title_include else F.lit(True)


def title_reason(title: Column, rules: FilterRules) -> Column:
    """STRUCT<kind, term> of the rule hiding a title that has an include hit, else null."""
    every, season = _excludes(rules)

    def read(t: Column) -> Column:
        term = tm.first_match(t["text"], every)
        if season != every:
            term = F.when(t["season"], tm.first_match(t["text"], season)).otherwise(term)

        def reason(found: Column) -> Column:
            out = F.when(found.isNotNull(), F.struct(F.lit("title_exclude").alias("kind"), found.alias("term")))
            for rule in rules.title_exclude_unless:
                out = out.when(
                    tm.contains_any(t["text"], rule.terms) & ~tm.contains_any(t["text"], rule.unless),
                    F.struct(F.lit("title_exclude_unless").alias("kind"),
                             F.coalesce(F.lower(tm.first_match(t["text"], rule.terms)), F.lit("")).alias("term")))
            return out

        return F.when(_included(t, rules), let(F.lower(term), reason))

    return _title(title, read)


def title_passes(title: Column, rules: FilterRules) -> Column:
    every, season = _excludes(rules)

    def read(t: Column) -> Column:
        excluded = tm.contains_any(t["text"], every)
        if season != every:
            excluded = F.when(t["season"], tm.contains_any(t["text"], season)).otherwise(excluded)
        ok = _included(t, rules) & ~excluded
        for rule in rules.title_exclude_unless:
            ok = ok & ~(tm.contains_any(t["text"], rule.terms) & ~tm.contains_any(t["text"], rule.unless))
        return ok

    return _title(title, read)


def location_rule(location: Column, rules: FilterRules) -> Column:
    """Name of the first rule that drops a location, null when it passes."""
    def check(w: Column) -> Column:
        named = [F.when(w[where].rlike(pattern), F.lit(name)) for name, pattern, where in fv.LOCATION_SHAPES]
        if rules.locations_include:
            wanted = F.lit(False)
            for term in rules.locations_include:
                wanted = wanted | w["lowered"].contains(term.lower())
            named.append(F.when(~wanted, F.lit("not_included")))
        if rules.locations_exclude:
            named.append(F.when(tm.contains_any(w["folded"], rules.locations_exclude), F.lit("excluded_term")))
        return F.coalesce(*named)

    return let(F.coalesce(location, F.lit("")), lambda raw: let(
        F.struct(raw.alias("raw"), F.lower(raw).alias("lowered"), tx.fold_accents(F.lower(raw)).alias("folded")), check))


def with_rules(postings: DataFrame, rules: FilterRules, title: str = "title", location: str = "location",
               link: str | None = None) -> DataFrame:
    """Adds `hit`, `rule_kind`, `rule_term` and `location_rule` in one pass, without a shuffle."""
    where = tx.effective_location(F.col(location), F.col(link) if link else F.lit(""), F.col(title))
    staged = postings.withColumn("_where", where).withColumn("location_rule", location_rule(F.col("_where"), rules))
    return (staged.withColumn("_reason", title_reason(F.col(title), rules))
            .withColumn("hit", title_passes(F.col(title), rules) & F.col("location_rule").isNull())
            .withColumn("rule_kind", F.col("_reason.kind")).withColumn("rule_term", F.col("_reason.term"))
            .drop("_where", "_reason"))


def matching(postings: DataFrame, rules: FilterRules, title: str = "title", location: str = "location",
             link: str | None = None) -> DataFrame:
    """Postings that pass every rule; the cheap title tests come first."""
    where = tx.effective_location(F.col(location), F.col(link) if link else F.lit(""), F.col(title))
    return postings.where(title_passes(F.col(title), rules)).where(location_rule(where, rules).isNull())


def hidden_roles(postings: DataFrame, rules: FilterRules) -> DataFrame:
    """Every role a title rule hides although the location rules pass, with that rule.

    A hidden role fails the title rules, so it is never a hit and no anti join is needed.
    """
    place = tx.effective_location(F.col("location"), F.lit(""), F.lit("x"))
    return (postings.withColumn("_reason", title_reason(F.col("title"), rules)).where("_reason is not null")
              .where(location_rule(place, rules.location_only()).isNull())
              .select("company", "posting_id", "title", "location", "url", F.col("_reason.kind").alias("rule_kind"),
                      F.col("_reason.term").alias("rule_term"), "ord"))


def hidden_by_title(postings: DataFrame, rules: FilterRules, cap: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(the hidden roles, the count of them per company).

    A report may ask for the first `cap` per company; the ranking then keeps only those before its shuffle.
    """
    hidden = hidden_roles(postings, rules)
    rows = hidden if cap is None else (
        hidden.withColumn("_n", F.row_number().over(Window.partitionBy("company").orderBy("ord"))).where(F.col("_n") <= cap).drop("_n"))
    totals = hidden.groupBy("company").agg(F.count(F.lit(1)).alias("n"))
    return rows, totals


def rescue_multi_site(postings: DataFrame, sites: DataFrame, rules: FilterRules) -> DataFrame:
    """Multi-site postings whose first site fails: a hit, with the full site list, when any site passes.

    `sites(company, posting_id, full_location)` is the looked-up site list; rows without one wait for a later run.
    """
    first = F.split(F.coalesce(F.col("location"), F.lit("")), r" \(", 2)[0]
    candidates = (postings.where(F.col("board_type") == fv.RELATIVE_DATE_TYPE).where(first.rlike(tx.MULTI_SITE))
                  .where(title_passes(F.col("title"), rules.title_only()))
                  .where(location_rule(tx.effective_location(F.col("location"), F.lit(""), F.col("title")), rules).isNotNull()))
    joined = candidates.join(sites, ["company", "posting_id"])
    any_site = F.exists(F.split("full_location", "; ", -1),
                        lambda s: location_rule(tx.effective_location(s, F.lit(""), F.col("title")), rules).isNull())
    return (joined.where((F.col("full_location") != F.col("location")) & any_site)
            .withColumn("location", F.col("full_location")).drop("full_location"))


def drop_rejected_locations(queue: DataFrame, rules: FilterRules) -> DataFrame:
    """Queue without still-new rows that today's location rules reject."""
    where = tx.effective_location(F.col("location"), F.col("link"), F.col("role"))
    rejected = (F.col("state") == "new") & location_rule(where, rules.location_only()).isNotNull()
    return queue.where(~rejected)


def in_team(team: Column, wanted: str | None) -> Column:
    return F.lit(True) if not wanted else F.coalesce(team == wanted, F.lit(False))


def card_mentions(card: Column, needle: str | None) -> Column:
    return F.lit(True) if not needle else F.lower(card).contains(needle.lower())


def rules_from_tables(terms: Sequence[tuple[str, str]], unless: Sequence[UnlessRule] = ()) -> FilterRules:
    """Rules from (list name, term) rows, ordered, without blanks and repeats."""
    def named(name: str) -> tuple[str, ...]:
        return tuple(tm.clean_terms(t for n, t in terms if n == name))
    return FilterRules(named("title_include"), named("title_exclude"), tuple(unless), named("locations_include"),
                       named("locations_exclude"))
