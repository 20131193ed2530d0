"""Matching records across sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postingworks.functions import fixed_values as fv
from postingworks.functions import text as tx
from postingworks.session import materialize


def _metadata_key(company: str, role: str, location: str) -> Column:
    return F.concat_ws("|", tx.alnum_key(F.col(company)), tx.alnum_key(F.col(role)), tx.alnum_key(F.col(location)))


def match_identity(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """Adds `match_key`: the existing record that is the same posting, or null.

    Both tables hold company, role, location, link; `existing` also `key` and its insertion order `ord`. Equal links
    decide when both sides have one. Otherwise company, role and location decide, but only if one side has no link.
    The existing side is reduced to the last record per key before the joins, so a hot key costs one row.
    """
    keyed = (existing.withColumn("_link", F.nullif(tx.normalize_link(F.col("link")), F.lit("")))
             .withColumn("_meta", _metadata_key("company", "role", "location")))
    latest = F.max_by("key", "ord")
    by_link = keyed.where("_link is not null").groupBy("_link").agg(latest.alias("_by_link"))
    by_meta = keyed.groupBy("_meta").agg(
        latest.alias("_by_meta"), F.max_by(F.when(F.col("_link").isNull(), F.col("key")),
                                           F.when(F.col("_link").isNull(), F.col("ord"))).alias("_by_linkless"))
    # linkless candidates get keys of their own: a null key would put them all in one partition
    own = F.coalesce(F.nullif(tx.normalize_link(F.col("link")), F.lit("")),
                     F.concat(F.lit("\x00"), F.xxhash64(*candidates.columns).cast("string")))
    keys = candidates.withColumn("_link", own).withColumn("_meta", _metadata_key("company", "role", "location"))
    out = keys.join(by_link, ["_link"], "left").join(by_meta, ["_meta"], "left")
    linked = ~F.col("_link").startswith("\x00")
    return (out.withColumn("match_key", F.when(linked, F.coalesce("_by_link", "_by_linkless")).otherwise(F.col("_by_meta")))
            .select(*candidates.columns, "match_key"))


def not_yet_applied(queue: DataFrame, tracker: DataFrame, statuses=fv.APPLIED_STATUSES) -> DataFrame:
    """Queue rows that match no tracker row with an applied status (all rows count when `statuses` is None)."""
    applied = tracker if statuses is None else tracker.where(F.col("status").isin(*statuses))
    return match_identity(queue, applied).where("match_key is null").drop("match_key")


def mark_tracked(cards: DataFrame, known: DataFrame) -> DataFrame:
    """Adds `tracked`: the (company, title) key of a card is already known."""
    keys = (known.select(tx.alnum_key(F.col("company")).alias("_c"), tx.alnum_key(F.col("title")).alias("_t"))
            .distinct().withColumn("tracked", F.lit(True)))
    keyed = cards.withColumn("_c", tx.alnum_key(F.col("company"))).withColumn("_t", tx.alnum_key(F.col("title")))
    return (keyed.join(keys, ["_c", "_t"], "left").withColumn("tracked", F.coalesce("tracked", F.lit(False))).drop("_c", "_t"))


def untracked(cards: DataFrame, known: DataFrame) -> DataFrame:
    return mark_tracked(cards, known).where(~F.col("tracked")).drop("tracked")


def _prefixes(key: Column, shortest: int) -> Column:
    return F.transform(F.sequence(F.lit(shortest), F.length(key)), lambda n: F.substring(key, F.lit(1), n))


def mark_covered(names: DataFrame, boards: DataFrame, name: str = "company", board: str = "company") -> DataFrame:
    """Adds `has_board`: the name equals a polled employer, or one is a prefix of the other (employers over 4 letters).

    The prefix test runs as equi-joins on exploded prefixes, never as a product of the two tables.
    """
    wanted = names.select(tx.alnum_key(F.col(name)).alias("_n")).distinct()
    polled = boards.select(tx.alnum_key(F.col(board)).alias("_b")).distinct()
    long_ = polled.where(F.length("_b") > 4)
    equal = wanted.join(polled, F.col("_n") == F.col("_b"), "left_semi")
    heads = wanted.where(F.length("_n") > 4).select("_n", F.explode(_prefixes(F.col("_n"), 5)).alias("_p"))
    starts_with_board = heads.join(long_, F.col("_p") == F.col("_b"), "left_semi").select("_n")
    board_heads = long_.select(F.explode(_prefixes(F.col("_b"), 0)).alias("_p")).distinct()
    starts_a_board = wanted.join(board_heads, F.col("_n") == F.col("_p"), "left_semi")
    covered = (equal.unionByName(starts_with_board).unionByName(starts_a_board).distinct()
               .withColumn("has_board", F.lit(True)))
    return (names.withColumn("_n", tx.alnum_key(F.col(name))).join(covered, ["_n"], "left")
            .withColumn("has_board", F.coalesce("has_board", F.lit(False))).drop("_n"))


def coverage_key(name: Column) -> Column:
    return tx.alnum_key(F.substring_index(F.coalesce(name, F.lit("")), "|", 1))


def covered_keys(companies: DataFrame, alias_groups: DataFrame) -> DataFrame:
    """Keys of polled employers plus every member of an alias group with a covered member.

    Groups `alias_groups(group_no, name)` are taken in ascending order, once: a group sees the keys added by groups before
    it. A group is covered from the number of the first group on that covers one of its keys, so each round passes numbers
    from groups to their keys and back by grouped joins, until none falls; there are as many rounds as groups hang on one
    another in a row. Numbers only fall and a group takes what lies before itself, so the order is kept.
    """
    keys = companies.select(coverage_key(F.col("name")).alias("key")).distinct()
    members = materialize(alias_groups.select(F.col("group_no").cast("bigint").alias("group_no"), coverage_key(F.col("name")).alias("key"))
                          .distinct(), "alias-groups")
    polled = members.join(keys, "key", "left_semi").select("key").distinct()
    # the groups that cover a key: polled keys are covered before any group
    since = materialize(polled.withColumn("since", F.lit(None).cast("bigint")).withColumn("polled", F.lit(True)), "aliases")
    while True:
        met = members.join(since, "key").where(F.col("polled") | (F.col("since") < F.col("group_no")))
        covered = met.select("group_no").distinct()
        reached = members.join(covered, "group_no", "left_semi").groupBy("key").agg(F.min("group_no").alias("since"))
        after = materialize(since.where("polled").unionByName(reached.join(polled, "key", "left_anti").withColumn("polled", F.lit(False))), "aliases")
        if after.join(since.select("key", F.col("since").alias("_before"), F.lit(True).alias("_was")), "key", "left").where(
                "NOT polled AND (_was IS NULL OR since < _before)").isEmpty():
            return keys.unionByName(after.where("NOT polled").select("key"))
        since = after


def update_uncovered(uncovered: DataFrame, answers: DataFrame, covered: DataFrame, reason: str) -> DataFrame:
    """The list of employers without a readable board: polled ones dropped, answers without an adapter added.

    Rows carry `change` (kept, dropped, added).
    """
    marked = (uncovered.withColumn("key", coverage_key(F.col("name")))
              .join(covered.withColumn("_c", F.lit(True)), "key", "left"))
    old = marked.select("name", "reason", "url", "key", F.when(F.col("_c"), "dropped").otherwise("kept").alias("change"))
    named = (answers.withColumn("name", F.trim(F.substring_index(F.coalesce("company", F.lit("")), "|", 1)))
             .where((F.col("name") != "") & F.coalesce(F.col("adapter"), F.lit("")).isin(""))
             .withColumn("key", coverage_key(F.col("name"))))
    fresh = (named.join(covered, "key", "left_anti").join(old.where("change = 'kept'"), "key", "left_anti")
             .groupBy("key").agg(F.min_by(F.struct("name", "evidence_url"), "ord").alias("_r"))
             .select(F.col("_r.name").alias("name"), F.lit(reason).alias("reason"),
                     F.nullif(F.col("_r.evidence_url"), F.lit("")).alias("url"), "key", F.lit("added").alias("change")))
    return old.unionByName(fresh).drop("key")


def _substrings(key: Column) -> Column:
    """Every non-empty part of a short key."""
    return F.array_distinct(F.flatten(F.transform(
        F.sequence(F.lit(1), F.length(key)),
        lambda i: F.transform(F.sequence(F.lit(1), F.length(key) - i + 1), lambda n: F.substring(key, i, n)))))


def unanimous_dates(entries: DataFrame, cards: DataFrame) -> DataFrame:
    """Adds `card_date` to undated entries whose title and location fit cards that all agree on one date.

    Locations fit when either is empty, one key contains the other, or the entry's first part is inside the card's.
    Containment runs as equi-joins on parts of the distinct location keys of wanted titles. Cards are first reduced to
    the earliest and latest date per (company, title, location), so no pairs inside a title group arise.
    """
    title = ["_c", "_t"]
    wanted = (entries.withColumn("_c", tx.alnum_key(F.col("company"))).withColumn("_t", tx.alnum_key(F.col("role")))
              .withColumn("_a", tx.alnum_key(F.col("location")))
              .withColumn("_f", tx.alnum_key(F.substring_index(F.coalesce("location", F.lit("")), ",", 1))))
    places = wanted.select(*title, "_a", "_f").distinct()
    found = (cards.withColumn("_c", tx.alnum_key(F.col("company"))).withColumn("_t", tx.alnum_key(F.col("title")))
             .withColumn("_b", tx.alnum_key(F.col("location")))
             .groupBy(*title, "_b").agg(F.min("date").alias("_lo"), F.max("date").alias("_hi"))
             .join(places.select(*title).distinct(), title, "left_semi"))
    by_title = found.groupBy(*title).agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    anywhere = places.where("_a = '' or _f = ''").join(by_title, title)
    unplaced = places.join(found.where("_b = ''").drop("_b"), title)
    parts = (found.where("_b <> ''").withColumn("_part", F.explode(_substrings(F.col("_b"))))
             .groupBy(*title, "_part").agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi")))
    inside = places.join(parts.withColumnRenamed("_part", "_a"), [*title, "_a"])
    first_part = places.join(parts.withColumnRenamed("_part", "_f"), [*title, "_f"])
    around = (places.where("_a <> ''").withColumn("_b", F.explode(_substrings(F.col("_a"))))
              .join(found.where("_b <> ''"), [*title, "_b"]).drop("_b"))
    cols = [*title, "_a", "_f", "_lo", "_hi"]
    every = anywhere.select(cols)
    for part in (unplaced, inside, first_part, around):
        every = every.unionByName(part.select(cols))
    verdict = every.groupBy(*title, "_a", "_f").agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    return (wanted.join(verdict, [*title, "_a", "_f"], "left")
            .withColumn("card_date", F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")))
            .select(*entries.columns, "card_date"))


def already_polled(found: DataFrame, boards: DataFrame) -> DataFrame:
    """Adds `polled_as`: the company whose board has the same type and endpoint key, null when new."""
    known = boards.groupBy("board_type", "endpoint").agg(F.min_by("company", "ord").alias("polled_as"))
    return found.join(known, ["board_type", "endpoint"], "left").select(*found.columns, "polled_as")


def dates_from_listing(entries: DataFrame, listing: DataFrame) -> DataFrame:
    """Entries with `posted` taken from a later listing that has one for the same posting."""
    later = listing.where("posted is not null").groupBy("company", "posting_id").agg(
        F.max_by("posted", "ord").alias("_listed"))
    return (entries.join(later, ["company", "posting_id"], "left")
            .withColumn("posted", F.coalesce("_listed", "posted")).drop("_listed").select(*entries.columns))


def posts_with_dates(posts: DataFrame, dates: DataFrame) -> DataFrame:
    """Posts of one payload dated by a second payload of the same board."""
    opened = dates.groupBy("company", "posting_id").agg(F.max_by("opened_at", "ord").alias("posted"))
    return posts.join(opened, ["company", "posting_id"], "left")
