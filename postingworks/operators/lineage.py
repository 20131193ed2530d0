"""Lineages of re-listed postings rebuilt from their links to the entries they re-list."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postingworks.session import materialize


def roots(links: DataFrame) -> DataFrame:
    """(id, root, steps) of every id of a table (id, up), by pointer jumping in logarithmically many rounds.

    The root is the last id that an id's links lead to, and `steps` how many links that takes. Links that lead into a circle
    have the least id on the circle as their root and no number of steps. An id with several links follows the least.
    """
    own = links.where("up IS NOT NULL").groupBy("id").agg(F.min("up").alias("up"))
    # the rounds run on numbers in the order of the ids, which are joined and sorted much faster
    names = materialize(own.select("id").union(own.select("up")).distinct().orderBy("id").withColumn("n", F.monotonically_increasing_id()), "names")
    start = names.select(F.col("id").alias("_id"), F.col("n").alias("_n"))
    end = names.select(F.col("id").alias("_up"), F.col("n").alias("up_n"))
    numbered = own.join(start, F.col("id").eqNullSafe(F.col("_id"))).join(end, F.col("up") == F.col("_up"))
    open_ = materialize(numbered.select(F.col("_n").alias("id"), F.col("up_n").alias("up"), F.col("up_n").alias("at"), F.col("_n").alias("least"),
                                        F.lit(1).cast("bigint").alias("steps"), F.lit(False).alias("done")), "lineage")
    # rows that have ended are written once, in the round they end
    ended = []
    while True:
        onward = functools.reduce(DataFrame.unionByName, [*ended, open_]).select(
            F.col("id").alias("_id"), F.col("at").alias("_at"), F.col("least").alias("_least"), F.col("steps").alias("_steps"))
        met = open_.join(onward, F.col("at") == F.col("_id"), "left")
        state = materialize(_jumped(met), "lineage")
        ended.append(state.where("done"))
        open_ = state.where("NOT done")
        left = state.agg(F.count_if("done").alias("ended"), F.count_if(~F.col("done")).alias("open")).first()
        if not left["open"] or not left["ended"]:
            break
    finished = functools.reduce(DataFrame.unionByName, ended).select("id", F.col("at").alias("root"), "steps")
    # on the way to a root there is an id at every number of steps, so each round ends some until none is on its way to one:
    # what is open after a round that ended none goes round a circle
    found = finished.unionByName(_circles(open_)) if left["open"] else finished
    named = found.select(F.col("id").alias("n"), F.col("root").alias("root_n"), "steps").join(names, "n")
    return named.join(names.select(F.col("n").alias("root_n"), F.col("id").alias("root")), "root_n").select("id", "root", "steps")


def _jumped(met: DataFrame) -> DataFrame:
    return met.select("id", "up", F.coalesce("_at", "at").alias("at"), F.least("least", F.coalesce("_least", "least")).alias("least"),
                      (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"), F.col("_id").isNull().alias("done"))


def _circles(turning: DataFrame) -> DataFrame:
    """(id, root, steps) of ids whose links lead into a circle, all of them given.

    The root is the least id met from an id's place on; it is the circle's when every id has the same as the id it links to:
    it is then one value all along the circle, met from each place on it, so none there is less.
    """
    while True:
        onward = turning.select(F.col("id").alias("_id"), F.col("at").alias("_at"), F.col("least").alias("_least"), F.col("steps").alias("_steps"))
        met = turning.join(onward, F.col("at") == F.col("_id"))
        caught = materialize(met.select("id", "up", F.col("_least").alias("root")), "circles")
        parents = caught.select(F.col("id").alias("_id"), F.col("root").alias("_root"))
        if caught.join(parents, F.col("up") == F.col("_id")).where("root <> _root").isEmpty():
            return caught.select("id", "root", F.lit(None).cast("bigint").alias("steps"))
        turning = materialize(_jumped(met), "lineage")


def rebuilt(queue: DataFrame, *, only_missing: bool = True) -> DataFrame:
    """The queue with `lineage_root` and `lineage_first_seen` as `repost_of` says them; by default only where they are null.

    A link to an entry that is not in the queue (pruned since) counts as none, so the entry is a root. The first sighting is
    that of the root, or the lineage's own where the root still carries an older one.
    """
    known = queue.select(F.col("id").alias("up"), F.lit(True).alias("_known"))
    links = queue.where("repost_of IS NOT NULL").select("id", F.col("repost_of").alias("up")).join(known.distinct(), "up", "left_semi")
    found = roots(links.select("id", "up"))
    origin = queue.groupBy(F.col("id").alias("root")).agg(F.min(F.coalesce("lineage_first_seen", "first_seen")).alias("_origin"))
    placed = found.join(origin, "root", "left").select(F.col("id").alias("_id"), F.col("root").alias("_root"), "_origin")
    rows = queue.join(placed, F.col("id") == F.col("_id"), "left")
    new = {"lineage_root": F.coalesce("_root", "id"), "lineage_first_seen": F.coalesce("_origin", "first_seen")}
    return rows.select(*[(F.coalesce(c, new[c]) if only_missing else new[c]).alias(c) if c in new else F.col(c) for c in queue.columns])
