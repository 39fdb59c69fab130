"""Centrality of authors in the author-file graph as it grows day by day."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from revtide.operators.base import attach, dense_ids, hash_bucket
from revtide.operators.graph import PAIR_ROWS
from revtide.session import cut_lineage, store


def _first_links(revisions: DataFrame, changes: DataFrame) -> DataFrame:
    """(author, path, day the author first touched the path)."""
    touched = changes.select("revno", "changedpath").distinct()
    return (
        touched.join(revisions.select("revno", "author", "commitdate"), "revno")
        .groupBy("author", "changedpath")
        .agg(F.to_date(F.min("commitdate")).alias("day"))
    )


def degree_over_time(revisions: DataFrame, changes: DataFrame) -> DataFrame:
    """(author, day, degree, centrality) at the end of every commit day."""
    return _degree_by_day(revisions, changes).drop("_nodes")


def _degree_by_day(revisions: DataFrame, changes: DataFrame) -> DataFrame:
    """(author, day, degree, centrality, _nodes): the graph's nodes come along.

    An author is listed from the first commit on. New links and new nodes are
    counted per day, so every ordered window runs over days.
    """
    links = _first_links(revisions, changes)
    gains = links.groupBy("author", "day").agg(F.count(F.lit(1)).alias("_new"))
    born = (
        links.groupBy("author").agg(F.min("day").alias("day")).select("day")
        .unionAll(links.groupBy("changedpath").agg(F.min("day").alias("day")).select("day"))
        .groupBy("day")
        .agg(F.count(F.lit(1)).alias("_born"))
    )
    commit_days = (
        revisions.join(changes.select("revno").distinct(), "revno", "left_semi")
        .select(F.to_date("commitdate").alias("day"))
        .distinct()
    )
    run = W.orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    nodes = commit_days.join(born, "day", "left").select(
        "day", F.sum(F.coalesce("_born", F.lit(0))).over(run).alias("_nodes")
    )
    # One array of commit days serves all authors; it grows with days, not with rows.
    calendar = commit_days.agg(F.sort_array(F.collect_set("day")).alias("_days"))
    starts = attach(gains.groupBy("author").agg(F.min("day").alias("_start")), calendar)
    grid = starts.select(
        "author", F.explode(F.filter("_days", lambda d: d >= F.col("_start"))).alias("day")
    )
    mine = W.partitionBy("author").orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    degree = (
        grid.join(gains, ["author", "day"], "left")
        .withColumn("degree", F.sum(F.coalesce("_new", F.lit(0))).over(mine))
        .drop("_new")
    )
    return degree.join(nodes, "day").select(
        "author",
        "day",
        "degree",
        F.when(F.col("_nodes") > 1, F.col("degree") / (F.col("_nodes") - 1))
        .otherwise(F.lit(0.0))
        .alias("centrality"),
        "_nodes",
    )


def _author_steps(links: DataFrame, authors: DataFrame) -> DataFrame:
    """(author, node, hops, day): from ``day`` on the node lies within ``hops`` of the author.

    Links only appear, so all days are walked at once: what counts of a path is its
    latest link, and a step takes the earliest day over all paths with one link more.
    Rows are kept only where one more hop reaches a node on an earlier day. Every
    link joins an author to a path, so steps lead to paths and to authors in turn.
    """
    step = store(
        links.join(authors, "a", "left_semi").groupBy(F.col("a").alias("author")).agg(F.min("day").alias("day"))
        .select("author", F.col("author").alias("node"), "day")
    )
    none = step.limit(0)
    out, hop = step.select("author", "node", F.lit(0).alias("hops"), "day"), 0
    best = {"a": step, "f": none}
    while not step.isEmpty():
        hop += 1
        at, to = ("a", "f") if hop % 2 else ("f", "a")
        offers = (
            step.select("author", F.col("node").alias(at), "day")
            .join(links.withColumnRenamed("day", "_day"), at)
            .groupBy("author", F.col(to).alias("node"))
            .agg(F.min(F.greatest("day", "_day")).alias("_offer"), F.lit(True).alias("_got"))
        )
        earlier = F.col("_got") & (F.col("day").isNull() | (F.col("_offer") < F.col("day")))
        merged = store(
            best[to].join(offers, ["author", "node"], "full_outer")
            .select("author", "node", F.least("day", "_offer").alias("day"), F.coalesce(earlier, F.lit(False)).alias("_new"))
        )
        best[to] = merged.select("author", "node", "day")
        step = merged.filter("_new").drop("_new")
        out = out.unionByName(step.select("author", "node", F.lit(hop).alias("hops"), "day"))
    # Paths and authors have numbers of their own: at odd hops lie paths.
    return out


def closeness_over_time(
    revisions: DataFrame, changes: DataFrame, days: Sequence[str] | None = None, pair_rows: int = PAIR_ROWS
) -> DataFrame:
    """(author, day, closeness) at the end of every commit day from the author's first on.

    ``days`` keeps some of them. Distances of all days come from one walk outwards from
    the authors (``_author_steps``), who are taken in batches of about ``pair_rows``
    (author, node) rows. A node is at ``hops`` from the day it is reached in so many
    until the day it is in fewer; sums over nodes change on such days only.
    """
    first = _first_links(revisions, changes)
    named = store(first)
    # Authors and paths go by numbers; links of a path lie together, so that offers to it are merged where they are made.
    authors = store(dense_ids(named.select("author").distinct(), hash_bucket("author"), ["author"], "_id", 0))
    paths = dense_ids(named.select("changedpath").distinct(), hash_bucket("changedpath"), ["changedpath"], "f", 0)
    numbered = named.join(authors.select("author", F.col("_id").alias("a")), "author", "left").join(paths, "changedpath", "left")
    links = store(numbered.select("a", "f", "day").repartition("f"))
    nodes = links.agg((F.count_distinct("a") + F.count_distinct("f")).alias("n")).first()["n"]
    batch = max(1, pair_rows // max(nodes, 1))
    shifts: DataFrame | None = None
    for start in range(0, authors.count(), batch):
        own = authors.filter((F.col("_id") >= start) & (F.col("_id") < start + batch)).select(F.col("_id").alias("a"))
        steps = _author_steps(links, own)
        until = F.lag("day").over(W.partitionBy("author", "node", F.col("hops") % 2).orderBy("hops"))
        moved = steps.withColumn("_until", until).select(
            "author",
            F.explode(
                F.array(
                    F.struct(F.col("day").alias("day"), F.lit(1).alias("r"), F.col("hops").alias("d")),
                    F.struct(F.col("_until").alias("day"), F.lit(-1).alias("r"), (-F.col("hops")).alias("d")),
                )
            ).alias("e"),
        ).select("author", "e.*").filter(F.col("day").isNotNull())
        part = cut_lineage(moved.groupBy("author", "day").agg(F.sum("r").alias("_r"), F.sum("d").alias("_d")))
        shifts = part if shifts is None else shifts.unionByName(part)
    calendar = _degree_by_day(revisions, changes).select("author", "day", "_nodes")
    if shifts is None:
        return calendar.select("author", "day", F.lit(None).cast("double").alias("closeness"))
    shifts = shifts.withColumnRenamed("author", "_id").join(authors, "_id").drop("_id")
    run = W.partitionBy("author").orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    r = F.sum(F.coalesce("_r", F.lit(0))).over(run) - 1
    d = F.sum(F.coalesce("_d", F.lit(0))).over(run)
    summed = calendar.join(shifts, ["author", "day"], "left").select("author", "day", "_nodes", r.alias("r"), d.alias("d"))
    value = F.when((F.col("d") > 0) & (F.col("_nodes") > 1), F.col("r") / F.col("d") * (F.col("r") / (F.col("_nodes") - 1)))
    out = summed.select("author", "day", value.otherwise(F.lit(0.0)).alias("closeness"))
    return out if days is None else out.filter(F.col("day").isin([date.fromisoformat(x) for x in days]))


def centrality_over_time(revisions: DataFrame, changes: DataFrame) -> DataFrame:
    """(author, day, degree, centrality, closeness) at the end of every commit day."""
    degree = degree_over_time(revisions, changes)
    return degree.join(closeness_over_time(revisions, changes), ["author", "day"], "left")
