"""Times between consecutive revisions and commits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revtide.functions.calendar import months_before
from revtide.functions.cooling import hours_between
from revtide.operators.aggregates import author_ranking
from revtide.operators.base import attach, per_group, prev_value, revno_share, share_bucket
from revtide.operators.scope import log_end
from revtide.schema import OTHERS

# Gap classes in days, their labels, and the spread of the band.
GAP_EDGES = (0.0, 1.0 / 24.0, 4.0 / 24.0, 1.0, 2.0, 4.0, 8.0, 16.0)
GAP_LABELS = (
    "0-1 hr", "1-4 hrs", "4hrs-1 day", "1-2 days", "2-4 days", "4-8 days", "8-16 days",
)
BAND_FACTOR = 1.28
TOP_AUTHORS = 20


def bucket(value: Column, edges: Sequence[float]) -> Column:
    """Index of the half-open interval ``[lo, hi)`` holding ``value``; null outside."""
    out = F.when(value < edges[0], F.lit(None).cast("int"))
    for i, hi in enumerate(edges[1:]):
        out = out.when(value < F.lit(hi), F.lit(i))
    return out


def _days(start: Column, end: Column) -> Column:
    return hours_between(start, end) / F.lit(24.0)


def _of_top_authors(
    log: DataFrame, ranked: DataFrame, top: int, group_cols: Sequence[str]
) -> DataFrame:
    keys = [*group_cols, "author"]
    best = author_ranking(ranked, top, group_cols).select(*keys)
    return log.join(best, keys, "left_semi")


def rank_desc(revisions: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Rank of each revision within its author, newest revision = 1.

    Ranks within a bucket of revisions plus the number of rows in later buckets.
    """
    from pyspark.sql import Window as W

    keys = [*group_cols, "author"]
    rows = revisions.withColumn("_b", revno_share(revisions))
    inner = rows.withColumn(
        "_r", F.row_number().over(W.partitionBy(*keys, "_b").orderBy(F.col("revno").desc()))
    )
    later = rows.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    later = later.select(
        *keys,
        "_b",
        F.coalesce(
            F.sum("_n").over(W.partitionBy(*keys).orderBy(F.col("_b").desc()).rowsBetween(W.unboundedPreceding, -1)),
            F.lit(0),
        ).alias("_later"),
    )
    return (
        inner.join(later, [*keys, "_b"])
        .withColumn("rank", F.col("_r") + F.col("_later"))
        .drop("_b", "_r", "_later")
    )


def revision_gaps(
    revisions: DataFrame,
    n_authors: int | None = None,
    group_cols: Sequence[str] = (),
    ranked: DataFrame | None = None,
) -> DataFrame:
    """Hours since the previous revision; authors outside the top n of ``ranked`` become ``others``."""
    group_cols = list(group_cols)
    keys = [*group_cols, "author"]
    rows = prev_value(
        revisions.select(*group_cols, "revno", "author", "commitdate"),
        group_cols,
        revno_share(revisions),
        ["revno"],
        {"_prev_date": "commitdate"},
    ).filter(F.col("_prev_date").isNotNull())
    busy = author_ranking(ranked if ranked is not None else revisions, n_authors, group_cols)
    named = busy.select(*keys, F.lit(True).alias("_known"))
    return rows.join(named, keys, "left").select(
        *group_cols,
        "revno",
        F.when(F.col("_known"), F.col("author")).otherwise(F.lit(OTHERS)).alias("author"),
        hours_between(F.col("_prev_date"), F.col("commitdate")).alias("hours"),
    )


def author_gaps(log: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Days since the same author's previous commit, in commit-time order."""
    keys = [*group_cols, "author"]
    share = share_bucket(log, "commitdate", "revno")
    rows = prev_value(log, keys, share, ["commitdate", "revno"], {"_prev_date": "commitdate"})
    return rows.withColumn("gap_days", _days(F.col("_prev_date"), F.col("commitdate"))).drop("_prev_date")


def commit_gap_histogram(
    log: DataFrame,
    ranked: DataFrame | None = None,
    edges: Sequence[float] = GAP_EDGES,
    labels: Sequence[str] | None = None,
    top: int = TOP_AUTHORS,
    group_cols: Sequence[str] = (),
) -> DataFrame:
    """Commits of the busiest authors by time since their previous commit.

    ``ranked`` is the scope that decides who is busiest; gaps use the whole log.
    """
    if labels is None:
        labels = GAP_LABELS if tuple(edges) == GAP_EDGES else [
            f"{lo:.2f}-{hi:.2f}" for lo, hi in zip(edges[:-1], edges[1:])
        ]
    busy = _of_top_authors(log, ranked if ranked is not None else log, top, group_cols)
    cls = bucket(F.col("gap_days"), edges)
    gaps = author_gaps(busy.select(*group_cols, "author", "commitdate", "revno"), group_cols)
    counts = per_group(
        gaps, group_cols, F.array(*[F.count_if(cls == i) for i in range(len(labels))]).alias("_c")
    )
    rows = counts.select(*group_cols, F.posexplode("_c").alias("bin", "commits"))
    return rows.withColumn(
        "label", F.element_at(F.array(*[F.lit(x) for x in labels]), (F.col("bin") + 1).cast("int"))
    )


def deltastddev(
    df: DataFrame, keys: Sequence[str], ts: str = "commitdate", tiebreak: str = "revno"
) -> DataFrame:
    """Sample deviation, in days, of the steps between consecutive rows; 0 below two steps."""
    rows = prev_value(df, keys, share_bucket(df, ts, tiebreak), [ts, tiebreak], {"_p": ts})
    return rows.groupBy(*keys).agg(
        F.coalesce(F.stddev_samp(_days(F.col("_p"), F.col(ts))), F.lit(0.0)).alias("stddev")
    )


def commit_gap_stats(
    log: DataFrame,
    ranked: DataFrame | None = None,
    months: int | None = None,
    unbiased: bool = False,
    top: int = TOP_AUTHORS,
    group_cols: Sequence[str] = (),
) -> DataFrame:
    """Mean and deviation of the days between commits, for the busiest authors.

    The mean divides by the number of commits, counting the newest with gap 0;
    ``unbiased=True`` divides by the number of gaps. Neighbours for the mean are
    by revision number, for the deviation by commit time.
    """
    group_cols = list(group_cols)
    keys = [*group_cols, "author"]
    busy = _of_top_authors(
        log.select(*keys, "revno", "commitdate"), ranked if ranked is not None else log, top, group_cols
    )
    if months is None:
        inside, prev_inside = F.lit(True), F.lit(True)
        recent = busy
    else:
        busy = attach(busy, log_end(log, group_cols), group_cols)
        since = months_before(F.col("end_day"), months).cast("timestamp")
        inside, prev_inside = F.col("commitdate") >= since, F.col("_prev_date") >= since
        recent = busy.filter(inside)
    rows = prev_value(busy, keys, revno_share(log), ["revno"], {"_prev_date": "commitdate"})
    gap = F.when(inside & prev_inside, _days(F.col("_prev_date"), F.col("commitdate")))
    n = F.count(gap) if unbiased else F.count_if(inside)
    means = (
        rows.groupBy(*keys)
        .agg(F.coalesce(F.sum(gap), F.lit(0.0)).alias("_s"), n.alias("_n"), F.count_if(inside).alias("_m"))
        .filter(F.col("_m") > 0)
        .select(
            *keys,
            F.when(F.col("_n") > 0, F.col("_s") / F.col("_n")).otherwise(F.lit(0.0)).alias("mean_days"),
        )
    )
    return means.join(deltastddev(recent, keys), keys)


def commit_gap_band(
    log: DataFrame,
    ranked: DataFrame | None = None,
    months: int | None = None,
    group_cols: Sequence[str] = (),
) -> DataFrame:
    """Mean gap with a 1.28-deviation band, low end not below 0."""
    stats = commit_gap_stats(log, ranked, months, group_cols=group_cols)
    half = F.lit(BAND_FACTOR) * F.col("stddev")
    return stats.select(
        *group_cols,
        "author",
        F.col("mean_days").alias("avg"),
        (F.col("mean_days") + half).alias("hi"),
        F.greatest(F.lit(0.0), F.col("mean_days") - half).alias("lo"),
    )
