"""Daily series: running totals, gap filling, leading-zero stripping.

Rows are folded to one per (group, day) before any ordered window, so a window
partition holds at most as many rows as the log has days.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from revtide.functions import calendar
from revtide.functions.paths import dir_prefix
from revtide.operators.aggregates import author_ranking
from revtide.operators.base import attach, per_group
from revtide.operators.scope import BUGFIX_KEYWORDS, bugfix_filter, log_end


def running(group_cols: Sequence[str], order: str = "day"):
    return W.partitionBy(*group_cols).orderBy(order).rowsBetween(W.unboundedPreceding, 0)


def revision_facts(
    revisions: DataFrame, changes: DataFrame, group_cols: Sequence[str] = ()
) -> DataFrame:
    """One row per revision with its change totals; the base of most series.

    A report caches this once instead of scanning ``changes`` per chart.
    """
    on = [*group_cols, "revno"]
    is_file = F.col("pathtype") == "F"
    totals = changes.groupBy(*on).agg(
        F.sum("linesadded").alias("lines_added"),
        F.sum("linesdeleted").alias("lines_deleted"),
        F.count_if(is_file & (F.col("changetype") == "A")).alias("files_added"),
        F.count_if(is_file & (F.col("changetype") == "D")).alias("files_deleted"),
        F.count(F.lit(1)).alias("n_changes"),
    )
    return revisions.select(*on, "commitdate", "author", "msg").join(totals, on)


def _daily(facts: DataFrame, keys: Sequence[str], tz: str, *aggs: Column) -> DataFrame:
    return facts.groupBy(*keys, calendar.local_day("commitdate", tz).alias("day")).agg(*aggs)


def gap_fill(
    daily: DataFrame,
    values: Sequence[str],
    ends: DataFrame,
    keys: Sequence[str] = (),
    end_cols: Sequence[str] = (),
    fill_gaps: bool = True,
) -> DataFrame:
    """Before a gap of more than a day repeat the old value on the day before it;
    after the last day repeat the last value on ``end_day``.

    ``keys`` name one series; ``end_cols`` the groups that ``ends`` is keyed by.
    """
    keys = list(keys)
    w = W.partitionBy(*keys).orderBy("day")
    here = F.struct(F.col("day"), *[F.col(v) for v in values])
    prev_day = F.lag("day").over(w)
    filler = F.struct(
        F.date_sub("day", 1).alias("day"), *[F.lag(v).over(w).alias(v) for v in values]
    )
    closing = F.struct(F.col("end_day").alias("day"), *[F.col(v) for v in values])
    is_last = F.lead("day").over(w).isNull()
    parts = [here, F.when(is_last & (F.col("day") < F.col("end_day")), closing)]
    if fill_gaps:
        parts.insert(0, F.when(F.datediff("day", prev_day) > 1, filler))
    filled = attach(daily, ends, end_cols).select(*keys, F.array(*parts).alias("_rows"))
    return filled.select(*keys, F.explode(F.array_compact("_rows")).alias("_r")).select(
        *keys, "_r.day", *[f"_r.{v}" for v in values]
    )


def strip_leading_zeros(
    series: DataFrame, value: str, keys: Sequence[str] = (), order: str = "day"
) -> DataFrame:
    started = F.max(F.col(value) != 0).over(running(keys, order))
    return series.withColumn("_on", started).filter("_on").drop("_on")


def _trend(
    daily: DataFrame, delta: str, ends: DataFrame, keys: Sequence[str], end_cols: Sequence[str], out: str
) -> DataFrame:
    run = daily.select(*keys, "day", F.sum(delta).over(running(keys)).alias(out))
    return strip_leading_zeros(gap_fill(run, [out], ends, keys, end_cols), out, keys)


def loc_trend(
    revisions: DataFrame,
    changes: DataFrame,
    facts: DataFrame | None = None,
    tz: str = "UTC",
    group_cols: Sequence[str] = (),
) -> DataFrame:
    """Total lines per day."""
    group_cols = list(group_cols)
    facts = revision_facts(revisions, changes, group_cols) if facts is None else facts
    daily = _daily(facts, group_cols, tz, F.sum(F.col("lines_added") - F.col("lines_deleted")).alias("_d"))
    return _trend(daily, "_d", log_end(revisions, group_cols), group_cols, group_cols, "loc")


def author_loc_trend(
    revisions: DataFrame,
    changes: DataFrame,
    authors: DataFrame | Sequence[str] | None = None,
    top: int | None = None,
    facts: DataFrame | None = None,
    tz: str = "UTC",
    group_cols: Sequence[str] = (),
) -> DataFrame:
    """Lines contributed per author and day, all authors in one job.

    Give a list of names, or ``top`` to keep the busiest authors.
    """
    group_cols = list(group_cols)
    keys = [*group_cols, "author"]
    facts = revision_facts(revisions, changes, group_cols) if facts is None else facts
    if top is not None:
        authors = author_ranking(revisions, top, group_cols)
    if isinstance(authors, DataFrame):
        facts = facts.join(authors.select(*keys), keys, "left_semi")
    elif authors is not None:
        facts = facts.filter(F.col("author").isin(*authors))
    daily = _daily(facts, keys, tz, F.sum(F.col("lines_added") - F.col("lines_deleted")).alias("_d"))
    return _trend(daily, "_d", log_end(revisions, group_cols), keys, group_cols, "loc")


def file_count_trend(
    revisions: DataFrame,
    changes: DataFrame,
    facts: DataFrame | None = None,
    tz: str = "UTC",
    group_cols: Sequence[str] = (),
) -> DataFrame:
    """Live files per day; only days that add or delete files count as events."""
    group_cols = list(group_cols)
    facts = revision_facts(revisions, changes, group_cols) if facts is None else facts
    moved = facts.filter((F.col("files_added") > 0) | (F.col("files_deleted") > 0))
    daily = _daily(moved, group_cols, tz, F.sum(F.col("files_added") - F.col("files_deleted")).alias("_d"))
    return _trend(daily, "_d", log_end(revisions, group_cols), group_cols, group_cols, "files")


def avg_loc_trend(
    revisions: DataFrame,
    changes: DataFrame,
    facts: DataFrame | None = None,
    tz: str = "UTC",
    group_cols: Sequence[str] = (),
) -> DataFrame:
    """Lines per live file, 0 while there are no files; no filling of gaps."""
    group_cols = list(group_cols)
    facts = revision_facts(revisions, changes, group_cols) if facts is None else facts
    daily = _daily(
        facts,
        group_cols,
        tz,
        F.sum(F.col("lines_added") - F.col("lines_deleted")).alias("_l"),
        F.sum(F.col("files_added") - F.col("files_deleted")).alias("_f"),
    )
    w = running(group_cols)
    loc, files = F.sum("_l").over(w), F.sum("_f").over(w)
    run = daily.select(
        *group_cols, "day", F.when(files > 0, loc / files).otherwise(F.lit(0.0)).alias("avg_loc")
    )
    ended = gap_fill(
        run, ["avg_loc"], log_end(revisions, group_cols), group_cols, group_cols, fill_gaps=False
    )
    return strip_leading_zeros(ended, "avg_loc", group_cols)


def churn_by_day(
    revisions: DataFrame,
    changes: DataFrame,
    facts: DataFrame | None = None,
    tz: str = "UTC",
    group_cols: Sequence[str] = (),
) -> DataFrame:
    """Lines added plus deleted per day."""
    group_cols = list(group_cols)
    facts = revision_facts(revisions, changes, group_cols) if facts is None else facts
    daily = _daily(
        facts, group_cols, tz, F.sum(F.col("lines_added") + F.col("lines_deleted")).alias("churn")
    )
    return strip_leading_zeros(daily, "churn", group_cols)


def dir_loc_trend(
    revisions: DataFrame,
    changes: DataFrame,
    directories: DataFrame | Sequence[str] | None = None,
    scope: str = "/",
    depth: int = 2,
    tz: str = "UTC",
    group_cols: Sequence[str] = (),
) -> DataFrame:
    """Size of each directory per day, never below zero.

    ``directories`` is a short list of path prefixes (or a one-column table of
    them, such as the directory chart's); None follows every directory of the
    given depth.
    """
    group_cols = list(group_cols)
    keys = [*group_cols, "directory"]
    net = F.col("linesadded") - F.col("linesdeleted")
    if directories is None:
        rows = changes.withColumn("directory", dir_prefix("changedpath", scope, depth))
    else:
        if isinstance(directories, DataFrame):
            listed = per_group(directories, group_cols, F.collect_set("directory").alias("_dirs"))
            rows = attach(changes, listed, group_cols)
        else:
            rows = changes.withColumn("_dirs", F.array(*[F.lit(d) for d in directories]))
        hits = F.filter("_dirs", lambda d: F.col("changedpath").startswith(d))
        rows = rows.withColumn("directory", F.explode(hits))
    per_rev = rows.groupBy(*keys, "revno").agg(F.sum(net).alias("_d"))
    dated = per_rev.join(revisions.select(*group_cols, "revno", "commitdate"), [*group_cols, "revno"])
    daily = _daily(dated, keys, tz, F.sum("_d").alias("_d"))
    # A sum clamped at 0 after every step equals the plain sum minus its lowest point so far.
    total = daily.select(*keys, "day", F.sum("_d").over(running(keys)).alias("_s"))
    clamped = total.select(
        *keys,
        "day",
        (F.col("_s") - F.least(F.lit(0), F.min("_s").over(running(keys)))).alias("loc"),
    )
    filled = gap_fill(clamped, ["loc"], log_end(revisions, group_cols), keys, group_cols)
    return strip_leading_zeros(filled, "loc", keys)


def waste_effort(
    revisions: DataFrame,
    changes: DataFrame,
    facts: DataFrame | None = None,
    tz: str = "UTC",
    group_cols: Sequence[str] = (),
) -> DataFrame:
    """Running lines added and deleted, and their ratio."""
    group_cols = list(group_cols)
    facts = revision_facts(revisions, changes, group_cols) if facts is None else facts
    daily = _daily(
        facts,
        group_cols,
        tz,
        F.sum("lines_added").alias("_a"),
        F.sum("lines_deleted").alias("_d"),
    )
    w = running(group_cols)
    run = daily.select(
        *group_cols,
        "day",
        F.sum("_a").over(w).alias("lines_added"),
        F.sum("_d").over(w).alias("lines_deleted"),
    )
    ratio = F.when(
        F.col("lines_added") > 0, F.col("lines_deleted") / F.col("lines_added")
    ).otherwise(F.lit(0.0))
    return run.withColumn("waste_ratio", ratio)


def bugfix_trend(
    revisions: DataFrame,
    changes: DataFrame,
    facts: DataFrame | None = None,
    tz: str = "UTC",
    group_cols: Sequence[str] = (),
    keywords: Sequence[str] = BUGFIX_KEYWORDS,
) -> DataFrame:
    """File changes in bug-fix revisions, per day and in total."""
    group_cols = list(group_cols)
    facts = revision_facts(revisions, changes, group_cols) if facts is None else facts
    daily = _daily(bugfix_filter(facts, keywords), group_cols, tz, F.sum("n_changes").alias("file_changes"))
    return daily.withColumn("total", F.sum("file_changes").over(running(group_cols)))
