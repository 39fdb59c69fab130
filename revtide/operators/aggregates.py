"""Calendar, ranking and roll-up aggregates.

Anything that needs both tables folds ``changes`` to one row per revision first
(a partial aggregate on the map side), so the join moves one row per revision
however many paths a single revision touches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revtide.functions import calendar, paths
from revtide.operators.base import attach, per_group, top_k_with_others, top_n
from revtide.operators.scope import recent_months
from revtide.schema import NO_EXTENSION, OTHERS, UNKNOWN_AUTHOR


def _named(author: Column) -> Column:
    return F.when(author == "", F.lit(UNKNOWN_AUTHOR)).otherwise(author)


def author_ranking(
    revisions: DataFrame, n: int | None = None, group_cols: Sequence[str] = ()
) -> DataFrame:
    """Commits per author, spelling ignored; shows the earliest spelling."""
    # Exact spellings first: counts and numbers aggregate in hash tables, and the
    # choice of a spelling then runs over one row per spelling.
    exact = revisions.groupBy(*group_cols, "author").agg(
        F.count(F.lit(1)).alias("_n"), F.min("revno").alias("_first")
    )
    counts = (
        exact.groupBy(*group_cols, F.lower("author").alias("_key"))
        .agg(F.sum("_n").alias("commits"), F.min_by("author", "_first").alias("author"))
        .select(*group_cols, _named(F.col("author")).alias("author"), "commits")
    )
    order = [F.col("commits").desc(), F.col("author")]
    return counts if n is None else top_n(counts, n, order, group_cols)


def activity_by_weekday(
    revisions: DataFrame,
    months: int | None = None,
    log: DataFrame | None = None,
    tz: str = "UTC",
    group_cols: Sequence[str] = (),
) -> DataFrame:
    """Commits per weekday, Sunday first, all seven present."""
    if months is not None:
        revisions = recent_months(revisions, months, log, group_cols)
    wd = calendar.weekday_index("commitdate", tz)
    counts = per_group(
        revisions, group_cols, F.array(*[F.count_if(wd == i) for i in range(7)]).alias("_c")
    )
    rows = counts.select(*group_cols, F.posexplode("_c").alias("weekday", "commits"))
    return rows.withColumn("name", calendar.weekday_name(F.col("weekday")))


def activity_by_hour(
    revisions: DataFrame,
    months: int | None = None,
    log: DataFrame | None = None,
    tz: str = "UTC",
    group_cols: Sequence[str] = (),
) -> DataFrame:
    """Commits per hour of day, all 24 present."""
    if months is not None:
        revisions = recent_months(revisions, months, log, group_cols)
    hr = F.hour(calendar.local_ts("commitdate", tz))
    counts = per_group(
        revisions, group_cols, F.array(*[F.count_if(hr == i) for i in range(24)]).alias("_c")
    )
    return counts.select(*group_cols, F.posexplode("_c").alias("hour", "commits"))


def weekday_hour_pivot(
    revisions: DataFrame, tz: str = "UTC", group_cols: Sequence[str] = ()
) -> DataFrame:
    """Weekday rows by hour columns ``h0..h23``, zeros included."""
    hr = F.hour(calendar.local_ts("commitdate", tz))
    by_day = revisions.groupBy(
        *group_cols, calendar.weekday_index("commitdate", tz).alias("weekday")
    ).agg(F.array(*[F.count_if(hr == i) for i in range(24)]).alias("_h"))
    week = per_group(
        by_day,
        group_cols,
        F.map_from_entries(F.collect_list(F.struct("weekday", "_h"))).alias("_m"),  # at most 7
    )
    rows = week.select(*group_cols, "_m", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("weekday"))
    cell = F.try_element_at(F.col("_m"), F.col("weekday"))
    return rows.select(
        *group_cols,
        "weekday",
        calendar.weekday_name(F.col("weekday")).alias("name"),
        *[F.coalesce(cell[i], F.lit(0)).cast("long").alias(f"h{i}") for i in range(24)],
    )


def file_types(changes: DataFrame, n: int = 20, group_cols: Sequence[str] = ()) -> DataFrame:
    """Files added minus deleted per extension, the n largest."""
    ext = paths.file_type("changedpath")
    counts = (
        changes.filter((F.col("pathtype") == "F") & F.col("changetype").isin("A", "D"))
        .groupBy(*group_cols, F.when(ext == "", F.lit(NO_EXTENSION)).otherwise(ext).alias("file_type"))
        .agg(F.sum(F.when(F.col("changetype") == "A", 1).otherwise(-1)).alias("files"))
    )
    return top_n(counts, n, [F.col("files").desc(), F.col("file_type")], group_cols)


def author_activity(
    revisions: DataFrame,
    changes: DataFrame,
    n: int = 10,
    per_revision: bool = False,
    group_cols: Sequence[str] = (),
) -> DataFrame:
    """Shares of added, changed and deleted files per author, n busiest authors.

    By default a revision's counters weigh once per changed path, as the original
    statistic does; ``per_revision=True`` counts each revision once.
    """
    on = [*group_cols, "revno"]
    touched = changes.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows"))
    weight = F.lit(1) if per_revision else F.col("_rows")
    sums = (
        revisions.join(touched, on)
        .groupBy(*group_cols, "author")
        .agg(
            F.sum(F.col("added_files") * weight).alias("_a"),
            F.sum(F.col("changed_files") * weight).alias("_c"),
            F.sum(F.col("deleted_files") * weight).alias("_d"),
            F.count(F.lit(1)).alias("_n"),
            F.min("revno").alias("_first"),
        )
        .groupBy(*group_cols, F.lower("author").alias("_key"))
        .agg(
            F.sum("_a").alias("_a"),
            F.sum("_c").alias("_c"),
            F.sum("_d").alias("_d"),
            F.sum("_n").alias("commits"),
            F.min_by("author", "_first").alias("author"),
        )
    )
    total = F.col("_a") + F.col("_c") + F.col("_d")

    def share(c: str) -> Column:
        return F.when(total > 0, F.lit(100.0) * F.col(c) / total).otherwise(F.lit(0.0))

    shares = sums.select(
        *group_cols,
        "author",
        share("_a").alias("added_pct"),
        share("_c").alias("changed_pct"),
        share("_d").alias("deleted_pct"),
        "commits",
    )
    return top_n(shares, n, [F.col("commits").desc(), F.col("author")], group_cols)


def dir_file_count(
    changes: DataFrame,
    scope: str = "/",
    depth: int = 2,
    max_dirs: int = 10,
    group_cols: Sequence[str] = (),
) -> DataFrame:
    """Live files per directory, the largest plus ``others``."""
    counts = (
        changes.filter((F.col("pathtype") == "F") & F.col("changetype").isin("A", "D"))
        .groupBy(*group_cols, paths.dir_prefix("changedpath", scope, depth).alias("directory"))
        .agg(F.sum(F.when(F.col("changetype") == "A", 1).otherwise(-1)).alias("files"))
    )
    if max_dirs <= 0:
        return counts
    return top_k_with_others(counts, "directory", "files", max_dirs, group_cols, OTHERS)


def dir_loc(
    changes: DataFrame,
    scope: str = "/",
    depth: int = 2,
    max_dirs: int = 10,
    min_pct: float = 5.0,
    group_cols: Sequence[str] = (),
) -> DataFrame:
    """Net lines per directory; small ones and the overflow go to ``others``."""
    group_cols = list(group_cols)
    sizes = changes.groupBy(
        *group_cols, paths.dir_prefix("changedpath", scope, depth).alias("directory")
    ).agg(F.sum(F.col("linesadded") - F.col("linesdeleted")).alias("loc"))
    positive = sizes.filter(F.col("loc") > 0)
    if max_dirs <= 0:
        return positive
    totals = per_group(
        sizes, group_cols, F.sum("loc").alias("_total"), F.count_if(F.col("loc") > 0).alias("_n")
    )
    keep = (F.col("_n") <= max_dirs) | (F.col("loc") > F.lit(min_pct / 100.0) * F.col("_total"))
    kept = top_n(
        attach(positive, totals, group_cols).filter(keep).select(*group_cols, "directory", "loc"),
        max_dirs,
        [F.col("loc").desc(), F.col("directory")],
        group_cols,
    )
    kept_sum = per_group(kept, group_cols, F.sum("loc").alias("_kept"))
    rest = (
        attach(totals, kept_sum, group_cols)
        .filter(F.col("_n") > max_dirs)
        .select(
            *group_cols,
            F.lit(OTHERS).alias("directory"),
            (F.col("_total") - F.coalesce("_kept", F.lit(0))).alias("loc"),
        )
    )
    return kept.unionByName(rest)


def dir_names(
    changes: DataFrame, scope: str = "/", depth: int = 2, group_cols: Sequence[str] = ()
) -> DataFrame:
    return changes.select(
        *group_cols, paths.dir_prefix("changedpath", scope, depth).alias("directory")
    ).distinct()


def daily_commit_count(
    revisions: DataFrame, tz: str = "UTC", group_cols: Sequence[str] = ()
) -> DataFrame:
    return revisions.groupBy(*group_cols, calendar.local_day("commitdate", tz).alias("day")).agg(
        F.count(F.lit(1)).alias("commits")
    )


def author_commit_times(
    revisions: DataFrame,
    authors: Sequence[str] | None = None,
    tz: str = "UTC",
    group_cols: Sequence[str] = (),
) -> DataFrame:
    """Day and hour of every distinct commit time per author.

    A series starts at the author's first commit outside hour 0.
    """
    keys = [*group_cols, "author"]
    rows = revisions.select(*keys, "commitdate")
    if authors is not None:
        rows = rows.filter(F.col("author").isin(*authors))
    hr = F.hour(calendar.local_ts("commitdate", tz))
    starts = rows.groupBy(*keys).agg(F.min(F.when(hr != 0, F.col("commitdate"))).alias("_from"))
    return (
        rows.dropDuplicates([*keys, "commitdate"])
        .join(starts, keys)
        .filter(F.col("commitdate") >= F.col("_from"))
        .select(*keys, "commitdate", calendar.local_day("commitdate", tz).alias("day"), hr.alias("hour"))
    )


def basic_stats(
    revisions: DataFrame, changes: DataFrame, group_cols: Sequence[str] = ()
) -> DataFrame:
    """One row: revision bounds and dates, revisions, files, authors, lines.

    Takes scoped revisions and path-scoped changes.
    """
    group_cols = list(group_cols)
    per_author = revisions.groupBy(*group_cols, F.lower("author").alias("_key")).agg(
        F.min("revno").alias("_lo"),
        F.max("revno").alias("_hi"),
        F.min_by("commitdate", "revno").alias("_lo_date"),
        F.max_by("commitdate", "revno").alias("_hi_date"),
        F.count(F.lit(1)).alias("_n"),
    )
    log = per_group(
        per_author,
        group_cols,
        F.min("_lo").alias("first_rev"),
        F.max("_hi").alias("last_rev"),
        F.min_by("_lo_date", "_lo").alias("first_rev_date"),
        F.max_by("_hi_date", "_hi").alias("last_rev_date"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("num_revs"),
        F.count(F.lit(1)).alias("num_authors"),
    )
    is_file = F.col("pathtype") == "F"
    tree = per_group(
        changes,
        group_cols,
        (
            F.count_if(is_file & (F.col("changetype") == "A"))
            - F.count_if(is_file & (F.col("changetype") == "D"))
        ).alias("num_files"),
        F.sum(F.col("linesadded") - F.col("linesdeleted")).alias("loc"),
    )
    return attach(log, tree, group_cols)


def path_change_counts(changes: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    return changes.groupBy(*group_cols, "changedpath").agg(F.count(F.lit(1)).alias("n_changes"))


def deleted_paths(changes: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    return changes.filter(F.col("changetype") == "D").select(*group_cols, "changedpath").distinct()


def max_commit_date(revisions: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    return per_group(revisions, group_cols, F.to_date(F.max("commitdate")).alias("max_day"))


def revision_for_date(
    revisions: DataFrame,
    start: str | None = None,
    end: str | None = None,
    group_cols: Sequence[str] = (),
) -> DataFrame:
    """First revision on or after ``start``; last one in ``[end, end + 1 day]``, else the head."""
    day = F.col("commitdate")
    first = (
        F.min("revno")
        if start is None
        else F.min_by("revno", F.struct("commitdate", "revno")).alias("x")
    )
    if start is not None:
        since = day >= F.lit(start).cast("timestamp")
        first = F.min_by(
            F.when(since, F.col("revno")), F.when(since, F.struct("commitdate", "revno"))
        )
    head = F.max("revno")
    last = head
    if end is not None:
        lo = F.lit(end).cast("timestamp")
        inside = (day >= lo) & (day <= lo + F.expr("INTERVAL 1 DAY"))
        in_day = F.max_by(
            F.when(inside, F.col("revno")), F.when(inside, F.struct("commitdate", "revno"))
        )
        last = F.coalesce(in_day, head)
    return per_group(revisions, group_cols, first.alias("first_rev"), last.alias("last_rev"))
