"""Filters and scoping: which revisions and changes a statistic looks at."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revtide.functions.calendar import local_day, months_before
from revtide.operators.base import attach, per_group

# Words that mark a revision as a bug fix.
BUGFIX_KEYWORDS = ("bug", "fix")


def path_scope(changes: DataFrame, prefix: str = "/") -> DataFrame:
    """Changes whose path starts with ``prefix`` (literal; one trailing % dropped)."""
    if prefix.endswith("%"):
        prefix = prefix[:-1]
    return changes.filter(F.col("changedpath").startswith(prefix))


def rev_range(df: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """Revisions ``first..last``, both inclusive; an open end means no limit."""
    if first is not None and last is not None and first > last:
        raise ValueError(f"empty revision range {first}..{last}")
    if first is not None:
        df = df.filter(F.col("revno") >= first)
    if last is not None:
        df = df.filter(F.col("revno") <= last)
    return df


def scope(
    revisions: DataFrame,
    changes: DataFrame,
    prefix: str = "/",
    first: int | None = None,
    last: int | None = None,
    group_cols: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """(revisions in range touching ``prefix``, changes under ``prefix``).

    The second table is scoped by path only, as most statistics want it.
    """
    on = [*group_cols, "revno"]
    scoped_changes = path_scope(changes, prefix)
    touched = rev_range(scoped_changes, first, last).select(*on).distinct()
    return rev_range(revisions, first, last).join(touched, on, "left_semi"), scoped_changes


def log_end(revisions: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Day after the last commit day, as column ``end_day``."""
    return per_group(
        revisions, group_cols, F.date_add(F.to_date(F.max("commitdate")), 1).alias("end_day")
    )


def recent_months(
    revisions: DataFrame,
    n: int,
    log: DataFrame | None = None,
    group_cols: Sequence[str] = (),
) -> DataFrame:
    """Revisions of the last ``n`` months before the end of ``log``."""
    ends = log_end(log if log is not None else revisions, group_cols)
    out = attach(revisions, ends, group_cols)
    keep = F.col("commitdate") >= months_before(F.col("end_day"), n).cast("timestamp")
    return out.filter(keep).drop("end_day")


def bugfix_filter(revisions: DataFrame, keywords: Sequence[str] = BUGFIX_KEYWORDS) -> DataFrame:
    """Revisions whose message contains a keyword (case-sensitive)."""
    return revisions.filter(reduce(Column.__or__, [F.col("msg").contains(k) for k in keywords]))


def date_in_range(
    df: DataFrame, revisions: DataFrame, tz: str = "UTC", group_cols: Sequence[str] = ()
) -> DataFrame:
    """Rows of ``df`` dated from the day before the first commit to the day after the last."""
    bounds = per_group(
        revisions,
        group_cols,
        F.date_sub(F.to_date(F.min("commitdate")), 1).alias("_lo"),
        F.date_add(F.to_date(F.max("commitdate")), 1).alias("_hi"),
    )
    out = attach(df, bounds, group_cols)
    return out.filter(local_day("commitdate", tz).between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def file_changes(changes: DataFrame, *types: str) -> DataFrame:
    """File rows, optionally of the given change types only."""
    out = changes.filter(F.col("pathtype") == "F")
    return out.filter(F.col("changetype").isin(*types)) if types else out


def in_repo_url(changes: DataFrame, root: str, url: str) -> DataFrame:
    """Changes under ``url``, a sub-tree of the repository at ``root``."""
    return changes.filter(F.concat(F.lit(root), F.col("changedpath")).startswith(url))


def copied_dirs(changes: DataFrame) -> DataFrame:
    return changes.filter(
        (F.col("pathtype") == "D")
        & (F.coalesce(F.length("copyfrompath"), F.lit(0)) > 0)
        & F.col("copyfromrev").isNotNull()
    )


def deleted_dirs(changes: DataFrame) -> DataFrame:
    return changes.filter((F.col("pathtype") == "D") & (F.col("changetype") == "D"))


def is_branch_or_tag() -> Column:
    return (F.col("changetype") == "A") & (
        F.col("copyfrompath").isNotNull() | F.col("copyfromrev").isNotNull()
    )


def pending_line_counts(changes: DataFrame) -> DataFrame:
    return changes.filter(F.col("lc_updated") == "N")
