"""The whole dashboard as named tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from revtide.functions.cloud import cloud_style
from revtide.operators import aggregates as A
from revtide.operators import gaps as G
from revtide.operators import series as S
from revtide.operators import temperature as H
from revtide.operators import text as X
from revtide.operators.scope import scope


def report(
    revisions: DataFrame,
    changes: DataFrame,
    prefix: str = "/",
    first: int | None = None,
    last: int | None = None,
    depth: int = 2,
    max_dirs: int = 10,
    recent_months: int = 3,
    authors: int = 10,
    types: int = 20,
    tz: str = "UTC",
    only: Sequence[str] | None = None,
) -> dict[str, DataFrame]:
    """Every dataset of the dashboard, each under the scope it is meant to have.

    The per-revision totals most charts need are computed once and kept; call
    ``unpersist`` on ``report(...)["revision_facts"]`` when done.
    """
    scoped, under = scope(revisions, changes, prefix, first, last)
    facts = S.revision_facts(revisions, under).persist()
    dirs = A.dir_loc(under, prefix, depth, max_dirs)
    made = {
        "revision_facts": lambda: facts,
        "basic_stats": lambda: A.basic_stats(scoped, under),
        "tag_cloud": lambda: cloud_style(X.tag_cloud(facts), "freq"),
        "author_cloud": lambda: cloud_style(
            H.author_cloud(scoped, log=revisions), "commits", "activity"
        ),
        "active_files": lambda: H.hot_files(revisions, under, 10, prefix),
        "active_authors": lambda: H.active_authors(scoped, 10, log=revisions),
        "loc": lambda: S.loc_trend(revisions, under, facts, tz),
        "loc_by_author": lambda: S.author_loc_trend(
            revisions, under, A.author_ranking(scoped, authors), facts=facts, tz=tz
        ),
        "avg_loc": lambda: S.avg_loc_trend(revisions, under, facts, tz),
        "file_count": lambda: S.file_count_trend(revisions, under, facts, tz),
        "file_types": lambda: A.file_types(under, types),
        "weekday": lambda: A.activity_by_weekday(scoped, tz=tz),
        "weekday_recent": lambda: A.activity_by_weekday(scoped, recent_months, revisions, tz),
        "hour": lambda: A.activity_by_hour(scoped, tz=tz),
        "hour_recent": lambda: A.activity_by_hour(scoped, recent_months, revisions, tz),
        "weekday_hour": lambda: A.weekday_hour_pivot(scoped, tz),
        "activity_index": lambda: H.revision_activity_index(revisions, changes),
        "churn": lambda: S.churn_by_day(revisions, under, facts, tz),
        "dir_size": lambda: dirs,
        "dir_file_count": lambda: A.dir_file_count(under, prefix, depth, max_dirs),
        "dir_size_trend": lambda: S.dir_loc_trend(revisions, changes, dirs, tz=tz),
        "commit_gaps": lambda: G.commit_gap_histogram(revisions, scoped),
        "author_activity": lambda: A.author_activity(revisions, under, authors),
        "author_commit_times": lambda: A.author_commit_times(scoped, tz=tz),
        "daily_commits": lambda: A.daily_commit_count(revisions, tz),
        "waste_effort": lambda: S.waste_effort(revisions, under, facts, tz),
        "bugfix": lambda: S.bugfix_trend(revisions, under, facts, tz),
        "gap_band": lambda: G.commit_gap_band(revisions, scoped),
        "gap_band_recent": lambda: G.commit_gap_band(revisions, scoped, recent_months),
        "revision_gaps": lambda: G.revision_gaps(facts.select("revno", "author", "commitdate"), authors, ranked=scoped),
    }
    return {name: build() for name, build in made.items() if only is None or name in only}
