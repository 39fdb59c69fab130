from __future__ import annotations

from datetime import date

import pytest
from conftest import rows
from pyspark.sql import functions as F

from revtide.functions import calendar, paths
from revtide.operators import aggregates as A
from revtide.operators import scope as C


def test_prefix_is_literal(make_changes):
    ch = make_changes([(1, "/a_b/x", "A"), (2, "/axb/x", "A"), (3, "/trunkX/y", "A"), (4, "/trunk/y", "A")])
    assert rows(C.path_scope(ch, "/a_b"), "revno") == [(1,)]
    assert rows(C.path_scope(ch, "/trunk%"), "revno") == [(3,), (4,)]


def test_scope_keeps_touched_revisions(make_revisions, make_changes):
    rev = make_revisions([(i, "2020-01-01 00:00:00", "a") for i in range(1, 6)])
    ch = make_changes([(1, "/t/x", "A"), (2, "/u/x", "A"), (3, "/t/y", "A"), (3, "/t/z", "A"), (4, "/t/x", "M")])
    scoped, under = C.scope(rev, ch, "/t/", first=2, last=4)
    assert rows(scoped, "revno") == [(3,), (4,)]
    assert under.count() == 4  # the path scope ignores the range
    with pytest.raises(ValueError):
        C.rev_range(rev, 5, 2)


@pytest.mark.parametrize(
    "end,n,want", [("2010-03-31", 1, "2010-03-03"), ("2010-03-15", 1, "2010-02-15"), ("2012-03-30", 1, "2012-03-01"), ("2010-01-05", 3, "2009-10-05")]
)
def test_months_before_overflows(spark, end, n, want):
    df = spark.range(1).select(calendar.months_before(F.lit(end).cast("date"), n).alias("d"))
    assert df.first()[0] == date.fromisoformat(want)


def test_authors_merge_by_case(make_revisions):
    rev = make_revisions([(3, "2020-01-03", "BOB"), (1, "2020-01-01", "Bob"), (2, "2020-01-02", "bob"), (4, "2020-01-04", "")])
    assert rows(A.author_ranking(rev), "author", "commits") == [("Bob", 3), ("unknown", 1)]


def test_groups_stay_apart(make_revisions):
    rev = make_revisions([(1, "2020-01-01", "a"), (2, "2020-01-02", "a"), (3, "2020-01-03", "b")])
    two = rev.withColumn("repo_id", F.lit("x")).unionByName(rev.limit(1).withColumn("repo_id", F.lit("y")))
    got = rows(A.author_ranking(two, 1, ["repo_id"]), "repo_id", "author")
    assert got[0][0] == "x" and got[0][1] == "a" and len(got) == 2
    week = A.activity_by_weekday(two, group_cols=["repo_id"])
    assert week.count() == 14
    assert week.groupBy("repo_id").agg(F.sum("commits")).count() == 2


def test_path_functions(spark):
    given = ["/a//b.txt", "/a/.bashrc", "/a/b.tar.gz", "/a.b/c", "/a/f.", "/a/..b"]
    df = spark.createDataFrame([(p,) for p in given], "p string")
    assert [r[0] for r in df.select(paths.file_type("p")).collect()] == [".txt", "", ".gz", "", ".", ""]
    assert df.select(paths.normalize_path("p")).first()[0] == "/a/b.txt"
    d = spark.createDataFrame([("/t/x/y/z.c",), ("/t/top.c",), ("/t/x/",)], "p string")
    assert [r[0] for r in d.select(paths.dir_prefix("p", "/t/", 2)).collect()] == ["/t/x/y", "/t/", "/t/x"]
    assert [r[0] for r in d.select(paths.dir_prefix("p", "/", 1)).collect()] == ["/t", "/t", "/t"]
    assert [r[0] for r in d.select(paths.parent_dir("p")).collect()] == ["/t/x/y", "/t", "/t/x"]
    assert d.select(paths.ancestors("p")).first()[0] == ["/", "/t/", "/t/x/", "/t/x/y/"]
    assert d.filter("p = '/t/x/'").select(paths.ancestors("p"), paths.ancestors("p", True)).first() == (
        ["/", "/t/"], ["/", "/t/", "/t/x/"],
    )
    b = spark.createDataFrame(
        [("/a.doc", None), ("/a.DOC", None), ("/a.Doc", None), ("/a.c", "text/plain"), ("/a.c", "image/png"), ("/a.c", "image/x-xbitmap"), ("/doc", None)],
        "p string, m string",
    )
    assert [r[0] for r in b.select(F.coalesce(paths.is_binary("p", "m"), F.lit(False))).collect()] == [
        True, True, False, False, True, False, False,
    ]


def test_author_activity_options(make_revisions, make_changes):
    from revtide.operators.logprep import with_file_counts

    ch = make_changes([(1, "/a", "A"), (1, "/b", "A"), (1, "/c", "A"), (2, "/a", "D")])
    rev = with_file_counts(make_revisions([(1, "2020-01-01", "x"), (2, "2020-01-02", "x"), (3, "2020-01-02", "y")]), ch)
    # counters weigh once per path: 9 added against 1 deleted
    assert rows(A.author_activity(rev, ch), "author", "added_pct", "deleted_pct") == [("x", 90.0, 10.0)]
    assert rows(A.author_activity(rev, ch, per_revision=True), "author", "added_pct") == [("x", 75.0)]


def test_top_k_with_others_keeps_totals(spark):
    from revtide.operators.base import top_k_with_others

    df = spark.createDataFrame([(f"d{i:02}", i) for i in range(20)], "directory string, files long")
    out = top_k_with_others(df, "directory", "files", 5)
    assert out.count() == 6
    assert out.agg(F.sum("files")).first()[0] == sum(range(20))
    assert top_k_with_others(df.limit(3), "directory", "files", 5).filter("directory = 'others'").count() == 0


def test_author_commit_times(make_revisions):
    rev = make_revisions([(1, "2020-01-01 00:10:00", "a"), (2, "2020-01-01 05:00:00", "a"), (3, "2020-01-01 05:00:00", "a"), (4, "2020-01-02 00:30:00", "a")])
    assert rows(A.author_commit_times(rev), "day", "hour") == [(date(2020, 1, 1), 5), (date(2020, 1, 2), 0)]


def test_basic_stats_without_changes(make_revisions, make_changes):
    rev = make_revisions([(2, "2020-01-01", "a"), (5, "2020-01-02", "b")])
    r = A.basic_stats(rev, make_changes([(1, "/x", "A")]).limit(0)).first()
    assert (r.first_rev, r.last_rev, r.num_revs, r.num_authors, r.num_files) == (2, 5, 2, 2, 0)


def test_copies_and_times(spark, make_changes):
    ch = make_changes([(1, "/t/", "A", 0, 0, "/s/", 0), (2, "/t/", "R", 0, 0, "/s/", 1), (3, "/x", "A"), (4, "/t/", "D")])
    assert rows(ch.filter(C.is_branch_or_tag()), "revno") == [(1,)]
    assert rows(C.copied_dirs(ch), "revno") == [(1,), (2,)]
    assert rows(C.deleted_dirs(ch), "revno") == [(4,)]
    t = spark.range(1).select(calendar.epoch_to_timestamp(F.lit(86400 * 365)).alias("t")).first()
    assert t.t.isoformat() == "1971-01-01T00:00:00"


def test_revision_for_date(make_revisions):
    rev = make_revisions([(1, "2020-01-01 05:00:00", "a"), (2, "2020-01-05 05:00:00", "a"), (3, "2020-01-05 09:00:00", "a"), (4, "2020-02-01 00:00:00", "a")])
    assert A.revision_for_date(rev).first() == (1, 4)
    assert A.revision_for_date(rev, "2020-01-02", "2020-01-05").first() == (2, 3)
    assert A.revision_for_date(rev, "2020-01-02", "2020-01-20").first() == (2, 4)


def test_date_in_range_of_the_whole_log(spark, make_revisions, tmp_path):
    rev = make_revisions([(i, f"2020-0{1 + i // 3}-01 12:00:00", "a") for i in range(6)] + [(6, None, "a")])
    assert rows(C.date_in_range(rev, rev.filter("revno < 3")), "revno") == [(0,), (1,), (2,)]
    # The registered query takes its range from all events, those after number 300 too.
    events = spark.range(600).selectExpr(
        "id AS event_id", "CAST(date_add(DATE'2020-01-01', CAST(id AS int)) AS timestamp_ntz) AS ts", "id AS user_id",
        "'view' AS event_type", "1.0D AS value", "'{}' AS props",
    )
    events.write.parquet(f"{tmp_path}/events.parquet")
    from revtide.catalog import QUERIES

    assert rows(QUERIES["date_in_range"](spark, str(tmp_path))) == [("view", 600)]
