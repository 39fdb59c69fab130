from __future__ import annotations

import json
from datetime import date

import pytest
from conftest import SMALL, rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revtide import schema
from revtide.adapters import event_revisions, order_changes, order_revisions
from revtide.functions.cloud import cloud_style, heat_color
from revtide.operators.aggregates import daily_commit_count
from revtide.plans.report import report
from revtide.sources import readers, sinks
from revtide.streaming import incremental as I

XML = """<log>
<logentry revision="2"><author>amy</author><date>2020-02-01T10:00:00.000000Z</date>
<paths><path action="A" kind="dir" copyfrom-path="/trunk" copyfrom-rev="1">/tags/1</path>
<path action="M" kind="file">/trunk/a.c</path></paths><msg>tag it</msg></logentry>
<logentry revision="3"><paths><path action="M" kind="file">/trunk/a.c</path></paths><msg>no date</msg></logentry>
<logentry revision="4"><date>2020-02-02T10:00:00.000000Z</date>
<paths><path action="D" kind="file">/trunk/a.c</path></paths></logentry>
</log>"""


def test_xml_log(spark, tmp_path):
    (tmp_path / "log.xml").write_text(XML)
    rev = readers.read_revisions(spark, str(tmp_path), "xml")
    assert rows(rev, "revno", "author", "msg") == [(2, "amy", "tag it"), (4, "", "")]
    ch = readers.read_changes(spark, str(tmp_path), "xml")
    assert rows(ch, "revno", "changedpath", "changetype", "copyfrompath", "copyfromrev", "pathtype") == [
        (2, "/tags/1/", "A", "/trunk/", 1, "D"), (2, "/trunk/a.c", "M", None, None, "F"), (4, "/trunk/a.c", "D", None, None, "F"),
    ]


def test_xml_log_in_many_tasks(spark, tmp_path):
    """A file is cut behind its entries; each is read once, whichever task it falls to; grouping columns come along."""
    entry = (
        '<logentry revision="{0}" repo_id="{1}"><author>a{0} &amp; b</author><date>2020-01-01T00:00:00.000000Z</date>\n'
        '<paths><path action="M" kind="file">/t/&lt;{0}&gt;é</path></paths><msg>line 1\nline 2 &lt;/logentry&gt;</msg></logentry>\n'
    )
    text = '<?xml version="1.0" encoding="UTF-8"?>\n<log>\n' + "".join(entry.format(i, i % 3) for i in range(200)) + "</log>\n"
    (tmp_path / "log.xml").write_text(text, encoding="utf-8")
    repo = [T.StructField("repo_id", T.IntegerType())]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        changes = readers.read_changes(spark, str(tmp_path), "xml", group_cols=repo)
        revisions = readers.read_revisions(spark, str(tmp_path), "xml", group_cols=repo)
        assert changes.rdd.getNumPartitions() > 5
        assert rows(changes, "repo_id", "revno", "changedpath") == sorted((i % 3, i, f"/t/<{i}>é") for i in range(200))
        want = sorted((i % 3, i, f"a{i} & b", "line 1\nline 2 </logentry>") for i in range(200))
        assert rows(revisions, "repo_id", "revno", "author", "msg") == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    (tmp_path / "latin").mkdir()
    (tmp_path / "latin" / "log.xml").write_bytes(text.replace("UTF-8", "ISO-8859-1").encode("latin-1"))
    whole = readers.read_changes(spark, str(tmp_path / "latin"), "xml", encoding="ISO-8859-1", group_cols=repo)
    assert rows(whole, "changedpath") == sorted((f"/t/<{i}>é",) for i in range(200))


def test_csv_changes_are_split(spark, tmp_path):
    changes = spark.range(5_000).selectExpr("id AS revno", "concat('/p', id) AS changedpath", "'M' AS changetype").coalesce(1)
    changes.write.option("header", "true").csv(str(tmp_path / "c"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        got = readers.read_changes(spark, str(tmp_path / "c"), "csv")
        assert got.rdd.getNumPartitions() > 5 and got.select("revno").distinct().count() == 5_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@pytest.mark.parametrize("fmt", ["parquet", "json", "csv", "orc"])
def test_flat_formats(spark, tmp_path, make_revisions, make_changes, fmt):
    rev = make_revisions([(1, "2020-01-01 10:00:00", "a", 'says "hi",\nthen'), (2, None, "b", "x"), (3, "2020-01-02 00:00:00", None, None)])
    options = {"header": "true", "escape": '"'} if fmt == "csv" else {}
    rev.write.format(fmt).options(**options).save(str(tmp_path / "r"))
    got = readers.read_revisions(spark, str(tmp_path / "r"), fmt)
    assert rows(got, "revno", "author", "msg") == [(1, "a", 'says "hi",\nthen'), (3, "", "")]
    make_changes([(1, "/a", "A", 3, 0)]).write.format(fmt).options(**options).save(str(tmp_path / "c"))
    assert rows(readers.read_changes(spark, str(tmp_path / "c"), fmt), "changedpath", "linesadded") == [("/a", 3)]


def test_nested_log(spark, tmp_path):
    log = [(1, None, "a", "m", [("/x", "A", None, None, "F", 1, 0, "Y", "R"), ("/y", "A", None, None, "F", 2, 0, "Y", "R")])]
    df = spark.createDataFrame(log, schema.LOG_ENTRIES).withColumn("commitdate", F.timestamp_seconds(F.lit(0)))
    df.write.json(str(tmp_path / "log"))
    got = readers.read_changes(spark, str(tmp_path / "log"), "json", nested=True)
    assert rows(got, "revno", "changedpath", "linesadded") == [(1, "/x", 1), (1, "/y", 2)]


def test_append_new(make_revisions):
    old = make_revisions([(1, "2020-01-01", "a"), (4, "2020-01-01", "a")])
    new = make_revisions([(i, "2020-01-01", "a") for i in range(3, 8)])
    assert rows(readers.append_new(old, new), "revno") == [(5,), (6,), (7,)]
    assert readers.append_new(old.limit(0), new).count() == 5


def test_file_line_counts(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "a.txt").write_text("1\n2\n3")
    (tmp_path / "d" / "b.png").write_text("1\n2\n")
    (tmp_path / "d" / "empty.c").write_text("")
    (tmp_path / "d" / "with space+é%.c").write_text("1\n")
    got = {r.file.rsplit("/", 1)[-1]: r.lines for r in readers.file_line_counts(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": 3, "b.png": 0, "empty.c": 0, "with space+é%.c": 1}


def test_csv_sections(spark, tmp_path):
    rev, ch = order_revisions(spark, SMALL), order_changes(spark, SMALL)
    sections = sinks.stats_sections(rev, ch, repo_name="orders")
    sinks.write_stats_csv(sections, str(tmp_path))
    basic = dict(rows(spark.read.csv(str(tmp_path / "basic"), header=True)))
    assert basic["Repository Name"] == "orders" and int(basic["Number of Revisions"]) == rev.count()
    assert spark.read.csv(str(tmp_path / "files"), header=True).count() == 10
    assert spark.read.csv(str(tmp_path / "weekday"), header=True).count() == 7


def test_query_and_series_export(spark, tmp_path):
    rev = order_revisions(spark, SMALL)
    sinks.query_to_csv(spark, "SELECT author, count(*) AS n FROM revisions GROUP BY 1", str(tmp_path / "q"), {"revisions": rev})
    assert spark.read.csv(str(tmp_path / "q"), header=True).count() == rev.select("author").distinct().count()
    sinks.write_series_json(daily_commit_count(rev), str(tmp_path / "s"))
    line = next(p for p in (tmp_path / "s").glob("part-*")).read_text().splitlines()[0]
    assert set(json.loads(line)) == {"day", "commits"}


@pytest.mark.parametrize("fmt", ["parquet", "xml", "csv"])
def test_graph_export(spark, tmp_path, make_revisions, fmt):
    rev = make_revisions([(1, "2020-01-01", "b"), (2, "2020-01-01", "a"), (3, "2020-01-01", "")])
    edges = spark.createDataFrame([("a", "b", 2.0), ("Unknown", "a", 3.0)], "src string, dst string, weight double")
    nodes = sinks.author_nodes(rev)
    assert rows(nodes, "id", "label") == [(0, "b"), (1, "a"), (2, "Unknown")]
    sinks.graph_export(nodes, edges, str(tmp_path), fmt)
    opts = {"xml": {"rowTag": "edge"}, "csv": {"header": "true", "inferSchema": "true"}}.get(fmt, {})
    back = spark.read.format(fmt).options(**opts).load(str(tmp_path / "edges"))
    assert rows(back.select(F.col("source").cast("int"), F.col("target").cast("int"))) == [(1, 0), (2, 1)]


def test_stream_equals_batch(spark, tmp_path):
    rev = event_revisions(spark, SMALL).selectExpr("*", "0 as added_files", "0 as changed_files", "0 as deleted_files")
    src = str(tmp_path / "in")
    rev.filter("revno < 600").write.parquet(src)
    rev.filter("revno >= 500").write.mode("append").parquet(src)  # 100 revisions arrive twice
    stream = I.stream_new(I.revision_stream(spark, src))
    I.write_available(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == rev.count()
    rev.limit(5).write.mode("append").parquet(src)  # old ones again: nothing new
    I.write_available(I.stream_new(I.revision_stream(spark, src)), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == rev.count()

    daily = I.daily_counts(I.revision_stream(spark, src).dropDuplicates(["revno"]))
    q = daily.writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("daily"), "day", "commits") == rows(daily_commit_count(rev), "day", "commits")


def test_scores_and_counts_on_a_stream(spark, tmp_path):
    """Files that come in pieces, and one twice: states are merged, rows counted once; a batch again replaces its own rows."""
    from revtide.operators.temperature import author_scores

    rev = event_revisions(spark, SMALL).selectExpr("*", "0 as added_files", "0 as changed_files", "0 as deleted_files")
    src, out = str(tmp_path / "in"), str(tmp_path / "out")

    def load():
        log = I.stream_new(I.revision_stream(spark, src))
        I.write_updates(I.author_windows(log, "5 days"), f"{out}/scores", f"{out}/cp1").awaitTermination()
        log = I.stream_new(I.revision_stream(spark, src))
        I.write_updates(I.daily_counts(log), f"{out}/days", f"{out}/cp2").awaitTermination()

    for lo, hi in ((0, 400), (300, 700), (700, 5_000)):
        rev.filter((F.col("revno") >= lo) & (F.col("revno") < hi)).write.mode("append").parquet(src)
        load()
    days = I.read_updates(spark, f"{out}/days", ["day"])
    assert rows(days, "day", "commits") == rows(daily_commit_count(rev), "day", "commits")
    scores = I.scores_of_windows(I.read_updates(spark, f"{out}/scores", ["author", "start"]))
    want = {r.author: (r.temperature, r.commits) for r in author_scores(rev).collect()}
    assert {r.author: (pytest.approx(r.temperature), r.commits) for r in scores.collect()} == want


def test_state_is_bounded(spark, tmp_path):
    """What lies behind the newest row by more than the delay is forgotten, and late rows don't come in."""
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    day = "timestamp '2020-01-01 00:00:00' + make_dt_interval(CAST({} AS INT))"
    for lo, hi in ((0, 50), (50, 200), (0, 10), (200, 210)):
        spark.range(lo, hi).selectExpr("id AS revno", f"{day.format('id')} AS commitdate", "'a' AS author", "'' AS msg", "0 AS added_files", "0 AS changed_files", "0 AS deleted_files").write.mode("append").parquet(src)
        q = I.write_available(I.stream_new(I.revision_stream(spark, src), "20 days"), out, str(tmp_path / "cp"))
        q.awaitTermination()
    assert rows(spark.read.parquet(out), "revno") == [(i,) for i in range(210)]
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] < 60


def test_report_is_complete(spark):
    rev, ch = order_revisions(spark, SMALL), order_changes(spark, SMALL)
    from revtide.operators.logprep import with_file_counts

    made = report(with_file_counts(rev, ch), ch, prefix="/ECONOMY/", last=1200)
    assert len(made) >= 28
    light = ["basic_stats", "loc", "weekday", "hour_recent", "dir_size_trend", "gap_band", "author_activity", "waste_effort"]
    for name in light:
        assert made[name].columns
        made[name].count()
    week = made["weekday"].agg(F.sum("commits")).first()[0]
    assert week == made["basic_stats"].first().num_revs
    assert made["daily_commits"].agg(F.sum("commits")).first()[0] == rev.count()  # whole log
    made["revision_facts"].unpersist()


def test_cloud(spark):
    heats = spark.createDataFrame([(0.0,), (0.5,), (1.0,)], "h double").select(heat_color(F.col("h")).alias("c"))
    assert [r.c for r in heats.collect()] == ["#000080", "#7BFF7B", "#800000"]
    df = spark.createDataFrame([("a", 1, 1.0), ("b", 10, 2.0), ("c", 100, 12.0)], "w string, n long, s double")
    got = {r.w: r for r in cloud_style(df, "n", "s").collect()}
    assert got["c"].font_size == 30 and got["a"].font_size == 11 and got["b"].font_size > 11
    assert got["c"].score_norm == pytest.approx(1.0) and got["b"].score_norm == 0.0
    same = spark.createDataFrame([("a", 5), ("b", 5)], "w string, n long")
    assert {r.font_size for r in cloud_style(same, "n").collect()} == {10}


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["day", "loc"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_timeline(make_revisions, make_changes):
    from revtide.operators.timeline import centrality_over_time

    rev = make_revisions([(1, "2020-01-01", "a"), (2, "2020-01-02", "b"), (3, "2020-01-03", "a")])
    ch = make_changes([(1, "/x", "A"), (2, "/x", "M"), (2, "/y", "A"), (3, "/x", "M")])
    got = rows(centrality_over_time(rev, ch), "author", "day", "degree", "centrality", "closeness")
    assert got == [
        ("a", date(2020, 1, 1), 1, 1.0, 1.0),
        ("a", date(2020, 1, 2), 1, pytest.approx(1 / 3), pytest.approx(3 / 6)),
        ("a", date(2020, 1, 3), 1, pytest.approx(1 / 3), pytest.approx(3 / 6)),
        ("b", date(2020, 1, 2), 2, pytest.approx(2 / 3), pytest.approx(3 / 4)),
        ("b", date(2020, 1, 3), 2, pytest.approx(2 / 3), pytest.approx(3 / 4)),
    ]
