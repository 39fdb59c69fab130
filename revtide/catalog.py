"""Named queries over the given tables: one per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revtide import adapters as D
from revtide.operators import aggregates as A
from revtide.operators import gaps as G
from revtide.operators import scope as C
from revtide.operators import series as S
from revtide.operators import temperature as H

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def plain(df: DataFrame) -> DataFrame:
    """Comparable across engines: days and times as text, 4 decimals, 64-bit integers."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, T.TimestampType):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c, 4)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType, T.DecimalType)):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = lambda spark, sf_dir: plain(fn(spark, sf_dir))
    return fn


def _orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return D.order_revisions(spark, sf_dir), D.order_changes(spark, sf_dir)


def _events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return D.event_revisions(spark, sf_dir), D.event_changes(spark, sf_dir)


# Scope and filters


@query
def path_scope(spark, sf):
    _, ch = _orders(spark, sf)
    return C.path_scope(ch, "/PROMO/%").groupBy("changetype").agg(
        F.count(F.lit(1)).alias("n"), F.sum("linesadded").alias("lines")
    )


@query
def rev_range(spark, sf):
    rev, _ = _orders(spark, sf)
    return C.rev_range(rev, 100, 5000).groupBy("msg").agg(
        F.count(F.lit(1)).alias("n"), F.min("revno").alias("lo"), F.max("revno").alias("hi")
    )


@query
def scope(spark, sf):
    rev, ch = _orders(spark, sf)
    scoped, _ = C.scope(rev, ch, "/LARGE/", first=50)
    return scoped.select("revno", "commitdate", "author")


@query
def recent_months(spark, sf):
    rev, _ = _orders(spark, sf)
    return C.recent_months(rev, 6).select("revno", "commitdate")


@query
def bugfix_filter(spark, sf):
    return C.bugfix_filter(D.document_revisions(spark, sf), ("sh", "ing")).select("revno", "author")


@query
def date_in_range(spark, sf):
    rev, _ = _events(spark, sf)
    return C.date_in_range(rev, rev).groupBy("msg").agg(F.count(F.lit(1)).alias("n"))


@query
def file_changes(spark, sf):
    _, ch = _orders(spark, sf)
    return C.file_changes(ch, "A", "R").groupBy("changedpath").agg(F.count(F.lit(1)).alias("n"))


@query
def in_repo_url(spark, sf):
    _, ch = _orders(spark, sf)
    return (
        C.in_repo_url(ch, "http://host/repo", "http://host/repo/SMALL/Brand1")
        .groupBy("changedpath")
        .agg(F.count(F.lit(1)).alias("n"))
    )


# Aggregates


@query
def author_ranking(spark, sf):
    rev, _ = _orders(spark, sf)
    return A.author_ranking(rev)


@query
def author_ranking_top(spark, sf):
    rev, _ = _events(spark, sf)
    return A.author_ranking(rev, 10)


@query
def author_ranking_by_type(spark, sf):
    rev, _ = _events(spark, sf)
    return A.author_ranking(rev.withColumnRenamed("msg", "repo"), 3, ["repo"])


@query
def activity_by_weekday(spark, sf):
    rev, _ = _events(spark, sf)
    return A.activity_by_weekday(rev)


@query
def activity_by_weekday_recent(spark, sf):
    rev, _ = _orders(spark, sf)
    return A.activity_by_weekday(rev, months=3)


@query
def activity_by_hour(spark, sf):
    rev, _ = _events(spark, sf)
    return A.activity_by_hour(rev)


@query
def activity_by_hour_local(spark, sf):
    rev, _ = _events(spark, sf)
    return A.activity_by_hour(rev, tz="America/New_York")


@query
def weekday_hour_pivot(spark, sf):
    rev, _ = _events(spark, sf)
    return A.weekday_hour_pivot(rev)


@query
def file_types(spark, sf):
    _, ch = _orders(spark, sf)
    return A.file_types(ch, 20)


@query
def author_activity(spark, sf):
    from revtide.operators.logprep import with_file_counts

    rev, ch = _orders(spark, sf)
    return A.author_activity(with_file_counts(rev, ch), ch, 10)


@query
def dir_file_count(spark, sf):
    _, ch = _orders(spark, sf)
    return A.dir_file_count(ch, depth=2, max_dirs=10)


@query
def dir_loc(spark, sf):
    _, ch = _orders(spark, sf)
    return A.dir_loc(ch, depth=1)


@query
def dir_loc_others(spark, sf):
    _, ch = _orders(spark, sf)
    return A.dir_loc(ch, depth=2, max_dirs=10, min_pct=0.5)


@query
def dir_names(spark, sf):
    _, ch = _orders(spark, sf)
    return A.dir_names(ch, depth=2)


@query
def churn_by_day(spark, sf):
    return S.churn_by_day(*_orders(spark, sf))


@query
def daily_commit_count(spark, sf):
    rev, _ = _orders(spark, sf)
    return A.daily_commit_count(rev)


@query
def author_commit_times(spark, sf):
    rev, _ = _events(spark, sf)
    return A.author_commit_times(rev)


@query
def basic_stats(spark, sf):
    rev, ch = _orders(spark, sf)
    return A.basic_stats(rev, ch)


@query
def author_cloud(spark, sf):
    rev, _ = _events(spark, sf)
    return H.author_cloud(rev)


@query
def hot_files(spark, sf):
    return H.hot_files(*_orders(spark, sf), n=10)


@query
def hot_files_events(spark, sf):
    return H.hot_files(*_events(spark, sf), n=25)


@query
def active_authors(spark, sf):
    rev, _ = _events(spark, sf)
    return H.active_authors(rev, 10)


@query
def commit_gap_histogram(spark, sf):
    rev, _ = _events(spark, sf)
    return G.commit_gap_histogram(rev)


@query
def commit_gap_stats(spark, sf):
    rev, _ = _events(spark, sf)
    return G.commit_gap_stats(rev)


@query
def commit_gap_stats_recent(spark, sf):
    rev, _ = _orders(spark, sf)
    return G.commit_gap_stats(rev, months=12)


@query
def commit_gap_band(spark, sf):
    rev, _ = _events(spark, sf)
    return G.commit_gap_band(rev)


@query
def deltastddev(spark, sf):
    rev, _ = _events(spark, sf)
    return G.deltastddev(rev, ["author"])


@query
def path_change_counts(spark, sf):
    _, ch = _orders(spark, sf)
    return A.path_change_counts(ch)


@query
def deleted_paths(spark, sf):
    _, ch = _orders(spark, sf)
    return A.deleted_paths(ch)


@query
def max_commit_date(spark, sf):
    rev, _ = _orders(spark, sf)
    return A.max_commit_date(rev)


@query
def revision_for_date(spark, sf):
    rev, _ = _orders(spark, sf)
    return A.revision_for_date(rev, "1997-03-01", "2000-06-15")


# Series


@query
def loc_trend(spark, sf):
    return S.loc_trend(*_orders(spark, sf))


@query
def author_loc_trend(spark, sf):
    return S.author_loc_trend(*_orders(spark, sf), top=10)


@query
def author_loc_trend_all(spark, sf):
    return S.author_loc_trend(*_orders(spark, sf))


@query
def file_count_trend(spark, sf):
    return S.file_count_trend(*_orders(spark, sf))


@query
def avg_loc_trend(spark, sf):
    return S.avg_loc_trend(*_orders(spark, sf))


@query
def dir_loc_trend(spark, sf):
    rev, ch = _orders(spark, sf)
    # Swap the signs of half the sizes so that the lower bound of 0 matters.
    swapped = ch.withColumn(
        "linesadded", F.when(F.col("changetype") == "M", F.lit(0)).otherwise(F.col("linesadded"))
    ).withColumn(
        "linesdeleted",
        F.when(F.col("changetype") == "M", F.col("linesdeleted") + 40).otherwise(F.col("linesdeleted")),
    )
    return S.dir_loc_trend(rev, swapped, depth=2)


@query
def dir_loc_trend_listed(spark, sf):
    rev, ch = _orders(spark, sf)
    return S.dir_loc_trend(rev, ch, A.dir_loc(ch, depth=2, max_dirs=10, min_pct=0.5))


@query
def waste_effort(spark, sf):
    return S.waste_effort(*_orders(spark, sf))


@query
def bugfix_trend(spark, sf):
    return S.bugfix_trend(*_orders(spark, sf), keywords=("URGENT", "HIGH"))


@query
def author_temperature(spark, sf):
    rev, _ = _events(spark, sf)
    return H.author_temperature(rev)


@query
def file_temperature(spark, sf):
    return H.file_temperature(*_orders(spark, sf))


@query
def revision_temperature(spark, sf):
    return H.revision_temperature(*_orders(spark, sf))


@query
def revision_activity_index(spark, sf):
    return H.revision_activity_index(*_events(spark, sf))


@query
def revision_gaps(spark, sf):
    rev, _ = _events(spark, sf)
    return G.revision_gaps(rev, 10)


@query
def gap_fill(spark, sf):
    rev, _ = _orders(spark, sf)
    daily = rev.groupBy("author", F.to_date("commitdate").alias("day")).agg(F.count(F.lit(1)).alias("commits"))
    return S.gap_fill(daily, ["commits"], C.log_end(rev), ["author"])


@query
def strip_leading_zeros(spark, sf):
    rev, _ = _orders(spark, sf)
    daily = rev.groupBy("author", F.to_date("commitdate").alias("day")).agg(
        F.count_if(F.col("msg") == "1-URGENT").alias("urgent")
    )
    return S.strip_leading_zeros(daily, "urgent", ["author"])


@query
def rank_desc(spark, sf):
    rev, _ = _events(spark, sf)
    return G.rank_desc(rev).select("author", "revno", "rank")


@query
def top_k_with_others(spark, sf):
    from revtide.operators.base import top_k_with_others as top_k

    rev, _ = _orders(spark, sf)
    counts = rev.groupBy("msg", "author").agg(F.count(F.lit(1)).alias("commits"))
    return top_k(counts, "author", "commits", 5, ["msg"])


# Text


@query
def word_frequency(spark, sf):
    from revtide.operators import text as X

    return X.word_frequency(D.document_revisions(spark, sf))


@query
def word_frequency_exact(spark, sf):
    from revtide.operators import text as X

    return X.word_frequency(D.document_revisions(spark, sf), 10, "exact")


@query
def tag_cloud(spark, sf):
    from revtide.operators import text as X

    return X.tag_cloud(D.document_revisions(spark, sf))


@query
def cloud_style(spark, sf):
    from revtide.functions.cloud import cloud_style as style

    rev, _ = _events(spark, sf)
    return style(H.author_cloud(rev), "commits", "activity")


# Log preparation


@query
def normalize_paths(spark, sf):
    from revtide.functions.paths import normalize_path

    return D.page_changes(spark, sf).select("revno", normalize_path("changedpath").alias("path"))


@query
def path_functions(spark, sf):
    from revtide.functions import paths as P

    p = "changedpath"
    return D.part_paths(spark, sf).select(
        p,
        P.file_type(p).alias("file_type"),
        P.dir_prefix(p, "/", 1).alias("dir1"),
        P.dir_prefix(p, "/", 3).alias("dir3"),
        P.parent_dir(p).alias("parent"),
        P.base_name(p).alias("base"),
        P.relative_path(p, "/PROMO").alias("relative"),
        P.is_binary(p, extensions=("js",)).alias("is_binary"),
    )


@query
def sql_functions(spark, sf):
    from revtide.functions.sql import register_sql_functions

    register_sql_functions(spark)
    rev, ch = _orders(spark, sf)
    rev.createOrReplaceTempView("log_revisions")
    ch.createOrReplaceTempView("log_changes")
    return spark.sql(
        """SELECT file_type(changedpath) AS ext, dir_prefix('/', changedpath, 1) AS dir,
                  sum(cool(10D, commitdate, timestamp '2001-09-01', 0.0025D)) AS heat
           FROM log_revisions JOIN log_changes USING (revno) GROUP BY 1, 2"""
    )


@query
def inherit_copyfrom(spark, sf):
    from revtide.operators.logprep import inherit_copyfrom as inherit

    return (
        inherit(D.copied_dir_changes(spark, sf))
        .filter(F.col("pathtype") == "F")
        .groupBy("revno", "changedpath", "changetype", "copyfrompath", "copyfromrev")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query
def copied_and_deleted_dirs(spark, sf):
    ch = D.release_changes(spark, sf)
    copied = C.copied_dirs(ch).select("revno", "changedpath", F.lit("copy").alias("what"))
    deleted = C.deleted_dirs(ch).select("revno", "changedpath", F.lit("delete").alias("what"))
    return copied.unionByName(deleted)


@query
def revision_file_counts(spark, sf):
    from revtide.operators.logprep import revision_file_counts as counts

    _, ch = _orders(spark, sf)
    return counts(ch)


@query
def diff_line_counts(spark, sf):
    from revtide.operators.logprep import diff_line_counts as counts

    keys = ("revno", "of", "changetype", "plus", "minus")
    per_diff = counts(D.line_diffs(spark, sf), keys)
    return per_diff.groupBy("changedpath").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("linesadded").alias("added"),
        F.sum("linesdeleted").alias("deleted"),
    )


@query
def text_line_counts(spark, sf):
    from revtide.operators.logprep import text_line_counts as counts

    return counts(D.table(spark, sf, "documents"), "text").select("doc_id", "lines")


@query
def resolve_line_counts(spark, sf):
    from revtide.operators.logprep import resolve_line_counts as resolve

    _, ch = _orders(spark, sf)
    kept = F.col("changetype").isin("A", "R")
    contents = (
        ch.filter(kept | (F.col("changetype") == "D"))
        .select(
            F.when(kept, F.col("revno")).otherwise(F.col("revno") - 1).alias("revno"),
            "changedpath",
            (F.col("linesadded") + F.when(kept, 1).otherwise(2)).alias("lines"),
        )
        .groupBy("revno", "changedpath")
        .agg(F.max("lines").alias("lines"))
    )
    diffs = (
        ch.filter((F.col("changetype") == "M") | ((F.col("changetype") == "R") & (F.col("linesdeleted") > 4)))
        .groupBy("revno", "changedpath")
        .agg(F.max("linesadded").alias("linesadded"), F.max("linesdeleted").alias("linesdeleted"))
    )
    blank = ch.withColumns({"linesadded": F.lit(0), "linesdeleted": F.lit(0), "lc_updated": F.lit("N")})
    return (
        resolve(blank, contents, diffs)
        .groupBy("changedpath", "changetype", "lc_updated")
        .agg(F.sum("linesadded").alias("added"), F.sum("linesdeleted").alias("deleted"))
    )


def _dictionary(spark, sf):
    """The paths ever added, by id."""
    from revtide.operators.base import dense_ids, hash_bucket

    _, ch = _orders(spark, sf)
    added = ch.filter(F.col("changetype") == "A").select(F.col("changedpath").alias("path")).distinct()
    return dense_ids(added, hash_bucket("path"), ["path"], "path_id", 1)


@query
def encode_paths(spark, sf):
    from revtide.operators.logprep import encode_paths as encode

    _, ch = _orders(spark, sf)
    return encode(_dictionary(spark, sf), ch.select(F.col("changedpath").alias("path")))


def _encoded(spark, sf, dictionary):
    _, ch = _orders(spark, sf)
    ids = dictionary.select(F.col("path_id").alias("changedpathid"), F.col("path").alias("changedpath"))
    return ch.join(ids, "changedpath").select(
        "revno", "changedpathid", (F.col("changedpathid") - 1).alias("copyfrompathid"), "linesadded"
    )


@query
def change_view(spark, sf):
    from revtide.operators.logprep import change_view as view

    words = _dictionary(spark, sf)
    return (
        view(_encoded(spark, sf, words), words)
        .groupBy("changedpath", "copyfrompath")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("linesadded").alias("lines"))
    )


@query
def repair_path_dictionary(spark, sf):
    from revtide.operators.logprep import change_view as view
    from revtide.operators.logprep import repair_path_dictionary as repair

    words = _dictionary(spark, sf)
    # Misspell the dictionary: every path once more with a doubled slash, higher ids.
    doubled = words.select(
        (F.col("path_id") + 1000000000).alias("path_id"), F.concat(F.lit("/"), "path").alias("path")
    )
    changes = _encoded(spark, sf, words)
    odd = F.col("linesadded") > 25
    broken = changes.withColumn(
        "changedpathid", F.when(odd, F.col("changedpathid") + 1000000000).otherwise(F.col("changedpathid"))
    )
    clean, fixed = repair(words.select("path_id", "path").unionByName(doubled), broken)
    return (
        view(fixed, clean)
        .groupBy("changedpathid", "changedpath")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("linesadded").alias("lines"))
    )


@query
def live_files(spark, sf):
    from revtide.operators.dirstate import live_files as live

    _, ch = _orders(spark, sf)
    return live(ch, "/STANDARD/", 9000)


@query
def expand_dir_copies(spark, sf):
    from revtide.operators.dirstate import expand_dir_copies as expand

    return expand(D.release_changes(spark, sf)).drop("lc_updated", "entrytype", "pathtype")


@query
def expand_dir_deletes(spark, sf):
    from revtide.operators.dirstate import expand_dir_deletes as expand

    return expand(D.release_changes(spark, sf)).select("revno", "changedpath", "linesadded", "linesdeleted")


@query
def update_file_counters(spark, sf):
    from revtide.operators import logprep as L

    rev, ch = _orders(spark, sf)
    extra = ch.filter(F.col("linesadded") > 30).withColumn(
        "changetype", F.when(F.col("changetype") == "A", "D").otherwise("A")
    )
    return L.update_file_counters(L.with_file_counts(rev, ch), extra).select(
        "revno", "added_files", "changed_files", "deleted_files"
    )


@query
def overlay_line_counts(spark, sf):
    from revtide.operators import logprep as L

    _, ch = _orders(spark, sf)
    waiting = ch.withColumn(
        "lc_updated", F.when(F.col("changetype") == "R", "N").otherwise("Y")
    )
    updates = (
        C.pending_line_counts(waiting)
        .groupBy("revno", "changedpath")
        .agg(F.max(F.col("linesadded") * 2).alias("linesadded"), F.lit(1).cast("long").alias("linesdeleted"))
    )
    return (
        L.overlay_line_counts(waiting, updates)
        .groupBy("changedpath", "lc_updated")
        .agg(F.sum("linesadded").alias("added"), F.sum("linesdeleted").alias("deleted"))
    )


@query
def append_new(spark, sf):
    from revtide.sources.readers import append_new as fresh

    rev, _ = _events(spark, sf)
    stored = rev.filter(F.col("commitdate") < F.lit("2024-01-16").cast("timestamp"))
    return fresh(stored, rev).select("revno", "author")


def _event_stream(spark, sf):
    """Revisions of the events table as a stream, and a folder for what comes of it."""
    layout = D.table(spark, sf, "events").schema
    raw = spark.readStream.schema(layout).option("pathGlobFilter", "events.parquet").parquet(sf)
    log = raw.select(
        F.col("event_id").alias("revno"),
        D.utc("ts").alias("commitdate"),
        F.col("user_id").cast("string").alias("author"),
    )
    return log, _shared(spark, "stream")


@query
def stream_new(spark, sf):
    from revtide.streaming import incremental as I

    log, base = _event_stream(spark, sf)
    I.write_available(I.stream_new(log), f"{base}/log", f"{base}/state").awaitTermination()
    return A.daily_commit_count(spark.read.parquet(f"{base}/log"))


@query
def stream_daily_counts(spark, sf):
    from revtide.streaming import incremental as I

    log, base = _event_stream(spark, sf)
    I.write_updates(I.daily_counts(I.stream_new(log)), f"{base}/days", f"{base}/state").awaitTermination()
    return I.read_updates(spark, f"{base}/days", ["day"])


@query
def stream_author_scores(spark, sf):
    from revtide.streaming import incremental as I

    log, base = _event_stream(spark, sf)
    I.write_updates(I.author_windows(I.stream_new(log)), f"{base}/scores", f"{base}/state").awaitTermination()
    return I.scores_of_windows(I.read_updates(spark, f"{base}/scores", ["author", "start"]))


@query
def merge_scores(spark, sf):
    rev, _ = _events(spark, sf)
    cut = F.lit("2024-01-16").cast("timestamp")
    old_log = rev.filter(F.col("commitdate") < cut)
    new_log = rev.filter(F.col("commitdate") >= cut)
    elapsed = 24.0 * (
        rev.agg(F.datediff(F.date_add(F.to_date(F.max("commitdate")), 1), F.lit("2024-01-16").cast("date"))).first()[0]
    )
    return H.merge_scores(H.author_scores(old_log), H.author_scores(new_log), ["author"], elapsed)


# Edges and graphs


def _nations(spark, sf):
    return D.nation_revisions(spark, sf), D.order_changes(spark, sf)


@query
def author_file_edges(spark, sf):
    from revtide.operators import edges as E

    return E.author_file_edges(*_orders(spark, sf))


@query
def rev_file_edges(spark, sf):
    from revtide.operators import edges as E

    _, ch = _orders(spark, sf)
    return E.rev_file_edges(ch)


@query
def cochange_edges(spark, sf):
    from revtide.operators import edges as E

    _, ch = _orders(spark, sf)
    return E.cochange_edges(ch)


@query
def cochange_edges_blocks(spark, sf):
    """The same pairs with every revision of more than 3 paths cut into blocks."""
    from revtide.operators import edges as E

    _, ch = _orders(spark, sf)
    return E.cochange_edges(ch, block=3)


@query
def cochange_edges_decayed(spark, sf):
    from revtide.operators import edges as E

    return E.cochange_edges_decayed(*_orders(spark, sf))


@query
def author_network(spark, sf):
    from revtide.plans.networks import author_network as network

    return network(*_orders(spark, sf))


@query
def file_network(spark, sf):
    from revtide.plans.networks import file_network as network

    return network(*_orders(spark, sf))


@query
def drop_node(spark, sf):
    from revtide.operators import edges as E

    return E.filter_edges(E.drop_node(E.author_file_edges(*_nations(spark, sf)), "NATION_3"), 2.0)


@query
def coauthor_edges(spark, sf):
    from revtide.operators import edges as E

    return E.coauthor_edges(*_nations(spark, sf))


@query
def coauthor_matrix(spark, sf):
    from revtide.operators import edges as E

    return E.coauthor_matrix(*_nations(spark, sf), dense=True, direct_rows=28)


@query
def degree_centrality(spark, sf):
    from revtide.operators import edges as E
    from revtide.operators.graph import degree_centrality as degree

    return degree(E.author_file_edges(*_orders(spark, sf)))


def _author_network(spark, sf):
    from revtide.plans.networks import author_network as network

    return network(*_orders(spark, sf))


def _file_network(spark, sf):
    from revtide.plans.networks import file_network as network

    return network(*_orders(spark, sf))


@query
def k_core(spark, sf):
    from revtide.operators import edges as E
    from revtide.operators.graph import k_core as core

    _, ch = _orders(spark, sf)
    return core(E.cochange_edges(ch), 5)


@query
def connected_components(spark, sf):
    from revtide.operators.graph import connected_components as components

    return components(_author_network(spark, sf))


@query
def largest_component(spark, sf):
    from revtide.operators.graph import largest_component as largest

    return largest(_author_network(spark, sf))


@query
def components_min_size(spark, sf):
    from revtide.operators.graph import components_min_size as parts

    return parts(_author_network(spark, sf), 10)


@query
def closeness_centrality(spark, sf):
    from revtide.operators.graph import closeness_centrality as closeness

    return closeness(_author_network(spark, sf))


@query
def closeness_file_network(spark, sf):
    from revtide.operators.graph import closeness_centrality as closeness

    return closeness(_file_network(spark, sf))


@query
def weighted_closeness(spark, sf):
    from revtide.operators.graph import closeness_centrality as closeness

    return closeness(_author_network(spark, sf), "weight")


@query
def graph_stats(spark, sf):
    from revtide.operators.graph import graph_stats as stats

    return stats(_author_network(spark, sf))


@query
def graph_stats_file_network(spark, sf):
    from revtide.operators.graph import graph_stats as stats

    return stats(_file_network(spark, sf))


@query
def graph_center(spark, sf):
    from revtide.operators.graph import graph_center as center

    return center(_file_network(spark, sf))


@query
def betweenness(spark, sf):
    from revtide.operators.graph import betweenness as between

    return between(_author_network(spark, sf))


@query
def edge_betweenness(spark, sf):
    from revtide.operators.graph import edge_betweenness as between

    return between(_author_network(spark, sf))


@query
def trim_by_edge_betweenness(spark, sf):
    from revtide.operators.graph import trim_by_edge_betweenness as trim

    return trim(_author_network(spark, sf))


@query
def minimum_spanning_tree(spark, sf):
    from revtide.operators.graph import minimum_spanning_tree as mst

    return mst(_author_network(spark, sf))


@query
def betweenness_tree(spark, sf):
    from revtide.operators.graph import betweenness_tree as tree

    return tree(_author_network(spark, sf), "weight")


@query
def degree_over_time(spark, sf):
    from revtide.operators.timeline import degree_over_time as timeline

    return timeline(*_nations(spark, sf))


@query
def closeness_over_time(spark, sf):
    from revtide.operators.timeline import closeness_over_time as timeline

    return timeline(*_nations(spark, sf))


@query
def centrality_over_time(spark, sf):
    from revtide.operators.timeline import centrality_over_time as timeline

    return timeline(*_nations(spark, sf))


@query
def path_treemap(spark, sf):
    from revtide.operators.treemap import path_treemap as treemap

    _, ch = _orders(spark, sf)
    return treemap(_file_network(spark, sf), A.path_change_counts(ch), "/", 10)


@query
def author_nodes(spark, sf):
    from revtide.sources.sinks import author_nodes as nodes

    rev, _ = _orders(spark, sf)
    return nodes(rev)


@query
def numbered_edges(spark, sf):
    from revtide.operators import edges as E
    from revtide.sources import sinks

    rev, ch = _nations(spark, sf)
    return sinks.numbered_edges(sinks.author_nodes(rev), E.coauthor_edges(rev, ch))


# Sources and sinks: written to the shared folder and read back


def _shared(spark, name):
    import uuid

    from revtide.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4()}"


@query
def report(spark, sf):
    from revtide.plans.report import report as tables

    wanted = ("churn", "daily_commits", "weekday", "hour", "active_authors", "file_types")
    names = {"churn": "day", "daily_commits": "day", "weekday": "name", "hour": "hour", "active_authors": "author", "file_types": "file_type"}
    values = {"churn": "churn", "active_authors": "temperature", "file_types": "files"}
    made = tables(*_orders(spark, sf), prefix="/ECONOMY/", first=100, last=4000, only=wanted)
    out = None
    for section in wanted:
        part = made[section].select(
            F.lit(section).alias("section"), F.col(names[section]).cast("string").alias("name"), F.col(values.get(section, "commits")).cast("double").alias("value")
        )
        out = part if out is None else out.unionByName(part)
    return out


@query
def read_revisions(spark, sf):
    from revtide.operators.logprep import with_file_counts
    from revtide.sources.readers import read_revisions as read

    path = _shared(spark, "revisions")
    with_file_counts(*_orders(spark, sf)).write.json(path)
    return read(spark, path, "json").select(
        "revno", "commitdate", "author", "msg", "added_files", "changed_files", "deleted_files"
    )


@query
def read_changes(spark, sf):
    from revtide.sources.readers import read_changes as read

    path = _shared(spark, "changes")
    _, ch = _orders(spark, sf)
    ch.write.option("header", "true").csv(path)
    return (
        read(spark, path, "csv")
        .groupBy("changedpath", "changetype")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("linesadded").alias("lines"))
    )


def _entries(spark, sf):
    """The log with the changed paths of a revision nested in it."""
    from revtide import schema

    rev, ch = _orders(spark, sf)
    one = F.struct(*[F.col(f.name) if f.name in ch.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.CHANGED_PATH.fields])
    lists = ch.groupBy("revno").agg(F.collect_list(one).alias("changed_paths"))  # the paths of one revision
    return rev.select("revno", "commitdate", "author", "msg").join(lists, "revno")


@query
def read_changes_xml(spark, sf):
    from revtide.sources.readers import read_changes as read

    path = _shared(spark, "log-xml")
    entries = _entries(spark, sf)
    each = F.transform("changed_paths", lambda c: F.struct(c["changedpath"].alias("_VALUE"), c["changetype"].alias("_action"), F.lit("file").alias("_kind")))
    entries.select(
        F.col("revno").alias("_revision"), F.lit("orders").alias("_repo_id"), "author",
        F.date_format("commitdate", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("date"), F.struct(each.alias("path")).alias("paths"), "msg",
    ).write.format("xml").option("rowTag", "logentry").option("rootTag", "log").save(path)
    return read(spark, path, "xml", group_cols=[T.StructField("repo_id", T.StringType())]).select(
        "repo_id", "revno", "changedpath", "changetype", "pathtype"
    )


@query
def read_changes_nested(spark, sf):
    from revtide.sources.readers import read_changes as read

    path = _shared(spark, "log-nested")
    _entries(spark, sf).write.parquet(path)
    return read(spark, path, "parquet", nested=True).select("revno", "changedpath", "changetype", "linesadded", "linesdeleted")


@query
def read_revisions_parquet(spark, sf):
    from revtide.operators.logprep import with_file_counts
    from revtide.sources.readers import read_revisions as read

    path = _shared(spark, "revisions-parquet")
    with_file_counts(*_orders(spark, sf)).write.parquet(path)
    return read(spark, path).select("revno", "commitdate", "author", "msg", "added_files", "changed_files", "deleted_files")


@query
def epoch_to_timestamp(spark, sf):
    from revtide.functions.calendar import epoch_to_timestamp as moment

    rev, _ = _events(spark, sf)
    seconds = rev.select("revno", F.unix_seconds("commitdate").alias("seconds"))
    return seconds.select("revno", F.date_format(moment(F.col("seconds")), "yyyy-MM-dd HH:mm:ss").alias("moment"))


@query
def write_stats_csv(spark, sf):
    from revtide.sources import sinks

    path = _shared(spark, "stats")
    rev, ch = _orders(spark, sf)
    sinks.write_stats_csv(sinks.stats_sections(rev, ch, repo_name="orders"), path)
    out = None
    for name in ("basic", "authors", "files", "weekday", "hour"):
        df = spark.read.option("header", "true").csv(f"{path}/{name}")
        a, b = df.columns[:2]
        # scores go through text; compare them rounded
        b = F.when(F.lit(name).isin("authors", "files"), F.format_string("%.3f", F.col(b).try_cast("double"))).otherwise(F.col(b))
        part = df.select(F.lit(name).alias("section"), F.col(a).alias("name"), b.alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


@query
def query_to_csv(spark, sf):
    from revtide.sources import sinks

    path = _shared(spark, "query")
    rev, ch = _orders(spark, sf)
    sql = "SELECT author, sum(linesadded) AS lines FROM log_rev JOIN log_chg USING (revno) GROUP BY author"
    sinks.query_to_csv(spark, sql, path, {"log_rev": rev, "log_chg": ch})
    return spark.read.option("header", "true").schema("author string, lines long").csv(path)


@query
def write_series_json(spark, sf):
    from revtide.sources import sinks

    path = _shared(spark, "series")
    sinks.write_series_json(S.waste_effort(*_orders(spark, sf)), path)
    return spark.read.schema("day date, lines_added long, lines_deleted long, waste_ratio double").json(path)


@query
def graph_export(spark, sf):
    from revtide.operators import edges as E
    from revtide.sources import sinks

    path = _shared(spark, "graph")
    rev, ch = _nations(spark, sf)
    sinks.graph_export(sinks.author_nodes(rev), E.coauthor_edges(rev, ch), path, "xml")
    layout = "id long, source long, target long, weight double"
    return spark.read.format("xml").schema(layout).option("rowTag", "edge").load(f"{path}/edges")


@query
def treemap_export(spark, sf):
    from revtide.operators.treemap import roll_up_paths
    from revtide.sources import sinks

    path = _shared(spark, "treemap")
    _, ch = _orders(spark, sf)
    leaves = A.path_change_counts(ch).select(
        F.substring("changedpath", 2, 2147483647).alias("path"),
        F.col("n_changes").alias("size"),
        F.lit(0.0).alias("centrality"),
    )
    sinks.treemap_export(roll_up_paths(leaves), path)
    return spark.read.schema("node string, parent string, name string, depth long, size long").json(path)
