"""Writing results: CSV sections, JSON series, graph and treemap tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revtide.functions.paths import relative_path
from revtide.operators.aggregates import activity_by_hour, activity_by_weekday, basic_stats
from revtide.operators.base import dense_ids, hash_bucket, share_bucket
from revtide.operators.temperature import active_authors, hot_files

# How dates are shown.
DATE_FORMAT = "MMM dd, yyyy hh:mm a"


def stats_sections(
    revisions: DataFrame, changes: DataFrame, prefix: str = "/", repo_name: str = "",
    log: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """The tables of the CSV export, by section name."""
    basic = basic_stats(revisions, changes)
    shown = [
        ("Repository Name", F.lit(repo_name)),
        ("Search Path", F.lit(prefix)),
        ("First Revision no.", F.col("first_rev").cast("string")),
        ("Latest Revision no.", F.col("last_rev").cast("string")),
        ("First Commit Date", F.date_format("first_rev_date", DATE_FORMAT)),
        ("Last Commit Date", F.date_format("last_rev_date", DATE_FORMAT)),
        ("Number of Revisions", F.col("num_revs").cast("string")),
        ("Number of active files", F.col("num_files").cast("string")),
        ("Number of authors", F.col("num_authors").cast("string")),
        ("Total Number of Lines", F.col("loc").cast("string")),
    ]
    pairs = F.explode(
        F.array(*[F.struct(F.lit(n).alias("stat"), v.alias("value")) for n, v in shown])
    ).alias("_p")
    whole = log if log is not None else revisions
    return {
        "basic": basic.select(pairs).select("_p.*"),
        "authors": active_authors(revisions, 10, log=whole).select("author", "temperature"),
        "files": hot_files(whole, changes, 10, prefix).select(
            relative_path("changedpath", prefix).alias("file"), "temperature", F.col("n_changes").alias("revisions")
        ),
        "weekday": activity_by_weekday(revisions).select(F.col("name").alias("weekday"), "commits"),
        "hour": activity_by_hour(revisions),
    }


def write_stats_csv(sections: dict[str, DataFrame], path: str, mode: str = "overwrite") -> None:
    """One CSV table per section, each in a folder of its own."""
    for name, df in sections.items():
        df.write.mode(mode).csv(f"{path}/{name}", header=True)


def query_to_csv(
    spark: SparkSession, sql: str, path: str, tables: dict[str, DataFrame] | None = None,
    mode: str = "overwrite",
) -> None:
    """Run a query over the given tables (as temporary views) and write it as CSV."""
    for name, df in (tables or {}).items():
        df.createOrReplaceTempView(name)
    spark.sql(sql).write.mode(mode).csv(path, header=True)


def write_series_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def author_nodes(revisions: DataFrame) -> DataFrame:
    """(id, label) of all authors, numbered from 0 in order of their first revision."""
    a = F.col("author")
    firsts = revisions.groupBy(
        F.when(a.isNull() | (a == ""), F.lit("Unknown")).otherwise(a).alias("label")
    ).agg(F.min("revno").alias("_first"))
    return dense_ids(firsts, share_bucket(firsts, "_first"), ["_first"], "id").select("id", "label")


def numbered_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges by node id, with an edge id of their own."""
    s = nodes.select(F.col("label").alias("src"), F.col("id").alias("source"))
    t = nodes.select(F.col("label").alias("dst"), F.col("id").alias("target"))
    joined = edges.join(s, "src").join(t, "dst").select("src", "dst", "source", "target", "weight")
    return dense_ids(joined, hash_bucket("src", "dst"), ["src", "dst"], "id").select(
        "id", "source", "target", "weight"
    )


def graph_export(
    nodes: DataFrame, edges: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite"
) -> None:
    """Node and edge table under ``path``; formats parquet, csv, json, orc or xml."""
    for name, df, tag in (("nodes", nodes, "node"), ("edges", numbered_edges(nodes, edges), "edge")):
        writer = df.write.mode(mode).format(fmt)
        if fmt == "csv":
            writer = writer.option("header", "true")
        if fmt == "xml":
            writer = writer.option("rowTag", tag).option("rootTag", name)
        writer.save(f"{path}/{name}")


def treemap_export(treemap: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Tree nodes with parents as JSON rows."""
    treemap.write.mode(mode).json(path)
