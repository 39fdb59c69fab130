"""The given test tables seen as revisions and changes.

Orders with their line items act as multi-file revisions, events as a
fine-grained log, documents as log messages, page addresses as paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revtide.operators.base import dealt


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utc(name: str) -> Column:
    """The files hold zone-less times, which are UTC."""
    return F.col(name).cast("timestamp")


def order_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("revno"),
        utc("o_orderdate").alias("commitdate"),
        F.col("o_custkey").cast("string").alias("author"),
        F.col("o_orderpriority").alias("msg"),
    )


def part_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = (
        F.when(F.col("p_size") % 4 == 0, ".py")
        .when(F.col("p_size") % 4 == 1, ".html")
        .when(F.col("p_size") % 4 == 2, ".js")
        .otherwise("")
    )
    path = F.concat(
        F.lit("/"),
        "p_type",
        F.lit("/"),
        F.replace("p_brand", F.lit("#"), F.lit("")),
        F.lit("/"),
        F.replace("p_name", F.lit(" "), F.lit("_")),
        F.lit("_"),
        F.col("p_partkey").cast("string"),
        ext,
    )
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"), path.alias("changedpath")
    )


def order_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = (
        F.when(F.col("l_returnflag") == "A", "A")
        .when(F.col("l_returnflag") == "N", "M")
        .when(F.col("l_linestatus") == "F", "D")
        .otherwise("R")
    )
    return (
        table(spark, sf_dir, "lineitem")
        .join(part_paths(spark, sf_dir), "l_partkey")
        .select(
            F.col("l_orderkey").alias("revno"),
            "changedpath",
            kind.alias("changetype"),
            F.lit(None).cast("string").alias("copyfrompath"),
            F.lit(None).cast("long").alias("copyfromrev"),
            F.lit("F").alias("pathtype"),
            F.col("l_quantity").cast("long").alias("linesadded"),
            F.round(F.col("l_discount") * 100).cast("long").alias("linesdeleted"),
            F.lit("Y").alias("lc_updated"),
            F.lit("R").alias("entrytype"),
        )
    )


def event_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("revno"),
        utc("ts").alias("commitdate"),
        F.col("user_id").cast("string").alias("author"),
        F.col("event_type").alias("msg"),
    )


def event_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "A").when(F.col("event_type") == "error", "D").otherwise("M")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("revno"),
        F.concat(
            F.lit("/"), "event_type", F.lit("/k"), F.get_json_object("props", "$.k"), F.lit(".dat")
        ).alias("changedpath"),
        kind.alias("changetype"),
        F.lit(None).cast("string").alias("copyfrompath"),
        F.lit(None).cast("long").alias("copyfromrev"),
        F.lit("F").alias("pathtype"),
        F.col("value").cast("long").alias("linesadded"),
        F.lit(0).cast("long").alias("linesdeleted"),
        F.lit("Y").alias("lc_updated"),
        F.lit("R").alias("entrytype"),
    )


def document_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("revno"), F.col("source").alias("author"), F.col("text").alias("msg")
    )


def page_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    no_scheme = F.regexp_replace("url", "^[a-z]+:", "")
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("revno"), F.regexp_replace(no_scheme, "[?#].*$", "").alias("changedpath")
    )


def nation_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order revisions with the customer's nation as author."""
    who = table(spark, sf_dir, "customer").join(
        table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    return (
        table(spark, sf_dir, "orders")
        .join(who.select(F.col("c_custkey").alias("o_custkey"), "n_name"), "o_custkey")
        .select(
            F.col("o_orderkey").alias("revno"),
            utc("o_orderdate").alias("commitdate"),
            F.col("n_name").alias("author"),
            F.col("o_orderpriority").alias("msg"),
        )
    )


def copied_dir_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order changes plus directory copies in the same revisions, for copy inheritance.

    A brand directory with an added file counts as copied from ``/old``, a type
    directory with a deleted file from ``/base``.
    """
    ch = order_changes(spark, sf_dir)
    parts = F.split("changedpath", "/")

    def copies(depth: int, kind: str, source: str) -> DataFrame:
        d = F.concat(F.array_join(F.slice(parts, 1, depth + 1), "/"), F.lit("/"))
        return (
            ch.filter(F.col("changetype") == kind)
            .select("revno", d.alias("changedpath"))
            .distinct()
            .select(
                "revno",
                "changedpath",
                F.lit("A").alias("changetype"),
                F.concat(F.lit(source), "changedpath").alias("copyfrompath"),
                (F.col("revno") - depth).alias("copyfromrev"),
                F.lit("D").alias("pathtype"),
                F.lit(0).cast("long").alias("linesadded"),
                F.lit(0).cast("long").alias("linesdeleted"),
                F.lit("Y").alias("lc_updated"),
                F.lit("R").alias("entrytype"),
            )
        )

    return ch.unionByName(copies(2, "A", "/old")).unionByName(copies(1, "D", "/base"))


def release_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order changes (ten revision numbers apart) with directory copies and deletes.

    Every supplier tags one brand directory. Tags of suppliers in debt are deleted
    and later restored from before the delete; tags of rich ones are released.
    """
    files = order_changes(spark, sf_dir).withColumn("revno", F.col("revno") * 10)
    brand = part_paths(spark, sf_dir).select(
        F.col("l_partkey").alias("s_suppkey"),
        F.concat(F.array_join(F.slice(F.split("changedpath", "/"), 1, 3), "/"), F.lit("/")).alias("brand"),
    )
    s = table(spark, sf_dir, "supplier").join(brand, "s_suppkey").withColumn(
        "at", F.col("s_suppkey") * 1500 + 605
    )
    key = F.col("s_suppkey").cast("string")
    tag = F.concat(F.lit("/tags/"), key, F.lit("/"))
    none, no_rev = F.lit(None).cast("string"), F.lit(None).cast("long")
    debt, rich = F.col("s_acctbal") < 0, F.col("s_acctbal") > 5000

    def op(offset: int, path: Column, kind: str, source: Column, source_rev: Column) -> Column:
        return F.struct(
            (F.col("at") + offset).cast("long").alias("revno"),
            path.alias("changedpath"),
            F.lit(kind).alias("changetype"),
            source.alias("copyfrompath"),
            source_rev.cast("long").alias("copyfromrev"),
        )

    at = F.col("at")
    restored = F.concat(F.lit("/restored/"), key, F.lit("/"))
    released = F.concat(F.lit("/releases/"), key, F.lit("/"))
    ops = F.array_compact(
        F.array(
            op(0, tag, "A", F.col("brand"), at - 5 - F.col("s_nationkey") * 10),
            F.when(debt, op(101, tag, "D", none, no_rev)),
            F.when(debt, op(202, restored, "A", tag, at + 50)),
            F.when(rich, op(303, released, "A", tag, at + 250)),
        )
    )
    dirs = s.select(F.explode(ops).alias("o")).select(
        "o.*",
        F.lit("D").alias("pathtype"),
        F.lit(0).cast("long").alias("linesadded"),
        F.lit(0).cast("long").alias("linesdeleted"),
        F.lit("Y").alias("lc_updated"),
        F.lit("R").alias("entrytype"),
    )
    return files.unionByName(dirs)


def line_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One unified diff per line item: a file block, then a property block.

    The rows are spread before the texts are written, as log files would be.
    """
    keys = ["revno", "changedpath"]
    rows = table(spark, sf_dir, "lineitem").count()
    ch = dealt(order_changes(spark, sf_dir).repartition(*keys), keys, rows)
    name = F.substring("changedpath", 2, 2147483647)
    text = F.concat(
        F.lit("Index: "), name, F.lit("\n" + "=" * 67 + "\n--- "), name, F.lit("\t(old)\n+++ "), name,
        F.lit("\t(new)\n@@ -1,3 +1,3 @@\n context\n"),
        F.expr("repeat('-old line\n', cast(linesdeleted as int))"),
        F.expr("repeat('+new line\n', cast(linesadded as int))"),
        F.lit("\nProperty changes on: props/"), F.col("changetype"),
        F.lit("\n" + "_" * 67 + "\nAdded: svn:eol-style\n   + native\n"),
    )
    return ch.select(
        "revno",
        F.col("changedpath").alias("of"),
        "changetype",
        F.col("linesadded").alias("plus"),
        F.col("linesdeleted").alias("minus"),
        text.alias("diff"),
    )
