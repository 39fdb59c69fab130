"""Reading exported logs. Connecting to a version-control server is out of scope.

Large files are split among tasks: an XML log at the ends of its entries, CSV at lines
(only revisions, whose messages may run over lines, are read file by file unless
``multiLine="false"`` says that they don't).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revtide import schema
from revtide.functions.paths import is_binary
from revtide.operators.base import attach, per_group

# Layout of a log exported as XML, one <logentry> per revision.
_XML_PATH = T.StructType(
    [
        T.StructField("_VALUE", T.StringType()),
        T.StructField("_action", T.StringType()),
        T.StructField("_kind", T.StringType()),
        T.StructField("_copyfrom-path", T.StringType()),
        T.StructField("_copyfrom-rev", T.LongType()),
    ]
)
XML_ENTRIES = T.StructType(
    [
        T.StructField("_revision", T.LongType()),
        T.StructField("author", T.StringType()),
        T.StructField("date", T.TimestampType()),
        T.StructField("msg", T.StringType()),
        T.StructField("paths", T.StructType([T.StructField("path", T.ArrayType(_XML_PATH))])),
    ]
)


def _read(spark: SparkSession, path: str, fmt: str, layout: T.StructType, **options) -> DataFrame:
    reader = spark.read.format(fmt).schema(layout)
    if fmt == "csv":
        text = "true" if "msg" in layout.names else "false"
        options = {"header": "true", "multiLine": text, "escape": '"', **options}
    return reader.options(**options).load(path)


def _xml_entries(
    spark: SparkSession, path: str, group_cols: Sequence[T.StructField] = (), **options
) -> DataFrame:
    """Entries of XML logs, one row each; a file is cut behind each ``</logentry>``.

    A grouping column is an attribute of the entry or an element in it. Files of
    another encoding than UTF-8 (``encoding``) can't be cut and are read whole.
    """
    extra = [T.StructField(f"_{f.name}", f.dataType) for f in group_cols] + list(group_cols)
    layout = T.StructType(XML_ENTRIES.fields + extra)
    if "encoding" in options or "charset" in options:
        log = _read(spark, path, "xml", layout, rowTag="logentry", **options)
    else:
        ending = "</logentry>"
        pieces = spark.read.option("lineSep", ending).text(path)
        begin = F.locate("<logentry", F.col("value"))
        # What comes behind the last entry has no beginning of one.
        entry = F.concat(F.substring("value", begin, F.lit(2_147_483_647)), F.lit(ending))
        parsed = pieces.filter(begin > 0).select(F.from_xml(entry, layout, {"mode": "PERMISSIVE", **options}).alias("e"))
        log = parsed.select("e.*")
    return log.withColumns({f.name: F.coalesce(F.col(f"_{f.name}"), F.col(f.name)) for f in group_cols})


def clean_revisions(df: DataFrame) -> DataFrame:
    """Drop undated revisions; missing author or message becomes empty."""
    return df.filter(F.col("commitdate").isNotNull()).withColumns(
        {"author": F.coalesce("author", F.lit("")), "msg": F.coalesce("msg", F.lit(""))}
    )


def read_revisions(
    spark: SparkSession, path: str, fmt: str = "parquet", group_cols: Sequence[T.StructField] = (), **options
) -> DataFrame:
    """Revisions from parquet, json, csv, orc or an XML log."""
    if fmt == "xml":
        log = _xml_entries(spark, path, group_cols, **options)
        rows = log.select(
            *[f.name for f in group_cols],
            F.col("_revision").alias("revno"),
            F.col("date").alias("commitdate"),
            "author",
            "msg",
        )
        return clean_revisions(rows)
    layout = T.StructType(list(group_cols) + schema.REVISIONS.fields)
    return clean_revisions(_read(spark, path, fmt, layout, **options))


def read_changes(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    nested: bool = False,
    group_cols: Sequence[T.StructField] = (),
    **options,
) -> DataFrame:
    """One row per changed path; ``nested`` logs hold a list of paths per revision."""
    if fmt == "xml":
        log = _xml_entries(spark, path, group_cols, **options)
        names = [f.name for f in group_cols]
        rows = log.filter(F.col("date").isNotNull()).select(
            *names, F.col("_revision").alias("revno"), F.explode("paths.path").alias("p")
        )
        is_dir = F.col("p._kind") == "dir"
        slash = F.when(is_dir & ~F.col("p._VALUE").endswith("/"), F.lit("/")).otherwise(F.lit(""))
        source = F.col("p.`_copyfrom-path`")
        source_slash = F.when(is_dir & ~source.endswith("/"), F.lit("/")).otherwise(F.lit(""))
        return rows.select(
            *names,
            "revno",
            F.concat(F.col("p._VALUE"), slash).alias("changedpath"),
            F.col("p._action").alias("changetype"),
            F.concat(source, source_slash).alias("copyfrompath"),
            F.col("p.`_copyfrom-rev`").alias("copyfromrev"),
            F.when(is_dir, F.lit("D")).otherwise(F.lit("F")).alias("pathtype"),
            F.lit(0).cast("long").alias("linesadded"),
            F.lit(0).cast("long").alias("linesdeleted"),
            F.lit("N").alias("lc_updated"),
            F.lit("R").alias("entrytype"),
        )
    if nested:
        layout = T.StructType(list(group_cols) + schema.LOG_ENTRIES.fields)
        return explode_changes(_read(spark, path, fmt, layout, **options), [f.name for f in group_cols])
    return _read(spark, path, fmt, T.StructType(list(group_cols) + schema.CHANGES.fields), **options)


def explode_changes(log: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Flatten the changed-path list of each dated revision."""
    return (
        log.filter(F.col("commitdate").isNotNull())
        .select(*group_cols, "revno", F.explode("changed_paths").alias("_p"))
        .select(*group_cols, "revno", "_p.*")
    )


def append_new(existing: DataFrame, incoming: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Rows of ``incoming`` beyond the highest stored revision, ready to append."""
    last = per_group(existing, group_cols, F.max("revno").alias("_last"))
    out = attach(incoming, last, group_cols)
    return out.filter(F.col("revno") > F.coalesce("_last", F.lit(0))).drop("_last")


def file_line_counts(spark: SparkSession, path: str) -> DataFrame:
    """Lines per file of a directory tree; empty files and those of binary types count 0.

    A scan passes over empty files, so names come from the listing that the scan is
    planned by; only the lines of the other files are read.
    """
    text = spark.read.option("recursiveFileLookup", "true").text(path)
    files = spark.createDataFrame([(name,) for name in text.inputFiles()], "name string").select(_plain(F.col("name")).alias("file"))
    own = text.select(_plain(F.col("_metadata.file_path")).alias("file")).filter(~is_binary("file"))
    counts = own.groupBy("file").agg(F.count(F.lit(1)).alias("lines"))
    return files.join(counts, "file", "left").select("file", F.coalesce("lines", F.lit(0)).cast("long").alias("lines"))


def _plain(name: Column) -> Column:
    """A file's name without the escapes of links ("+" stands for itself), a local one with one slash behind its scheme."""
    return F.regexp_replace(F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), "^file:/+", "file:/")
