"""From raw log rows to clean tables: copy sources, counters, line counts, path ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revtide.functions import paths
from revtide.operators.base import dense_ids, hash_bucket


def normalize_log_paths(changes: DataFrame) -> DataFrame:
    return changes.withColumn("changedpath", paths.normalize_path("changedpath")).withColumn(
        "copyfrompath", paths.normalize_path("copyfrompath")
    )


def _as_dir(path: Column) -> Column:
    return F.concat(F.rtrim(path, F.lit("/")), F.lit("/"))


def inherit_copyfrom(changes: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Changes (other than additions) under a copied path take over its copy source.

    The deepest copied path above the change decides. Looking up each ancestor
    makes this an equality join instead of a prefix comparison.
    """
    on = [*group_cols, "revno"]
    has_source = F.coalesce(F.length("copyfrompath"), F.lit(0)) > 0
    sources = (
        changes.filter(has_source)
        .groupBy(*on, _as_dir(F.col("changedpath")).alias("_dir"))
        .agg(F.max(F.struct("copyfrompath", "copyfromrev")).alias("_src"))
    )
    wanting = changes.filter((F.col("changetype") != "A") & F.col("copyfrompath").isNull())
    above = wanting.select(*on, "changedpath").distinct()
    found = (
        above.withColumn("_dir", F.explode(paths.ancestors("changedpath", include_self=True)))
        # the path itself is only "under" a copied directory if it names that directory
        .filter(F.col("changedpath").startswith(F.col("_dir")))
        .join(sources, [*on, "_dir"])
        .groupBy(*on, "changedpath")
        .agg(F.max_by(F.struct("_dir", "_src"), F.length("_dir")).alias("_hit"))
    )
    inherits = (F.col("changetype") != "A") & F.col("copyfrompath").isNull() & F.col("_hit").isNotNull()
    rest = F.substring(F.col("changedpath"), F.length("_hit._dir") + 1, F.lit(2147483647))
    new_path = paths.normalize_path(F.concat(_as_dir(F.col("_hit._src.copyfrompath")), rest))
    joined = changes.join(found, [*on, "changedpath"], "left")
    return joined.select(
        *[
            F.when(inherits, new_path).otherwise(F.col(c)).alias(c)
            if c == "copyfrompath"
            else F.when(inherits, F.col("_hit._src.copyfromrev")).otherwise(F.col(c)).alias(c)
            if c == "copyfromrev"
            else F.col(c)
            for c in changes.columns
        ]
    )


def revision_file_counts(changes: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Files added, changed and deleted per revision; directories do not count."""
    kind = F.col("changetype")
    return (
        changes.filter(F.col("pathtype") == "F")
        .groupBy(*group_cols, "revno")
        .agg(
            F.count_if(kind == "A").cast("int").alias("added_files"),
            F.count_if(kind.isin("M", "R")).cast("int").alias("changed_files"),
            F.count_if(kind == "D").cast("int").alias("deleted_files"),
        )
    )


def with_file_counts(
    revisions: DataFrame, changes: DataFrame, group_cols: Sequence[str] = ()
) -> DataFrame:
    """Revisions with the three counters filled in from ``changes``."""
    on = [*group_cols, "revno"]
    names = ("added_files", "changed_files", "deleted_files")
    base = revisions.drop(*names)
    out = base.join(revision_file_counts(changes, group_cols), on, "left")
    return out.fillna(0, subset=list(names))


def diff_line_counts(diffs: DataFrame, keys: Sequence[str] = ("revno",), text: str = "diff") -> DataFrame:
    """Lines added and deleted per file of a unified diff text.

    The text is cut into file and property blocks inside its own row; only the
    counts leave the row. A file named twice keeps its last block; a property
    block adds nothing.
    """
    blocks = diffs.select(
        *keys,
        F.posexplode(
            F.split(text, r"\n(?=Index: |Property changes on: )")
        ).alias("_pos", "_block"),
    )
    is_file = F.col("_block").startswith("Index: ")
    is_prop = F.col("_block").startswith("Property changes on: ")
    header = F.rtrim(F.substring_index("_block", "\n", 1), F.lit(" \t\r\x0b\x0c"))
    skip = F.when(is_file, len("Index: ")).otherwise(len("Property changes on: "))
    name = F.substring(header, skip + 1, F.lit(2147483647))

    def count(sign: str) -> Column:
        # lines opening with the sign but not with three of them; the header comes
        # first, so every counted line follows a line break
        one = "\\" + sign
        return F.regexp_count("_block", F.lit(f"\n{one}(?!{one}{one})"))

    counted = blocks.filter(is_file | is_prop).select(
        *keys,
        "_pos",
        is_file.alias("_is_file"),
        F.concat(F.lit("/"), name).alias("changedpath"),
        count("+").alias("_a"),
        count("-").alias("_d"),
    )
    at = F.when(F.col("_is_file"), F.col("_pos"))
    return counted.groupBy(*keys, "changedpath").agg(
        F.coalesce(F.max_by("_a", at), F.lit(0)).cast("long").alias("linesadded"),
        F.coalesce(F.max_by("_d", at), F.lit(0)).cast("long").alias("linesdeleted"),
    )


def text_line_counts(df: DataFrame, text: str) -> DataFrame:
    """Add ``lines``: the number of lines of a text column, a last open line included."""
    t = F.col(text)
    breaks = F.length(t) - F.length(F.replace(t, F.lit("\n")))
    return df.withColumn(
        "lines",
        (breaks + F.when((F.length(t) > 0) & ~t.endswith("\n"), 1).otherwise(0)).cast("long"),
    )


def resolve_line_counts(
    changes: DataFrame,
    file_lines: DataFrame,
    diff_counts: DataFrame,
    mime_col: str | None = None,
    group_cols: Sequence[str] = (),
) -> DataFrame:
    """Fill in line counts: an added file counts its lines, a deleted one the lines
    it had before, everything else its diff. Directories and binaries count 0.

    ``file_lines`` is (revno, changedpath, lines) of file contents at a revision;
    ``diff_counts`` is the output of :func:`diff_line_counts`.
    """
    on = [*group_cols, "revno", "changedpath"]
    content = file_lines.select(*on, F.col("lines").alias("_lines"))
    before = file_lines.select(
        *group_cols,
        F.col("revno").alias("_prev_rev"),
        F.col("changedpath").alias("_prev_path"),
        F.col("lines").alias("_before"),
    )
    diff = diff_counts.select(
        *on, F.col("linesadded").alias("_add"), F.col("linesdeleted").alias("_del")
    )
    prev_path = F.when(F.coalesce(F.length("copyfrompath"), F.lit(0)) > 0, F.col("copyfrompath"))
    rows = (
        changes.withColumn("_prev_path", F.coalesce(prev_path, F.col("changedpath")))
        .withColumn("_prev_rev", F.coalesce(F.col("copyfromrev"), F.col("revno") - 1))
        .join(content, on, "left")
        .join(before, [*group_cols, "_prev_rev", "_prev_path"], "left")
        .join(diff, on, "left")
    )
    plain = (F.col("pathtype") == "F") & ~paths.is_binary(
        F.when(F.col("changetype") == "D", F.col("_prev_path")).otherwise(F.col("changedpath")),
        mime_col,
    )
    kind = F.col("changetype")
    added = (
        F.when(~plain | (kind == "D"), F.lit(0))
        .when(kind == "A", F.col("_lines"))
        .when(kind == "R", F.coalesce("_add", "_lines"))
        .otherwise(F.col("_add"))
    )
    deleted = (
        F.when(~plain | (kind == "A"), F.lit(0))
        .when(kind == "D", F.col("_before"))
        .otherwise(F.col("_del"))
    )
    filled = {
        "linesadded": F.coalesce(added, F.lit(0)).cast("long"),
        "linesdeleted": F.coalesce(deleted, F.lit(0)).cast("long"),
        "lc_updated": F.lit("Y"),
    }
    return rows.select(*[filled[c].alias(c) if c in filled else F.col(c) for c in changes.columns])


def encode_paths(existing: DataFrame, new_paths: DataFrame) -> DataFrame:
    """The path dictionary with an id for every unseen path appended."""
    known = existing.select("path_id", "path")
    unseen = (
        new_paths.select("path")
        .filter(F.col("path").isNotNull() & (F.col("path") != ""))
        .distinct()
        .join(known.select("path"), "path", "left_anti")
    )
    top = known.agg(F.coalesce(F.max("path_id"), F.lit(0)) + 1).scalar()
    fresh = dense_ids(unseen, hash_bucket("path"), ["path"], "path_id", top)
    return known.unionByName(fresh.select("path_id", "path"))


def change_view(changes: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Encoded changes with both path names looked up."""
    changed = dictionary.select(
        F.col("path_id").alias("changedpathid"), F.col("path").alias("changedpath")
    )
    source = dictionary.select(
        F.col("path_id").alias("copyfrompathid"), F.col("path").alias("copyfrompath")
    )
    return changes.join(changed, "changedpathid", "left").join(source, "copyfrompathid", "left")


def repair_path_dictionary(
    dictionary: DataFrame, changes: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Normalise stored paths, merge duplicates into the lowest id, remap the changes."""
    clean = dictionary.select("path_id", paths.normalize_path("path").alias("path"))
    kept = clean.groupBy("path").agg(F.min("path_id").alias("_kept"))
    # Only ids that really move need a lookup.
    moved = clean.join(kept, "path").filter(F.col("path_id") != F.col("_kept")).select("path_id", "_kept")
    out = changes
    for c in ("changedpathid", "copyfrompathid"):
        m = moved.select(F.col("path_id").alias(c), "_kept")
        out = out.join(m, c, "left").withColumn(c, F.coalesce("_kept", c)).drop("_kept")
    return kept.select(F.col("_kept").alias("path_id"), "path"), out.select(*changes.columns)


def update_file_counters(
    revisions: DataFrame, synthetic: DataFrame, group_cols: Sequence[str] = ()
) -> DataFrame:
    """Add the synthetic additions and deletions to the revision counters."""
    on = [*group_cols, "revno"]
    extra = synthetic.groupBy(*on).agg(
        F.count_if(F.col("changetype") == "A").alias("_a"),
        F.count_if(F.col("changetype") == "D").alias("_d"),
    )
    out = revisions.join(extra, on, "left")
    bumped = {"added_files": "_a", "deleted_files": "_d"}
    return out.select(
        *[
            (F.col(c) + F.coalesce(F.col(bumped[c]), F.lit(0))).cast("int").alias(c)
            if c in bumped
            else F.col(c)
            for c in revisions.columns
        ]
    )


def overlay_line_counts(
    changes: DataFrame, updates: DataFrame, group_cols: Sequence[str] = ()
) -> DataFrame:
    """Replace line counts by (revno, path) where ``updates`` has them."""
    on = [*group_cols, "revno", "changedpath"]
    new = updates.select(
        *on, F.col("linesadded").alias("_a"), F.col("linesdeleted").alias("_d"), F.lit("Y").alias("_y")
    )
    over = {"linesadded": "_a", "linesdeleted": "_d", "lc_updated": "_y"}
    return changes.join(new, on, "left").select(
        *[F.coalesce(over[c], c).alias(c) if c in over else F.col(c) for c in changes.columns]
    )
