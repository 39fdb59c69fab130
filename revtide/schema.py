"""Column layout of the two input tables and the code values they use."""

from __future__ import annotations

from pyspark.sql import types as T

REVISIONS = T.StructType(
    [
        T.StructField("revno", T.LongType()),
        T.StructField("commitdate", T.TimestampType()),
        T.StructField("author", T.StringType()),
        T.StructField("msg", T.StringType()),
        T.StructField("added_files", T.IntegerType()),
        T.StructField("changed_files", T.IntegerType()),
        T.StructField("deleted_files", T.IntegerType()),
    ]
)

CHANGES = T.StructType(
    [
        T.StructField("revno", T.LongType()),
        T.StructField("changedpath", T.StringType()),
        T.StructField("changetype", T.StringType()),
        T.StructField("copyfrompath", T.StringType()),
        T.StructField("copyfromrev", T.LongType()),
        T.StructField("pathtype", T.StringType()),
        T.StructField("linesadded", T.LongType()),
        T.StructField("linesdeleted", T.LongType()),
        T.StructField("lc_updated", T.StringType()),
        T.StructField("entrytype", T.StringType()),
    ]
)

# A log as exported: revisions with their changed paths nested inside.
CHANGED_PATH = T.StructType([f for f in CHANGES.fields if f.name != "revno"])
LOG_ENTRIES = T.StructType(
    REVISIONS.fields[:4]
    + [T.StructField("changed_paths", T.ArrayType(CHANGED_PATH))]
)

UNKNOWN_AUTHOR = "unknown"
OTHERS = "others"
NO_EXTENSION = "{no ext}"
