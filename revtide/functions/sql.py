"""SQL functions for people who write SQL: expanded by the optimiser, no UDF."""

from __future__ import annotations

from pyspark.sql import SparkSession

from revtide.functions.cooling import ACTIVITY

_DEFINITIONS = (
    r"""CREATE OR REPLACE TEMPORARY FUNCTION file_type(path STRING) RETURNS STRING
        RETURN regexp_extract(path, '[^./][^/]*(\\.[^./]*)$', 1)""",
    r"""CREATE OR REPLACE TEMPORARY FUNCTION dir_prefix(scope STRING, path STRING, depth INT)
        RETURNS STRING
        RETURN concat(scope, substring_index(
            regexp_extract(substring(path, length(scope) + 1), '^(.*)/[^/]*$', 1), '/', depth))""",
    f"""CREATE OR REPLACE TEMPORARY FUNCTION cool(
            temp DOUBLE, from_ts TIMESTAMP, to_ts TIMESTAMP, rate DOUBLE) RETURNS DOUBLE
        RETURN CASE WHEN temp >= {ACTIVITY.ambient}D THEN {ACTIVITY.ambient}D
            + (temp - {ACTIVITY.ambient}D) * exp(-rate * greatest(0D,
                (unix_micros(to_ts) - unix_micros(from_ts)) / 3600000000D)) ELSE 0D END""",
)


def register_sql_functions(spark: SparkSession) -> None:
    """``file_type(path)``, ``dir_prefix(scope, path, depth)``, ``cool(...)``."""
    for d in _DEFINITIONS:
        spark.sql(d)
