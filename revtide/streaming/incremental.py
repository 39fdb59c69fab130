"""Continuous loading: new log files in; new revisions, counts and author scores out.

State is bounded by default: repeats are remembered for a delay of event time, and
counts and scores are kept for windows that are dropped once the delay has passed.
What a batch changes is written under the batch's number, so a batch that is run
again after a failure replaces its own rows; readers take the last state of each key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from revtide import schema
from revtide.functions.cooling import ACTIVITY, CoolingModel, hours_between
from revtide.operators.base import attach
from revtide.operators.scope import log_end
from revtide.sources.readers import clean_revisions

#: How far a row may lag behind the newest, and how long its number is remembered.
DELAY = "30 days"


def revision_stream(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """Revisions of all log files appearing under ``path``."""
    df = spark.readStream.format(fmt).schema(schema.REVISIONS).options(**options).load(path)
    return clean_revisions(df)


def stream_new(revisions: DataFrame, delay: str | None = DELAY) -> DataFrame:
    """Each revision once, however often its file is delivered.

    Rows that lag behind the newest by more than ``delay`` are taken for repeats and
    dropped, so a number need only be remembered that long. With ``delay=None`` nothing
    is late and every number is remembered for ever.
    """
    if delay is None:
        return revisions.dropDuplicates(["revno"])
    return revisions.withWatermark("commitdate", delay).dropDuplicatesWithinWatermark(["revno"])


def daily_counts(revisions: DataFrame, delay: str = DELAY) -> DataFrame:
    """Commits per day over a stream; a day is final once ``delay`` has passed."""
    return (
        _marked(revisions, delay)
        .groupBy(F.window("commitdate", "1 day"))
        .agg(F.count(F.lit(1)).alias("commits"))
        .select(F.to_date("window.start").alias("day"), "commits")
    )


def author_windows(
    revisions: DataFrame, window: str = "30 days", delay: str = DELAY, model: CoolingModel = ACTIVITY
) -> DataFrame:
    """(author, start, heat, first, clock, commits): scores kept per author and window of event time.

    ``heat`` is the sum of the window's events, each counted as if it had come at the
    window's start; ``clock`` is the last event. Such parts add up to the author's
    temperature at any later time, see ``scores_of_windows``.
    """
    span = F.window("commitdate", window)
    events = _marked(revisions, delay).select("author", "commitdate", span.alias("w"))
    grown = F.exp(F.lit(model.rate) * hours_between(F.col("w.start"), F.col("commitdate")))
    # grouped by the window itself, which carries the watermark
    parts = events.withColumn("_grown", grown).groupBy("author", "w").agg(
        F.sum("_grown").alias("heat"),
        F.min("commitdate").alias("first"),
        F.max("commitdate").alias("clock"),
        F.count(F.lit(1)).alias("commits"),
    )
    return parts.select("author", F.col("w.start").alias("start"), "heat", "first", "clock", "commits")


def scores_of_windows(windows: DataFrame, model: CoolingModel = ACTIVITY) -> DataFrame:
    """(author, temperature, commits) at the end of the log, as ``author_scores`` has them."""
    ends = log_end(windows.select(F.col("clock").alias("commitdate")))
    rows = attach(windows, ends).withColumn("_end", F.col("end_day").cast("timestamp"))
    k, a = F.lit(model.rate), F.lit(model.ambient)
    heat = F.sum(F.col("heat") * F.exp(-k * hours_between(F.col("start"), F.col("_end"))))
    first = F.exp(-k * hours_between(F.min("first"), F.max("_end")))
    return rows.groupBy("author").agg(
        (a + F.lit(model.step) * heat - a * first).alias("temperature"), F.sum("commits").alias("commits")
    )


def _marked(revisions: DataFrame, delay: str) -> DataFrame:
    """With a watermark, if ``stream_new`` hasn't set one."""
    field = next(f for f in revisions.schema.fields if f.name == "commitdate")
    return revisions if "spark.watermarkDelayMs" in field.metadata else revisions.withWatermark("commitdate", delay)


def write_available(
    df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", mode: str = "append"
) -> StreamingQuery:
    """Process everything that has arrived, then stop."""
    return (
        df.writeStream.format(fmt)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )


def write_updates(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process everything that has arrived; each batch leaves the keys it changed under its own number."""

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return (
        df.writeStream.foreachBatch(keep)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_updates(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The last state of each key that ``write_updates`` left."""
    rows = spark.read.option("basePath", path).parquet(path)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_v"))
    return last.select(*keys, "_v.*")
