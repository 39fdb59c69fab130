"""Cooling scores of authors and files, and the activity index of the log.

Final scores are plain sums (see ``functions.cooling``) and merge across tasks.
Files are walked in revision order, where the clock may run backwards, so their
clock is the sum of forward steps; it is built bucket by bucket, so that a file
touched by every third change of the log is still spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from revtide.functions.cooling import (
    ACTIVITY,
    CoolingModel,
    banded_prefix_sum,
    cool_hours,
    hours_between,
)
from revtide.operators.aggregates import author_ranking
from revtide.operators.base import SHARES, attach, dealt, per_group, revno_share, share_bucket, top_n
from revtide.operators.scope import log_end, path_scope


def author_scores(
    revisions: DataFrame,
    log: DataFrame | None = None,
    model: CoolingModel = ACTIVITY,
    group_cols: Sequence[str] = (),
) -> DataFrame:
    """Temperature of every author at the end of the log, with commit counts."""
    group_cols = list(group_cols)
    ends = log_end(log if log is not None else revisions, group_cols)
    rows = attach(revisions.select(*group_cols, "author", "commitdate"), ends, group_cols)
    age = hours_between(F.col("commitdate"), F.col("end_day").cast("timestamp"))
    decayed = F.exp(-F.lit(model.rate) * F.greatest(age, F.lit(0.0)))
    # The very first event is the oldest, so its factor is the smallest one.
    return rows.groupBy(*group_cols, "author").agg(
        (
            F.lit(model.ambient)
            + F.lit(model.step) * F.sum(decayed)
            - F.lit(model.ambient) * F.min(decayed)
        ).alias("temperature"),
        F.count(F.lit(1)).alias("commits"),
        F.min(decayed).alias("first_factor"),
    )


def merge_scores(
    old: DataFrame, new: DataFrame, keys: Sequence[str], elapsed_hours: float,
    model: CoolingModel = ACTIVITY,
) -> DataFrame:
    """Refresh scores taken ``elapsed_hours`` ago with the scores of newer events only.

    A key present on both sides loses the first-event allowance of the new part.
    ``new`` must carry ``first_factor``, the decay factor of its first event.
    """
    a, k = model.ambient, model.rate
    o = old.select(*keys, F.col("temperature").alias("_old"))
    n = new.select(*keys, F.col("temperature").alias("_new"), "first_factor")
    cooled = (F.col("_old") - a) * F.exp(F.lit(-k * elapsed_hours))
    both = F.lit(a) + cooled + (F.col("_new") - a + a * F.col("first_factor"))
    merged = (
        F.when(F.col("_old").isNull(), F.col("_new"))
        .when(F.col("_new").isNull(), F.lit(a) + cooled)
        .otherwise(both)
    )
    return o.join(n, list(keys), "full_outer").select(*keys, merged.alias("temperature"))


def active_authors(
    revisions: DataFrame,
    n: int = 10,
    log: DataFrame | None = None,
    group_cols: Sequence[str] = (),
) -> DataFrame:
    """The n warmest authors, under the spelling the ranking shows."""
    keys = [*group_cols, "author"]
    shown = author_ranking(revisions, None, group_cols).select(*keys)
    scores = author_scores(revisions, log, group_cols=group_cols).join(shown, keys, "left_semi")
    return top_n(
        scores.select(*keys, "temperature"), n, [F.col("temperature").desc(), F.col("author")], group_cols
    )


def author_cloud(
    revisions: DataFrame,
    max_authors: int = 50,
    log: DataFrame | None = None,
    group_cols: Sequence[str] = (),
) -> DataFrame:
    """The warmest authors (spelling kept apart) with commits and activity."""
    scores = author_scores(revisions, log, group_cols=group_cols).select(
        *group_cols, "author", "commits", F.col("temperature").alias("activity")
    )
    best = top_n(scores, max_authors, [F.col("activity").desc(), F.col("author")], group_cols)
    return best.filter(F.col("activity") > 0).orderBy(*group_cols, "author")


def author_temperature(
    revisions: DataFrame, model: CoolingModel = ACTIVITY, group_cols: Sequence[str] = ()
) -> DataFrame:
    """Temperature of each author right after each distinct commit time."""
    group_cols = list(group_cols)
    keys = [*group_cols, "author"]
    events = revisions.groupBy(*keys, "commitdate").agg(F.count(F.lit(1)).alias("_n"))
    events = events.withColumn("_b", share_bucket(revisions, "commitdate"))
    return _prefix_by_bucket(events, keys, ["commitdate"], model).select(
        *keys, "commitdate", "temperature"
    )


def _file_events(revisions: DataFrame, changes: DataFrame, group_cols: Sequence[str], shares: int) -> DataFrame:
    on = [*group_cols, "revno"]
    files = changes.filter(F.col("pathtype") == "F")
    hits = (
        files
        .groupBy(*on, "changedpath")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    dated = hits.join(revisions.select(*on, "commitdate"), on)
    # What follows sorts within (path, bucket): tasks are bounded, however long the log.
    return dealt(dated.withColumn("_b", revno_share(changes, shares)), [*group_cols, "changedpath", "_b"], files.count())


def _with_clock(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Hours run forward since the first event of the same bucket, as ``_c``."""
    w = W.partitionBy(*keys, "_b").orderBy(*order)
    step = F.greatest(
        hours_between(F.lag("commitdate").over(w), F.col("commitdate")), F.lit(0.0)
    )
    stepped = events.withColumn("_step", F.coalesce(step, F.lit(0.0)))
    return stepped.withColumn("_c", F.sum("_step").over(w.rowsBetween(W.unboundedPreceding, 0)))


def _bucket_clock(ends: DataFrame, keys: list[str]) -> DataFrame:
    """Adds to each bucket summary ``_hop`` (hours since the previous bucket's last
    event) and ``_start`` (effective clock at the bucket's first event)."""
    w = W.partitionBy(*keys).orderBy("_b")
    hop = F.coalesce(
        F.greatest(hours_between(F.lag("_last_ts").over(w), F.col("_first_ts")), F.lit(0.0)), F.lit(0.0)
    )
    hopped = ends.withColumn("_hop", hop)
    upto = F.sum(F.col("_hop") + F.col("_span")).over(w.rowsBetween(W.unboundedPreceding, 0))
    return hopped.withColumn("_start", upto - F.col("_span"))


def _prefix_by_bucket(
    events: DataFrame, keys: list[str], order: list[str], model: CoolingModel
) -> DataFrame:
    """Running temperature per key over events (``_n`` at once) cut into buckets ``_b``."""
    k, a = model.rate, model.ambient
    part = [*keys, "_b"]
    clocked = _with_clock(events, keys, order)
    inner = clocked.withColumn(
        "_heat",
        banded_prefix_sum(part, order, F.col("_c") * F.lit(k), F.lit(model.step) * F.col("_n")),
    )
    last_key = F.struct(*order)
    ends = inner.groupBy(*part).agg(
        F.min_by("commitdate", last_key).alias("_first_ts"),
        F.max_by("commitdate", last_key).alias("_last_ts"),
        F.max("_c").alias("_span"),
        F.max_by("_heat", last_key).alias("_end_heat"),
    )
    ends = _bucket_clock(ends, keys)
    ends = ends.withColumn("_end_clock", F.col("_start") + F.col("_span"))
    total = banded_prefix_sum(keys, ["_b"], F.col("_end_clock") * F.lit(k), F.col("_end_heat"))
    ends = ends.withColumn("_sum", total)
    w = W.partitionBy(*keys).orderBy("_b")
    side = ends.select(
        *part,
        "_hop",
        "_start",
        F.coalesce(F.lag("_sum").over(w), F.lit(0.0)).alias("_before"),
    )
    out = inner.join(side, part)
    excess = (
        F.col("_heat")
        + F.col("_before") * F.exp(-F.lit(k) * (F.col("_hop") + F.col("_c")))
        - F.lit(a) * F.exp(-F.lit(k) * (F.col("_start") + F.col("_c")))
    )
    return out.withColumn("temperature", F.lit(a) + excess)


def file_temperature(
    revisions: DataFrame,
    changes: DataFrame,
    model: CoolingModel = ACTIVITY,
    group_cols: Sequence[str] = (),
    shares: int = SHARES,
) -> DataFrame:
    """Temperature of each file right after each revision touching it."""
    keys = [*group_cols, "changedpath"]
    events = _file_events(revisions, changes, group_cols, shares)
    return _prefix_by_bucket(events, keys, ["revno"], model).select(
        *keys, "revno", "commitdate", "temperature"
    )


def file_scores(
    revisions: DataFrame,
    changes: DataFrame,
    model: CoolingModel = ACTIVITY,
    group_cols: Sequence[str] = (),
    shares: int = SHARES,
) -> DataFrame:
    """Temperature of each file at the end of the log, with its change rows.

    Only sums are carried from bucket to bucket; rows are never joined back.
    """
    group_cols = list(group_cols)
    keys = [*group_cols, "changedpath"]
    k, a = model.rate, model.ambient
    events = _file_events(revisions, changes, group_cols, shares)
    clocked = _with_clock(events, keys, ["revno"])
    span = F.max("_c").over(W.partitionBy(*keys, "_b"))
    buckets = (
        clocked.withColumn("_span", span)
        .groupBy(*keys, "_b")
        .agg(
            F.min_by("commitdate", "revno").alias("_first_ts"),
            F.max_by("commitdate", "revno").alias("_last_ts"),
            F.max("_c").alias("_span"),
            F.sum(
                F.lit(model.step) * F.col("_n") * F.exp(F.lit(k) * (F.col("_c") - F.col("_span")))
            ).alias("_heat"),
            F.sum("_n").alias("_rows"),
            F.max("revno").alias("_last_rev"),
        )
    )
    buckets = _bucket_clock(buckets, keys).withColumn("_end", F.col("_start") + F.col("_span"))
    final = F.max("_end").over(W.partitionBy(*keys))
    scores = (
        buckets.withColumn("_final", final)
        .groupBy(*keys)
        .agg(
            F.sum(F.col("_heat") * F.exp(F.lit(k) * (F.col("_end") - F.col("_final")))).alias("_heat"),
            F.max("_final").alias("_final"),
            F.max_by("_last_ts", "_b").alias("_last_ts"),
            F.max("_last_rev").alias("last_revno"),
            F.sum("_rows").alias("n_changes"),
        )
        .withColumn(
            "_temp",
            F.lit(a) + F.col("_heat") - F.lit(a) * F.exp(-F.lit(k) * F.col("_final")),
        )
    )
    out = attach(scores, log_end(revisions, group_cols), group_cols)
    elapsed = hours_between(
        F.date_trunc("minute", F.col("_last_ts")), F.col("end_day").cast("timestamp")
    )
    return out.select(
        *keys,
        "last_revno",
        F.col("_temp").alias("last_temperature"),
        cool_hours(F.col("_temp"), elapsed, model).alias("temperature"),
        "n_changes",
    )


def hot_files(
    revisions: DataFrame,
    changes: DataFrame,
    n: int = 10,
    prefix: str = "/",
    group_cols: Sequence[str] = (),
) -> DataFrame:
    """The n warmest files under ``prefix`` with the number of their change rows."""
    scoped = path_scope(changes, prefix)
    scores = file_scores(revisions, scoped, group_cols=group_cols)
    return top_n(
        scores.select(*group_cols, "changedpath", "temperature", "n_changes"),
        n,
        [F.col("temperature").desc(), F.col("changedpath")],
        group_cols,
    )


def revision_temperature(
    revisions: DataFrame,
    changes: DataFrame,
    group_cols: Sequence[str] = (),
    shares: int = SHARES,
) -> DataFrame:
    """Hottest file of each revision; 0 for a revision without files."""
    on = [*group_cols, "revno"]
    hottest = (
        file_temperature(revisions, changes, group_cols=group_cols, shares=shares)
        .groupBy(*on)
        .agg(F.max("temperature").alias("_t"))
    )
    return revisions.select(*on, "commitdate").join(hottest, on, "left").select(
        *on, "commitdate", F.coalesce("_t", F.lit(0.0)).alias("temperature")
    )


def revision_activity_index(
    revisions: DataFrame,
    changes: DataFrame | None = None,
    temperatures: DataFrame | None = None,
    model: CoolingModel = ACTIVITY,
    group_cols: Sequence[str] = (),
) -> DataFrame:
    """Activity of the log after each distinct commit time.

    The index never drops below the cooled previous value, and cools by whole
    days only: the recurrence ``max(raw, cooled)`` is a running maximum of
    ``ln(raw - A) + k * day``, scanned in buckets of equal share.
    """
    group_cols = list(group_cols)
    if temperatures is None:
        temperatures = revision_temperature(revisions, changes, group_cols)
    k, a = model.rate, model.ambient
    raw = (
        temperatures.groupBy(*group_cols, "commitdate")
        .agg(F.max("temperature").alias("_raw"))
        .withColumn("day", F.to_date("commitdate"))
    )
    # Cooling goes by whole days, so a raw value that counts from its day on is an ordinary running maximum.
    number = F.unix_date("day")
    excess = F.log(F.when(F.col("_raw") > a, F.col("_raw") - a))
    since_origin = (excess + F.lit(k * 24.0) * number).alias("order")
    peak = F.struct(since_origin, excess.alias("excess"), number.alias("day"))
    raw = raw.withColumn("_log", F.when(excess.isNotNull(), peak))
    raw = raw.withColumn("_b", share_bucket(temperatures, "commitdate"))
    upto = W.partitionBy(*group_cols, "_b").orderBy("commitdate").rowsBetween(W.unboundedPreceding, 0)
    rows = raw.withColumn("_peak", F.max("_log").over(upto))
    ends = raw.groupBy(*group_cols, "_b").agg(F.max("_log").alias("_end"))
    before = W.partitionBy(*group_cols).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    carry = ends.select(*group_cols, "_b", F.max("_end").over(before).alias("_before"))
    top = F.greatest("_peak", "_before")  # ignores nulls
    best = top["excess"] - F.lit(k * 24.0) * (number - top["day"])
    out = rows.join(carry, [*group_cols, "_b"]).select(
        *group_cols,
        "commitdate",
        "day",
        F.coalesce(F.lit(a) + F.exp(best), F.lit(0.0)).alias("activity"),
    )
    # Once warm the index stays warm: leading zeros are exactly the zeros.
    return out.filter(F.col("activity") > 0)

