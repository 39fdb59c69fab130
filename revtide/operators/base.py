"""Shared building blocks: scope-wide values, neighbours, ranking, bucketing.

Whatever is ordered over a long group is scanned in two passes: within buckets of the
order, and over one summary row per bucket. ``share_bucket`` cuts the order so that
buckets hold equal shares of the rows, however sparse or bunched its values are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Buckets that an order is cut into, and that rows with one value of it are.
SHARES = 64
# Rows that a task sorts or groups at once where their number decides how many tasks there are.
TASK_ROWS = 500_000


def share_bucket(df: DataFrame, first: str, second: str | None = None, parts: int = SHARES) -> Column:
    """A bucket number that never falls along (first, second), with about equal shares of the rows of ``df``.

    Buckets end at quantiles of ``first``. A value that is a quantile has a bucket of
    its own, and if so many rows share it, that is cut by quantiles of ``second``.
    The quantiles come in as a scalar subquery; a null goes before all values.
    """
    steps = [i / parts for i in range(1, parts)]
    names = [first] if second is None else [first, second]
    cuts = df.agg(*(F.percentile_approx(n, steps, 100 * parts).alias(n) for n in names))
    bounds = cuts.select(F.struct(*names)).scalar()

    def place(name: str) -> tuple[Column, Column]:
        own = F.coalesce(bounds.getField(name), F.array().cast(df.select(F.array(name)).schema[0].dataType))
        # where the value would stand among the quantiles
        below = F.array_position(F.sort_array(F.array_append(own, F.col(name))), F.col(name)).cast("int") - 1
        return below, F.coalesce(F.array_contains(own, F.col(name)), F.lit(False))

    below, on = place(first)
    out = (F.when(F.col(first).isNull(), -1).otherwise(2 * below + on.cast("int"))).cast("long") * parts
    return out if second is None else out + F.when(on, place(second)[0]).otherwise(F.lit(0))


def share_bounds(df: DataFrame, name: str, parts: int = SHARES) -> list:
    """Quantiles of a column at once, for loops that checkpoint anyway: at most ``parts`` values."""
    found = df.agg(F.percentile_approx(name, [i / parts for i in range(1, parts)], 100 * parts)).first()[0]
    return sorted(set(found or ()))


def bucket_between(bounds: list, name: str) -> Column:
    """How many of ``bounds`` lie below the column's value."""
    if not bounds:
        return F.lit(0)
    own = F.sort_array(F.array_append(F.array(*map(F.lit, bounds)), F.col(name)))
    return F.array_position(own, F.col(name)).cast("int") - 1


def revno_share(df: DataFrame, parts: int = SHARES) -> Column:
    return share_bucket(df, "revno", parts=parts)


def busy_key(df: DataFrame, keys: Sequence[str], most: int, shares: int = 256) -> Column | None:
    """Whether a row's key is one of the ``shares`` largest and has over ``most`` rows; None if no key has.

    So what is not busy has at most that many rows or a small share of all. Keys are counted
    by their hash, of which at most ``shares`` come to the driver; a key that shares its hash
    with a busy one counts as busy too.
    """
    sizes = df.groupBy(F.xxhash64(*keys).alias("_h")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most)
    found = sizes.orderBy(F.col("_n").desc()).limit(shares).collect()
    return F.xxhash64(*keys).isin([r["_h"] for r in found]) if found else None


def dealt(df: DataFrame, keys: Sequence[str], rows: int, most: int = TASK_ROWS) -> DataFrame:
    """``df`` of about ``rows`` rows dealt by ``keys``, so that tasks have about ``most`` rows at any size.

    As long as the session's shuffle partitions hold no more, dealing is left to Spark.
    """
    tasks = -(-rows // most)
    if tasks <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return df
    return df.repartition(tasks, *keys)


def attach(df: DataFrame, values: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Add one row of values per group (or one row in all) to every row.

    Without groups the values come in as a scalar subquery, so there is neither a
    join nor a cross product.
    """
    group_cols = list(group_cols)
    if group_cols:
        return df.join(values, group_cols, "left")
    names = [c for c in values.columns]
    packed = values.select(F.struct(*names).alias("_v")).scalar()
    out = df.withColumn("_v", packed)
    for n in names:
        out = out.withColumn(n, F.col("_v").getField(n))
    return out.drop("_v")


def per_group(df: DataFrame, group_cols: Sequence[str], *aggs: Column) -> DataFrame:
    return df.groupBy(*group_cols).agg(*aggs) if group_cols else df.agg(*aggs)


def top_n(df: DataFrame, n: int, order: Sequence[Column], group_cols: Sequence[str] = ()) -> DataFrame:
    """First ``n`` rows (per group). Both forms keep at most n rows per task."""
    if not group_cols:
        return df.orderBy(*order).limit(n)
    w = W.partitionBy(*group_cols).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def hash_bucket(*cols: str) -> Column:
    """One of 4096 even buckets, the same on every engine that has md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("\x00", *cols)), 1, 3), 16, 10).cast("int")


def dense_ids(
    df: DataFrame, bucket: Column, order: Sequence[str], name: str, start: Column | int = 0
) -> DataFrame:
    """Number rows ``start, start + 1, ...`` along (bucket, order).

    Rows are counted per bucket and each bucket starts where the ones before it
    end, so no task has to see all rows.
    """
    df = df.withColumn("_b", bucket)
    ranked = df.withColumn("_rn", F.row_number().over(W.partitionBy("_b").orderBy(*order)))
    sizes = df.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, 0))
    offsets = sizes.select("_b", (upto - F.col("_n")).alias("_off"))
    first = F.lit(start) if isinstance(start, int) else start
    return (
        ranked.join(offsets, "_b")
        .withColumn(name, first + F.col("_off") + F.col("_rn") - 1)
        .drop("_b", "_rn", "_off")
    )


def prev_value(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[str],
    values: dict[str, str],
) -> DataFrame:
    """Add, for each ``new: old`` in ``values``, the previous row's ``old``.

    "Previous" is within ``keys`` along ``order``. ``bucket`` must not fall along
    ``order``. Each task sees one bucket of one key, never a whole key; the last
    row of a bucket travels to the next bucket through a small side table.
    """
    keys = list(keys)
    order_cols = [F.col(c) for c in order]
    df = df.withColumn("_b", bucket)
    w = W.partitionBy(*keys, "_b").orderBy(*order_cols)
    inner = df.withColumn(
        "_prev", F.lag(F.struct(*[F.col(o).alias(n) for n, o in values.items()])).over(w)
    )
    ends = df.groupBy(*keys, "_b").agg(
        F.max_by(
            F.struct(*[F.col(o).alias(n) for n, o in values.items()]), F.struct(*order_cols)
        ).alias("_last")
    )
    side = ends.select(
        *keys,
        "_b",
        F.lag("_last").over(W.partitionBy(*keys).orderBy("_b")).alias("_carry"),
    )
    joined = inner.join(side, [*keys, "_b"], "left")
    prev = F.coalesce("_prev", "_carry")
    for n in values:
        joined = joined.withColumn(n, prev.getField(n))
    return joined.drop("_b", "_prev", "_carry")


def top_k_with_others(
    df: DataFrame,
    key: str,
    value: str,
    k: int,
    group_cols: Sequence[str] = (),
    others: str = "others",
) -> DataFrame:
    """The k largest values plus one ``others`` row holding the rest, if any."""
    group_cols = list(group_cols)
    top = top_n(df, k, [F.col(value).desc(), F.col(key)], group_cols)
    total = per_group(
        df, group_cols, F.sum(value).alias("_total"), F.count(F.lit(1)).alias("_n")
    )
    kept = per_group(top, group_cols, F.sum(value).alias("_kept"))
    rest = (
        attach(total, kept, group_cols)
        .filter(F.col("_n") > k)
        .select(*group_cols, F.lit(others).alias(key), (F.col("_total") - F.col("_kept")).alias(value))
    )
    return top.select(*group_cols, key, value).unionByName(rest)
