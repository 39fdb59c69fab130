"""Font sizes and colours for tag and author clouds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revtide.operators.base import attach

# Font range, and the break points (position, level) of the colour map.
MIN_FONT, MAX_FONT = 10, 30
RED = ((0.0, 0.0), (0.35, 0.0), (0.66, 1.0), (0.89, 1.0), (1.0, 0.5))
GREEN = ((0.0, 0.0), (0.125, 0.0), (0.375, 1.0), (0.64, 1.0), (0.91, 0.0), (1.0, 0.0))
BLUE = ((0.0, 0.5), (0.11, 1.0), (0.34, 1.0), (0.65, 0.0), (1.0, 0.0))


def _level(heat: Column, points: tuple) -> Column:
    """Linear interpolation between break points, as a 0..255 level."""
    expr: Column | None = None
    for (x0, y0), (x1, y1) in zip(points[:-1], points[1:]):
        value = F.lit(y0) + (heat - x0) / (x1 - x0) * (y1 - y0)
        expr = F.when(heat <= x1, value) if expr is None else expr.when(heat <= x1, value)
    return F.floor(expr * 255 + 0.5).cast("int")


def heat_color(heat: Column) -> Column:
    """``#RRGGBB`` of a value between 0 and 1."""
    h = F.least(F.greatest(heat, F.lit(0.0000001)), F.lit(1.0))
    return F.format_string("#%02X%02X%02X", _level(h, RED), _level(h, GREEN), _level(h, BLUE))


def font_size(freq: Column, low: Column, high: Column) -> Column:
    """Size on a log scale; ``low`` and ``high`` are the extremes of the displayed set."""
    span = float(MAX_FONT - MIN_FONT)
    lo, hi = F.log(low), F.log(high)
    base = lo - (hi - lo) / span
    scale = F.when(hi == base, F.lit(1.0)).otherwise(F.lit(span) / (hi - base))
    return F.floor(F.lit(float(MIN_FONT)) + (F.log(freq) - base) * scale + 0.5).cast("int")


def normalized_score(score: Column, low: Column, high: Column) -> Column:
    x = score - low
    return F.when(x > 1.0, F.log(x) / F.log(high - low)).otherwise(F.lit(0.0))


def cloud_style(df: DataFrame, count_col: str, score_col: str | None = None) -> DataFrame:
    """Add ``font_size`` and, with a score, ``score_norm`` and ``color``."""
    aggs = [F.min(count_col).alias("_c0"), F.max(count_col).alias("_c1")]
    if score_col:
        aggs += [F.min(score_col).alias("_s0"), F.max(score_col).alias("_s1")]
    out = attach(df, df.agg(*aggs))
    out = out.withColumn("font_size", font_size(F.col(count_col), F.col("_c0"), F.col("_c1")))
    if score_col:
        out = out.withColumn(
            "score_norm", normalized_score(F.col(score_col), F.col("_s0"), F.col("_s1"))
        ).withColumn("color", heat_color(F.col("score_norm")))
    return out.drop("_c0", "_c1", "_s0", "_s1")
