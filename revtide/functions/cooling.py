"""The cooling model: every event heats an item, which then cools exponentially.

With ``n`` events and effective clock ``c`` (hours), the recurrence
``T(n) = step + A + (T(n-1) - A) * exp(-k * dt)``, ``T(1) = step``, has the
closed form ``A + sum(w_i * exp(-k * (c - c_i)))`` where the first weight is
``step - A`` and all others are ``step``. Sums of that form merge, so scores
aggregate partially like any other sum.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import Window as W


@dataclass(frozen=True)
class CoolingModel:
    rate: float  # per hour
    step: float
    ambient: float


# Fixed values of the two models in use.
ACTIVITY = CoolingModel(rate=0.06 / 24.0, step=10.0, ambient=1.1)
EDGES = CoolingModel(rate=0.005 / 24.0, step=10.0, ambient=0.0)

MICROS_PER_HOUR = 3_600_000_000.0
_BAND = 300.0  # exponents stay inside one band, far below double overflow


def hours(ts: Column) -> Column:
    return F.unix_micros(ts) / F.lit(MICROS_PER_HOUR)


def hours_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(MICROS_PER_HOUR)


def cool_hours(temp: Column, elapsed: Column, model: CoolingModel = ACTIVITY) -> Column:
    """Temperature after ``elapsed`` hours; below ambient counts as 0."""
    a = F.lit(model.ambient)
    t = a + (temp - a) * F.exp(-F.lit(model.rate) * F.greatest(elapsed, F.lit(0.0)))
    return F.when(t >= a, t).otherwise(F.lit(0.0))


def cool(temp: Column, from_ts: Column, to_ts: Column, model: CoolingModel = ACTIVITY) -> Column:
    return cool_hours(temp, hours_between(from_ts, to_ts), model)


def banded_prefix_sum(part: list, order: list, x: Column, weight: Column) -> Column:
    """``sum(weight_j * exp(x_j - x_i))`` over the rows up to and with row i.

    ``x`` must not fall along ``order``. Exponents are taken relative to bands of
    width 300; the band before contributes as a whole, older ones are below
    ``exp(-300)`` of the result and are left out.
    """
    band = F.floor(x / F.lit(_BAND)).cast("long")
    local = F.exp(x - band * F.lit(_BAND)) * weight
    in_band: WindowSpec = (
        W.partitionBy(*part, band).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    )
    before: WindowSpec = W.partitionBy(*part).orderBy(band).rangeBetween(-1, -1)
    own = F.exp(band * F.lit(_BAND) - x) * F.sum(local).over(in_band)
    carried = F.exp((band - 1) * F.lit(_BAND) - x) * F.sum(local).over(before)
    return own + F.coalesce(carried, F.lit(0.0))
