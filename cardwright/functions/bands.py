"""Band and label expressions: the two closures, IV bands, digitising."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def band_open_closed(x: Column, inner: list[float]) -> Column:
    """Index of the ``(lo, hi]`` interval between sorted inner edges (binning).

    Null falls into no band; NaN, above every edge, into the last.
    """
    steps = [F.when(x > F.lit(float(e)), 1).otherwise(0) for e in inner]
    return F.when(x.isNull(), None).otherwise(reduce(lambda a, b: a + b, steps, F.lit(0))).cast("int")


def band_closed_open(x: Column, inner: list[float]) -> Column:
    """Index of the ``[lo, hi)`` interval between sorted inner edges (score
    bands). Repeated edges leave empty bands, as digitising does; NaN is last."""
    steps = [F.when(x >= F.lit(float(e)), 1).otherwise(0) for e in inner]
    return F.when(x.isNull(), None).otherwise(reduce(lambda a, b: a + b, steps, F.lit(0))).cast("int")


# Upper ends of the information-value bands.
IV_BANDS = ((0.02, "useless"), (0.10, "weak"), (0.30, "medium"), (0.50, "strong"))
IV_TOP = "SUSPICIOUS - check leakage"


def iv_band(iv: Column) -> Column:
    """Name of an information value's strength; NaN and null are suspicious too."""
    out = F.lit(IV_TOP)
    for end, name in reversed(IV_BANDS):
        out = F.when(iv < end, name).otherwise(out)
    return out


def ratio(top: Column, bottom: Column) -> Column:
    """``top / bottom``, null where the bottom is null or 0."""
    return F.when(bottom != 0, top / bottom)
