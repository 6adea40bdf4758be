"""Descriptor arithmetic on ARRAY<DOUBLE> columns, all in built-in higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOG_BASE = 0.001


def entropy(desc: Column) -> Column:
    """Shannon entropy in bits of round(255 v) in 256 bins; larger values are left out of the bins."""
    bins = F.filter(F.transform(desc, lambda v: F.floor(v * 255 + 0.5)), lambda b: (b >= 0) & (b < 256))
    share = lambda b: F.size(F.filter(bins, lambda x: x == b)) / F.size(desc)
    return F.aggregate(F.transform(F.array_distinct(bins), share), F.lit(0.0), lambda s, p: s - p * F.log2(p))


def resize(desc: Column, s: float) -> Column:
    return F.transform(desc, lambda v: F.greatest(v * F.lit(float(s)), F.lit(0.0)))


def quantise(desc: Column, s: float = 100.0) -> Column:
    return F.transform(desc, lambda v: F.least(F.greatest(
        (v * F.lit(float(s))).cast("bigint").cast("double") / F.lit(float(s)), F.lit(0.0)), F.lit(1.0)))


def log_scale(desc: Column, least: float = LOG_BASE) -> Column:
    span = -F.ln(F.lit(float(least)))
    return F.transform(desc, lambda v: F.least((F.ln(F.greatest(v, F.lit(float(least)))) + span) / span, F.lit(1.0)))


def double_and_cap(desc: Column) -> Column:
    return F.transform(desc, lambda v: F.least(v * 2, F.lit(1.0)))


def _fold(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def l1(a: Column, b: Column) -> Column:
    return _fold(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def l2_squared(a: Column, b: Column) -> Column:
    return _fold(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(l2_squared(a, b))


def l_max(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def dot(a: Column, b: Column) -> Column:
    return _fold(F.zip_with(a, b, lambda x, y: x * y))
