"""Percentiles, probabilities and guarded statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

# Fixed value: probabilities are kept this far from 0 and 1.
EDGE = 1e-9


def clip_prob(p: str | Column) -> Column:
    return F.least(F.lit(1 - EDGE), F.greatest(F.lit(EDGE), col(p)))


def clip_unit(x: str | Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), col(x)))


def nearest_rank(values: str | Column, q: float) -> Column:
    """Nearest-rank percentile of an array: its ceil(q n / 100)-th smallest, the first at least; null for an empty one."""
    v = col(values)
    n = F.size(v)
    return F.try_element_at(F.sort_array(v), F.greatest(F.lit(1), F.least(n, F.ceil(F.lit(q / 100.0) * n).cast("int"))))


def linear_percentile(values: str | Column, q: float) -> Column:
    """Percentile of a column in a group, interpolated between neighbours."""
    return F.percentile(col(values), F.lit(q / 100.0))


def pearson(x: str | Column, y: str | Column) -> Column:
    """Correlation of a group; null with fewer than two rows or a constant side, where the built-in one fails."""
    x, y = col(x), col(y)
    flat = (F.count(F.when(x.isNotNull() & y.isNotNull(), 1)) < 2) | (F.min(x) == F.max(x)) | (F.min(y) == F.max(y))
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return F.when(flat | F.isnan(r) | (F.abs(r) == float("inf")), None).otherwise(r)


def speech_seconds(first: str | Column, last: str | Column, frame_len: str | Column) -> Column:
    """From the first to the last frame with speech, one frame at least."""
    return F.greatest(col(last) - col(first), F.lit(1)) * col(frame_len)


def words_per_minute(words: str | Column, seconds: str | Column) -> Column:
    return F.coalesce(F.try_divide(col(words).cast("double"), col(seconds) / 60.0), F.lit(0.0))


def calibrated(raw: str | Column, a: float | Column, b: float | Column) -> Column:
    """clip(a + b raw) to [0, 1]."""
    a, b = (F.lit(x) if isinstance(x, (int, float)) else x for x in (a, b))
    return clip_unit(a + b * col(raw))
