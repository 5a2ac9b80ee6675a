"""Scalar column functions. All stay inside whole-stage code generation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

from plantgauge import fixed_values as fv


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_defective(c: Column | str) -> Column:
    """True for the defect words and for 1; null is False. Category names are not labels."""
    word = F.lower(F.trim(as_col(c).cast("string")))
    return F.coalesce(word.isin(fv.DEFECTIVE_WORDS), F.lit(False))


def has_category(c: Column | str) -> Column:
    """True for a category text that names a defect."""
    word = F.lower(F.trim(as_col(c).cast("string")))
    return F.coalesce(~word.isin(fv.NO_CATEGORY_WORDS), F.lit(False))


def to_number(c: Column | str) -> Column:
    """Double or null; NaN counts as missing."""
    number = as_col(c).try_cast("double")
    return F.when(~F.isnan(number), number)


def ratio(n: Column, d: Column) -> Column:
    """n/d, 0 where d is not positive."""
    return F.when(d > 0, n / d).otherwise(F.lit(0.0))


def per_unit(n: Column, d: Column) -> Column:
    """n / max(1, d)."""
    return n / F.greatest(F.lit(1), d)


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), c))


def rounded(c: Column, digits: int) -> Column:
    """Round half up. The boundary sits a hair below the half, so that a value
    that is a half in decimal does not depend on the last binary digit."""
    scale = float(10**digits)
    return F.floor(c * F.lit(scale) + F.lit(0.500001)) / F.lit(scale)


def total(cols: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def cycle_minutes(c: Column) -> Column:
    """Cycle times above 10 are seconds, others minutes."""
    return F.when(c > 10.0, c / 60.0).otherwise(F.greatest(c, F.lit(1e-4)))


def wilson(count: Column, n: Column, z: float = fv.WILSON_Z) -> dict[str, Column]:
    """Wilson score interval: rate, low, high; all 0 when n is not positive."""
    m = F.greatest(n, F.lit(1)).cast("double")
    p = count / m
    z2 = F.lit(z * z)
    denominator = F.lit(1.0) + z2 / m
    centre = (p + z2 / (F.lit(2.0) * m)) / denominator
    half = F.lit(z) * F.sqrt(p * (F.lit(1.0) - p) / m + z2 / (F.lit(4.0) * m * m)) / denominator
    none = n <= 0
    return {
        "rate": F.when(none, 0.0).otherwise(p),
        "low": F.when(none | (count == 0), 0.0).otherwise(F.greatest(F.lit(0.0), centre - half)),
        "high": F.when(none, 0.0).when(count == n, 1.0).otherwise(F.least(F.lit(1.0), centre + half)),
    }


def sequence_number(c: Column | str) -> Column:
    """The first run of digits, as a double."""
    return F.nullif(F.regexp_extract(as_col(c), r"(\d+)", 1), F.lit("")).try_cast("double")


def annotation(bbox: Column | str, heatmap: bool = False) -> Column:
    """Where a unit's spatial annotation comes from."""
    box = as_col(bbox)
    fallback = fv.BBOX_HEATMAP if heatmap else fv.BBOX_ABSENT
    return F.when(box.isNotNull() & (box != "") & (box != "[]"), fv.BBOX_PRESENT).otherwise(fallback)
