"""Elementwise expressions over voxel values.

A value is valid if it is finite; NaN, infinities and NULL all count as missing. Expressions that feed an aggregate map
missing values to NULL, those at the edge of a volume give NaN or 0 as documented.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")
#: Names of the transformations; all spellings of one lead to one tag.
IDENTITY = ("", "none", "null")
FISHER = ("fisherz", "fisher_z", "fisher-z")


def is_finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(math.inf))


def finite_or_null(v: Column) -> Column:
    return F.when(is_finite(v), v)


def fisher_z(v: Column, eps: float = 1e-7, clip: bool = True) -> Column:
    """atanh of a correlation; missing values give NaN. With clip=False a value outside (-1, 1) raises an error."""
    if clip:
        z = F.atanh(F.greatest(F.lit(-1.0 + eps), F.least(F.lit(1.0 - eps), v)))
    else:
        z = F.when(F.abs(v) >= 1, F.raise_error(F.lit("Fisher z needs values strictly within (-1, 1); use clip=True")).cast("double")).otherwise(F.atanh(v))
    return F.when(is_finite(v), z).otherwise(F.lit(NAN))


def transformation_tag(name: str | None) -> str:
    """The suffix of output names: empty for none, _fisherz for all spellings of the Fisher transformation."""
    t = "" if name is None else str(name).lower().strip()
    if t in IDENTITY:
        return ""
    if t in FISHER:
        return "_fisherz"
    raise ValueError(f"unknown transformation {name!r}; known: none, fisherz")


def transformed(v: Column, name: str | None) -> Column:
    return fisher_z(v) if transformation_tag(name) else v


def in_mask(v: Column) -> Column:
    """Mask membership: finite and above zero."""
    return is_finite(v) & (v > 0)


def masked(v: Column, inside: Column) -> Column:
    """The value inside the mask, 0 outside and for missing values, in single precision."""
    return F.when(F.coalesce(inside, F.lit(False)) & is_finite(v), v).otherwise(F.lit(0.0)).cast("float")


def or_nan(v: Column) -> Column:
    return F.coalesce(v, F.lit(NAN))
