"""Randomness as a hash of a seed and keys: the same on every run, executor and engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(seed: int | str, *keys: Column | str) -> Column:
    """32 hexadecimal digits to order rows by; add the keys after it as tie-breaks."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys)))


def integer(seed: int | str, *keys: Column | str, digits: int = 8) -> Column:
    """A uniform integer of so many hexadecimal digits."""
    return F.conv(F.substring(digest(seed, *keys), 1, digits), 16, 10).cast("long")


def uniform(seed: int | str, *keys: Column | str) -> Column:
    """A uniform number in (0, 1)."""
    return (integer(seed, *keys, digits=12).cast("double") + 0.5) / F.lit(float(16**12))


def laplace(seed: int | str, scale: Column, *keys: Column | str) -> Column:
    """Laplace noise around 0 by the inverse of its distribution function."""
    u = uniform(seed, *keys) - 0.5
    return -scale * F.signum(u) * F.log1p(-2 * F.abs(u))
