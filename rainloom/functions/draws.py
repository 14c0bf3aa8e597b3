"""Seeded draws from a hash of the key, so a retried task repeats them exactly."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

SPAN = float(16 ** 12)


def draw(seed: int, *keys) -> Column:
    """Uniform integer below 2**48."""
    parts = [F.lit(str(seed))] + [k.cast("string") if isinstance(k, Column) else F.col(k).cast("string") for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 12), 16, 10).cast("bigint")


def draw_below(n, seed: int, *keys) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    return draw(seed, *keys) % n


def draw_unit(seed: int, *keys) -> Column:
    """Uniform in the open unit interval."""
    return (draw(seed, *keys) + 0.5) / SPAN


def draw_normal(seed: int, *keys) -> Column:
    """Box-Muller from two hashed uniforms."""
    u = draw_unit(seed, F.lit("u"), *keys)
    v = draw_unit(seed, F.lit("v"), *keys)
    return F.sqrt(F.log(u) * -2.0) * F.cos(v * (2.0 * math.pi))
