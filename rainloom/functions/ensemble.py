"""Expressions over the members array: one row holds a whole ensemble, so no shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from rainloom.functions.scalar import col


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def members_count(m) -> Column:
    return F.size(col(m))


def largest(df: DataFrame, members: str = "members") -> int:
    """Members of the largest ensemble; a job that reads no more than the arrays."""
    return df.agg(F.max(F.size(members)).alias("n")).first()["n"] or 0


def each(agg: Callable[[Column], Column], n: int, members="members") -> Column:
    """An aggregate of every member over the rows of a group, as one array: partial sums stay one row, whatever the ensemble's size."""
    return F.array(*[agg(F.get(col(members), F.lit(i))) for i in range(n)]) if n else F.array().cast("array<double>")


def added(parts) -> Column:
    """Sum of arrays by position; a missing entry adds nothing and the sum of none is missing."""
    p = col(parts)
    return F.aggregate(F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))), F.get(p, F.lit(0)), lambda a, b: F.zip_with(a, b, lambda x, y: F.coalesce(x + y, x, y)))


def mean_of_known(a: Column) -> Column:
    """Mean of the entries that are not missing; NULL without any."""
    known = F.filter(a, lambda x: x.isNotNull())
    return F.when(F.size(known) > 0, total(known) / F.nullif(F.size(known), F.lit(0)))


def mean(m) -> Column:
    return total(col(m)) / F.size(col(m))


def variance(m, ddof: int = 1) -> Column:
    """Two-pass variance; NULL where the divisor is not positive."""
    m = col(m)
    mu = mean(m)
    ss = total(F.transform(m, lambda x: (x - mu) * (x - mu)))
    return F.when(F.size(m) > ddof, ss / F.nullif(F.size(m) - ddof, F.lit(0)))


def std(m, ddof: int = 1) -> Column:
    return F.sqrt(variance(m, ddof))


def quantile(m, q: float) -> Column:
    """Linear-interpolation quantile of the members."""
    m = col(m)
    s = F.array_sort(m)
    pos = (F.size(m) - 1) * F.lit(float(q))
    lo = F.floor(pos).cast("int")
    hi = F.least(lo + 1, F.size(m) - 1)
    return F.get(s, lo) + (pos - lo) * (F.get(s, hi) - F.get(s, lo))


def median(m) -> Column:
    return quantile(m, 0.5)


def abs_error(m, y) -> Column:
    m, y = col(m), col(y)
    return total(F.transform(m, lambda x: F.abs(x - y))) / F.size(m)


def pair_sum(m) -> Column:
    """Sum of (2k-M-1)*x_(k) over the ordered members: the pair term in M log M."""
    m = col(m)
    return total(F.transform(F.array_sort(m), lambda x, i: x * ((i + 1) * 2 - F.size(m) - 1)))


def fair_crps(m, y) -> Column:
    """Unbiased for finite ensembles; a single member gives its absolute error."""
    n = F.size(col(m))
    return F.when(n > 1, abs_error(m, y) - pair_sum(m) / F.nullif(n * (n - 1), F.lit(0))).otherwise(abs_error(m, y))


def plain_crps(m, y) -> Column:
    """Pair term over M squared; kept apart because its numbers differ."""
    n = F.size(col(m))
    return abs_error(m, y) - pair_sum(m) / (n * n)


def rank(m, y) -> Column:
    m, y = col(m), col(y)
    return F.size(F.filter(m, lambda x: x < y))


def share_at_least(m, t) -> Column:
    m = col(m)
    return F.size(F.filter(m, lambda x: x >= t)) / F.size(m)


def inside(m, y, low: float, high: float) -> Column:
    return (col(y) >= quantile(m, low)) & (col(y) <= quantile(m, high))


def usable(m, y=None) -> Column:
    """Truth and every member finite."""
    m = col(m)
    ok = m.isNotNull() & ~F.exists(m, lambda x: x.isNull() | F.isnan(x))
    return ok if y is None else ok & col(y).isNotNull() & ~F.isnan(col(y))


def elementwise(m, fn) -> Column:
    return F.transform(col(m), fn)
