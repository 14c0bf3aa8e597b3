"""Column helpers: transforms, geometry, calendar strata, error models, verdicts."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# Missing tokens and the two sentinel sets.
MISSING_TOKENS = ["", "***", "NA", "N/A", "NULL", "NONE"]
SENTINELS_LEGACY = [-999.0, -9999.0, -99.9, 999.0, 9999.0]
SENTINELS_STATION = [-999.0, -9999.0, -99.9, 999.0]
TRACE_MM = 0.05

# Default transform per predictor channel.
CHANNEL_KINDS = {"era5_tp": "log1p", "cpc_precip": "log1p", "era5_cape": "sqrt"}

EARTH_KM = 6371.0088
EARTH_M = 6_371_000.0


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: str | Column) -> Column:
    """NaN and infinities become NULL."""
    c = col(c)
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def rounded(c: str | Column, digits: int = 6) -> Column:
    """Report value: half-up on the double itself, never a negative zero."""
    scale = float(10 ** digits)
    return F.floor(col(c) * scale + 0.5) / scale


def ratio(num: Column, den: Column) -> Column:
    """NULL instead of a division by zero."""
    return F.when(den != 0, num / F.nullif(den, F.lit(0.0)))


def clip(c, low=None, high=None) -> Column:
    """Bounds a value and keeps NULL; greatest and least would drop the NULL."""
    c = col(c)
    out = c
    if high is not None:
        out = F.when(c > high, F.lit(float(high))).otherwise(out)
    if low is not None:
        out = F.when(c < low, F.lit(float(low))).otherwise(out)
    return out


# ---- cleaning -------------------------------------------------------------

def token_value(c: str | Column) -> Column:
    """Numeric value of a text cell, NULL for missing tokens and for junk."""
    text = F.trim(col(c))
    return F.when(~F.upper(text).isin(MISSING_TOKENS), finite(text.try_cast("double")))


def is_unknown_token(c: str | Column) -> Column:
    text = F.trim(col(c))
    return ~F.upper(text).isin(MISSING_TOKENS) & text.try_cast("double").isNull()


def is_sentinel(value: Column, sentinels=SENTINELS_LEGACY) -> Column:
    return F.coalesce(value.isin(sentinels), F.lit(False))


def clean_legacy(c: str | Column, max_mm: float = 1000.0) -> Column:
    """Station-month cell: sentinels, negatives and values above max_mm are missing."""
    v = token_value(c)
    return F.when(~is_sentinel(v, SENTINELS_LEGACY) & (v >= 0) & (v <= max_mm), v)


def clean_station(c: str | Column) -> Column:
    """Station CSV cell: trace T counts as 0.05 mm; no upper bound."""
    text = F.trim(col(c))
    v = F.when(F.upper(text) == "T", F.lit(TRACE_MM)).otherwise(token_value(text))
    return F.when(~is_sentinel(v, SENTINELS_STATION) & (v >= 0), v)


def station_key(c: str | Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(col(c))), "[^a-z0-9]", "")


# ---- transforms -----------------------------------------------------------

#: Each transform and its inverse; scale is the amount that log1p treats as one unit.
TRANSFORMS = {
    "none": (lambda p, scale: p, lambda z, scale: z),
    "sqrt": (lambda p, scale: F.sqrt(p), lambda z, scale: F.pow(clip(z, 0), F.lit(2.0))),
    "cbrt": (lambda p, scale: F.pow(p, F.lit(1.0 / 3.0)), lambda z, scale: F.pow(z, F.lit(3.0))),
    "log1p": (lambda p, scale: F.log1p(p / scale), lambda z, scale: F.expm1(clip(z, high=LARGEST_LOG)) * scale),
}
#: Fixed value: logarithms beyond it are cut before the exponential.
LARGEST_LOG = 30.0


def transform_pair(kind: str):
    try:
        return TRANSFORMS[kind]
    except KeyError:
        raise ValueError(f"no transform is called {kind!r}; there are {', '.join(TRANSFORMS)}") from None


def stretch(p: Column, kind: str, eps: float = 0.1) -> Column:
    """Variance-stabilising function of a non-negative amount."""
    return transform_pair(kind)[0](clip(p, 0), eps)


def unstretch(z: Column, kind: str, eps: float = 0.1) -> Column:
    """The amount again, never negative."""
    return clip(transform_pair(kind)[1](z, eps), 0)


def rain_forward(p, kind="log1p", eps=0.1, mu=0.0, sd=1.0) -> Column:
    return (stretch(col(p), kind, eps) - mu) / sd


def rain_inverse(y, kind="log1p", eps=0.1, mu=0.0, sd=1.0) -> Column:
    return unstretch(col(y) * sd + mu, kind, eps)


def channel_forward(value, channel, spec=None, eps=0.1) -> Column:
    """Per-channel predictor transform; channels outside the spec pass through."""
    value, channel = col(value), col(channel)
    out = value
    for name, kind in (CHANNEL_KINDS if spec is None else spec).items():
        if kind != "none":
            out = F.when(channel == name, stretch(value, kind, eps)).otherwise(out)
    return out


def channel_inverse(value, channel, spec=None, eps=0.1) -> Column:
    value, channel = col(value), col(channel)
    out = value
    for name, kind in (CHANNEL_KINDS if spec is None else spec).items():
        if kind != "none":
            out = F.when(channel == name, unstretch(value, kind, eps)).otherwise(out)
    return out


def residual_encode(target, base, mean, std) -> Column:
    return (col(target) - col(base) - mean) / std


def residual_decode(code, base, mean, std) -> Column:
    return col(code) * std + mean + col(base)


def residual_fill(mean, std) -> Column:
    """Code of a zero residual, used where the target is missing."""
    return -mean / std


def standardize(x, mu, sd) -> Column:
    return (col(x) - mu) / sd


def unstandardize(x, mu, sd) -> Column:
    return col(x) * sd + mu


# ---- geometry -------------------------------------------------------------

def haversine_km(lat1, lon1, lat2, lon2, radius: float = EARTH_KM) -> Column:
    p1, p2 = F.radians(col(lat1)), F.radians(col(lat2))
    half_lat = F.sin((p2 - p1) / 2)
    half_lon = F.sin((F.radians(col(lon2)) - F.radians(col(lon1))) / 2)
    a = half_lat * half_lat + F.cos(p1) * F.cos(p2) * half_lon * half_lon
    return F.asin(F.sqrt(clip(a, 0, 1))) * (2.0 * radius)


def tangent_km(lat1, lon1, lat2, lon2) -> Column:
    """Local-tangent distance about the first point, 111 km per degree."""
    dy = col(lat2) - col(lat1)
    dx = F.cos(F.radians(col(lat1))) * (col(lon2) - col(lon1))
    return F.sqrt(dy * dy + dx * dx) * 111.0


def gaspari_cohn(distance, support) -> Column:
    """Compact fifth-order taper, zero from the support distance outward."""
    r = col(distance) * 2.0 / support

    def poly(*coefs):
        out = F.lit(float(coefs[-1]))
        for c in reversed(coefs[:-1]):
            out = out * r + F.lit(float(c))
        return out

    near = poly(1, 0, -5 / 3, 5 / 8, 1 / 2, -1 / 4)
    far = poly(4, -5, 5 / 3, 5 / 8, -1 / 2, 1 / 12) - F.lit(2.0) / (r * 3.0)
    return clip(F.when(r <= 1, near).when(r < 2, far).when(r >= 2, F.lit(0.0)), 0, 1)


def cell_area_m2(lat_south, lat_north, dlon_deg) -> Column:
    band = F.sin(F.radians(col(lat_north))) - F.sin(F.radians(col(lat_south)))
    return band * F.radians(F.lit(dlon_deg) if isinstance(dlon_deg, float) else col(dlon_deg)) * (EARTH_M ** 2)


def wrap_longitude(lon) -> Column:
    lon = col(lon)
    return F.when(lon > 180, lon - 360.0).otherwise(lon)


def nearest_index(coord, origin: float, step: float) -> Column:
    """Index of the nearest centre on a regular axis."""
    return F.floor((col(coord) - origin) / step + 0.5).cast("int")


# ---- calendar -------------------------------------------------------------

def season(date) -> Column:
    """DJF, MAM, JJAS, ON: May closes the pre-monsoon, June opens the monsoon."""
    m = F.month(col(date))
    return (
        F.when(m.isin(12, 1, 2), "DJF").when(m.isin(3, 4, 5), "MAM")
        .when(m.isin(6, 7, 8, 9), "JJAS").otherwise("ON")
    )


def month_stratum(date) -> Column:
    return F.date_format(col(date), "'M'MM")


def seasonal_angle(date) -> Column:
    return (F.dayofyear(col(date)) - 1) * (2.0 * math.pi / 365.25)


def year_split(date, train, val, test) -> Column:
    y = F.year(col(date))
    return (
        F.when(y.between(*train), "train").when(y.between(*val), "val").when(y.between(*test), "test")
    )


def confirmatory_day(date) -> Column:
    """Daily confirmatory sample leaves out the ten tuning days of May 2022."""
    d = col(date)
    return ~d.between(F.lit("2022-05-01").cast("date"), F.lit("2022-05-10").cast("date"))


def confirmatory_month(date) -> Column:
    return F.date_format(col(date), "yyyy-MM") != "2022-05"


def confirmatory_year(date) -> Column:
    return F.year(col(date)) != 2022


# ---- error models and verdicts --------------------------------------------

def secant_variance(p, err, rep=0.0, floor=1e-4, kind="log1p", eps=0.1, mu=0.0, sd=1.0) -> Column:
    """Physical error of an amount restated as a variance in transformed units."""
    up = rain_forward(col(p) + col(err), kind, eps, mu, sd)
    down = rain_forward(clip(col(p) - col(err), 0), kind, eps, mu, sd)
    s = clip(F.abs(up - down) * 0.5, floor)
    return s * s + rep * rep


def intensity_variance(p, floor=0.30, slope=0.15, largest=1.5) -> Column:
    s = clip(F.log1p(clip(p, 0)) * slope + floor, floor, largest)
    return s * s


def verdict_envelope(value, low, high) -> Column:
    v, lo, hi = col(value), col(low), col(high)
    known = v.isNotNull() & lo.isNotNull() & hi.isNotNull()
    return F.when(~known, "n/a").when(v < lo, "BELOW").when(v > hi, "ABOVE").otherwise("inside")


def verdict_interval(low, high) -> Column:
    return F.when(col(low) > 0, "worse").when(col(high) < 0, "better").otherwise("unresolved")


def jensen_inflation(spread) -> Column:
    return F.exp(col(spread) * col(spread) / 2)


def jensen_implied_mean(median, spread) -> Column:
    return col(median) * jensen_inflation(spread)


def jensen_spread_for(mean, median) -> Column:
    r = ratio(col(mean), col(median))
    return F.when(r >= 1, F.sqrt(F.log(r) * 2))


def percent_reduction(reference, value) -> Column:
    return ratio((col(reference) - col(value)) * 100.0, col(reference))


def directional_change(metric, before, after) -> Column:
    """Positive is better: bias by magnitude, coverage by distance to 0.90, correlation in points."""
    metric, a, b = col(metric), col(before), col(after)
    miss_a, miss_b = F.abs(a - 0.90), F.abs(b - 0.90)
    return (
        F.when(metric == "bias", percent_reduction(F.abs(a), F.abs(b)))
        .when(metric == "coverage", percent_reduction(miss_a, miss_b))
        .when(metric == "correlation", (b - a) * 100.0)
        .otherwise(percent_reduction(a, b))
    )


def json_path(doc, path: str, default=None) -> Column:
    v = F.get_json_object(col(doc), path)
    return v if default is None else F.coalesce(v, F.lit(default))


def binned_sigma(value, edges, sigmas, fallback: float) -> Column:
    """Sigma fitted per intensity bin; unmeasured bins use the fallback."""
    v = F.coalesce(col(value), F.lit(0.0))
    out = F.lit(fallback if sigmas[-1] is None else float(sigmas[-1]))
    for edge, s in reversed(list(zip(edges[1:-1], sigmas[:-1]))):
        out = F.when(v < edge, F.lit(fallback if s is None else float(s))).otherwise(out)
    return out


def stream_variance(stream, sigmas: dict, rep: float) -> Column:
    """sigma squared plus representativeness squared for each observation stream."""
    out = F.lit(None).cast("double")
    for name, s in sigmas.items():
        out = F.when(col(stream) == name, F.lit(s * s + rep * rep)).otherwise(out)
    return out
