"""Scalar column expressions shared by all operators. Everything here stays inside codegen."""

from __future__ import annotations

import math

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR = 3600
DAY = 86400


def epoch_s(ts: str | Column) -> Column:
    """Whole epoch seconds of a (zone-less or UTC) timestamp column."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_seconds(c.cast("timestamp"))


def bucket(ts: str | Column, width: int) -> Column:
    """Index of the fixed-width bucket that holds ``ts``."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(c / F.lit(width)).cast("long")


def day_of(ts: str | Column) -> Column:
    return bucket(ts, DAY) * F.lit(DAY)


def month_of(ts: str | Column) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.date_format(F.timestamp_seconds(c), "yyyy-MM")


def round_half_up(x: Column) -> Column:
    """Nearest integer, halves towards +infinity."""
    return F.floor(x + F.lit(0.5)).cast("long")


def round_scaled(x: Column, digits: int) -> Column:
    """Rounded as DuckDB does: the scaled double to its nearest integer, halves away from zero, scaled back.

    Spark's ``round`` goes by the decimal text, so it differs where a tie such as 0.0628125 scales to just below one half.
    """
    scale = F.lit(10.0 ** digits)
    return F.round(x * scale) / scale


def ieee_divide(x: Column, y: Column) -> Column:
    """x / y of doubles where a division by zero gives NaN or an infinity, as in DuckDB, not an error or null."""
    return F.when(y == 0, x * F.lit(math.inf)).otherwise(F.try_divide(x, y))


def signif(x: Column, digits: int) -> Column:
    """Round to ``digits`` significant digits; zero stays zero, null stays null."""
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, F.lit(0.0)).otherwise(F.floor(F.abs(x) * scale + F.lit(0.5)) / scale * F.signum(x))


def band(x: Column, edges: Sequence[float]) -> Column:
    """Index of the first edge above ``x`` (an edge belongs to the band above it)."""
    out = F.lit(len(edges))
    for i in range(len(edges) - 1, -1, -1):
        out = F.when(x < F.lit(float(edges[i])), F.lit(i)).otherwise(out)
    return F.when(x.isNotNull(), out).cast("int")


def half_of(t: Column, split: int) -> Column:
    return F.when(t < F.lit(split), F.lit("FIT")).otherwise(F.lit("JUDGE"))


def era_of(t: Column, starts: Sequence[tuple[int, str]], before: str = "pre") -> Column:
    """Name of the last era whose start is at or before ``t``."""
    out = F.lit(before)
    for start, name in sorted(starts):
        out = F.when(t >= F.lit(start), F.lit(name)).otherwise(out)
    return out


def float32(x: Column) -> Column:
    """The value as it survives in single precision, back in double."""
    return x.cast("float").cast("double")


def hash_u32(*parts: Column | str | int) -> Column:
    """Deterministic 32-bit draw from an md5 of the joined parts; any SQL engine can repeat it."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    text = F.concat_ws("|", *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def hash_unit(*parts: Column | str | int) -> Column:
    """Deterministic draw in [0, 1)."""
    return hash_u32(*parts) / F.lit(4294967296.0)


def poisson1(u: Column) -> Column:
    """Poisson(1) count by inversion of a uniform draw; the tail above 7 has mass 1e-5 and maps to 8."""
    # fixed values: cumulative Poisson(1) probabilities for 0..7
    cdf = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462,
           0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253]
    out = F.lit(8)
    for i in range(len(cdf) - 1, -1, -1):
        out = F.when(u < F.lit(cdf[i]), F.lit(i)).otherwise(out)
    return out


#: Terms of the two expansions of the normal tail; at their meeting point both are exact to about 1e-12.
SERIES, FRACTION = 34, 60


def _half_tail(x2: Column, x: Column) -> Column:
    """Half of erfc(x) for x >= 0, with a small relative error: a power series below 2, a continued fraction beyond."""
    down = lambda n: F.array(*[F.lit(float(k)) for k in range(n, 0, -1)])  # from the innermost term outwards
    series = F.aggregate(down(SERIES), F.lit(1.0), lambda a, k: F.lit(1.0) + a * x2 * F.lit(2.0) / (F.lit(2.0) * k + F.lit(1.0)))
    fraction = F.aggregate(down(FRACTION), F.lit(1.0), lambda a, k: F.lit(1.0) + k / (F.lit(2.0) * x2 * a))
    root = math.sqrt(math.pi)
    return F.when(x < 2, F.lit(0.5) - F.exp(-x2) * x * series / F.lit(root)).otherwise(F.exp(-x2) / (x * F.lit(2 * root)) / fraction)


def normal_sf(z: Column) -> Column:
    """Upper tail of the standard normal distribution, accurate in relative terms far into the tail."""
    x2 = z * z / F.lit(2.0)
    half = _half_tail(x2, F.abs(z) / F.lit(math.sqrt(2.0)))
    return F.when(z >= 0, half).otherwise(F.lit(1.0) - half)


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function."""
    return normal_sf(-z)


def static_fee(pips: Column, dynamic_marker: int = 8388608) -> Column:
    """Fee share from pips; the dynamic marker and anything at or above 100 % has no static fee."""
    return F.when((pips >= 0) & (pips < 1_000_000) & (pips != dynamic_marker), pips / F.lit(1e6))


def monotone_bucket(x: Column) -> Column:
    """Order-preserving integer bucket of a double, about 1 % wide at every scale."""
    mag = F.floor(F.lit(64.0) * F.log2(F.greatest(F.abs(x), F.lit(1e-300)))).cast("long") + F.lit(70000)
    return F.when(x > 0, mag).when(x < 0, -mag).otherwise(F.lit(0).cast("long"))
