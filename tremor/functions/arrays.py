"""Signal features as expressions over array columns; no Python runs per row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(x: Column, f=lambda v: v) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + f(v))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value computed once, not for each element of the lambdas that use it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def mean(x: Column) -> Column:
    return F.when(F.size(x) > 0, _sum(x) / F.size(x))


def central_moment(x: Column, mu: Column, k: int) -> Column:
    return _sum(x, lambda v: F.pow(v - mu, F.lit(k))) / F.size(x)


def rms(x: Column) -> Column:
    return F.sqrt(_sum(x, lambda v: v * v) / F.size(x))


def peak(x: Column) -> Column:
    return F.array_max(F.transform(x, F.abs))


def crest(x: Column) -> Column:
    """Peak over RMS, 0 for silence."""
    return F.when(rms(x) > 0, peak(x) / rms(x)).otherwise(0.0)


def impulse(x: Column) -> Column:
    """Peak over mean absolute value, 0 for silence."""
    level = _sum(x, F.abs) / F.size(x)
    return F.when(level > 0, peak(x) / level).otherwise(0.0)


def skewness(x: Column, mu: Column) -> Column:
    """Bias-corrected skewness, null for fewer than 3 values or none that differ."""
    n, m2, m3 = F.size(x), central_moment(x, mu, 2), central_moment(x, mu, 3)
    return F.when((n > 2) & (m2 > 0), m3 / F.pow(m2, F.lit(1.5)) * F.sqrt(n * (n - 1.0)) / (n - 2))


def kurtosis(x: Column, mu: Column) -> Column:
    """Bias-corrected Pearson kurtosis (3 for a normal distribution), null for fewer than 4 values or none that differ."""
    n, m2, m4 = F.size(x), central_moment(x, mu, 2), central_moment(x, mu, 4)
    return F.when((n > 3) & (m2 > 0), ((F.pow(n, F.lit(2)) - 1) * m4 / (m2 * m2) - 3 * F.pow(n - 1, F.lit(2))) / ((n - 2) * (n - 3)) + 3)


def zero_crossing_rate(x: Column) -> Column:
    """Sign changes between neighbours that are both not zero, over the number of neighbours."""
    pairs = F.zip_with(F.slice(x, 1, F.size(x) - 1), F.slice(x, 2, F.size(x) - 1), lambda a, b: a * b < 0)
    return F.when(F.size(x) > 1, F.size(F.filter(pairs, lambda c: c)) / (F.size(x) - 1)).otherwise(0.0)


def windows(x: Column, width: int, hop: int) -> Column:
    """Windows of a signal; a last one, aligned to the end, where samples remain. A short signal is one window."""
    n = F.size(x)
    starts = F.sequence(F.lit(0), F.greatest(n - width, F.lit(0)), F.lit(hop))
    all_starts = F.array_distinct(F.concat(starts, F.array(F.greatest(n - width, F.lit(0)))))
    return F.transform(all_starts, lambda s: F.slice(x, s + 1, F.lit(width)))


def quantile(x: Column, q: float) -> Column:
    """Linear interpolation between the order statistics."""
    return _let(F.array_sort(x), lambda s: _sorted_quantile(s, q))


def _sorted_quantile(s: Column, q: float) -> Column:
    place = (F.size(s) - 1) * F.lit(q)
    low = F.floor(place).cast("int")
    below = F.try_element_at(s, low + 1)
    return below + (place - low) * (F.try_element_at(s, F.least(low + 2, F.size(s))) - below)


def robust_scale(x: Column, floor: float = 1e-9) -> Column:
    """The largest of scaled median absolute deviation, scaled interquartile range and floor."""
    deviations = lambda m: F.transform(x, lambda v: F.abs(v - m))
    spread = _let(quantile(x, 0.5), lambda m: 1.4826 * quantile(deviations(m), 0.5))
    between = _let(F.array_sort(x), lambda s: (_sorted_quantile(s, 0.75) - _sorted_quantile(s, 0.25)) / 1.349)
    return F.greatest(spread, between, F.lit(floor))


def energy_entropy(x: Column) -> Column:
    """Entropy of the shares of energy, in nats."""
    entropy = lambda e: -_sum(x, lambda v: F.when(v != 0, v * v / e * F.log(v * v / e)).otherwise(0.0))
    return _let(_sum(x, lambda v: v * v), lambda e: F.when(e > 0, entropy(e)).otherwise(0.0))


def autocorrelation(x: Column, mu: Column, lag: int = 1) -> Column:
    parts = F.zip_with(F.slice(x, 1, F.size(x) - lag), F.slice(x, lag + 1, F.size(x) - lag), lambda a, b: (a - mu) * (b - mu))
    whole = _sum(x, lambda v: F.pow(v - mu, F.lit(2)))
    return F.when(whole > 0, _sum(parts) / whole).otherwise(0.0)


def longest_run(x: Column, level: Column) -> Column:
    """The most values above the level that follow each other."""
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))

    def step(acc: Column, v: Column) -> Column:
        now = F.when(v > level, acc["now"] + 1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(acc["best"], now).alias("best"))

    return F.aggregate(x, start, step, lambda acc: acc["best"])


def quarters(x: Column) -> Column:
    """Four parts of equal size, earlier ones one longer where the number does not divide."""
    n = F.size(x)
    base, more = F.floor(n / 4).cast("int"), n % 4
    return F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.slice(x, k * base + F.least(k, more) + 1, base + (k < more).cast("int")))


def haar(x: Column) -> Column:
    """struct(low, high) of one level of the Haar wavelet; an odd last sample is dropped."""
    half = F.sequence(F.lit(1), F.floor(F.size(x) / 2).cast("int"))
    at = lambda k, d: F.element_at(x, 2 * k - d)
    return F.struct(F.transform(half, lambda k: (at(k, 1) + at(k, 0)) / F.sqrt(F.lit(2.0))).alias("low"), F.transform(half, lambda k: (at(k, 1) - at(k, 0)) / F.sqrt(F.lit(2.0))).alias("high"))


def to_db(power: Column, floor: float = 1e-10, top_db: float = 80.0) -> Column:
    """Decibels below the largest power, cut at top_db."""
    level = lambda p, high: F.greatest(10 * F.log10(F.greatest(p, F.lit(floor)) / high), F.lit(-top_db))
    return _let(F.greatest(F.array_max(power), F.lit(floor)), lambda high: F.transform(power, lambda p: level(p, high)))


def fixed_length(x: Column, n: int) -> Column:
    """Cut at the end or filled with zeros."""
    return F.slice(F.concat(x, F.array_repeat(F.lit(0.0), n)), 1, n)


def decimate(x: Column, step: int) -> Column:
    return F.filter(x, lambda _, i: i % step == 0)


def standardize(x: Column, eps: float = 1e-8) -> Column:
    scaled = lambda mu, sd: F.transform(x, lambda v: (v - mu) / (sd + eps))
    return _let(mean(x), lambda mu: _let(F.sqrt(central_moment(x, mu, 2)), lambda sd: scaled(mu, sd)))
