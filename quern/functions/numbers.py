"""Numeric expressions: rounding, ratios, intervals, prices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(value: Column, digits: int) -> Column:
    """Rounds the binary product towards positive infinity at the half: floor(v 10^d + 0.5) / 10^d."""
    f = float(10**digits)
    return F.floor(value * f + 0.5) / f


def clamp(value: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def ratio(part: Column, whole: Column, empty: float | None) -> Column:
    """part / whole as a double; `empty` where the whole is 0."""
    return F.when(whole == 0, F.lit(empty).cast("double")).otherwise(part.cast("double") / F.when(whole != 0, whole).cast("double"))


#: z of a two-sided 95 % interval.
Z95 = 1.959963984540054


def wilson(successes: Column, total: Column, upper: bool) -> Column:
    """Bound of the Wilson interval; 1 without observations."""
    n, p = F.when(total > 0, total).cast("double"), successes.cast("double") / F.when(total > 0, total).cast("double")
    z2 = Z95 * Z95
    middle = (p + z2 / (2 * n)) / (1 + z2 / n)
    spread = Z95 * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return F.coalesce(clamp(middle + spread if upper else middle - spread, 0.0, 1.0), F.lit(1.0))


def resolve_price(catalog: Column, operation: Column, model: Column, fallback: Column) -> Column:
    """The most special entry of a map from 'operation:model', either of them '*'; local models cost nothing."""
    keys = [F.concat(operation, F.lit(":"), model), F.concat(operation, F.lit(":*")), F.concat(F.lit("*:"), model), F.lit("*:*")]
    return F.when(model.startswith("local-"), F.lit(0.0)).otherwise(F.coalesce(*(F.try_element_at(catalog, k) for k in keys), fallback))


def call_cost(price_in: Column, price_out: Column, tokens_in: Column, tokens_out: Column) -> Column:
    """US dollars, from prices a million tokens."""
    return (tokens_in * price_in + tokens_out * price_out) / F.lit(1_000_000.0)


def backoff_ms(attempt: Column, cap: int = 60_000) -> Column:
    """1, 2, 4 ... seconds from the first attempt on, up to a cap."""
    return F.least(F.lit(float(cap)), F.lit(1000.0) * F.pow(F.lit(2.0), F.greatest(F.lit(0), attempt - 1).cast("double"))).cast("long")


def image_tokens(width: Column, height: Column) -> Column:
    """170 for each 512 by 512 tile begun and 85 more, at least 256; 1024 where a side is unknown or 0."""
    tiles = F.ceil(width / 512) * F.ceil(height / 512)
    known = F.coalesce((width > 0) & (height > 0), F.lit(False))
    return F.when(known, F.greatest(F.lit(256), tiles * 170 + 85)).otherwise(F.lit(1024)).cast("long")


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)
