"""Functions over short arrays that hold the last rows of a series, oldest first.

They take and give SQL expression text, as those in ``histogram``.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from ..config import EWMA_ALPHA, MAD_FLOOR, MAD_SCALE, Z_MIN_ROWS

_names = count()


def bind(value: str, body: Callable[[str], str]) -> str:
    """Evaluate ``value`` once and use it several times in ``body``."""
    name = f"v{next(_names)}"
    return f"get(transform(array({value}), {name} -> {body(name)}), 0)"


def last_rows(values: str, k: int) -> str:
    return f"slice({values}, greatest(size({values}) - {k - 1}, 1), {k})"


def finite_only(values: str) -> str:
    return f"filter({values}, x -> NOT isnan(x) AND abs(x) < DOUBLE('Infinity'))"


def median(values: str) -> str:
    """Median of an array, null if it is empty."""

    def middle(ordered: str) -> str:
        low = f"get({ordered}, CAST((size({ordered}) - 1) DIV 2 AS INT))"
        high = f"get({ordered}, CAST(size({ordered}) DIV 2 AS INT))"
        return f"({low} + {high}) / 2"

    return bind(f"sort_array({values})", middle)


def percentile(values: str, q: float) -> str:
    """Percentile with linear interpolation between neighbours, null if empty."""

    def interpolate(ordered: str) -> str:
        position = f"((size({ordered}) - 1) * {float(q)!r}D)"
        low = f"get({ordered}, CAST(floor({position}) AS INT))"
        high = f"get({ordered}, CAST(ceil({position}) AS INT))"
        return f"{low} + ({high} - {low}) * ({position} - floor({position}))"

    return f"IF(size({values}) > 0, {bind(f'sort_array({values})', interpolate)}, NULL)"


def robust_z(values: str, current: str, rows: int) -> str:
    """Distance of ``current`` from the median of the last rows, in scaled MAD units."""

    def score(recent: str) -> str:
        def with_median(mid: str) -> str:
            mad = median(f"transform({recent}, x -> abs(x - {mid}))")
            floor = bind(mad, lambda m: f"IF({m} > 0, {m}, {MAD_FLOOR!r}D)")
            return f"({current} - {mid}) / ({floor} * {MAD_SCALE!r}D)"

        return f"IF(size({recent}) >= {Z_MIN_ROWS}, {bind(median(recent), with_median)}, 0D)"

    return bind(last_rows(values, rows), score)


def std_pop(values: str) -> str:
    """Population standard deviation, 0 for fewer than two values."""

    def spread(mean: str) -> str:
        squares = f"aggregate({values}, 0D, (acc, x) -> acc + (x - {mean}) * (x - {mean}))"
        return f"sqrt({squares} / size({values}))"

    mean = f"aggregate({values}, 0D, (acc, x) -> acc + x) / size({values})"
    return f"IF(size({values}) >= 2, {bind(mean, spread)}, 0D)"


def slope(values: str) -> str:
    """Least-squares slope against 0, 1, 2, …; 0 for fewer than two values."""
    n = f"size({values})"
    weights = f"transform({values}, (y, i) -> y * (i - ({n} - 1) / 2))"
    top = f"aggregate({weights}, 0D, (acc, x) -> acc + x)"
    return f"IF({n} >= 2, {top} * 12 / ({n} * ({n} * {n} - 1)), 0D)"


def ewma(values: str, alpha: float = EWMA_ALPHA) -> str:
    """Exponential average that starts at the first value."""
    step = f"coalesce(x * {alpha!r}D + acc * {1.0 - alpha!r}D, x)"
    return f"aggregate({values}, CAST(NULL AS DOUBLE), (acc, x) -> {step})"


def trailing_run(flags: str) -> str:
    """Length of the run of true values at the end of a boolean array."""
    gap = f"array_position(reverse({flags}), false)"
    return f"CAST(IF({gap} > 0, {gap} - 1, size({flags})) AS INT)"
