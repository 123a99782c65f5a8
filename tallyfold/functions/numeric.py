"""Numeric column expressions with the null and zero rules that the features share.

Those that features use hundreds of times are SQL text, as columns that are made call by call take longer to build than to run.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_div(a: str, b: str) -> str:
    """SQL of a / max(b, 1e-6); null where either is null."""
    return f"CAST({a} AS double) / CASE WHEN {b} IS NOT NULL THEN greatest(CAST({b} AS double), 1e-6D) END"


def log1p0(x: Column) -> Column:
    """log(1 + max(x, 0)); null stays null."""
    return F.when(x.isNotNull(), F.log1p(F.greatest(x.cast("double"), F.lit(0.0))))


def expm1_0(x: Column) -> Column:
    """exp(max(x, 0)) - 1, the way back from a predicted logarithm."""
    return F.when(x.isNotNull(), F.expm1(F.greatest(x.cast("double"), F.lit(0.0))))


def filled(x: str) -> str:
    """SQL of 0 for null, NaN and infinite values."""
    # NaN is greater than any number, and null is no comparison.
    return f"CASE WHEN abs(CAST({x} AS double)) < CAST('Infinity' AS double) THEN CAST({x} AS double) ELSE 0D END"


def rounded(x: str, places: int) -> str:
    """SQL of the number x rounded half away from zero: Spark's ``round`` goes through a decimal's digits, which takes longer than making a feature.

    A number too large for its product with the power of ten to have halves needs only the product's own rounding.
    """
    scale, most = f"{10**places}D", f"{4e15 / 10**places!r}D"
    return f"CASE WHEN {x} >= 0D AND {x} < {most} THEN floor({x} * {scale} + 0.5D) / {scale} WHEN {x} < 0D AND {x} > -{most} THEN -floor(0.5D - {x} * {scale}) / {scale} ELSE rint({x} * {scale}) / {scale} END"


def lgamma(x: Column) -> Column:
    """Logarithm of the gamma function for x > 0: Stirling's series after a shift by eight."""
    shift = sum((F.log(x + i) for i in range(1, 8)), F.log(x))
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + series - shift


def digamma(x: Column) -> Column:
    """Derivative of :func:`lgamma` for x > 0, by the series' derivative after the same shift."""
    shift = sum((1 / (x + i) for i in range(1, 8)), 1 / x)
    y = x + 8
    return F.log(y) - 1 / (2 * y) - 1 / (12 * y**2) + 1 / (120 * y**4) - 1 / (252 * y**6) + 1 / (240 * y**8) - shift


def trigamma(x: Column) -> Column:
    """Derivative of :func:`digamma` for x > 0."""
    shift = sum((1 / (x + i) ** 2 for i in range(1, 8)), 1 / x**2)
    y = x + 8
    return 1 / y + 1 / (2 * y**2) + 1 / (6 * y**3) - 1 / (30 * y**5) + 1 / (42 * y**7) - 1 / (30 * y**9) + shift
