"""Standard normal distribution as column expressions (no Python UDF, no erf in Spark SQL).

Φ uses Hart's double-precision rational approximation (algorithm 5666, as published by
G. West, "Better approximations to cumulative normal functions", 2005); Φ⁻¹ of constants is
taken from the standard library on the driver.  The same text renders for Spark and DuckDB.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, functions as F

# Coefficients of Hart's algorithm 5666 (numerator, then denominator), highest
# power first, and the switch point and constants of its tail continued fraction.
_P = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
      112.079291497871, 221.213596169931, 220.206867912376)
_Q = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
      296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
_SWITCH = 7.07106781186547
_SQRT_2PI = 2.506628274631


def _horner(coefs, x: str) -> str:
    s = repr(coefs[0])
    for c in coefs[1:]:
        s = f"({s}) * {x} + {c!r}"
    return s


def norm_cdf_sql(x: str) -> str:
    ax = f"abs({x})"
    e = f"exp(-{ax} * {ax} / 2.0)"
    near = f"({e} * ({_horner(_P, ax)}) / ({_horner(_Q, ax)}))"
    far = f"({e} / ({ax} + 1.0 / ({ax} + 2.0 / ({ax} + 3.0 / ({ax} + 4.0 / ({ax} + 0.65))))) / {_SQRT_2PI})"
    tail = f"(CASE WHEN {ax} > 37.0 THEN 0.0 WHEN {ax} < {_SWITCH} THEN {near} ELSE {far} END)"
    return f"(CASE WHEN ({x}) IS NULL THEN NULL WHEN ({x}) > 0 THEN 1.0 - {tail} ELSE {tail} END)"


def norm_cdf(col: Column | str) -> Column:
    """Φ(x) as a Spark column expression (JVM-side, codegen; common subexpressions are shared)."""
    return _expr_on(F.col(col) if isinstance(col, str) else col)


def _expr_on(x: Column) -> Column:
    ax = F.abs(x)
    e = F.exp(-ax * ax / 2.0)

    def horner(coefs):
        s = F.lit(coefs[0])
        for k in coefs[1:]:
            s = s * ax + F.lit(k)
        return s

    near = e * horner(_P) / horner(_Q)
    far = e / (ax + 1.0 / (ax + 2.0 / (ax + 3.0 / (ax + 4.0 / (ax + 0.65))))) / _SQRT_2PI
    tail = F.when(ax > 37.0, F.lit(0.0)).when(ax < _SWITCH, near).otherwise(far)
    return F.when(x.isNull(), F.lit(None)).when(x > 0, 1.0 - tail).otherwise(tail)


def norm_ppf(p: float) -> float:
    """Φ⁻¹ of a constant (driver side)."""
    return NormalDist().inv_cdf(p)


def norm_cdf_py(x: float) -> float:
    ax = abs(x)
    if ax > 37:
        t = 0.0
    else:
        e = __import__("math").exp(-ax * ax / 2)
        if ax < _SWITCH:
            num = 0.0
            for k in _P:
                num = num * ax + k
            den = 0.0
            for k in _Q:
                den = den * ax + k
            t = e * num / den
        else:
            t = e / (ax + 1 / (ax + 2 / (ax + 3 / (ax + 4 / (ax + 0.65))))) / _SQRT_2PI
    return 1 - t if x > 0 else t
