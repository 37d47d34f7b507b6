"""Normal and t probabilities: vectorised column functions, and quantiles as constants."""

from __future__ import annotations

import math
from functools import reduce
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def norm_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2.0))


def norm_ppf(p: float) -> float:
    """Quantile of a parameter; the ends are infinite."""
    if p <= 0.0:
        return -math.inf
    if p >= 1.0:
        return math.inf
    return NormalDist().inv_cdf(p)


# Wichura's rational approximations of the normal quantile (AS 241, PPND16), numerator and
# denominator by falling powers, for the middle (in 0.180625 - q^2), the tails and the far tails.
PPND_MIDDLE = (
    (2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457,
     13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.387132872796366608),
    (5226.495278852854561, 28729.085735721942674, 39307.89580009271061, 21213.794301586595867,
     5394.1960214247511077, 687.1870074920579083, 42.313330701600911252, 1.0),
)
PPND_TAIL = (
    (7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177, 1.27045825245236838258,
     3.64784832476320460504, 5.7694972214606914055, 4.6303378461565452959, 1.42343711074968357734),
    (1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966, 0.14810397642748007459,
     0.68976733498510000455, 1.6763848301838038494, 2.05319162663775882187, 1.0),
)
PPND_FAR = (
    (2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.2426609473880784386e-3, 0.026532189526576123093,
     0.29656057182850489123, 1.7848265399172913358, 5.4637849111641143699, 6.6579046435011037772),
    (2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5, 7.868691311456132591e-4,
     0.0148753612908506148525, 0.13692988092273580531, 0.59983220655588793769, 1.0),
)


def _rational(table: tuple[tuple[float, ...], tuple[float, ...]], x: Column) -> Column:
    top, below = (reduce(lambda acc, c: acc * x + F.lit(c), cs[1:], F.lit(cs[0])) for cs in table)
    return top / below


def norm_ppf_column(p: Column) -> Column:
    """Quantile of each row's probability, an expression; the ends are infinite, outside is NULL."""
    q = p - 0.5
    middle = _rational(PPND_MIDDLE, 0.180625 - q * q) * q
    root = F.sqrt(-F.ln(F.when(F.least(p, 1 - p) > 0, F.least(p, 1 - p))))
    tail = F.signum(q) * F.when(root <= 5, _rational(PPND_TAIL, root - 1.6)).otherwise(_rational(PPND_FAR, root - 5.0))
    ends = F.when(p == 0, F.lit(-math.inf)).when(p == 1, F.lit(math.inf))
    return F.when(F.abs(q) <= 0.425, middle).when((p > 0) & (p < 1), tail).otherwise(ends)


@F.pandas_udf(T.DoubleType())
def norm_cdf_column(z: pd.Series) -> pd.Series:
    """Spark has no erf; one value per series or run passes through here."""
    return z.map(norm_cdf, na_action="ignore")


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by the modified Lentz method."""
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(abs(1.0 - (a + b) * x / (a + 1.0)), tiny)
    out = d
    for m in range(1, 1_000_000):  # about sqrt(a + b) terms; ends by the test below
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / (c if abs(c) > tiny else tiny)
            out *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return out


def t_two_sided(t: float, df: float) -> float:
    """Probability of a larger absolute value under Student's t with ``df`` degrees."""
    a, b, x = df / 2.0, 0.5, df / (df + t * t)
    if x >= 1.0:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


@F.pandas_udf(T.DoubleType())
def t_two_sided_column(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) else t_two_sided(a, b) for a, b in zip(t, df)], dtype="float64")
