"""Distribution functions as columns, and their scalar forms for fits on the driver."""

from __future__ import annotations

import functools
import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_lgamma = np.vectorize(math.lgamma, otypes=[float])


# Cody's rational approximations (1969) of erf up to 0.5 and of erfc up to 4 and beyond, numerators and
# denominators, highest power first.
_ERF = (1.85777706184603153e-1, 3.16112374387056560, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3), (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3)
_ERFC = (
    (2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594, 6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3),
    (1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3, 3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3),
)
_TAIL = (1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4), (1.0, 2.56852019228982242, 1.87295284992346725, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3)


def normal_cdf(x: Column | str, mean: Column | str, sd: Column | str) -> Column:
    """Normal distribution function as a column expression of some forty products; absolute error below 1e-15."""
    col = lambda c: F.col(c) if isinstance(c, str) else c

    def ratio(parts: tuple[tuple[float, ...], ...], y: Column) -> Column:
        above, below = (functools.reduce(lambda acc, k: acc * y + k, p[1:], F.lit(p[0])) for p in parts)
        return above / below

    u = (col(x) - col(mean)) / col(sd) / math.sqrt(2)
    y, square = F.abs(u), u * u
    inverse = 1 / F.greatest(square, F.lit(16.0))
    far = F.exp(-square) / F.greatest(y, F.lit(4.0)) * (1 / math.sqrt(math.pi) - inverse * ratio(_TAIL, inverse))
    tail = F.when(y <= 4, F.exp(-square) * ratio(_ERFC, F.least(y, F.lit(4.0)))).otherwise(far) / 2
    return F.when(y <= 0.5, 0.5 + u * ratio(_ERF, F.least(square, F.lit(0.25))) / 2).when(u > 0, 1 - tail).otherwise(tail)


def log_gamma(z: Column) -> Column:
    """ln gamma for z > 0 by Stirling's series at z + 8; absolute error below 1e-11."""
    y = z + 8
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * F.pow(y, F.lit(3.0))) + 1 / (1260 * F.pow(y, F.lit(5.0)))
    for k in range(8):
        series = series - F.log(z + k)
    return series


def nb_pmf(k: np.ndarray, size: float, mean: float) -> np.ndarray:
    """Negative binomial probabilities of counts; success probability size / (size + mean)."""
    p = min(max(size / (size + mean), 1e-300), 1 - 1e-16)
    return np.exp(_lgamma(k + size) - _lgamma(k + 1.0) - math.lgamma(size) + size * math.log(p) + k * math.log1p(-p))


def nb_median(size: float, mean: float) -> int:
    """Smallest count whose cumulative probability reaches a half."""
    total, k = 0.0, 0
    p = size / (size + mean)
    term = math.exp(size * math.log(max(p, 1e-300)))
    while total + term < 0.5 and k < 10_000_000:
        total += term
        term *= (k + size) / (k + 1) * (1 - p)
        k += 1
    return k
