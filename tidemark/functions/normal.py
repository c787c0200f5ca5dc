"""The normal distribution and its inverse as rational approximations, in column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.numeric import c

# fixed values: published coefficients, highest power first
CDF_TOP = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
CDF_BOTTOM = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
CDF_FAR = 7.07106781186547
MIDDLE_TOP = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
MIDDLE_BOTTOM = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
TAIL_TOP = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
TAIL_BOTTOM = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
TAIL = 0.02425


def _poly(factors: Sequence[float], x: Column) -> Column:
    out = F.lit(factors[0])
    for f in factors[1:]:
        out = out * x + F.lit(f)
    return out


def _bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x computed once: a lambda's argument is a value, where a column would be written out at each use."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def normal_cdf(z) -> Column:
    def upper(x: Column) -> Column:
        far = x + 0.65
        for k in (4, 3, 2, 1):
            far = x + k / far
        share = F.when(x < CDF_FAR, _poly(CDF_TOP, x) / _poly(CDF_BOTTOM, x)).otherwise(1.0 / (far * math.sqrt(2 * math.pi)))
        return F.exp(-x * x / 2) * share

    return _bound(c(z).cast("double"), lambda v: F.when(v > 0, 1.0 - _bound(F.abs(v), upper)).otherwise(_bound(F.abs(v), upper)))


def normal_quantile(p) -> Column:
    """The z whose :func:`normal_cdf` is p; NULL outside (0, 1). One Newton step follows the approximation."""
    tail = lambda q: _bound(F.sqrt(-2.0 * F.ln(q)), lambda t: _poly(TAIL_TOP, t) / _poly(TAIL_BOTTOM, t))
    middle = lambda d: _bound(d * d, lambda r: d * _poly(MIDDLE_TOP, r) / _poly(MIDDLE_BOTTOM, r))

    def of(p: Column) -> Column:
        first = F.when(p < TAIL, tail(p)).when(p > 1 - TAIL, -tail(1 - p)).otherwise(middle(p - 0.5))
        better = _bound(first, lambda x: x - (normal_cdf(x) - p) * math.sqrt(2 * math.pi) * F.exp(x * x / 2))
        return F.when((p > 0) & (p < 1), better)

    return _bound(c(p).cast("double"), of)
