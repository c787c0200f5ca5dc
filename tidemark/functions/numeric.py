"""Guarded arithmetic. ANSI mode raises on division by zero and on constant correlation,
while the semantics here ask for NULL."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

TRADING_DAYS = 252
DAYS_PER_YEAR = 365.25


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else (x if isinstance(x, Column) else F.lit(x))


def ratio(a, b) -> Column:
    """a / b, NULL when b is 0."""
    return F.try_divide(c(a).cast("double"), c(b).cast("double"))


def positive_ratio(a, b) -> Column:
    """a / b, NULL unless b > 0."""
    return F.when(c(b) > 0, ratio(a, b))


def change(new, old) -> Column:
    """new / old - 1, NULL when old is 0."""
    return ratio(new, old) - F.lit(1.0)


def corr_of(x, y) -> Column:
    """Pearson correlation aggregate; NULL below two pairs or without variance."""
    both = c(x).isNotNull() & c(y).isNotNull()
    xs, ys = F.when(both, c(x).cast("double")), F.when(both, c(y).cast("double"))
    spread = F.var_pop(xs) * F.var_pop(ys)
    return F.when((F.count(xs) >= 2) & (spread > 0), F.try_divide(F.covar_pop(xs, ys), F.sqrt(spread)))


def fallback_zero(adjusted, raw) -> Column:
    """Adjusted value, or the raw one when the adjusted is NULL or 0."""
    return F.coalesce(F.nullif(c(adjusted), F.lit(0.0)), c(raw))


def fallback_null(adjusted, raw) -> Column:
    """Adjusted value, or the raw one only when the adjusted is NULL."""
    return F.coalesce(c(adjusted), c(raw))


def finite(x) -> Column:
    """x, or NULL when it is NaN or infinite."""
    v = c(x).cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), v)


def running_product(x, over) -> Column:
    """Product of a column over a window, from logarithms; zeros and signs are counted beside them. NULLs are passed over."""
    v = c(x).cast("double")
    size = F.exp(F.coalesce(F.sum(F.when(v != 0, F.ln(F.abs(v)))).over(over), F.lit(0.0)))
    negative, zeros = F.count_if(v < 0).over(over), F.count_if(v == 0).over(over)
    return F.when(zeros > 0, F.lit(0.0)).when(negative % 2 == 1, -size).otherwise(size)


def running_log(x, over) -> Column:
    """Logarithm of :func:`running_product`, also where the product leaves the range of a double; NULL where it is not positive."""
    v = c(x).cast("double")
    size = F.coalesce(F.sum(F.when(v != 0, F.ln(F.abs(v)))).over(over), F.lit(0.0))
    negative, zeros = F.count_if(v < 0).over(over), F.count_if(v == 0).over(over)
    return F.when((zeros == 0) & (negative % 2 == 0), size)


def volatility(ret) -> Column:
    """Annualised sample volatility aggregate of a return column (NULL below two)."""
    return F.stddev_samp(c(ret)) * F.sqrt(F.lit(float(TRADING_DAYS)))


def average_rank(value, *partition: str) -> Column:
    """Rank from 1, ties share the mean of their places. The partition is one cross-section."""
    by_value = Window.partitionBy(*partition).orderBy(c(value))
    same = Window.partitionBy(*partition, c(value))
    return F.rank().over(by_value) + (F.count(F.lit(1)).over(same) - 1) / F.lit(2.0)


def nearest_rank(values: Column, q: float) -> Column:
    """ceil(q*n)-th smallest element of an array (at least the first)."""
    place = F.greatest(F.lit(1), F.ceil(F.size(values) * F.lit(q)).cast("int"))
    return F.try_element_at(F.array_sort(values), place)


def rounded_index(values: Column, q: float) -> Column:
    """Element of the sorted array at round(q*(n-1)), rounding half to even."""
    place = F.bround(F.lit(q) * (F.size(values) - 1), 0).cast("int")
    n = F.size(values)
    place = F.greatest(F.lit(0), F.least(place, n - 1))
    return F.try_element_at(F.array_sort(values), place + 1)
