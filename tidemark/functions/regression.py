"""Least squares from sums: Spark aggregates the cross products, and the small system is solved in column expressions.

The matrix of products is symmetric and positive, so it is eliminated along its diagonal, as Cholesky's method does,
without exchange of rows. What is left of the last row's corner is the residual sum of squares.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.numeric import c

SINGULAR = 1e-13  #: share of its diagonal term below which a pivot counts as none
MATRIX = "array<array<double>>"


def gram_sums(y, xs: Sequence) -> Column:
    """Flat upper triangle of sums over (1, x..., y) products; k = len(xs) + 2 columns."""
    cols = [F.lit(1.0), *[c(x).cast("double") for x in xs], c(y).cast("double")]
    return F.array(*[F.sum(a * b) for i, a in enumerate(cols) for b in cols[i:]])


def _size(flat: Column) -> Column:
    return F.round((F.sqrt(8 * F.size(flat) + 1) - 1) / 2).cast("int")


def _entry(flat: Column, i: Column, j: Column) -> Column:
    low, high = F.least(i, j), F.greatest(i, j)
    return F.get(flat, (low * _size(flat) - low * (low - 1) / 2 + high - low).cast("int"))


def _eliminated(flat: Column, ridge: Column) -> Column:
    """The matrix after all rows but the last have been used as pivots; NULL where a pivot vanishes or a sum is missing."""
    last = _size(flat) - 1
    places = F.sequence(F.lit(0), last)
    own = lambda i: _entry(flat, i, i) + F.when(i < last, ridge).otherwise(0.0)
    start = F.transform(places, lambda i: F.transform(places, lambda j: F.when(i == j, own(i)).otherwise(_entry(flat, i, j))))

    def use(matrix: Column, p: Column) -> Column:
        pivot = F.get(F.get(matrix, p), p)
        less = lambda row: F.zip_with(row, F.get(matrix, p), lambda x, y: x - F.get(row, p) / pivot * y)
        return F.when(pivot > SINGULAR * own(p), F.transform(matrix, lambda row, i: F.when(i == p, row).otherwise(less(row)))).cast(MATRIX)

    return F.aggregate(F.sequence(F.lit(0), last - 1), start.cast(MATRIX), use)


def r_squared(sums) -> Column:
    """R squared from a ``gram_sums`` column; NULL when singular or without variance."""
    flat = c(sums)
    last = _size(flat) - 1
    total = F.get(flat, F.size(flat) - 1) - F.get(flat, last) * F.get(flat, last) / F.get(flat, F.lit(0))
    residual = F.get(F.get(_eliminated(flat, F.lit(0.0)), last), last)
    return F.when(total != 0, 1.0 - F.try_divide(residual, total))


def coefficients(sums, ridge=0.0) -> Column:
    """Coefficient array, intercept first, from a ``gram_sums`` column. The ridge is added to every diagonal term but that of y."""
    flat = c(sums)
    last = _size(flat) - 1
    solved = _eliminated(flat, c(ridge).cast("double"))
    return F.transform(F.slice(solved, 1, last), lambda row, i: F.get(row, last) / F.get(row, i))
