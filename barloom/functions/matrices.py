"""Small dense matrices as arrays of rows, worked on by array folds inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY = "array<double>"
#: A pivot below this share of its diagonal entry counts as zero.
SINGULAR = 1e-14


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with `value` worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def square(flat: Column, k: int) -> Column:
    """Rows of a k x k matrix out of its entries, row by row."""
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.slice(flat, i * k + 1, k))


def times(matrix: Column, vector: Column) -> Column:
    return F.transform(matrix, lambda row: dot(row, vector))


def cholesky(matrix: Column) -> Column:
    """Lower factor of a symmetric matrix, rows of growing length; its entries are NULL from a pivot on that isn't positive."""

    def row(done: Column, r: Column) -> Column:
        def entry(z: Column, j: Column) -> Column:
            other = F.get(done, j)
            left = F.get(r, j) - dot(z, F.slice(other, 1, F.size(z)))
            pivot = F.get(r, j) - dot(z, z)
            above = left / F.get(other, j)
            return F.when(j < F.size(done), above).when(pivot > F.abs(F.get(r, j)) * SINGULAR, F.sqrt(pivot))

        steps = F.sequence(F.lit(0), F.size(done))
        return F.aggregate(steps, F.array().cast(EMPTY), lambda z, j: F.array_append(z, entry(z, j)))

    return F.aggregate(matrix, F.array().cast(f"array<{EMPTY}>"), lambda done, r: F.array_append(done, row(done, r)))


def solve(factor: Column, b: Column) -> Column:
    """x with L L' x = b for a lower factor L; NULL entries where L has some."""

    def down(z: Column, row: Column) -> Column:
        at = F.size(z)
        return F.array_append(z, (F.get(b, at) - dot(z, F.slice(row, 1, at))) / F.get(row, at))

    def up(z: Column) -> Column:
        def step(x: Column, i: Column) -> Column:
            below = F.transform(F.slice(factor, i + 2, F.size(factor)), lambda row: F.get(row, i))
            return F.array_prepend(x, (F.get(z, i) - dot(below, x)) / F.get(F.get(factor, i), i))

        return F.aggregate(F.reverse(F.sequence(F.lit(0), F.size(factor) - 1)), F.array().cast(EMPTY), step)

    return let(F.aggregate(factor, F.array().cast(EMPTY), down), up)


def inverse_of(factor: Column) -> Column:
    """Inverse of the factored matrix, as rows; NULL if the matrix is singular."""

    def unit(j: Column) -> Column:
        return F.transform(factor, lambda row, m: F.when(m == j, 1.0).otherwise(0.0))

    rows = F.transform(F.sequence(F.lit(0), F.size(factor) - 1), lambda j: solve(factor, unit(j)))
    return F.when(~F.exists(factor, lambda row: F.exists(row, lambda x: x.isNull())), rows)


def log_determinant(factor: Column) -> Column:
    return 2 * F.aggregate(factor, F.lit(0.0), lambda a, row: a + F.ln(F.element_at(row, -1)))
