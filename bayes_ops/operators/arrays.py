"""Array expressions over the cells of one group, held in one row.

A density on the cells of a group is an array column: no row per cell, no
exchange and no window.  ``let`` binds a value that lambdas use more than once
(a column used inside a lambda would be computed again for every element).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

HDI_PROB = 0.94


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), body)[0]


def total(xs: Column, f: Callable[[Column], Column] = lambda x: x) -> Column:
    """Sum of f over an array."""
    return F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + f(x))


def normalised(xs: Column, lp: Callable[[Column], Column], build: Callable[[Column, Column], Column]) -> Column:
    """``build(x, weight)`` of every element, weights exp(lp) / sum.  The greatest lp is taken off first, so
    the weights add up to one however large the log densities are."""
    return let(F.array_max(F.transform(xs, lp)), lambda top: let(total(xs, lambda x: F.exp(lp(x) - top)), lambda s: F.transform(
        xs, lambda x: build(x, F.exp(lp(x) - top) / s))))


def running(xs: Column) -> Column:
    """Running sums of an array of doubles, a leading 0 first."""
    return F.aggregate(xs, F.array(F.lit(0.0)), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x))


def edge_cdf(m: Column) -> Column:
    """CDF at the n + 1 cell edges from the density at the n cell middles (any scale).

    Midpoint sums with their first Euler-Maclaurin term, m'(edge) / 24 from the cells on
    both sides, so the error falls with the fourth power of the cell width."""
    n = F.size(m)

    def corrected(cum):
        return F.transform(cum, lambda c, i: F.when((i == 0) | (i == n), c).otherwise(
            c + (F.get(m, i) - F.get(m, i - 1)) / 24.0) / F.element_at(cum, -1))
    return let(running(m), corrected)


def quantile_at(cdf: Column, q: Column) -> Column:
    """Position (in cells, from 0) where an edge CDF reaches q; within the cell the density is a line
    whose slope is that between the cells on both sides."""
    # edges at or below q: the CDF rises, so they come first
    k = F.aggregate(cdf, F.lit(0), lambda acc, c: acc + F.when(c <= q, 1).otherwise(0))

    def inside(i):
        lo, hi = F.get(cdf, i), F.get(cdf, i + 1)
        before, after = lo - F.get(cdf, i - 1), F.get(cdf, i + 2) - hi
        bend = F.coalesce((after - before) / (4.0 * (hi - lo)), F.lit(0.0))
        p = (q - lo) / (hi - lo)
        return i + F.when(hi > lo, p + bend * p * (1.0 - p)).otherwise(0.0)
    return let(F.least(F.greatest(k - 1, F.lit(0)), F.size(cdf) - 2), inside)


def _density_at(f: Column, u: Column) -> Column:
    """Density at a position in cells, linear between cell middles."""
    def at(v):
        return let(F.least(F.greatest(F.floor(v), F.lit(0)), F.size(f) - 2).cast("int"),
                   lambda i: F.get(f, i) + (v - i) * (F.get(f, i + 1) - F.get(f, i)))
    return let(u - 0.5, at)


def narrowest(f: Column, cdf: Column, prob: float = HDI_PROB, steps: int = 30) -> Column:
    """[lower, upper] positions (in cells) of the narrowest interval holding ``prob`` of a density with
    one peak: the tail below it is bisected until the density is the same at both ends.

    ``f``: density in x at the cell middles, ``cdf``: at the edges."""
    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0 - prob).alias("hi"))

    def halve(acc, _):
        return let((acc["lo"] + acc["hi"]) / 2, lambda q: F.when(
            _density_at(f, quantile_at(cdf, q)) < _density_at(f, quantile_at(cdf, q + prob)),
            F.struct(q.alias("lo"), acc["hi"].alias("hi"))).otherwise(F.struct(acc["lo"].alias("lo"), q.alias("hi"))))
    ends = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda acc: (acc["lo"] + acc["hi"]) / 2)
    return let(ends, lambda q: F.array(quantile_at(cdf, q), quantile_at(cdf, q + prob)))
