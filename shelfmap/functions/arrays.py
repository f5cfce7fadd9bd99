"""Array-column math (G4, F6, F7, F8) as higher-order built-in expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, fn) -> Column:
    """Evaluate ``value`` once and hand it to ``fn`` as a lambda variable.

    Catalyst inlines a sub-expression used inside a lambda, so e.g. the sum
    in ``transform(a, x -> x / sum(a))`` would be recomputed per element; a
    one-element ``transform`` binds it once instead.
    """
    return F.element_at(F.transform(F.array(value), fn), 1)


def arr_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def normalize_sum(a: Column) -> Column:
    """Scale an array to sum 1."""
    return let(a, lambda v: let(arr_sum(v), lambda t: F.transform(v, lambda x: x / t)))


def js_distance(a: Column, b: Column) -> Column:
    """Jensen-Shannon distance, inputs normalised to sum 1, natural log, square root."""
    p, q = normalize_sum(a), normalize_sum(b)

    def kl_half(x, y):
        m = (x + y) / 2.0
        return F.when(x > 0, x * F.log(x / m)).otherwise(F.lit(0.0))

    terms = F.zip_with(p, q, lambda x, y: kl_half(x, y) + kl_half(y, x))
    return F.sqrt(F.greatest(arr_sum(terms) / 2.0, F.lit(0.0)))


def minmax_scale(a: Column) -> Column:
    """``(x - min) / (max - min)``; a constant array becomes zeros."""
    def scale(v):
        return let(F.struct(F.array_min(v).alias("lo"), F.array_max(v).alias("hi")), lambda m: F.when(
            m["hi"] == m["lo"], F.transform(v, lambda x: F.lit(0.0))).otherwise(
            F.transform(v, lambda x: (x - m["lo"]) / (m["hi"] - m["lo"]))))
    return let(a, scale)


def gaussian_weights(fwhm: float = 2.0, truncate: float = 4.0, normalized: bool = True) -> list[float]:
    """F7 kernel: sigma from the full width at half maximum, radius ``int(truncate*sigma+0.5)``.

    ``exp(-k^2 / (2 sigma^2))`` equals ``2 ** (-4 k^2 / fwhm^2)``; written that
    way the FWHM-2 kernel is exactly ``1, 1/2, 1/16, 1/512`` in binary.
    """
    sigma = fwhm / (2.0 * math.sqrt(2.0 * math.log(2.0)))
    radius = int(truncate * sigma + 0.5)
    raw = [2.0 ** (-4.0 * k * k / (fwhm * fwhm)) for k in range(-radius, radius + 1)]
    if not normalized:
        return raw
    total = sum(raw)
    return [w / total for w in raw]


def gaussian_blur(a: Column, fwhm: float = 2.0, normalized: bool = True) -> Column:
    """1-D Gaussian filter over the flat array, edges mirrored (``d c b a | a b c d``).

    ``normalized=False`` skips the division by the kernel sum; use it when a
    scale-invariant step (min-max) follows, so sums of integer counts stay exact.
    """
    weights = gaussian_weights(fwhm, normalized=normalized)
    r = len(weights) // 2
    w = F.array(*[F.lit(x) for x in weights])

    def blur(v):
        n = F.size(v)

        def reflect(j):
            m = F.pmod(j, 2 * n)
            return F.when(m < n, m).otherwise(2 * n - 1 - m)

        return F.transform(v, lambda _, i: F.aggregate(
            F.sequence(F.lit(-r), F.lit(r)), F.lit(0.0),
            lambda s, k: s + F.element_at(w, k + r + 1) * F.element_at(v, reflect(i + k) + 1)))

    return let(a, blur)


def explode_indexed(a: Column, index: str = "i", value: str = "v") -> Column:
    """Rows ``(index, value)`` from an array: ``inline`` of ``(i, x)`` structs.

    Measured ~7x faster than ``posexplode`` when the array is a computed
    expression (the collapsed projection is otherwise re-evaluated).
    """
    return F.inline(F.transform(a, lambda x, i: F.struct(i.alias(index), x.alias(value))))


def explode_values(a: Column, name: str) -> Column:
    """One row per element (``explode``), as ``inline`` of one-field structs.

    On computed arrays (regex tokens, n-grams, parsed JSON) this measured
    ~4x faster than ``explode`` in Spark 4.1 at sf0.1.
    """
    return F.inline(F.transform(a, lambda x: F.struct(x.alias(name))))
