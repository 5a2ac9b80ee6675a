"""Array-column functions for embeddings."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from plantgauge.functions.draws import uniform


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: lambda bodies are interpreted
    and recompute whatever expression is written inside them."""
    return F.transform(F.array(value), use)[0]


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def unit(v: Column) -> Column:
    """L2-normalised; the norm is floored at 1e-10."""
    return let(F.greatest(norm(v), F.lit(1e-10)), lambda size: F.transform(v, lambda x: x / size))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def softmax(z: Column, temperature: Column | float = 1.0) -> Column:
    """Softmax of z/T, T floored at 0.01."""
    t = F.greatest(F.lit(0.01), temperature if isinstance(temperature, Column) else F.lit(float(temperature)))

    def from_logits(v):
        powers = let(F.array_max(v), lambda top: F.transform(v, lambda x: F.exp((x - top) / t)))
        return let(powers, lambda e: let(total(e), lambda whole: F.transform(e, lambda x: x / whole)))

    return let(z, from_logits)


def neg_log_likelihood(z: Column, true_index: Column, temperature: Column) -> Column:
    """-log softmax(z/T)[true_index], with a 0-based class index."""

    def loss(top):
        whole = F.aggregate(z, F.lit(0.0), lambda a, x: a + F.exp((x - top) / temperature))
        return F.log(whole) - (F.element_at(z, (true_index + 1).cast("int")) - top) / temperature

    return let(F.array_max(z), loss)


def argmax(v: Column) -> Column:
    """0-based index of the first maximum."""
    return F.array_position(v, F.array_max(v)).cast("int") - 1


def scaled(v: Column, factor: Column | float) -> Column:
    return F.transform(v, lambda x: x * factor)


def contrasted(v: Column, factor: Column | float) -> Column:
    """Stretch about the row mean."""
    return let(total(v) / F.size(v), lambda mean: F.transform(v, lambda x: mean + (x - mean) * factor))


def smoothed(v: Column, radius: int) -> Column:
    """Moving average over 2*radius+1 neighbours, fewer at the ends."""
    return F.transform(
        v,
        lambda x, i: F.aggregate(
            F.slice(v, F.greatest(i - radius, F.lit(0)) + 1, radius * 2 + 1 - F.greatest(radius - i, F.lit(0))),
            F.lit(0.0),
            lambda a, y: a + y,
        )
        / (F.least(i + radius, F.size(v) - 1) - F.greatest(i - radius, F.lit(0)) + 1),
    )


def rotated(v: Column, places: Column | int) -> Column:
    """Cyclic shift to the left."""
    k = places if isinstance(places, Column) else F.lit(places)
    return F.concat(F.slice(v, k + 1, F.size(v) - k), F.slice(v, F.lit(1), k))


def noisy(v: Column, key: Column, sigma: Column | float, tag: str = "noise") -> Column:
    """Add normal noise; the draw of each element follows from (key, position)."""
    sd = sigma if isinstance(sigma, Column) else F.lit(float(sigma))

    def add(x, i):
        u1 = F.lit(1.0) - uniform(key, i, tag, "a")
        u2 = uniform(key, i, tag, "b")
        return x + sd * F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)

    return F.transform(v, add)
