"""Numeric column expressions: seeded uniforms, rounding, vectors."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_uniform(*parts: Column | str | int) -> Column:
    """A number in [0, 1) from a key: the first twelve hex digits of the md5 of the parts joined by ``|``.

    The same key gives the same number on any partitioning and in any engine that has md5.
    """
    key = F.concat_ws("|", *[F.lit(str(p)) if isinstance(p, int) else F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("bigint") / F.lit(281474976710656.0)


def hash_normal(*parts: Column | str | int) -> Column:
    """A standard normal number from a key, by Box and Muller over two uniforms."""
    u, v = hash_uniform(*parts, F.lit("u")), hash_uniform(*parts, F.lit("v"))
    return F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - u)) * F.cos(F.lit(2 * pi) * v)


def round_half_even(c: Column, digits: int = 0) -> Column:
    return F.rint(c) if digits == 0 else F.rint(c * F.lit(10.0**digits)) / F.lit(10.0**digits)


def as_doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Dot product over norms; 0 where a norm is 0."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def normalize_vector(v: Column) -> Column:
    """Min-max over one vector: a range of 0 divides by 1."""
    low, high = F.array_min(v), F.array_max(v)
    width = F.when(high == low, F.lit(1.0)).otherwise(high - low)
    return F.transform(v, lambda x: (x - low) / width)
