"""Vectors: hashed bags of tokens, products, and vectors kept as JSON text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

DIMENSION = 128


def bucket(token: Column, dimension: int = DIMENSION) -> Column:
    return (F.conv(F.substring(F.md5(F.encode(token, "UTF-8")), 1, 8), 16, 10).cast("long") % dimension).cast("int")


def buckets(tokens: Column, dimension: int = DIMENSION) -> Column:
    """The bucket of each token: a hashed bag of tokens, kept as the list of its hits."""
    return F.transform(tokens, lambda t: bucket(t, dimension))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once."""
    return F.transform(F.array(value), use)[0]


def bag(tokens: Column, dimension: int = DIMENSION) -> Column:
    """The non-zero places of a hashed bag of tokens: structs of bucket and n, by bucket, from one sort of the row's buckets."""

    def counted(held: Column) -> Column:
        ends = lambda kinds: F.transform(kinds, lambda b: F.array_position(held, b))
        n = lambda first, i: F.coalesce(F.get(first, i + 1), F.size(held) + 1) - F.get(first, i)
        return let(F.array_distinct(held), lambda kinds: let(ends(kinds), lambda first: F.transform(kinds, lambda b, i: F.struct(b.alias("bucket"), n(first, i).alias("n")))))

    return let(F.array_sort(buckets(tokens, dimension)), counted)


def dense(counts: Column, dimension: int = DIMENSION) -> Column:
    """A bag as a vector of unit length; of zeros where it is empty."""
    size = F.sqrt(bag_dot(counts, counts))
    place = lambda c, i: F.coalesce(F.get(F.filter(c, lambda x: x["bucket"] == i), F.lit(0))["n"], F.lit(0)).cast("double")
    return let(size, lambda s: F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: F.when(s > 0, place(counts, i) / s).otherwise(0.0)))


def bag_dot(a: Column, b: Column) -> Column:
    """Product of two bags: at most as many steps as either has places. Both must be plain columns, as they are read often."""
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x["n"] * F.coalesce(F.get(F.filter(b, lambda y: y["bucket"] == x["bucket"]), F.lit(0))["n"], F.lit(0)))


def bag_cosine(a: Column, b: Column) -> Column:
    """0 where either bag is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), bag_dot(a, b) / F.sqrt(bag_dot(a, a) * bag_dot(b, b))).otherwise(0.0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def from_json(text: Column) -> Column:
    return F.from_json(text, "array<double>")


def right_dimension(vector: Column, dimension: Column) -> Column:
    return F.size(vector) == dimension
