"""Vector arithmetic in double precision, and bits of hexadecimal hashes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


#: Dimensions up to which a dot product is one flat sum in generated code; beyond, its method would be too large.
FLAT = 128


def _sum_of(name: str, n: int, other) -> Column:
    """Sum over i of name[i] times other(i), as one parsed expression."""
    if n <= FLAT:
        return F.expr(" + ".join(f"CAST(get({name}, {i}) AS DOUBLE) * {other(i)}" for i in range(n)) or "0D")
    return F.expr(f"aggregate(zip_with({name}, array({', '.join(map(other, range(n)))}), (x, y) -> CAST(x AS DOUBLE) * y), 0D, (s, x) -> s + x)")


def dot_literal(name: str, query: list[float]) -> Column:
    """Dot product of a column with a bound vector."""
    return _sum_of(name, len(query), lambda i: f"CAST({float(query[i])!r} AS DOUBLE)")


def norm_of(name: str, n: int) -> Column:
    """Norm of a column of n dimensions."""
    return F.sqrt(_sum_of(name, n, lambda i: f"CAST(get({name}, {i}) AS DOUBLE)"))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    n = norm(v)
    return F.when(n > 0, F.transform(doubles(v), lambda x: x / n))


def hamming(a: Column, b: Column) -> Column:
    """Different bits of two 64-bit hashes of 16 hexadecimal digits."""
    as_long = lambda h: F.conv(h, 16, -10).cast("long")
    return F.bit_count(as_long(a).bitwiseXOR(as_long(b)))


def same_direction(a: Column, b: Column) -> Column:
    """Cosine; null where a norm is 0."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)
