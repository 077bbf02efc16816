"""Vector arithmetic over array<float> columns, in double precision. A null operand gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _d(x: Column) -> Column:
    return x.cast("double")


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: _d(x) * _d(y)))


def l2_norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: _d(x) * _d(x))))


def normalize(a: Column) -> Column:
    """Unit vector; a zero vector is null."""
    return F.when(l2_norm(a) > 0, F.transform(F.transform(F.array(F.struct(a.alias("v"), l2_norm(a).alias("n"))), lambda s: F.transform(s["v"], lambda x: _d(x) / s["n"]))[0], lambda x: x))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (_d(x) - _d(y)) * (_d(x) - _d(y)))))


def l1(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: F.abs(_d(x) - _d(y))))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is zero."""
    return F.try_divide(dot(a, b), l2_norm(a) * l2_norm(b))


def quantized(a: Column) -> Column:
    """Struct of int8 values (max |x| becomes 127, half away from zero), their scale, and squared norm."""
    top = F.array_max(F.transform(a, lambda x: F.abs(_d(x))))
    scale = F.when(top <= 1e-8, F.lit(1.0)).otherwise(top / 127)
    parts = F.array(F.struct(a.alias("v"), scale.alias("s")))
    q = lambda p: F.transform(p["v"], lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.round(_d(x) / p["s"]))).cast("tinyint"))
    return F.transform(parts, lambda p: F.struct(q(p).alias("q"), p["s"].alias("scale"), (_sum(F.transform(q(p), lambda x: _d(x) * _d(x))) * p["s"] * p["s"]).alias("norm2")))[0]


def quantized_dot(a: Column, b: Column) -> Column:
    """Inner product of two quantized vectors."""
    return dot(a["q"], b["q"]) * a["scale"] * b["scale"]
