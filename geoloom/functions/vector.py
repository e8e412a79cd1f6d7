"""Expressions over array columns that hold one vector per row."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-9


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(a), F.lit(0.0), lambda s, x: s + x * x))


def is_nodata(v: Column) -> Column:
    """A patch that holds zeros only was never computed."""
    return ~F.exists(v, lambda x: x != 0)


def l2_normalize(v: Column) -> Column:
    """F7."""
    n = norm(v)
    return F.transform(doubles(v), lambda x: x / (n + EPS))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / ((norm(a) + EPS) * (norm(b) + EPS))


def cosine01(v: Column, q: Column) -> Column:
    """F8. Cosine scaled to [0, 1]; a nodata patch scores 0; other lengths are an error."""
    checked = F.when(F.size(v) == F.size(q), (cosine(v, q) + 1) / 2).otherwise(
        F.raise_error(F.lit("query and patch vectors differ in length")).cast("double"))
    return F.when(is_nodata(v), 0.0).otherwise(checked)


def cosine_distance(a: Column, b: Column) -> Column:
    """F9."""
    return 1 - cosine(a, b)


def softmax(logits: Column, scale: float = 1.0) -> Column:
    """F10."""
    top = F.array_max(logits)
    ex = F.transform(logits, lambda x: F.exp((x - top) * scale))
    total = F.aggregate(ex, F.lit(0.0), lambda s, x: s + x)
    return F.transform(ex, lambda x: x / total)


def argmax(v: Column) -> Column:
    """0-based position of the largest value, the first one on ties."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def linear_head(v: Column, weights: Column, bias: Column) -> Column:
    """F11. One score per row of ``weights``."""
    return F.zip_with(F.transform(weights, lambda w: dot(w, v)), bias, lambda x, b: x + b)


def normalize_range(x: Column, lo: float, hi: float) -> Column:
    """F12."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x - lo) / (hi - lo)))


def denormalize(x: Column, lo: float, hi: float) -> Column:
    """F12, inverse."""
    return x * (hi - lo) + lo


def quantize_int8(v: Column, nodata: Column) -> Column:
    """F13. Signed square root scaled to 127; -128 in every band of a nodata patch."""
    def one(x: Column) -> Column:
        q = F.bround(F.signum(x) * F.sqrt(F.abs(x)) * 127)
        return F.least(F.lit(127.0), F.greatest(F.lit(-127.0), q)).cast("tinyint")

    blank = F.transform(v, lambda x: F.lit(-128).cast("tinyint"))
    return F.when(nodata, blank).otherwise(F.transform(doubles(v), one))


def dequantize_int8(q: Column) -> Column:
    """F13, inverse; null where the patch is nodata."""
    back = F.transform(q, lambda x: F.signum(x.cast("double")) * F.pow(x.cast("double") / 127, 2))
    return F.when(F.exists(q, lambda x: x == -128), F.lit(None).cast("array<double>")).otherwise(back)


def mean_vector(v: Column) -> Column:
    """D17, D18. Element-wise mean as an aggregate; no row per element is made."""
    return vector_to_array(Summarizer.mean(array_to_vector(doubles(v))))
