"""Vector functions as column expressions; everything is computed in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_DIMENSIONS = 32


def _total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def norm(v: Column) -> Column:
    return F.sqrt(_total(F.transform(doubles(v), lambda x: x * x)))


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def cosine(a: Column, b: Column) -> Column:
    """Inner product over the norms; null for a zero vector."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def unit(v: Column) -> Column:
    """The vector at length 1.  A zero vector is an error.  The norm is computed once, not for each component."""
    pair = F.array(F.struct(doubles(v).alias("v"), norm(v).alias("n")))
    scaled = F.transform(
        pair,
        lambda p: F.when(p["n"] == 0, F.raise_error(F.lit("zero vectors cannot be normalized")).cast("array<double>")).otherwise(
            F.transform(p["v"], lambda x: x / p["n"])
        ),
    )
    return F.get(scaled, F.lit(0))


def project(v: Column, dimensions: int) -> Column:
    """The first ``dimensions`` components, at length 1 again."""
    if dimensions < MIN_DIMENSIONS:
        raise ValueError(f"dimensions must be at least {MIN_DIMENSIONS}")
    fits = F.when(
        F.size(v) < dimensions, F.raise_error(F.lit(f"fewer than {dimensions} dimensions")).cast(f"array<double>")
    ).otherwise(F.slice(doubles(v), 1, dimensions))
    return unit(fits)


def is_finite(v: Column) -> Column:
    """Whether all components are numbers; a null component is none."""
    return ~F.exists(doubles(v), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def last_token(hidden: Column, mask: Column, batch_left_padded: Column) -> Column:
    """The hidden state of the last token.

    If every row of a batch ends in a token, the last position is taken, else in each row the
    position of as many tokens as the mask has: the choice belongs to the batch, not to the row.
    """
    tokens = F.aggregate(mask, F.lit(0), lambda s, x: s + x)
    return F.when(batch_left_padded, F.element_at(hidden, -1)).otherwise(F.get(hidden, tokens - 1))
