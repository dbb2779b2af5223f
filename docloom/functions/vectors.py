"""Vector arithmetic on array columns and the deterministic stand-in encoder."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.config import DEFAULT
from docloom.functions import fixed_values as fv
from docloom.functions.text import strip
from docloom.session import let


def as_double(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(vector), F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(vector: Column) -> Column:
    """Unit vector; a zero vector fails the query."""
    return let(
        as_double(vector),
        lambda v: let(
            l2_norm(v),
            lambda n: F.when(
                n == 0, F.raise_error(F.lit("cannot normalise a zero vector")).cast("array<double>")
            ).otherwise(F.transform(v, lambda x: x / n)),
        ),
    )


def is_unit(vector: Column, tolerance: float = DEFAULT.unit_tolerance) -> Column:
    return (F.size(vector) > 0) & (F.abs(l2_norm(vector) - 1.0) < tolerance)


def cosine_distance(unit_a: Column, unit_b: Column) -> Column:
    return F.lit(1.0) - dot(unit_a, unit_b)


def similarity(distance: Column) -> Column:
    return F.greatest(F.lit(0.0), F.lit(1.0) - distance)


def _prefixed(text: Column, prefix: str) -> Column:
    return let(
        strip(text),
        lambda t: F.when(t.startswith(prefix), t).otherwise(F.concat(F.lit(prefix), t)),
    )


def passage_input(text: Column) -> Column:
    return _prefixed(text, fv.PASSAGE_PREFIX)


def query_input(text: Column) -> Column:
    return _prefixed(text, fv.QUERY_PREFIX)


def _digest_vector(text: str, dimension: int) -> np.ndarray:
    seed, blocks = hashlib.sha256(text.encode("utf-8")).digest(), []
    for _ in range(-(-dimension // 32)):
        blocks.append(seed)
        seed = hashlib.sha256(seed).digest()
    return np.frombuffer(b"".join(blocks), dtype=np.uint8)[:dimension] / 127.5 - 1.0


def digest_encoder(dimension: int = DEFAULT.embedding_dimension):
    """Offline encoder: a vector read off the iterated sha256 of the input."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def encode(text: pd.Series) -> pd.Series:
        return text.map(lambda t: _digest_vector(t, dimension))

    return encode
