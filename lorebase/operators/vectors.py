"""Vector arithmetic as higher-order functions, and a deterministic embedding."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def total(v: str | Column) -> Column:
    return F.aggregate(col(v), F.lit(0.0), lambda s, x: s + x.cast("double"))


def l2(a: str | Column, b: str | Column) -> Column:
    """Euclidean distance in doubles."""
    squares = F.zip_with(col(a), col(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def padded(v: str | Column, dimension: int) -> Column:
    """Zeros up to the dimension; longer or non-finite vectors are errors."""
    x = col(v)
    bad = (F.size(x) > dimension) | F.exists(x, lambda e: F.isnan(e) | (F.abs(e) == float("inf")))
    zero = F.array_repeat(F.lit(0.0).cast("float"), F.greatest(F.lit(0), dimension - F.size(x)))
    return F.when(bad, F.raise_error(F.lit("vector too long or not finite"))).otherwise(F.concat(x.cast("array<float>"), zero))


def fixed(v: str | Column, dimension: int, truncate: bool = True) -> Column:
    """The first values where the model allows cutting, zeros behind shorter ones."""
    x = F.slice(col(v), 1, dimension) if truncate else col(v)
    return padded(x, dimension)


def hashed_vector(text: str, dimension: int = 1536) -> list[float]:
    """Words add to fifteen places found from the sum of their characters, less by position; unit length."""
    v = [0.0] * dimension
    for i, w in enumerate(text.lower().split()):
        base = sum(map(ord, w)) % 100 * 15
        for j in range(15):
            v[(base + j) % dimension] += 1 / (i + 1)
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v] if n else v


def hashed(rows: DataFrame, id_col: str, text_col: str, dimension: int = 1536) -> DataFrame:
    """(id, embedding) by :func:`hashed_vector`."""
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([hashed_vector(x or "", dimension) for x in b.column(1).to_pylist()], pa.list_(pa.float32()))], names=[id_col, "embedding"])

    return rows.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, embedding array<float>")
