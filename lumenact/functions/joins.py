"""Joins in which a null key matches a null key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def match(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, null equal to null; the keys appear once, as on the left.

    Which side is broadcast is left to the optimizer and its size limits.
    """
    rest = [c for c in right.columns if c not in keys]
    other = right.select(*[F.col(k).alias(f"_right_{k}") for k in keys], *rest)
    same = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    joined = left.join(other, reduce(lambda a, b: a & b, same), how)
    return joined.drop(*[f"_right_{k}" for k in keys])
