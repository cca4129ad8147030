"""Rounding that both sides of a comparison use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.functions import scalar as S

PLACES = 6


def rounded(df: DataFrame, places: int = PLACES) -> DataFrame:
    """All doubles rounded, so that the order of a sum doesn't show."""
    return df.select(*(S.rounded(F.col(c), places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def r(expression: str, places: int = PLACES) -> str:
    """The same in SQL; adding 0.0 turns a negative zero into zero."""
    return f"(round({expression}, {places}) + 0.0)"
