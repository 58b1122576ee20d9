"""BM25: plain Python values and Columns share the formulas."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def idf(df: float, n: float) -> float:
    return math.log((n - df + 0.5) / (df + 0.5) + 1)


def average_length(tokens: float, rows: float) -> float:
    return tokens / rows if rows else 0.0


def score(tf: float, length: float, average: float, df: float, n: float) -> float:
    return idf(df, n) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average)) if average else 0.0


def score_column(tf: Column, length: Column, average: float, df: float, n: float) -> Column:
    """score() with the corpus statistics as literals; 0 where the term is absent."""
    if not average:
        return F.lit(0.0)
    return F.when(tf > 0, F.lit(idf(df, n) * (K1 + 1)) * tf / (tf + F.lit(K1) * (F.lit(1 - B) + F.lit(B / average) * length))).otherwise(F.lit(0.0))


def score_sql_columns(tf: Column, length: Column, average: Column, df: Column, n: Column) -> Column:
    """score() with every value a Column."""
    inverse = F.log((n - df + 0.5) / (df + 0.5) + 1)
    return inverse * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))
