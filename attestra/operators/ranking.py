"""Top-k, scaling and fusion within groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int | None = None, name: str = "rank") -> DataFrame:
    """Rank within groups from 1; with ``k`` each task keeps its best k of a group before the shuffle.

    The order must be total, or ties are broken arbitrarily.
    """
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked if k is None else ranked.where(F.col(name) <= k)


def minmax(df: DataFrame, by: list[str], columns: list[str], least: float = 1e-8, prefix: str = "mm_") -> DataFrame:
    """``mm_x`` in 0..1 within each group, 0 throughout where the range is below ``least``.

    The bounds come from a pre-aggregated group-by joined back, so a hot group is never sorted or held in one task.
    """
    bounds = df.groupBy(*by).agg(*(f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))))
    out = df.join(bounds, by)
    for c in columns:
        lo, hi = F.col(f"__lo_{c}"), F.col(f"__hi_{c}")
        out = out.withColumn(prefix + c, F.when(hi - lo < least, 0.0).otherwise((F.col(c) - lo) / (hi - lo)))
    return out.drop(*(f"__{n}_{c}" for c in columns for n in ("lo", "hi")))


def zscore(df: DataFrame, by: list[str], column: str, name: str) -> DataFrame:
    """Standardised with the population deviation; 0 where that is below 1e-12."""
    stats = df.groupBy(*by).agg(F.avg(column).alias("__m"), F.stddev_pop(column).alias("__s"))
    return df.join(stats, by).withColumn(name, F.when(F.col("__s") < 1e-12, 0.0).otherwise((F.col(column) - F.col("__m")) / F.col("__s"))).drop("__m", "__s")


def hybrid(df: DataFrame, by: list[str], weights: dict[str, float], name: str = "hybrid") -> DataFrame:
    """Weighted sum of min-max scaled scores, rounded to 9 places so that equal scores tie alike everywhere."""
    scaled = minmax(df, by, list(weights))
    total = F.lit(0.0)
    for c, w in weights.items():
        total = total + w * F.col(f"mm_{c}")
    return scaled.withColumn(name, F.round(total, 9))


def rrf(routes: DataFrame, by: list[str], key: str, route: str, rank: str, score: str, idx: str, weight: Column | float = 1.0, k: int = 60, keep: dict[str, str] | None = None) -> DataFrame:
    """Reciprocal rank fusion: ``rrf, max_score, hits, idx`` per group and key; ``idx`` is that of the best-scored entry,
    ``keep`` the greatest value of further columns by their new names."""
    w = weight if isinstance(weight, Column) else F.lit(float(weight))
    return routes.groupBy(*by, key).agg(
        F.round(F.sum(w / (k + F.col(rank))), 9).alias("rrf"),
        F.max(score).alias("max_score"),
        F.count_distinct(route).alias("hits"),
        F.max_by(idx, F.struct(F.col(score), -F.col(idx))).alias("idx"),
        *(F.max(c).alias(n) for n, c in (keep or {}).items()),
    )
