"""Light learners fitted by aggregates: only sums over all rows reach the driver, one small row per step."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions.text import content_tokens
from attestra.functions.vectors import norm


def _linear(w: dict[str, float], bias: float = 0.0) -> Column:
    z = F.lit(bias)
    for f, x in w.items():
        z = z + x * F.col(f)
    return z


def fit_pairwise(diffs: DataFrame, features: list[str], steps: int = 12, rate: float = 1.0, l2: float = 1e-3, nonnegative: bool = False) -> dict[str, float]:
    """Logistic weights on feature differences (winner less loser), scaled by their root mean square."""
    n, *sq = diffs.agg(F.count("*"), *(F.avg(F.col(f) * F.col(f)) for f in features)).first()
    if not n:
        return dict.fromkeys(features, 0.0)
    scale = {f: math.sqrt(s) or 1.0 for f, s in zip(features, sq)}
    w = dict.fromkeys(features, 0.0)
    for _ in range(steps):
        p = 1 / (1 + F.exp(_linear({f: w[f] / scale[f] for f in features})))
        grad = diffs.agg(*(F.avg(p * F.col(f) / scale[f]) for f in features)).first()
        w = {f: x + rate * (g - l2 * x) for (f, x), g in zip(w.items(), grad)}
        if nonnegative:
            w = {f: max(0.0, x) for f, x in w.items()}
    return {f: w[f] / scale[f] for f in features}


def fit_logistic(rows: DataFrame, features: list[str], label: str, steps: int = 12, rate: float = 2.0, l2: float = 1e-3) -> tuple[dict[str, float], float]:
    w, bias = dict.fromkeys(features, 0.0), 0.0
    for _ in range(steps):
        miss = F.col(label) - 1 / (1 + F.exp(-_linear(w, bias)))
        got = rows.agg(F.avg(miss), *(F.avg(miss * F.col(f)) for f in features)).first()
        if got[0] is None:
            break
        bias += rate * got[0]
        w = {f: x + rate * (g - l2 * x) for (f, x), g in zip(w.items(), got[1:])}
    return w, bias


def cross_fit(rows: DataFrame, group: str, features: list[str], label: str, folds: int) -> DataFrame:
    """``rows`` with ``fold`` and the out-of-fold ``score``; groups are dealt to folds by hash."""
    dealt = rows.withColumn("fold", F.pmod(F.xxhash64(group), F.lit(folds)).cast("int"))
    score = F.lit(None).cast("double")
    for k in range(folds):
        w, bias = fit_logistic(dealt.where(F.col("fold") != k), features, label)
        score = F.when(F.col("fold") == k, 1 / (1 + F.exp(-_linear(w, bias)))).otherwise(score)
    return dealt.withColumn("score", F.round(score, 9))


def hashed_vectors(df: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """``key, vector``: signed counts of hashed content tokens, at unit length; a text without tokens is all zeros."""
    toks = F.transform(content_tokens(text), lambda t: F.xxhash64(t))
    hashed = df.select(key, toks.alias("h"))
    sign = lambda h: F.when(F.pmod(F.shiftright(h, 32), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    raw = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.aggregate(F.filter("h", lambda h: F.pmod(h, F.lit(size)) == i), F.lit(0.0), lambda s, h: s + sign(h)))
    counted = hashed.select(key, raw.alias("v"))
    return counted.select(key, F.transform("v", lambda x: x / F.greatest(norm(F.col("v")), F.lit(1e-12))).alias("vector"))
