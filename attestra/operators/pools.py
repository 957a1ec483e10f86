"""Relational selectors and pool merges: plans of joins, windows and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.operators.ranking import top_k


def union_pools(base: DataFrame, routes: DataFrame, by: list[str], key: str) -> DataFrame:
    """Full-outer merge of two pools on the text key: both sides' columns, ``in_base`` and ``in_routes``."""
    a = base.withColumn("in_base", F.lit(True))
    b = routes.withColumn("in_routes", F.lit(True))
    return a.join(b, [*by, key], "full_outer").na.fill(False, ["in_base", "in_routes"])


def interleave(union: DataFrame, by: list[str], base_rank: str, route_rank: str, tie: str, k: int) -> DataFrame:
    """One from each pool in turn by their own ranks, the base first; an entry of both takes its earlier place."""
    place = F.least(2 * F.col(base_rank) - 1, 2 * F.col(route_rank))
    return top_k(union.withColumn("place", place), by, [F.asc("place"), F.asc(tie)], k)


def prefix_budget(ranked: DataFrame, by: list[str], rank: str, cost: str, target: Column, overshoot: int = 32, least: int = 1) -> DataFrame:
    """The prefix of each ranked group whose summed cost is closest to the target; at most ``overshoot`` above it.

    Of equally close ones that below the target, then the longer; if none is allowed, the first ``least``. ``chosen`` marks
    its rows, ``total`` is the running cost.
    """
    w = Window.partitionBy(*by).orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
    run = ranked.withColumn("total", F.sum(cost).over(w)).withColumn("__t", target)
    ok = F.when((F.col(rank) >= least) & (F.col("total") <= F.col("__t") + overshoot), F.struct(F.abs(F.col("total") - F.col("__t")).alias("d"), (F.col("total") > F.col("__t")).alias("o"), (-F.col(rank)).alias("r"), F.col(rank).alias("k")))
    best = run.groupBy(*by).agg(F.coalesce(F.min(ok)["k"], F.lit(least)).alias("__k"))
    return run.join(best, by).withColumn("chosen", F.col(rank) <= F.col("__k")).drop("__k", "__t")


def fit_budget(ranked: DataFrame, by: list[str], rank: str, tokens: str, budget: Column) -> DataFrame:
    """Items from the top while they fit; the first that doesn't is clipped to the room left, later ones are dropped."""
    w = Window.partitionBy(*by).orderBy(rank).rowsBetween(Window.unboundedPreceding, -1)
    before = ranked.withColumn("__before", F.coalesce(F.sum(F.size(tokens)).over(w), F.lit(0))).withColumn("__room", budget - F.col("__before"))
    return before.where("__room > 0").withColumn(tokens, F.slice(F.col(tokens), F.lit(1), F.greatest(F.col("__room"), F.lit(1)).cast("int"))).drop("__before", "__room")


def source_diverse(df: DataFrame, by: list[str], score: str, source: str, tie: str, k: int, penalty: float) -> DataFrame:
    """Top k after taking ``penalty`` off for each better-scored item of the same source."""
    within = top_k(df, [*by, source], [F.desc(score), F.asc(tie)], name="__n")
    value = F.round(F.col(score) - penalty * (F.col("__n") - 1), 9)
    return top_k(within.withColumn("value", value), by, [F.desc("value"), F.asc(tie)], k).drop("__n")


def evidence_edges(pool: DataFrame, by: str) -> DataFrame:
    """Edges between the pool's evidence: ``by, a, b, kind, weight`` from ``id, key, dup, source, atoms, relation, side, direct, background``.

    ``direct``: direct or partial; ``background``: as ``operators.chains`` has it. With a column ``place``, a sentence number,
    those of one source at most three sentences apart are tied too. The pool is a top-k per event, so pairs per event are
    bounded by its square.
    """
    x, y = pool.alias("x"), pool.alias("y")
    pairs = x.join(y, F.expr(f"x.{by} = y.{by} AND x.id < y.id"))
    shared = F.arrays_overlap("x.atoms", "y.atoms")
    dup = F.coalesce((F.col("x.key") != "") & (F.col("x.key") == F.col("y.key")), F.lit(False)) | F.coalesce((F.col("x.dup") != "") & (F.col("x.dup") == F.col("y.dup")), F.lit(False))
    union, diff = F.size(F.array_union("x.atoms", "y.atoms")), F.size(F.array_union(F.array_except("x.atoms", "y.atoms"), F.array_except("y.atoms", "x.atoms")))
    sided = (F.col("x.side") != "U") & (F.col("y.side") != "U")
    source = (F.col("x.source") == F.col("y.source")) & (F.col("x.source") != "")
    kinds = {
        "duplicate": (dup, F.lit(1.0)),
        "complements": (~dup & (F.size("x.atoms") > 0) & (F.size("y.atoms") > 0) & (diff > 0) & (F.col("x.direct") | F.col("y.direct")), 0.45 + 0.55 * diff / F.greatest(union, F.lit(1))),
        "corroborates": (shared & sided & (F.col("x.relation") == F.col("y.relation")) & ~source, F.lit(0.75)),
        "tension": (shared & sided & (F.col("x.side") != F.col("y.side")), F.lit(0.85)),
        "bridge": (((F.col("x.background") & F.col("y.direct")) | (F.col("y.background") & F.col("x.direct"))) & (shared | source), F.lit(0.55)),
    }
    if "place" in pool.columns:
        kinds["same_source"] = (source & (F.abs(F.col("x.place") - F.col("y.place")) <= 3), F.lit(0.45))
    edges = F.array(*(F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(k).alias("kind"), w.cast("double").alias("weight"))) for k, (c, w) in kinds.items()))
    return pairs.select(f"x.{by}", F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.inline(F.filter(edges, lambda e: e.isNotNull())))


def best_subset(df: DataFrame, by: str, item: str, score: str, size: int) -> DataFrame:
    """Exhaustive search of the set of ``size`` items with the greatest summed score within each (bounded) pool; ties to the least items."""
    level = df.select(by, F.array(item).alias("set"), F.col(score).alias("total"))
    one = df.select(by, F.col(item).alias("__i"), F.col(score).alias("__s"))
    for _ in range(size - 1):
        level = level.join(one, by).where(F.col("__i") > F.element_at("set", -1)).select(by, F.array_append("set", F.col("__i")).alias("set"), (F.col("total") + F.col("__s")).alias("total"))
    return top_k(level.withColumn("total", F.round("total", 9)), [by], [F.desc("total"), F.asc("set")], 1).drop("rank")


def amplified_buckets(df: DataFrame, by: list[str], bucket: str, mass: str, source: str, gamma: float = 1.5, alpha: float = 0.1) -> DataFrame:
    """``(sum of mass / sqrt(items of the source) + alpha) ** gamma`` per group and bucket."""
    per = df.groupBy(*by, source).agg(F.count("*").alias("__n"))
    joined = df.alias("d").join(per.alias("p"), [F.col(f"d.{c}").eqNullSafe(F.col(f"p.{c}")) for c in [*by, source]])
    rows = joined.select(*(f"d.{c}" for c in [*by, bucket]), (F.col(f"d.{mass}") / F.sqrt("__n")).alias("m"))
    return rows.groupBy(*by, bucket).agg(F.round(F.pow(F.sum("m") + alpha, F.lit(gamma)), 9).alias("mass"))
