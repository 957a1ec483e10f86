"""Joins with a contract: what must match does, or the job fails where the row is, without collecting keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.operators.ranking import top_k


def strict_inner(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner join that fails on the first left row without a partner."""
    marked = right.withColumn("__met", F.lit(True))
    joined = left.join(marked, on, "left")
    said = F.concat(F.lit("no partner for "), F.to_json(F.struct(*on)))
    return joined.withColumn("__met", F.when(F.col("__met"), True).otherwise(F.raise_error(said).cast("boolean"))).where("__met").drop("__met")


def unmatched(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return left.join(right.select(*on).distinct(), on, "left_anti")


def require_unique(df: DataFrame, on: list[str]) -> DataFrame:
    """The rows with a check that none of their keys repeats; the check runs with the job that reads them."""
    counted = df.groupBy(*on).agg(F.count("*").alias("__n"))
    out = df.join(counted, on)
    ok = F.when(F.col("__n") == 1, True).otherwise(F.raise_error(F.concat(F.lit("repeated key "), F.to_json(F.struct(*on)))).cast("boolean"))
    return out.withColumn("__n", ok).where("__n").drop("__n")


def key_difference(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """``on, side``: keys of one side only."""
    a, b = left.select(*on).distinct().withColumn("l", F.lit(1)), right.select(*on).distinct().withColumn("r", F.lit(1))
    return a.join(b, on, "full_outer").where("l IS NULL OR r IS NULL").select(*on, F.when(F.col("r").isNull(), "left").otherwise("right").alias("side"))


def merge_candidates(left: DataFrame, right: DataFrame, on: list[str], least: list[str], most: list[str], sets: list[str]) -> DataFrame:
    """Full-outer merge: least of ranks, greatest of scores, union of route lists; nulls give way."""
    a, b = left.alias("a"), right.alias("b")
    joined = a.join(b, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in on], "full_outer")
    empty = F.array().cast("array<string>")
    return joined.select(
        *(F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in on),
        *(F.least(f"a.{c}", f"b.{c}").alias(c) for c in least),
        *(F.greatest(f"a.{c}", f"b.{c}").alias(c) for c in most),
        *(F.array_sort(F.array_union(F.coalesce(f"a.{c}", empty), F.coalesce(f"b.{c}", empty))).alias(c) for c in sets),
    )


def attach(rows: DataFrame, notes: DataFrame, on: list[str], defaults: dict[str, object]) -> DataFrame:
    """Left join with fall-backs for rows without a note."""
    return rows.join(notes, on, "left").fillna(defaults)


def keep_first(df: DataFrame, on: list[str], order: list[Column]) -> DataFrame:
    return top_k(df, on, order, 1, "__n").drop("__n")


def latest(df: DataFrame, on: list[str], time: str, tie: str) -> DataFrame:
    """The last row of each key, by a map-side aggregate rather than a sort of each key's rows."""
    rest = [c for c in df.columns if c not in on]
    return df.groupBy(*on).agg(F.max_by(F.struct(*rest), F.struct(time, tie)).alias("r")).select(*on, "r.*")


def pending(jobs: DataFrame, done: DataFrame, on: list[str], ok: Column) -> DataFrame:
    """Jobs without a successful result."""
    return jobs.join(done.where(ok).select(*on).distinct(), on, "left_anti")


def shard_of(key: Column, shards: int) -> Column:
    """Stable shard number of a key."""
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


def merge_shards(shards: list[DataFrame], on: list[str]) -> DataFrame:
    """Union of shards in which no key may repeat."""
    out = shards[0]
    for s in shards[1:]:
        out = out.unionByName(s)
    return require_unique(out, on)


def differences(df: DataFrame, by: list[str], positive: str, features: list[str], item: str, dealt: int = 256) -> DataFrame:
    """Feature differences of every positive and negative item of a group, for pairwise learners.

    A group's positives are dealt by hash into parts of some ``dealt`` items that each meet all its negatives, so the pairs of a
    hot group are made by many tasks.
    """
    x, y = df.where(positive), df.where(f"NOT {positive}")
    parts = x.groupBy(*by).agg(F.ceil(F.count("*") / dealt).cast("int").alias("__parts"))
    x = x.join(parts, by).withColumn("__part", F.pmod(F.xxhash64(item), F.col("__parts")).cast("int")).alias("x")
    y = y.join(parts, by).withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))).alias("y")
    pairs = x.join(y, [F.col(f"x.{c}") == F.col(f"y.{c}") for c in [*by, "__part"]])
    return pairs.select(*(F.col(f"x.{c}").alias(c) for c in by), F.col(f"x.{item}").alias("winner"), F.col(f"y.{item}").alias("loser"), *((F.col(f"x.{f}") - F.col(f"y.{f}")).alias(f) for f in features))
