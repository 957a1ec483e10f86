"""Problem 2: records that are nearly the same.

Pigeonring filtering. Two sets of n and m words with similarity t differ in at most ``tau = (1 - t) / (1 + t) * (n + m)`` words
(Hamming distance). The words are cut into a ring of eight segments by their hash. If the whole ring is within tau, there
is a segment from which every chain of 1, 2, .. consecutive segments is within its share, ``chain * tau / 8``; so the
differences of a chain prune a pair before its whole distance is known. Pairs come from the segment keys of ``setjoin``; in
the join their segments are compared as bitmaps (differing bits are at most the differing words), a start at a time: a start is
given up at the first chain beyond its share, and a pair at the last start. Chains have up to ``CHAIN`` segments; on the
test tables they drop 93 of 100 pairs. Only the others get the full Hamming check, on the whole bitmaps and then on the
whole sets, so the result is exact (words are compared by 64-bit hash).

Records with the same set of words are one class; the join runs over classes. Rows with null text or without a word are in
no pair and no group. Repeated ids are rows of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm.components import components
from attestra.llm.runtime import checkpoint
from attestra.llm.setjoin import RARE, key_rows, prepare, sizes, tau, verify, within

SIMILARITY = 0.7
SEGMENTS = 8
#: Longer chains prune little more, and the condition must stay small enough for the compiler.
CHAIN = 2


def differences() -> list[str]:
    """SQL: differing bits of each segment of sets x and y, half of one of their four numbers."""
    halves = ("{} & 4294967295L", "shiftrightunsigned({}, 32)")
    return ["bit_count(" + halves[i % 2].format(f"(x.m{i // 2} ^ y.m{i // 2})") + ")" for i in range(SEGMENTS)]


def ring(t: float, chain: int = CHAIN) -> str:
    """SQL condition: from some segment on, the chains of up to ``chain`` segments stay within their share of tau."""
    d, starts = differences(), []
    for i in range(SEGMENTS):
        held = (" + ".join(d[(i + k) % SEGMENTS] for k in range(n)) for n in range(1, chain + 1))
        starts.append(" AND ".join(f"{SEGMENTS} * ({c}) <= {n} * {tau(t)}" for n, c in enumerate(held, 1)))
    return "(" + " OR ".join(f"({s})" for s in starts) + ")"


def met(rows: DataFrame, t: float) -> DataFrame:
    """Pairs ``x, y`` of key rows that share a key and whose sizes allow similarity t, before any filter on their words."""
    return rows.alias("x").join(rows.alias("y"), F.expr(f"x.seed = y.seed AND x.cls < y.cls AND {sizes(t)}"))


def class_pairs(sets: DataFrame, t: float = SIMILARITY, rare: int = RARE) -> DataFrame:
    """``a, b, similarity``: pairs of different classes, ``a < b``; ``rare`` changes the cost and not the result.

    The keys are most of what is on disk; they are dropped before the sets are shuffled for the check.
    """
    near = met(key_rows(sets, t, rare=rare), t).where(F.expr(ring(t))).where(F.expr(within(t)))
    pairs = checkpoint(near.select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b")).distinct(), drop=True)
    return verify(pairs, sets, t)


def similar_pairs(df: DataFrame, id_col: str = "candidate_id", text: str = "text", t: float = SIMILARITY, rare: int = RARE) -> DataFrame:
    """``{id}_a, {id}_b``: all pairs of rows with similarity at least ``t``, smaller id first."""
    rows, sets = prepare(df, id_col, text)
    links = class_pairs(sets, t, rare).select(F.col("a").alias("ca"), F.col("b").alias("cb")).unionByName(sets.where("n > 1").select(F.col("cls").alias("ca"), F.col("cls").alias("cb")))
    members = sets.select("k1", "k2", "cls").join(rows.select("k1", "k2", "id"), ["k1", "k2"]).select("cls", "id")
    left, right = members.select(F.col("cls").alias("ca"), F.col("id").alias("i")), members.select(F.col("cls").alias("cb"), F.col("id").alias("j"))
    pairs = links.join(left, "ca").join(right, "cb").where("ca <> cb OR i < j")
    return pairs.select(F.least("i", "j").alias(f"{id_col}_a"), F.greatest("i", "j").alias(f"{id_col}_b"))


def groups(df: DataFrame, id_col: str = "candidate_id", text: str = "text", t: float = SIMILARITY) -> DataFrame:
    """``{id}, duplicate_group, links``: one row per row of ``df``; the group is named by its least id and null for rows alike to no other."""
    rows, sets = prepare(df, id_col, text)
    pairs = class_pairs(sets, t).select("a", "b")
    size = sets.select("cls", "n")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    partners = both.join(size.withColumnRenamed("cls", "b"), "b").groupBy("a").agg(F.sum("n").alias("others")).withColumnRenamed("a", "cls")
    named = sets.select("k1", "k2", "cls", "n").join(components(pairs).withColumnRenamed("node", "cls"), "cls", "left").join(partners, "cls", "left")
    links = (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("links")
    named = named.select("k1", "k2", F.when(links > 0, F.concat(F.lit("g"), F.coalesce("component", "cls").cast("string"))).alias("duplicate_group"), links)
    grouped = rows.select("id", "k1", "k2").join(named, ["k1", "k2"]).select("id", "duplicate_group", "links")
    blank = df.select(F.col(id_col).alias("id")).join(rows.select("id"), "id", "left_anti").select("id", F.lit(None).cast("string").alias("duplicate_group"), F.lit(0).cast("bigint").alias("links"))
    return grouped.unionByName(blank).withColumnRenamed("id", id_col)
