"""Lexical scores of claim and candidate pairs, from term counts joined on the term."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions.text import content_tokens

#: Query terms that are broadcast to the scan of a collection.
BROADCAST_TERMS = 200_000


def term_counts(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys, term, tf, n``: counts of content tokens, with the number of all tokens of the row."""
    toks = df.select(*keys, content_tokens(text).alias("t"))
    return toks.select(*keys, F.size("t").alias("n"), F.explode("t").alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("tf"), F.first("n").alias("n"))


def _sum(items: Column, value) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda acc, x: acc + value(x))


def _square_sum(toks: Column) -> Column:
    """Sum of squared counts of an array's values: runs of the sorted array, a run of r adding 2 r + 1 when it grows."""
    start = F.struct(F.lit(None).cast("string").alias("v"), F.lit(0).alias("run"), F.lit(0).alias("sum"))

    def step(acc: Column, x: Column) -> Column:
        same = x.eqNullSafe(acc["v"])
        run = F.when(same, acc["run"]).otherwise(0)
        return F.struct(x.alias("v"), (run + 1).alias("run"), (acc["sum"] + 2 * run + 1).alias("sum"))

    return F.aggregate(F.array_sort(toks), start, step, lambda acc: acc["sum"])


def count_cosine(a: Column, b: Column) -> Column:
    """Cosine of the value counts of two arrays; 0 if either is empty, null if either is."""
    shared = _sum(F.array_distinct(a), lambda t: F.size(F.filter(a, lambda x: x == t)) * F.size(F.filter(b, lambda x: x == t)))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(shared / F.sqrt(_square_sum(a).cast("double") * _square_sum(b)))


def lexical_scores(queries: DataFrame, candidates: DataFrame, by: list[str], cand: list[str], query_text: str = "claim", text: str = "text") -> DataFrame:
    """``lex, bm25, cos`` of every candidate against the query of its group, 0 where no term is shared.

    lex: F1 of the token multisets. bm25: saturated counts with k1 1.2, b 0.75, mean length 18 and an idf of the count within
    the sentence, not of the collection. cos: cosine of the term counts, the offline stand-in for a dense score.

    One join of candidates with their query; the scores are array expressions on the joined row, so no token is shuffled.
    ``cand`` names the candidate's key for callers that need it; rows are scored one by one.
    """
    toks = content_tokens(query_text)
    q = queries.select(*by, toks.alias("__q")).select(
        *by,
        F.transform(F.array_distinct("__q"), lambda t: F.struct(t.alias("t"), F.size(F.filter("__q", lambda x: x == t)).alias("c"))).alias("__qc"),
        F.size("__q").alias("__nq"),
        _square_sum(F.col("__q")).alias("__qq"),
    )
    joined = candidates.join(q, by).withColumn("__s", content_tokens(text))
    hits = F.filter(F.transform("__qc", lambda e: F.struct(e["c"].alias("c"), F.size(F.filter("__s", lambda x: x == e["t"])).alias("tf"))), lambda h: h["tf"] > 0)
    rows = joined.withColumns({"__h": hits, "__ns": F.size("__s")})
    shared = _sum(F.col("__h"), lambda h: F.least(h["c"], h["tf"]))
    p, r = shared / F.col("__ns"), shared / F.col("__nq")
    length = 1.2 * (0.25 + 0.75 * F.col("__ns") / 18.0)
    bm25 = _sum(F.col("__h"), lambda h: (F.log(1.0 + 1.0 / (1.0 + h["tf"])) + 0.5) * (h["tf"] * 2.2 / (h["tf"] + length)))
    cos = _sum(F.col("__h"), lambda h: h["c"] * h["tf"]) / F.sqrt(F.col("__qq").cast("double") * _square_sum(F.col("__s")))
    met = F.size("__h") > 0
    return rows.withColumns({
        "lex": F.when(met, 2.0 * p * r / F.greatest(F.lit(1e-8), p + r)).otherwise(0.0),
        "bm25": F.when(met, bm25).otherwise(0.0),
        "cos": F.when(met, cos).otherwise(0.0),
    }).drop("__qc", "__nq", "__qq", "__s", "__h", "__ns")


def okapi(queries: DataFrame, docs: DataFrame, by: list[str], cand: list[str], query_text: str = "claim", text: str = "text", k1: float = 1.5, b: float = 0.75, scope: list[str] | None = None) -> DataFrame:
    """``okapi`` of the candidates that share a term with their query.

    The collection over which document frequencies and the mean length are taken is the group (``scope`` = ``by``), or all
    documents for ``scope=[]``; then ``by`` names the query and every query meets every document that has one of its terms.
    """
    scope = by if scope is None else scope
    q = queries.select(*by, F.explode(F.array_distinct(content_tokens(query_text))).alias("term"))
    rows = docs.select(*scope, *cand, content_tokens(text).alias("t"))
    stats = rows.groupBy(*scope).agg(F.count("*").alias("docs"), F.greatest(F.avg(F.size("t")), F.lit(1.0)).alias("mean"))
    # Only the terms of queries leave a document's row: those of its own query, or any of the queries' where all are asked.
    if scope:
        wanted = queries.select(*by, F.array_distinct(content_tokens(query_text)).alias("__q"))
        near = rows.join(wanted, by).select(*scope, *cand, F.size("t").alias("n"), F.explode(F.filter("t", lambda x: F.array_contains("__q", x))).alias("term"))
    else:
        terms = q.select("term").distinct()
        # Sent to all tasks only while few; a join by the term takes over beyond.
        terms = F.broadcast(terms) if terms.count() <= BROADCAST_TERMS else terms
        near = rows.select(*cand, F.size("t").alias("n"), F.explode("t").alias("term")).join(terms, "term", "left_semi")
    s = near.groupBy(*scope, *cand, "term").agg(F.count("*").alias("tf"), F.first("n").alias("n"))
    df = s.groupBy(*scope, "term").agg(F.count("*").alias("df"))
    hit = s.join(df, [*scope, "term"]).join(q, [*scope, "term"])
    hit = hit.join(stats, scope) if scope else hit.join(F.broadcast(stats))  # without a scope one row of numbers
    idf = F.log(1.0 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf")
    return hit.groupBy(*dict.fromkeys(by + cand)).agg(F.sum(idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("n") / F.col("mean")))).alias("okapi"))
