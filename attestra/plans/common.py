"""Pieces shared by the queries: the claims and candidate sentences of the tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.functions import text as T
from attestra.registry import table

STOPS = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
CLEAN = r"trim(regexp_replace({0}, '[\s\p{{Z}}]+', ' ', 'g'))"
KEY = f"lower({CLEAN})"
TOKENS = "list_transform(regexp_extract_all({0}, '[A-Za-z0-9_''-]+'), lambda x: lower(x))"
CONTENT = f"list_filter({TOKENS}, lambda x: x NOT IN ({STOPS}))"
WORDS = f"list_transform(regexp_extract_all({CLEAN}, '[A-Za-z0-9%$]+'), lambda x: lower(x))"


def claims(spark: SparkSession, d: str) -> DataFrame:
    """``event_id, claim, label, label_schema``: one row per event, deliveries merged to the least value of each column."""
    rows = table(spark, d, "claims").where("event_id IS NOT NULL AND claim IS NOT NULL")
    return rows.groupBy("event_id").agg(F.min("claim").alias("claim"), F.min(F.lower("label")).alias("label"), F.min("label_schema").alias("label_schema"))


def sentences(spark: SparkSession, d: str) -> DataFrame:
    """``event_id, cand, key, text, report_id``: the different sentences of each event; ``cand`` is the least row that has it."""
    rows = table(spark, d, "sentence_items").where("event_id IS NOT NULL").withColumn("key", T.canonical_key("text")).where("key <> ''")
    first = F.min(F.struct("row_id", "text", "report_id"))
    return rows.groupBy("event_id", "key").agg(first.alias("r")).select("event_id", F.col("r.row_id").alias("cand"), "key", F.col("r.text").alias("text"), F.col("r.report_id").alias("report_id"))


CLAIMS_SQL = "SELECT event_id, min(claim) AS claim, min(lower(label)) AS label, min(label_schema) AS label_schema FROM claims WHERE event_id IS NOT NULL AND claim IS NOT NULL GROUP BY event_id"
SENTENCES_SQL = f"""SELECT event_id, min(row_id) AS cand, key, arg_min(text, row_id) AS text, arg_min(report_id, row_id) AS report_id
    FROM (SELECT *, {KEY.format("text")} AS key FROM sentence_items WHERE event_id IS NOT NULL) WHERE key <> '' GROUP BY event_id, key"""


def tf_sql(rows: str, keys: str, text: str) -> str:
    """Term counts and lengths of ``rows``: ``keys, t, tf, n``."""
    return f"SELECT {keys}, t, count(*) AS tf, any_value(n) AS n FROM (SELECT {keys}, len({CONTENT.format(text)}) AS n, unnest({CONTENT.format(text)}) AS t FROM ({rows})) GROUP BY {keys}, t"


#: Scores of every candidate of a claim: ``event_id, cand, key, text, lex, bm25, cos``.
SCORES_SQL = f"""
    q AS ({tf_sql("SELECT * FROM c", "event_id", "claim")}), s AS ({tf_sql("SELECT * FROM p", "event_id, cand", "text")}),
    qn AS (SELECT event_id, sum(tf * tf) AS qq FROM q GROUP BY event_id), sn AS (SELECT event_id, cand, sum(tf * tf) AS ss FROM s GROUP BY event_id, cand),
    hit AS (SELECT s.event_id, s.cand, any_value(q.n) AS nq, any_value(s.n) AS ns, sum(least(q.tf, s.tf)) AS shared, sum(q.tf * s.tf) AS qs,
        sum((ln(1.0 + 1.0 / (1.0 + s.tf)) + 0.5) * (s.tf * 2.2 / (s.tf + 1.2 * (0.25 + 0.75 * s.n / 18.0)))) AS bm25 FROM s JOIN q USING (event_id, t) GROUP BY s.event_id, s.cand),
    scored AS (SELECT p.event_id, p.cand, p.key, p.text, p.report_id,
        coalesce(2.0 * (shared / ns) * (shared / nq) / greatest(1e-8, shared / ns + shared / nq), 0.0) AS lex, coalesce(bm25, 0.0) AS bm25,
        coalesce(qs / sqrt(qq * ss), 0.0) AS cos
        FROM p JOIN c USING (event_id) LEFT JOIN hit USING (event_id, cand) LEFT JOIN qn USING (event_id) LEFT JOIN sn USING (event_id, cand))"""


def minmax_sql(x: str) -> str:
    return f"CASE WHEN max({x}) OVER e - min({x}) OVER e < 1e-8 THEN 0.0 ELSE ({x} - min({x}) OVER e) / (max({x}) OVER e - min({x}) OVER e) END"


HYBRID_SQL = f"""WITH c AS ({CLAIMS_SQL}), p AS ({SENTENCES_SQL}), {SCORES_SQL},
    mm AS (SELECT *, {minmax_sql("cos")} AS mcos, {minmax_sql("lex")} AS mlex, {minmax_sql("bm25")} AS mbm25 FROM scored WINDOW e AS (PARTITION BY event_id)),
    hybrid AS (SELECT *, round(0.7 * mcos + 0.2 * mlex + 0.1 * mbm25, 9) AS hybrid FROM mm)"""
