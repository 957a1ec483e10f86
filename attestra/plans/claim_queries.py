"""Queries of claim aspects, anchors and parsed atoms."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestra.functions import claims as K
from attestra.functions import text as T
from attestra.operators.ranking import top_k
from attestra.plans.common import CLAIMS_SQL, CLEAN, CONTENT, claims
from attestra.plans.ranking_queries import best_first
from attestra.operators.scoring import lexical_scores
from attestra.plans.common import sentences
from attestra.registry import query, table


def _q(pattern: str) -> str:
    return pattern.replace("'", "''")


_RETRIEVABLE = f"""(regexp_matches(x, '{_q(K.ENTITY)}')::INT + regexp_matches(x, '{_q(K.QUANTITY)}')::INT + (len({CONTENT.format("x").replace("lambda x: lower(x)", "lambda y: lower(y)").replace("lambda x: x NOT", "lambda y: y NOT")}) BETWEEN 5 AND 18)::INT
    - 2 * (regexp_matches(x, '{K.PRONOUN}') AND NOT regexp_matches(x, '{_q(K.ENTITY)}'))::INT - 2 * regexp_matches(x, '{K.CONTEXT_START}')::INT - (len({CONTENT.format("x").replace("lambda x: lower(x)", "lambda y: lower(y)").replace("lambda x: x NOT", "lambda y: y NOT")}) < 4)::INT)"""
ASPECTS_SQL = f"""WITH c AS (SELECT event_id, {CLEAN.format("claim")} AS t FROM ({CLAIMS_SQL})), p AS (SELECT event_id, list_filter(list_transform(list_concat([t], regexp_split_to_array(t, '{K.CLAUSE_CUT}')), lambda x: regexp_replace(x, '^[\\s,.;:"]+|[\\s,.;:"]+$', '', 'g')), lambda x: x <> '') AS parts FROM c),
    u AS (SELECT event_id, unnest(parts) AS x, generate_subscripts(parts, 1) AS i FROM p), o AS (SELECT event_id, x, i FROM u QUALIFY row_number() OVER (PARTITION BY event_id, lower(x) ORDER BY i) = 1), s AS (SELECT event_id, x, i, {_RETRIEVABLE} AS score FROM o)
    SELECT event_id, pos, x AS text, score FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY i) AS pos FROM s WHERE score >= 1) WHERE pos <= 8"""


@query(ASPECTS_SQL)
def t_claim_aspects(spark, d):
    return claims(spark, d).select("event_id", F.posexplode(K.aspects("claim")).alias("pos", "a")).select("event_id", (F.col("pos") + 1).alias("pos"), "a.text", "a.score")


ANCHORS_SQL = rf"""c AS (SELECT event_id, {CLEAN.format("claim")} AS t FROM ({CLAIMS_SQL})), k AS (SELECT event_id, list_distinct(regexp_extract_all(t, '{K.YEAR}')) AS y, list_distinct(regexp_extract_all(t, '\d+(?:[,.]\d+)*')) AS n, list_distinct(list_transform(regexp_extract_all(t, '{_q(K.ENTITY)}'), lambda x: lower(x))) AS e FROM c),
    a AS (SELECT event_id, 'year' AS kind, unnest(y) AS value FROM k UNION ALL SELECT event_id, 'number', unnest(list_filter(n, lambda x: NOT list_contains(y, x))) FROM k UNION ALL SELECT event_id, 'entity', unnest(list_filter(e, lambda x: contains(x, ' '))) FROM k)"""


@query(f"WITH {ANCHORS_SQL} SELECT * FROM a")
def t_anchors(spark, d):
    return claims(spark, d).select("event_id", F.inline(K.anchors("claim")))


@query(f"""WITH {ANCHORS_SQL}, w AS (SELECT event_id, kind, value, unnest(list_distinct({CONTENT.format("value")})) AS t FROM a), e AS (SELECT DISTINCT event_id, unnest({CONTENT.format("text")}) AS t FROM sentence_items WHERE event_id IS NOT NULL AND text IS NOT NULL),
    m AS (SELECT w.event_id, kind, value, count(*) AS n, count(e.t) AS hits FROM w LEFT JOIN e USING (event_id, t) GROUP BY 1, 2, 3) SELECT event_id, kind, count(*) AS anchors, count(*) FILTER (hits >= 0.75 * n) AS covered FROM m GROUP BY 1, 2""")
def t_anchor_coverage(spark, d):
    """Anchors of a claim that its sentences cover: at least three quarters of an anchor's words are found."""
    words = claims(spark, d).select("event_id", F.inline(K.anchors("claim"))).select("event_id", "kind", "value", F.explode(F.array_distinct(T.content_tokens("value"))).alias("t"))
    seen = table(spark, d, "sentence_items").where("event_id IS NOT NULL AND text IS NOT NULL").select("event_id", F.explode(T.content_tokens("text")).alias("t")).distinct().withColumn("hit", F.lit(1))
    m = words.join(seen, ["event_id", "t"], "left").groupBy("event_id", "kind", "value").agg(F.count("*").alias("n"), F.count("hit").alias("hits"))
    return m.groupBy("event_id", "kind").agg(F.count("*").alias("anchors"), F.count_if(F.col("hits") >= 0.75 * F.col("n")).alias("covered"))


@query(f"WITH c AS ({CLAIMS_SQL}) SELECT event_id, 'A1' AS atom_id, {CLEAN.format('claim')} AS proposition, CASE WHEN length(claim) % 2 = 0 THEN 0.5::DOUBLE ELSE 1.0 END AS importance FROM c")
def t_parse_atoms(spark, d):
    """Atoms read back from answers: claims of even length come as fenced JSON with a repeated atom, the others as talk."""
    c = claims(spark, d)
    atom = F.struct(F.col("claim").alias("proposition"))
    said = F.concat(F.lit("Sure!\n```json\n"), F.to_json(F.struct(F.array(atom, atom).alias("claim_atoms"))), F.lit("\n```"))
    rows = c.select("event_id", K.parse_atoms(F.when(F.length("claim") % 2 == 0, said).otherwise(F.lit("I can't {do} that")), "claim").alias("a"))
    return rows.select("event_id", F.inline("a")).drop("type")


def _aspect_query():
    return f"""WITH q0 AS ({ASPECTS_SQL}) SELECT count(*) AS aspects, count(DISTINCT event_id) AS events FROM q0"""


@query(_aspect_query())
def t_aspect_counts(spark, d):
    return t_claim_aspects(spark, d).agg(F.count("*").alias("aspects"), F.count_distinct("event_id").alias("events"))


@query()
def r_aspect_routes(spark, d):
    """Each aspect of a claim as a query of its own: the best five sentences of the event per aspect."""
    a = t_claim_aspects(spark, d)
    pool = sentences(spark, d).join(a.select("event_id", "pos"), "event_id")
    scored = lexical_scores(a.select("event_id", "pos", F.col("text").alias("claim")), pool, ["event_id", "pos"], ["cand"]).withColumn("lex", F.round("lex", 9))
    return top_k(scored.where("lex > 0"), ["event_id", "pos"], best_first("lex", "cand"), 5).select("event_id", "pos", "cand", "lex", "rank")
