"""Queries of the chunking strategies."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from attestra.functions import text as T
from attestra.operators import chunking as C
from attestra.operators.ranking import minmax
from attestra.operators.scoring import count_cosine, lexical_scores
from attestra.plans.common import KEY, claims
from attestra.plans.text_queries import _split_sql
from attestra.registry import query, table

SENTS = f"SELECT doc_id, unnest(s) AS sent, generate_subscripts(s, 1) - 1 AS idx FROM (SELECT doc_id, {_split_sql('text')} AS s FROM documents WHERE text IS NOT NULL)"


def doc_sentences(spark, d):
    return C.explode_sentences(table(spark, d, "documents").where("text IS NOT NULL"), ["doc_id"], "text")


def sentence_arrays(spark, d, keys=("doc_id",)):
    return C.sentence_arrays(table(spark, d, "documents").where("text IS NOT NULL"), list(keys), "text")


@query(SENTS)
def c_sentence(spark, d):
    return doc_sentences(spark, d)


@query(f"SELECT doc_id, string_agg(sent, ' ' ORDER BY idx) AS chunk, count(*) AS sentences FROM ({SENTS}) GROUP BY doc_id")
def c_raw(spark, d):
    return C.raw_chunks(sentence_arrays(spark, d), ["doc_id"])


@query(f"""WITH s AS (SELECT *, {KEY.format("sent")} AS key FROM ({SENTS})), w AS (SELECT a.doc_id, a.idx, b.idx AS j, b.sent, row_number() OVER (PARTITION BY a.doc_id, a.idx, b.key ORDER BY b.idx) AS n
    FROM s a JOIN s b ON a.doc_id = b.doc_id AND b.idx BETWEEN a.idx - 1 AND a.idx + 1) SELECT doc_id, idx, string_agg(sent, ' ' ORDER BY j) AS chunk, array_to_string(list(j ORDER BY j), ',') AS members FROM w WHERE n = 1 GROUP BY 1, 2""")
def c_ctx_window(spark, d):
    return C.context_windows(sentence_arrays(spark, d), ["doc_id"], 1).withColumn("members", F.array_join("members", ","))


@query("""WITH e AS (SELECT *, list_dot_product(lag(embedding) OVER w, embedding) AS s FROM (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS embedding FROM embeddings) WINDOW w AS (PARTITION BY label ORDER BY vec_id))
    SELECT vec_id, label, CAST(sum(CASE WHEN s IS NULL OR round(s, 9) <= 0.1 THEN 1 ELSE 0 END) OVER (PARTITION BY label ORDER BY vec_id) - 1 AS BIGINT) AS chunk FROM e""")
def c_semantic(spark, d):
    return C.semantic_chunks(table(spark, d, "embeddings"), ["label"], "vec_id", "embedding", 0.1).select("vec_id", "label", "chunk")


@query("""WITH p AS (SELECT label, vec_id, embedding, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) // 2 AS win FROM embeddings),
    m AS (SELECT label, win, dim, avg(x) AS x, min(vec_id) AS first, max(vec_id) AS last FROM (SELECT label, win, vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS dim FROM p) GROUP BY ALL),
    v AS (SELECT label, win, list(x ORDER BY dim) AS v, min(first) AS first, max(last) AS last FROM m GROUP BY 1, 2), u AS (SELECT *, list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-12)) AS u FROM v),
    s AS (SELECT *, list_dot_product(lag(u) OVER w, u) AS s FROM u WINDOW w AS (PARTITION BY label ORDER BY win))
    SELECT label, win AS "window", first, last, CAST(sum(CASE WHEN s IS NULL OR round(s, 9) <= 0.1 THEN 1 ELSE 0 END) OVER (PARTITION BY label ORDER BY win) - 1 AS BIGINT) AS chunk FROM s""")
def c_ctx_semantic(spark, d):
    return C.context_semantic_chunks(table(spark, d, "embeddings"), ["label"], "vec_id", "embedding", 2, 0.1)


def scored_report_sentences(spark, d):
    """Sentences of the reports with relevance to their claim and similarity to the next sentence, both lexical."""
    rows = table(spark, d, "anchors").where("report_content IS NOT NULL AND event_id IS NOT NULL AND report_id IS NOT NULL")
    reports = rows.groupBy("event_id", "report_id").agg(F.max("report_content").alias("body"))
    sents = C.explode_sentences(reports, ["event_id", "report_id"], "body").withColumnRenamed("sent", "text")
    scored = lexical_scores(claims(spark, d).select("event_id", "claim"), sents, ["event_id"], ["report_id", "idx"])
    scaled = minmax(scored, ["event_id", "report_id"], ["cos", "lex", "bm25"])
    rel = 0.7 * F.col("mm_cos") + 0.2 * F.col("mm_lex") + 0.1 * F.col("mm_bm25")
    w = Window.partitionBy("event_id", "report_id").orderBy("idx")
    out = scaled.withColumn("__t", T.content_tokens("text")).withColumn("__next", F.lead("__t").over(w))
    sim = F.coalesce(count_cosine(F.col("__t"), F.col("__next")), F.lit(0.0))
    return out.select("event_id", "report_id", "idx", F.col("text").alias("sent"), F.round(rel, 9).alias("rel"), F.round(sim, 9).alias("sim_next"), F.size("__t").alias("tokens"))


@query()
def c_claim_aware(spark, d):
    return C.claim_aware_chunks(scored_report_sentences(spark, d), ["event_id", "report_id"])


@query()
def c_claim_aware_tight(spark, d):
    return C.claim_aware_chunks(scored_report_sentences(spark, d), ["event_id", "report_id"], **C.TIGHT)


@query(f"""WITH s AS (SELECT *, {KEY.format("sent")} AS key FROM ({SENTS})), w AS (SELECT a.doc_id, a.idx, b.idx AS j, b.sent, row_number() OVER (PARTITION BY a.doc_id, a.idx, b.key ORDER BY b.idx) AS n
    FROM s a JOIN s b ON a.doc_id = b.doc_id AND b.idx BETWEEN a.idx - 1 AND a.idx + 1), c AS (SELECT doc_id, idx AS chunk_id, string_agg(sent, ' ' ORDER BY j) AS text, list(j) AS members FROM w WHERE n = 1 GROUP BY 1, 2),
    a AS (SELECT c.doc_id, chunk_id, text, min(s.idx) AS anchor FROM c JOIN s ON s.doc_id = c.doc_id AND list_contains(members, s.idx) AND length(s.sent) >= 40 GROUP BY 1, 2, 3),
    k AS (SELECT *, {KEY.format("text")} AS key, source FROM a JOIN (SELECT doc_id, source FROM documents WHERE source IS NOT NULL) USING (doc_id))
    SELECT source, doc_id, chunk_id, anchor FROM (SELECT *, row_number() OVER (PARTITION BY source, key ORDER BY doc_id, chunk_id) AS n FROM k) WHERE n = 1""")
def c_materialise(spark, d):
    """Window chunks of the documents as candidates of their source; sentences of 40 characters and more are kept ones."""
    docs = sentence_arrays(spark, d, ["doc_id", "source"]).where("source IS NOT NULL").withColumn("kept", F.transform("s", lambda s: F.length(s) >= 40))
    anchor = F.get(F.filter("members", lambda j: F.get("kept", j)), F.lit(0))
    chunks = C.context_windows(docs, ["doc_id", "source", "kept"], 1).select("source", "doc_id", F.col("idx").alias("chunk_id"), F.col("chunk").alias("text"), anchor.alias("anchor"))
    return C.materialise(chunks, ["doc_id"], "source", ["doc_id", "chunk_id"]).select("source", "doc_id", "chunk_id", "anchor")


@query(f"""WITH s AS (SELECT doc_id, sent, idx FROM ({SENTS})), l AS (SELECT doc_id, max(idx) AS last FROM s GROUP BY 1), g AS (SELECT doc_id AS id, doc_id, n_chars % 12 AS sent_idx FROM documents WHERE text IS NOT NULL),
    p AS (SELECT *, sent_idx > last AS clamped, least(sent_idx, last) AS pos FROM g LEFT JOIN l USING (doc_id))
    SELECT id, p.doc_id, sent_idx, clamped, string_agg(sent, ' ' ORDER BY idx) AS evidence FROM p LEFT JOIN s ON s.doc_id = p.doc_id AND idx BETWEEN pos - 1 AND pos + 1 GROUP BY ALL""")
def c_windowed_evidence(spark, d):
    """A gold sentence per document, here at its length modulo 12, with its neighbours."""
    gold = table(spark, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("id"), "doc_id", (F.col("n_chars") % 12).alias("sent_idx"))
    return C.windowed_evidence(gold, table(spark, d, "documents").where("text IS NOT NULL"), "doc_id", "text", 1)
