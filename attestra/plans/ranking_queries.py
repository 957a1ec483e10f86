"""Queries of scoring, ranking and fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestra.functions import vectors as V
from attestra.operators.ranking import hybrid, minmax, rrf, top_k, zscore
from attestra.operators.scoring import lexical_scores, okapi, term_counts
from attestra.plans.common import CLAIMS_SQL, HYBRID_SQL, SCORES_SQL, SENTENCES_SQL, claims, minmax_sql, sentences, tf_sql
from attestra.registry import query, table

WEIGHTS = {"cos": 0.7, "lex": 0.2, "bm25": 0.1}
# The weightings compared with the default one, of cos, lex and bm25.
VARIANTS = {"dense": (1.0, 0.0, 0.0), "lexical": (0.0, 1.0, 0.0), "bm25": (0.0, 0.0, 1.0), "dense_lexical": (0.5, 0.5, 0.0), "dense_bm25": (0.5, 0.0, 0.5), "lexical_bm25": (0.0, 0.5, 0.5), "equal": (1 / 3, 1 / 3, 1 / 3), "hybrid": (0.7, 0.2, 0.1)}
BASE = f"WITH c AS ({CLAIMS_SQL}), p AS ({SENTENCES_SQL}), {SCORES_SQL}"


def scored(spark, d):
    return lexical_scores(claims(spark, d).select("event_id", "claim"), sentences(spark, d), ["event_id"], ["cand"])


def ranked(spark, d):
    return hybrid(scored(spark, d), ["event_id"], WEIGHTS)


def best_first(score: str, *ties: str):
    return [F.desc(score), *(F.asc(t) for t in ties)]


@query(f"{HYBRID_SQL} SELECT event_id, cand, hybrid, rk AS rank FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY hybrid DESC, cand) AS rk FROM hybrid) WHERE rk <= 5")
def r_hybrid_topk(spark, d):
    return top_k(ranked(spark, d), ["event_id"], best_first("hybrid", "cand"), 5).select("event_id", "cand", "hybrid", "rank")


@query(f"{BASE} SELECT event_id, cand, round(lex, 9) AS lex, rk AS rank FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY round(lex, 9) DESC, cand) AS rk FROM scored) WHERE rk <= 5")
def r_lex_f1_topk(spark, d):
    rows = scored(spark, d).withColumn("lex", F.round("lex", 9))
    return top_k(rows, ["event_id"], best_first("lex", "cand"), 5).select("event_id", "cand", "lex", "rank")


@query(f"{BASE} SELECT event_id, cand, round(bm25, 9) AS bm25, rk AS rank FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY round(bm25, 9) DESC, cand) AS rk FROM scored) WHERE rk <= 5")
def r_bm25_like_topk(spark, d):
    rows = scored(spark, d).withColumn("bm25", F.round("bm25", 9))
    return top_k(rows, ["event_id"], best_first("bm25", "cand"), 5).select("event_id", "cand", "bm25", "rank")


@query(f"{BASE} SELECT event_id, cand, round({minmax_sql('lex')}, 6) AS mm_lex, round({minmax_sql('bm25')}, 6) AS mm_bm25 FROM scored WINDOW e AS (PARTITION BY event_id)")
def r_minmax(spark, d):
    out = minmax(scored(spark, d), ["event_id"], ["lex", "bm25"])
    return out.select("event_id", "cand", F.round("mm_lex", 6).alias("mm_lex"), F.round("mm_bm25", 6).alias("mm_bm25"))


_variants = ", ".join(f"('{k}', {a!r}, {b!r}, {c!r})" for k, (a, b, c) in VARIANTS.items())


@query(f"""{HYBRID_SQL}, v AS (SELECT *, round(a * mcos + b * mlex + c * mbm25, 9) AS score FROM hybrid, (VALUES {_variants}) t(variant, a, b, c))
    SELECT event_id, variant, cand, score, rk AS rank FROM (SELECT *, row_number() OVER (PARTITION BY event_id, variant ORDER BY score DESC, cand) AS rk FROM v) WHERE rk <= 3""")
def r_hybrid_variants(spark, d):
    rows = minmax(scored(spark, d), ["event_id"], ["cos", "lex", "bm25"])
    weights = F.array(*(F.struct(F.lit(k).alias("variant"), *(F.lit(float(x)).alias(n) for n, x in zip("abc", w))) for k, w in VARIANTS.items()))
    rows = rows.select("event_id", "cand", "mm_cos", "mm_lex", "mm_bm25", F.inline(weights))
    rows = rows.withColumn("score", F.round(F.col("a") * F.col("mm_cos") + F.col("b") * F.col("mm_lex") + F.col("c") * F.col("mm_bm25"), 9))
    return top_k(rows, ["event_id", "variant"], best_first("score", "cand"), 3).select("event_id", "variant", "cand", "score", "rank")


_OKAPI = "ln(1.0 + (docs - df + 0.5) / (df + 0.5)) * s.tf * {k1p} / (s.tf + {k1} * (0.25 + 0.75 * s.n / mean))"


@query(f"""WITH c AS ({CLAIMS_SQL}), p AS ({SENTENCES_SQL}), q AS ({tf_sql("SELECT * FROM c", "event_id", "claim")}), s AS ({tf_sql("SELECT * FROM p", "event_id, cand", "text")}),
    len AS (SELECT event_id, count(*) AS docs, greatest(avg(n), 1.0) AS mean FROM (SELECT event_id, coalesce(n, 0) AS n FROM p LEFT JOIN (SELECT event_id, cand, any_value(n) AS n FROM s GROUP BY 1, 2) USING (event_id, cand)) GROUP BY event_id),
    df AS (SELECT event_id, t, count(*) AS df FROM s GROUP BY 1, 2),
    o AS (SELECT s.event_id, s.cand, round(sum({_OKAPI.format(k1p=2.5, k1=1.5)}), 6) AS okapi FROM s JOIN q USING (event_id, t) JOIN df USING (event_id, t) JOIN len USING (event_id) GROUP BY 1, 2)
    SELECT event_id, cand, okapi, rk AS rank FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY okapi DESC, cand) AS rk FROM o) WHERE rk <= 5""")
def r_okapi_topk(spark, d):
    rows = okapi(claims(spark, d), sentences(spark, d), ["event_id"], ["cand"]).withColumn("okapi", F.round("okapi", 6))
    return top_k(rows, ["event_id"], best_first("okapi", "cand"), 5).select("event_id", "cand", "okapi", "rank")


@query(f"""WITH c AS (SELECT item_id, text FROM heldout_items), q AS ({tf_sql("SELECT * FROM c", "item_id", "text")}), p AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL), s AS ({tf_sql("SELECT * FROM p", "doc_id", "text")}),
    len AS (SELECT count(*) AS docs, greatest(avg(coalesce(n, 0)), 1.0) AS mean FROM p LEFT JOIN (SELECT doc_id, any_value(n) AS n FROM s GROUP BY 1) USING (doc_id)), df AS (SELECT t, count(*) AS df FROM s GROUP BY 1),
    o AS (SELECT q.item_id, s.doc_id, round(sum({_OKAPI.format(k1p=2.2, k1=1.2)}), 6) AS okapi FROM s JOIN q USING (t) JOIN df USING (t), len GROUP BY 1, 2)
    SELECT item_id, doc_id, okapi, rk AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY okapi DESC, doc_id) AS rk FROM o) WHERE rk <= 5""")
def r_corpus_bm25(spark, d):
    q = table(spark, d, "heldout_items").select("item_id", F.col("text").alias("claim"))
    docs = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text")
    rows = okapi(q, docs, ["item_id"], ["doc_id"], k1=1.2, scope=[]).withColumn("okapi", F.round("okapi", 6))
    return top_k(rows, ["item_id"], best_first("okapi", "doc_id"), 5).select("item_id", "doc_id", "okapi", "rank")


@query(f"WITH p AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL), s AS ({tf_sql('SELECT * FROM p', 'doc_id', 'text')}) SELECT t AS term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM s GROUP BY t")
def s_inverted_index(spark, d):
    s = term_counts(table(spark, d, "documents").where("text IS NOT NULL"), ["doc_id"], "text")
    return s.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


#: Routes: each candidate ranked by three scorers within its event.
ROUTES_SQL = f"""{HYBRID_SQL}, routes AS (SELECT event_id, cand, key, hybrid, lex, route, row_number() OVER (PARTITION BY event_id, route ORDER BY score DESC, cand) AS rk
    FROM (SELECT *, unnest(['cos', 'lex', 'bm25']) AS route, round(unnest([cos, lex, bm25]), 9) AS score FROM hybrid) WHERE score > 0)"""
RRF_SQL = f"""{ROUTES_SQL}, fused AS (SELECT event_id, key, round(sum((CASE WHEN route = 'cos' THEN 1.2 ELSE 1.0 END) / (60 + rk)), 9) AS rrf, max(hybrid) AS max_score, count(DISTINCT route) AS hits, max(lex) AS lex, arg_max(cand, struct_pack(a := hybrid, b := -cand)) AS idx
    FROM routes WHERE rk <= 20 GROUP BY 1, 2)"""


def routes(spark, d, k: int = 20):
    rows = ranked(spark, d)
    each = F.inline(F.array(*(F.struct(F.lit(r).alias("route"), F.round(r, 9).alias("score")) for r in ("cos", "lex", "bm25"))))
    long = rows.select("event_id", "cand", "key", "hybrid", F.col("lex").alias("overlap"), each).where("score > 0")
    return top_k(long, ["event_id", "route"], best_first("score", "cand"), k)


def fused(spark, d, overlap: str | None = None):
    rows = routes(spark, d)
    return rrf(rows, ["event_id"], "key", "route", "rank", "hybrid", "cand", F.when(F.col("route") == "cos", 1.2).otherwise(1.0), keep={overlap: "overlap"} if overlap else None)


@query(f"{ROUTES_SQL} SELECT event_id, route, cand, rk AS rank FROM routes WHERE rk <= 20")
def r_routes(spark, d):
    return routes(spark, d).select("event_id", "route", "cand", "rank")


@query(f"{RRF_SQL} SELECT event_id, idx, rrf, round(max_score, 9) AS max_score, hits, rk AS rank FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY rrf DESC, max_score DESC, hits DESC, idx) AS rk FROM fused) WHERE rk <= 15")
def r_rrf_merge(spark, d):
    order = [F.desc("rrf"), F.desc("max_score"), F.desc("hits"), F.asc("idx")]
    return top_k(fused(spark, d), ["event_id"], order, 15).select("event_id", "idx", "rrf", F.round("max_score", 9).alias("max_score"), "hits", "rank")


@query(f"""{ROUTES_SQL}, a AS (SELECT event_id, cand, rk AS claim_rank FROM routes WHERE route = 'cos' AND rk <= 5), b AS (SELECT event_id, cand, count(*) AS hits FROM routes WHERE route <> 'cos' AND rk <= 5 GROUP BY 1, 2)
    SELECT event_id, cand, claim_rank, coalesce(hits, 0) AS hits, row_number() OVER (PARTITION BY event_id ORDER BY claim_rank NULLS LAST, coalesce(hits, 0) DESC, cand) AS rank FROM a FULL JOIN b USING (event_id, cand)""")
def r_universe_merge(spark, d):
    r = routes(spark, d, 5)
    a = r.where("route = 'cos'").select("event_id", "cand", F.col("rank").alias("claim_rank"))
    b = r.where("route <> 'cos'").groupBy("event_id", "cand").agg(F.count("*").alias("hits"))
    both = a.join(b, ["event_id", "cand"], "full_outer").withColumn("hits", F.coalesce("hits", F.lit(0)))
    return top_k(both, ["event_id"], [F.asc_nulls_last("claim_rank"), F.desc("hits"), F.asc("cand")])


@query(f"{BASE} SELECT event_id, cand, round(0.6 * (bm25 / (1 + abs(bm25))) + 0.3 * lex + 0.1 / rp, 6) AS score FROM (SELECT *, dense_rank() OVER (PARTITION BY event_id ORDER BY report_id NULLS LAST) AS rp FROM scored)")
def r_page_hybrid(spark, d):
    """Page-to-sentence score; a sentence's page is its report, pages ranked by id."""
    rows = scored(spark, d)
    pages = rows.select("event_id", "report_id").distinct()
    pages = top_k(pages, ["event_id"], [F.asc_nulls_last("report_id")], name="page_rank").withColumnRenamed("report_id", "rid")
    both = rows.alias("s").join(pages.alias("g"), F.expr("s.event_id = g.event_id AND s.report_id <=> g.rid"))
    b = F.col("bm25")
    return both.select("s.event_id", "cand", F.round(0.6 * (b / (1 + F.abs(b))) + 0.3 * F.col("lex") + 0.1 / F.col("page_rank"), 6).alias("score"))


@query(f"{RRF_SQL} SELECT event_id, idx, round(greatest(max_score, least(1.0, 20 * rrf)), 6) AS retrieval, round(0.7 * greatest(max_score, least(1.0, 20 * rrf)) + 0.3 * lex, 6) AS gate, max_score >= 0.5 AND 20 * rrf >= 0.15 AS passed FROM fused")
def r_gates(spark, d):
    """Retrieval score, the better of the hybrid and twenty times the fused one, and the gate, which adds the overlap with the claim."""
    score = F.greatest(F.col("max_score"), F.least(F.lit(1.0), 20 * F.col("rrf")))
    return fused(spark, d, "lex").select("event_id", "idx", F.round(score, 6).alias("retrieval"), F.round(0.7 * score + 0.3 * F.col("lex"), 6).alias("gate"), ((F.col("max_score") >= 0.5) & (20 * F.col("rrf") >= 0.15)).alias("passed"))


_STANCE = "list_transform(range(1, 11), lambda c: exp(-(s - c) * (s - c)))"


@query(f"""WITH x AS (SELECT candidate_id, {_STANCE} AS e FROM (SELECT candidate_id, 1 + 9 * base_score AS s FROM evidence_candidates WHERE base_score IS NOT NULL)), p AS (SELECT candidate_id, list_transform(e, lambda v: v / list_sum(e)) AS p FROM x)
    SELECT candidate_id, list_position(p, list_max(p)) AS bucket, round(list_sum(list_transform(p, lambda v, i: v * i)), 6) AS expected, round(-list_sum(list_transform(p, lambda v: CASE WHEN v > 0 THEN v * ln(v) ELSE 0 END)) / ln(10), 6) AS entropy, round(list_reverse_sort(p)[1] - list_reverse_sort(p)[2], 6) AS margin FROM p""")
def r_stance_buckets(spark, d):
    rows = table(spark, d, "evidence_candidates").where("base_score IS NOT NULL").select("candidate_id", V.stance_probabilities(1 + 9 * F.col("base_score")).alias("p"))
    return rows.select("candidate_id", (V.argmax(F.col("p")) + 1).alias("bucket"), F.round(V.expectation(F.col("p")), 6).alias("expected"), F.round(V.entropy(F.col("p")) / F.log(F.lit(10.0)), 6).alias("entropy"), F.round(V.margin(F.col("p")), 6).alias("margin"))


@query("""WITH x AS (SELECT candidate_id, event_id, base_score AS s, avg(base_score) OVER e AS m, stddev_pop(base_score) OVER e AS sd, row_number() OVER (PARTITION BY event_id ORDER BY base_score DESC, candidate_id) AS rk FROM evidence_candidates WHERE base_score IS NOT NULL AND event_id IS NOT NULL WINDOW e AS (PARTITION BY event_id))
    SELECT candidate_id, round(CASE WHEN sd < 1e-12 THEN 0 ELSE (s - m) / sd END, 6) AS z, round(1.0 / rk, 6) AS reciprocal, round(ln(greatest(1e-6, least(1 - 1e-6, s)) / (1 - greatest(1e-6, least(1 - 1e-6, s)))), 6) AS logit FROM x""")
def r_fusion_features(spark, d):
    rows = table(spark, d, "evidence_candidates").where("base_score IS NOT NULL AND event_id IS NOT NULL").select("candidate_id", "event_id", "base_score")
    rows = top_k(zscore(rows, ["event_id"], "base_score", "z"), ["event_id"], best_first("base_score", "candidate_id"))
    s = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("base_score")))
    return rows.select("candidate_id", F.round("z", 6).alias("z"), F.round(1.0 / F.col("rank"), 6).alias("reciprocal"), F.round(F.log(s / (1 - s)), 6).alias("logit"))


# What a relation and a directness count.
DIRECTNESS = {"direct": 1.0, "partial": 0.65, "context": 0.25, "none": 0.0}
RELATION = {"support": 1.0, "refute": 1.0, "qualify": 0.60, "mixed": 0.60, "background": 0.15, "irrelevant": 0.0}


def map_features(spark, d):
    """``directness, polarity, background, confidence, atoms``: numbers of an evidence map's annotations."""
    pick = lambda c, values: F.coalesce(F.create_map(*(F.lit(x) for kv in values.items() for x in kv))[F.lower(c)], F.lit(0.0))
    rel, direct = F.coalesce(F.lower("map_relation"), F.lit("irrelevant")), F.coalesce(F.lower("map_directness"), F.lit("none"))
    background = F.when(rel == "irrelevant", 1.0).when(rel == "background", 0.9).when(direct == "none", 0.8).when(direct == "context", 0.55).otherwise(0.0)
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("map_confidence", F.lit(0.0))))
    rows = table(spark, d, "evidence_candidates")
    return rows.select("candidate_id", "event_id", F.coalesce(F.size("covered_atom_ids"), F.lit(0)).alias("atoms"), pick(direct, DIRECTNESS).alias("directness"), pick(rel, RELATION).alias("polarity"), background.alias("background"), confidence.alias("confidence"), "covered_atom_ids", "source_group", "duplicate_group", "base_score", "evidence_map_quality_score", "map_relation")


def _case(c: str, values: dict) -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " ELSE 0.0 END"


MAP_SQL = f"""SELECT *, {_case("d", DIRECTNESS)} AS directness, {_case("r", RELATION)} AS polarity, CASE WHEN r = 'irrelevant' THEN 1.0 WHEN r = 'background' THEN 0.9 WHEN d = 'none' THEN 0.8 WHEN d = 'context' THEN 0.55 ELSE 0.0 END AS background,
    greatest(0.0, least(1.0, coalesce(map_confidence, 0.0))) AS confidence, coalesce(len(covered_atom_ids), 0) AS atoms FROM (SELECT *, coalesce(lower(map_relation), 'irrelevant') AS r, coalesce(lower(map_directness), 'none') AS d FROM evidence_candidates)"""


@query(f"SELECT candidate_id, round(greatest(0.0, least(1.0, 0.35 * least(1.0, atoms / 3.0) + 0.25 * directness + 0.2 * polarity + 0.1 * confidence - 0.2 * background)), 6) AS quality FROM ({MAP_SQL})")
def r_map_features(spark, d):
    """Quality of a candidate in the evidence map; three atoms count as full coverage, as the tables list no atom weights."""
    q = 0.35 * F.least(F.lit(1.0), F.col("atoms") / 3.0) + 0.25 * F.col("directness") + 0.2 * F.col("polarity") + 0.1 * F.col("confidence") - 0.2 * F.col("background")
    return map_features(spark, d).select("candidate_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), q)), 6).alias("quality"))


@query("""WITH x AS (SELECT event_id, evidence_arm AS arm, prompt_token_count AS s, assignment_id, sample_id FROM prepared_samples WHERE event_id IS NOT NULL AND prompt_token_count IS NOT NULL),
    z AS (SELECT *, CASE WHEN stddev_pop(s) OVER e < 1e-12 THEN 0 ELSE (s - avg(s) OVER e) / stddev_pop(s) OVER e END AS z, count(*) OVER e - row_number() OVER (PARTITION BY event_id ORDER BY s DESC, sample_id) AS borda FROM x WINDOW e AS (PARTITION BY event_id))
    SELECT arm, round(avg(z), 6) AS mean_z, round(avg(s), 6) AS mean_s, round(avg(borda), 6) AS mean_borda, count(*) AS votes FROM z GROUP BY arm""")
def r_permutation_scores(spark, d):
    """Scores of choices over repeated presentations: mean z-score, mean and Borda count per choice."""
    rows = table(spark, d, "prepared_samples").where("event_id IS NOT NULL AND prompt_token_count IS NOT NULL").select("event_id", "evidence_arm", F.col("prompt_token_count").cast("double").alias("s"), "sample_id")
    sizes = rows.groupBy("event_id").agg(F.count("*").alias("n"))
    z = top_k(zscore(rows, ["event_id"], "s", "z"), ["event_id"], best_first("s", "sample_id")).join(sizes, "event_id")
    return z.groupBy(F.col("evidence_arm").alias("arm")).agg(F.round(F.avg("z"), 6).alias("mean_z"), F.round(F.avg("s"), 6).alias("mean_s"), F.round(F.avg(F.col("n") - F.col("rank")), 6).alias("mean_borda"), F.count("*").alias("votes"))


_LOGPROB = "list_transform(range(1, 7), lambda c: -abs(c - 1 - 5 * s))"


@query(f"""WITH x AS (SELECT candidate_id, {_LOGPROB} AS z FROM (SELECT candidate_id, base_score AS s FROM evidence_candidates WHERE base_score IS NOT NULL)), p AS (SELECT *, list_transform(z, lambda v: exp(v - list_max(z))) AS e FROM x), q AS (SELECT *, list_transform(e, lambda v: v / list_sum(e)) AS p FROM p)
    SELECT candidate_id, list_position(z, list_max(z)) - 1 AS top, round(list_reverse_sort(z)[1] - list_reverse_sort(z)[2], 6) AS margin, round(-list_sum(list_transform(p, lambda v: v * ln(v))), 6) AS entropy FROM q""")
def r_label_logprobs(spark, d):
    """Summary of a label's log scores: argmax, margin of the first two, entropy of the softmax."""
    z = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda c: -F.abs(c - 5 * F.col("base_score")))
    rows = table(spark, d, "evidence_candidates").where("base_score IS NOT NULL").select("candidate_id", z.alias("z"))
    return rows.select("candidate_id", V.argmax(F.col("z")).alias("top"), F.round(V.margin(F.col("z")), 6).alias("margin"), F.round(V.entropy(V.softmax(F.col("z"))), 6).alias("entropy"))


@query("""WITH l AS (SELECT label_schema, gold_id, count(*) AS c FROM prepared_samples WHERE gold_id >= 0 GROUP BY 1, 2), t AS (SELECT label_schema, sum(c) AS total FROM l GROUP BY 1)
    SELECT label_schema, gold_id, round(c / total, 6) AS prior, round(0.5 - 1.0 * ln(c / total), 6) AS adjusted FROM l JOIN t USING (label_schema)""")
def r_prior_adjustment(spark, d):
    """A constant score of 0.5 less the log prior of each class; schemas are few, so their totals ride on the same rows."""
    counts = table(spark, d, "prepared_samples").where("gold_id >= 0").groupBy("label_schema", "gold_id").agg(F.count("*").alias("c"))
    prior = F.col("c") / F.col("total")
    return counts.join(counts.groupBy("label_schema").agg(F.sum("c").alias("total")), "label_schema").select("label_schema", "gold_id", F.round(prior, 6).alias("prior"), F.round(0.5 - F.log(prior), 6).alias("adjusted"))


@query(f"""{BASE}, len AS (SELECT event_id, count(*) AS docs, greatest(avg(n), 1.0) AS mean FROM (SELECT p.event_id, coalesce(n, 0) AS n FROM p LEFT JOIN (SELECT event_id, cand, any_value(n) AS n FROM s GROUP BY 1, 2) USING (event_id, cand)) GROUP BY event_id),
    df AS (SELECT event_id, t, count(*) AS df FROM s GROUP BY 1, 2), o AS (SELECT s.event_id, s.cand, sum({_OKAPI.format(k1p=2.5, k1=1.5)}) AS okapi FROM s JOIN q USING (event_id, t) JOIN df USING (event_id, t) JOIN len USING (event_id) GROUP BY 1, 2),
    m AS (SELECT scored.event_id, scored.cand, coalesce(okapi, 0.0) AS okapi, lex FROM scored LEFT JOIN o USING (event_id, cand)), z AS (SELECT event_id, cand, round(0.7 * ({minmax_sql("okapi")}) + 0.3 * ({minmax_sql("lex")}), 6) AS score FROM m WINDOW e AS (PARTITION BY event_id))
    SELECT event_id, cand, score, rk AS rank FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY score DESC, cand) AS rk FROM z) WHERE rk <= 5""")
def r_coverage_rank(spark, d):
    """Sentences by collection BM25 and overlap, rounded before they are ranked."""
    rows = scored(spark, d).select("event_id", "cand", "lex")
    o = okapi(claims(spark, d), sentences(spark, d), ["event_id"], ["cand"])
    m = minmax(rows.join(o, ["event_id", "cand"], "left").na.fill(0.0, ["okapi"]), ["event_id"], ["okapi", "lex"])
    z = m.withColumn("score", F.round(0.7 * F.col("mm_okapi") + 0.3 * F.col("mm_lex"), 6))
    return top_k(z, ["event_id"], best_first("score", "cand"), 5).select("event_id", "cand", "score", "rank")
