"""Queries of the selectors."""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import functions as F

from attestra.functions import text as T
from attestra.functions import vectors as V
from attestra.operators import chains, cover, pools
from attestra.operators import selection as S
from attestra.operators.ranking import top_k
from attestra.plans.common import CONTENT, HYBRID_SQL, KEY
from attestra.plans.ranking_queries import MAP_SQL, RRF_SQL, best_first, fused, map_features, ranked
from attestra.registry import query, table

#: The candidates of an event that the selectors on evidence maps and chains read, best first: the default of their parameter.
POOL = 20
EMB = "SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings"
#: Vectors of a label scored by their closeness to the label's first one.
DENSE_SQL = f"""e AS ({EMB}), q AS (SELECT label, arg_min(v, vec_id) AS qv FROM e GROUP BY label),
    pool AS (SELECT e.label, vec_id, v, round(list_dot_product(v, qv), 9) AS s, row_number() OVER (PARTITION BY e.label ORDER BY round(list_dot_product(v, qv), 9) DESC, vec_id) AS rk FROM e JOIN q USING (label)),
    sim AS (SELECT a.label, a.rk AS i, b.rk AS j, round(list_dot_product(a.v, b.v), 9) AS sim FROM pool a JOIN pool b USING (label))"""


def mmr_sql(k: int, lam: str = "0.7") -> str:
    """Greedy choice step by step: each step's best candidate joins the list; ``lam`` may use the step number n."""
    return f"""pick AS (SELECT label, 1 AS n, [rk] AS chosen FROM pool WHERE rk = 1 UNION ALL
    SELECT label, n + 1, list_append(chosen, arg_max(rk, struct_pack(g := g, r := -rk))) FROM (
    SELECT p.label, p.n, p.chosen, c.rk, round({lam} * c.s - (1 - {lam}) * (SELECT greatest(0.0, max(sim)) FROM sim WHERE sim.label = p.label AND sim.i = c.rk AND list_contains(p.chosen, sim.j)), 9) AS g
    FROM pick p JOIN pool c ON c.label = p.label AND NOT list_contains(p.chosen, c.rk) WHERE p.n < {k}) GROUP BY label, n, chosen),
    done AS (SELECT label, chosen FROM pick WHERE n = {k}), steps AS (SELECT label, generate_subscripts(chosen, 1) AS step, unnest(chosen) AS rk FROM done)"""


def greedy_sql(k: int, gain: str, state: dict[str, tuple[str, str]] | None = None, stop: str = "true") -> str:
    """Steps of a greedy choice over ``pool(event_id, rk, ...)``: ``steps(event_id, step, rk, v)``.

    ``gain`` may use the candidate c, the chosen ranks p.chosen and the state p.*; ``state``: name to (empty value, what a
    candidate adds as a list). A step is taken while ``stop`` holds for its gain v.
    """
    state = state or {}
    first = "".join(f", {e} AS {n}" for n, (e, _) in state.items())
    held = "".join(f", p.{n}" for n in state)
    added = "".join(f", list_concat({n}, arg_max(add_{n}, struct_pack(v := v, r := -rk))) AS {n}" for n in state)
    adds = "".join(f", {a} AS add_{n}" for n, (_, a) in state.items())
    names = "".join(f", {n}" for n in state)
    return f"""pick AS (SELECT DISTINCT event_id, 0 AS n, []::BIGINT[] AS chosen, []::DOUBLE[] AS gains{first} FROM pool UNION ALL
    SELECT event_id, n + 1, list_append(chosen, arg_max(rk, struct_pack(v := v, r := -rk))), list_append(gains, max(v)){added} FROM (
    SELECT p.event_id, p.n, p.chosen, p.gains{held}, c.rk, round({gain}, 9) AS v{adds} FROM pick p JOIN pool c ON c.event_id = p.event_id AND NOT list_contains(p.chosen, c.rk) WHERE p.n < {k}) WHERE {stop} GROUP BY event_id, n, chosen, gains{names}),
    done AS (SELECT event_id, arg_max(chosen, n) AS chosen, arg_max(gains, n) AS gains FROM pick GROUP BY event_id), steps AS (SELECT event_id, generate_subscripts(chosen, 1) AS step, unnest(chosen) AS rk, unnest(gains) AS v FROM done)"""


JACCARD = "sim AS (SELECT a.event_id, a.rk AS i, b.rk AS j, CASE WHEN len(list_distinct(list_concat(a.w, b.w))) = 0 THEN 1.0 ELSE len(list_intersect(list_distinct(a.w), list_distinct(b.w))) * 1.0 / len(list_distinct(list_concat(a.w, b.w))) END AS sim FROM pool a JOIN pool b USING (event_id))"
TOKEN_GAIN = "0.7 * c.score - 0.3 * coalesce((SELECT max(sim) FROM sim WHERE sim.event_id = p.event_id AND sim.i = c.rk AND list_contains(p.chosen, sim.j)), 0.0)"
SPLIT_KEY = "regexp_split_to_array(key, '\\s+')"


def dense(spark, d):
    """Vectors of each label, and the label's first one as its query."""
    e = table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return e, e.groupBy("label").agg(F.min_by("v", "vec_id").alias("q"))


def dense_pool(spark, d):
    e, q = dense(spark, d)
    return e.join(q, "label").select("label", "vec_id", "v", F.round(V.dot(F.col("v"), F.col("q")), 9).alias("s"))


def dense_runs(spark, d, runs):
    """What MMR over all vectors of a label chooses under each run's lambdas."""
    e, q = dense(spark, d)
    return S.mmr_rounds(e, ["label"], "vec_id", "v", q, runs)


def dense_select(spark, d, lams):
    at = dense_runs(spark, d, {"": lams}).select("label", F.posexplode("chosen").alias("n", "c"))
    return at.select("label", (F.col("n") + 1).cast("long").alias("step"), "c.vec_id")


@query(f"WITH RECURSIVE {DENSE_SQL}, {mmr_sql(5)} SELECT label, step, vec_id FROM steps JOIN pool USING (label, rk)")
def g_mmr(spark, d):
    return dense_select(spark, d, [0.7] * 5)


STEP_LAMBDAS = [0.7, 0.9, 0.7, 0.5, 0.3]


@query(f"WITH RECURSIVE {DENSE_SQL}, {mmr_sql(5, '(1.1 - 0.2 * p.n)')} SELECT label, step, vec_id FROM steps JOIN pool USING (label, rk)")
def g_mmr_stepwise(spark, d):
    return dense_select(spark, d, STEP_LAMBDAS)


@query(f"WITH RECURSIVE {DENSE_SQL}, {mmr_sql(5)} SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) AS rank FROM steps JOIN pool USING (label, rk)")
def g_mmr_resorted(spark, d):
    """The chosen set of MMR, then in order of relevance."""
    chosen = g_mmr(spark, d).join(dense_pool(spark, d).select("label", "vec_id", "s"), ["label", "vec_id"])
    return top_k(chosen, ["label"], best_first("s", "vec_id")).select("label", "vec_id", "rank")


@query(f"WITH RECURSIVE {DENSE_SQL}, {mmr_sql(12)} SELECT label, step, vec_id FROM steps JOIN pool USING (label, rk)")
def g_mmr_pool(spark, d):
    """A pool of twelve in the order in which MMR takes them."""
    return dense_select(spark, d, [0.7] * 12)


_GATE = "c.lam * c.s - (1 - c.lam) * greatest(0.0, coalesce((SELECT max(sim) FROM sim WHERE sim.label = c.label AND sim.i = c.rk AND list_contains(p.chosen, sim.j)), 0.0))"


@query(f"""WITH RECURSIVE {DENSE_SQL.replace("pool AS", "dense AS").replace("FROM pool a JOIN pool b", "FROM dense a JOIN dense b")}, pool AS (SELECT label || '|' || lam AS event_id, label, lam, rk, s FROM dense, (VALUES (0.3), (0.7), (1.0)) t(lam)), {greedy_sql(5, _GATE)},
    sets AS (SELECT label, list(rk) FILTER (lam = 0.3) AS low, list(rk) FILTER (lam = 0.7) AS base, list(rk) FILTER (lam = 1.0) AS high, avg(s) FILTER (lam = 0.3) AS s_low, avg(s) FILTER (lam = 1.0) AS s_high FROM steps JOIN pool USING (event_id, rk) GROUP BY label),
    red AS (SELECT sets.label, avg(sim) AS redundancy FROM sets JOIN sim ON sim.label = sets.label AND i < j AND list_contains(high, i) AND list_contains(high, j) GROUP BY 1),
    g AS (SELECT label, greatest(1 - len(list_intersect(low, base)) / len(list_distinct(list_concat(low, base))), 1 - len(list_intersect(low, high)) / len(list_distinct(list_concat(low, high)))) AS sens, redundancy, s_low >= 0.5 * greatest(s_high, 1e-12) AS holds FROM sets JOIN red USING (label))
    SELECT label, CASE WHEN sens >= 0.3 AND redundancy >= 0.2 AND holds THEN 0.3::DOUBLE ELSE 0.7 END AS "lambda", round(sens, 6) AS sensitivity, round(redundancy, 6) AS redundancy FROM g""")
def g_sensitivity_gate(spark, d):
    def run(p: S.Pool):
        if p["n"][0] <= 5:
            return [(0.7, 0.0, 0.0)]
        chosen = dict(zip(p["run"], p["chosen"]))
        rows = {c["vec_id"]: c for x in chosen.values() for c in x}
        place = {k: i for i, k in enumerate(rows)}
        m = np.stack([c["v"] for c in rows.values()])
        at = [[place[c["vec_id"]] for c in chosen[x]] for x in ("low", "base", "high")]
        return [tuple(round(x, 6) for x in S.gate(np.array([c["s"] for c in rows.values()]), np.round(m @ m.T, 9), *at))]

    runs = dense_runs(spark, d, {"low": [0.3] * 5, "base": [0.7] * 5, "high": [1.0] * 5})
    packed = runs.groupBy("label").agg(F.collect_list(F.struct("run", "n", "chosen")).alias("runs"))
    return S.per_row(packed, ["label"], "runs", run, "`lambda` double, sensitivity double, redundancy double")


LAMBDAS = [0.3, 0.5, 0.7, 0.9]


@query("""WITH u AS (SELECT event_id, list_transform([0.3, 0.5, 0.7, 0.9], lambda l: -abs(l - b)) AS u FROM (SELECT event_id, avg(base_score) AS b FROM evidence_candidates WHERE event_id IS NOT NULL AND base_score IS NOT NULL GROUP BY 1)),
    p AS (SELECT event_id, list_transform(list_transform(u, lambda x: exp(x / 0.1)), lambda e: e / list_sum(list_transform(u, lambda x: exp(x / 0.1)))) AS p FROM u)
    SELECT event_id, ([0.3, 0.5, 0.7, 0.9]::DOUBLE[])[list_position(p, list_max(p))] AS argmax_lambda, round(0.3 * p[1] + 0.5 * p[2] + 0.7 * p[3] + 0.9 * p[4], 6) AS expected_lambda, round(list_reverse_sort(u)[1] - list_reverse_sort(u)[2], 6) AS gap, round(list_max(u) - u[3], 6) AS margin FROM p JOIN u USING (event_id)""")
def g_soft_lambda(spark, d):
    """Soft targets over lambdas from their utilities: the likeliest, the expected, and two weights of the sample, the gap of the
    two best utilities and the margin of the best over the base lambda 0.7. A utility is, for want of a trained verifier, the
    closeness of the lambda to the event's mean score."""
    b = table(spark, d, "evidence_candidates").where("event_id IS NOT NULL AND base_score IS NOT NULL").groupBy("event_id").agg(F.avg("base_score").alias("b"))
    lams = F.array(*(F.lit(x) for x in LAMBDAS))
    u = b.select("event_id", F.transform(lams, lambda x: -F.abs(x - F.col("b"))).alias("u"))
    p = u.select("event_id", "u", V.softmax(F.transform("u", lambda x: x / 0.1)).alias("p"))
    return p.select("event_id", F.get(lams, V.argmax(F.col("p"))).alias("argmax_lambda"), F.round(V.dot(F.col("p"), lams), 6).alias("expected_lambda"), F.round(V.margin(F.col("u")), 6).alias("gap"), F.round(F.array_max("u") - F.get("u", F.lit(LAMBDAS.index(0.7))), 6).alias("margin"))


# Pools of two routes: the hybrid ranking, and the fused routes.
BASE_POOL = f"base AS (SELECT event_id, key, cand, hybrid, brk FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY hybrid DESC, cand) AS brk FROM hybrid) WHERE brk <= 15), route AS (SELECT event_id, key, idx, rrf, hits, max_score, rrk FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY rrf DESC, max_score DESC, hits DESC, idx) AS rrk FROM fused) WHERE rrk <= 15)"
UNION_SQL = f"{RRF_SQL}, {BASE_POOL}, both_pools AS (SELECT event_id, key, coalesce(cand, idx) AS cand, hybrid, brk, rrf, hits, max_score, rrk, brk IS NOT NULL AS in_base, rrk IS NOT NULL AS in_routes FROM base FULL JOIN route USING (event_id, key))"


def union_pool(spark, d):
    """Both pools from one scored frame: the base ranking is one more route, and one aggregate makes a key's row."""
    each = F.inline(F.array(F.struct(F.lit("base").alias("route"), F.col("hybrid").alias("score")), *(F.struct(F.lit(r).alias("route"), F.round(r, 9).alias("score")) for r in ("cos", "lex", "bm25"))))
    long = ranked(spark, d).select("event_id", "cand", "key", "hybrid", each).where("route = 'base' OR score > 0")
    best = top_k(long, ["event_id", "route"], best_first("score", "cand"), 20).where("route <> 'base' OR rank <= 15")
    routed, base = F.col("route") != "base", F.col("route") == "base"
    weight = F.when(F.col("route") == "cos", 1.2).otherwise(1.0)
    keyed = best.groupBy("event_id", "key").agg(
        F.max(F.when(base, F.col("rank"))).alias("brk"), F.max(F.when(base, F.col("hybrid"))).alias("hybrid"), F.round(F.sum(F.when(routed, weight / (60 + F.col("rank")))), 9).alias("rrf"),
        F.count_if(routed).alias("hits"), F.max(F.when(routed, F.col("hybrid"))).alias("max_score"), F.min("cand").alias("cand"),
    )
    # Routes bring at most sixty keys an event, so this rank needs no limit.
    placed = top_k(keyed, ["event_id"], [F.desc_nulls_last("rrf"), F.desc("max_score"), F.desc("hits"), F.asc("cand")], name="rrk")
    inside = F.col("rrf").isNotNull() & (F.col("rrk") <= 15)
    held = [F.when(inside, F.col(c)).alias(c) for c in ("rrk", "rrf", "hits", "max_score")]
    rows = placed.select("event_id", "key", "cand", "brk", "hybrid", *held, F.col("brk").isNotNull().alias("in_base"), inside.alias("in_routes"))
    return rows.where("in_base OR in_routes")


@query(f"{UNION_SQL} SELECT event_id, cand, brk, rrk, in_base, in_routes FROM both_pools")
def j_pool_union(spark, d):
    return union_pool(spark, d).select("event_id", "cand", "brk", "rrk", "in_base", "in_routes")


MODES = {"base": "in_base", "routes": "in_routes", "union": "true", "intersection": "in_base AND in_routes"}


@query(f"{UNION_SQL} " + " UNION ALL ".join(f"SELECT event_id, '{k}' AS mode, count(*) AS n FROM both_pools WHERE {v} GROUP BY event_id" for k, v in MODES.items()))
def g_pool_modes(spark, d):
    """Size of an event's pool under each way of merging."""
    fits = F.array(*(F.when(F.expr(v), F.lit(k)) for k, v in MODES.items()))
    rows = union_pool(spark, d).select("event_id", F.explode(F.filter(fits, lambda x: x.isNotNull())).alias("mode"))
    return rows.groupBy("event_id", "mode").agg(F.count("*").alias("n"))


SCORE = "greatest(coalesce(hybrid, 0.0), coalesce(max_score, 0.0))"


@query(f"{UNION_SQL} SELECT event_id, cand, place, rk AS rank FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY place, cand) AS rk FROM (SELECT *, least(2 * brk - 1, 2 * rrk) AS place FROM both_pools)) WHERE rk <= 8")
def g_interleave(spark, d):
    return pools.interleave(union_pool(spark, d), ["event_id"], "brk", "rrk", "cand", 8).select("event_id", "cand", "place", "rank")


@query(f"{UNION_SQL} SELECT event_id, cand, rk AS rank FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY in_base DESC, coalesce(brk, rrk), cand) AS rk FROM both_pools) WHERE rk <= 8")
def g_baseline_first(spark, d):
    return top_k(union_pool(spark, d), ["event_id"], [F.desc("in_base"), F.expr("coalesce(brk, rrk)").asc(), F.asc("cand")], 8).select("event_id", "cand", "rank")


_RULES = "round(CASE WHEN in_base AND in_routes THEN 0.04 ELSE 0.0 END + 0.01 / coalesce(brk, rrk) + coalesce(rrf, 0.0) + 0.004 * coalesce(hits, 0) + 0.01 * coalesce(max_score, hybrid), 9)"


@query(f"{UNION_SQL} SELECT event_id, cand, score, rk AS rank FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY score DESC, cand) AS rk FROM (SELECT *, {_RULES} AS score FROM both_pools)) WHERE rk <= 8")
def g_union_rules(spark, d):
    rows = union_pool(spark, d).withColumn("score", F.expr(_RULES))
    return top_k(rows, ["event_id"], best_first("score", "cand"), 8).select("event_id", "cand", "score", "rank")


_UNION_REL = f"round({SCORE} + coalesce(rrf, 0.0) + 0.004 * coalesce(hits, 0), 9)"


@query(f"""{UNION_SQL.replace("WITH c AS", "WITH RECURSIVE c AS", 1)}, rel AS (SELECT *, {_UNION_REL} AS rel FROM both_pools), m AS (SELECT *, min(rel) OVER w AS lo, max(rel) OVER w AS hi, row_number() OVER (PARTITION BY event_id ORDER BY rel DESC, cand) AS rk FROM rel WINDOW w AS (PARTITION BY event_id)),
    pool AS (SELECT event_id, rk, cand, {SPLIT_KEY} AS w, CASE WHEN hi - lo > 1e-8 THEN (rel - lo) / (hi - lo) ELSE 0.0 END AS score FROM m WHERE rk <= 30), {JACCARD}, {greedy_sql(8, TOKEN_GAIN)} SELECT event_id, step, cand FROM steps JOIN pool USING (event_id, rk)""")
def g_union_mmr(spark, d):
    """MMR over both pools, closeness by shared words of the keys."""
    rows = union_pool(spark, d).withColumn("rel", F.expr(_UNION_REL))

    def run(p: S.Pool):
        lo, hi = p["rel"].min(), p["rel"].max()
        score = (p["rel"] - lo) / (hi - lo) if hi - lo > 1e-8 else p["rel"] * 0.0
        return [(n, p["cand"][i]) for n, i in enumerate(S.token_mmr(score, _words(p), 8), 1)]

    return S.grouped(rows, ["event_id"], best_first("rel", "cand"), 30, run, "step long, cand long")


def _words(p: S.Pool) -> list[set]:
    return [set(k.split()) for k in p["key"]]


@query(f"""{HYBRID_SQL.replace("WITH c AS", "WITH RECURSIVE c AS", 1)}, pool AS (SELECT event_id, cand, {SPLIT_KEY} AS w, hybrid AS score, row_number() OVER (PARTITION BY event_id ORDER BY hybrid DESC, cand) AS rk FROM hybrid), {JACCARD}, {greedy_sql(5, TOKEN_GAIN)}
    SELECT event_id, step, cand FROM steps JOIN pool USING (event_id, rk)""")
def g_token_mmr(spark, d):
    run = lambda p: [(n, p["cand"][i]) for n, i in enumerate(S.token_mmr(p["hybrid"], _words(p), 5), 1)]
    order = best_first("hybrid", "cand")
    rows = S.may_win(ranked(spark, d).select("event_id", "cand", "key", "hybrid"), ["event_id"], order, "hybrid", 5)
    return S.grouped(rows, ["event_id"], order, None, run, "step long, cand long")


@query(f"""{RRF_SQL.replace("WITH c AS", "WITH RECURSIVE c AS", 1)}, pool AS (SELECT event_id, idx, {SPLIT_KEY} AS w, rrf / max(rrf) OVER (PARTITION BY event_id) AS score, row_number() OVER (PARTITION BY event_id ORDER BY rrf DESC, max_score DESC, idx) AS rk FROM fused), {JACCARD}, {greedy_sql(5, TOKEN_GAIN)}
    SELECT event_id, step, idx FROM steps JOIN pool USING (event_id, rk)""")
def g_rrf_mmr(spark, d):
    """MMR with the fused score as relevance, over all fused candidates: at most twenty of each of three routes."""
    run = lambda p: [(n, p["idx"][i]) for n, i in enumerate(S.token_mmr(p["rrf"] / p["rrf"].max(), _words(p), 5), 1)]
    return S.grouped(fused(spark, d), ["event_id"], [F.desc("rrf"), F.desc("max_score"), F.asc("idx")], None, run, "step long, idx long")


RANKED_CAND = "SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY coalesce(base_score, 0.0) DESC, candidate_id) AS rk FROM evidence_candidates WHERE event_id IS NOT NULL AND text IS NOT NULL"


def ranked_candidates(spark, d, k: int | None = None):
    rows = table(spark, d, "evidence_candidates").where("event_id IS NOT NULL AND text IS NOT NULL")
    return top_k(rows.withColumn("b", F.coalesce("base_score", F.lit(0.0))), ["event_id"], best_first("b", "candidate_id"), k)


@query(f"""WITH r AS (SELECT event_id, candidate_id, rk, len({CONTENT.format("text")}) AS cost FROM ({RANKED_CAND}) WHERE rk <= 32), t AS (SELECT *, sum(cost) OVER (PARTITION BY event_id ORDER BY rk) AS total FROM r),
    b AS (SELECT event_id, coalesce(arg_min(rk, struct_pack(d := abs(total - 60), o := total > 60, r := -rk)) FILTER (total <= 92), 1) AS k FROM t GROUP BY event_id)
    SELECT event_id, candidate_id, CAST(total AS BIGINT) AS total FROM t JOIN b USING (event_id) WHERE rk <= k""")
def g_prompt_budget(spark, d):
    """The ranked prefix whose tokens come closest to 60, at most 32 above."""
    rows = ranked_candidates(spark, d, 32).withColumn("cost", F.size(T.content_tokens("text")))
    return pools.prefix_budget(rows, ["event_id"], "rank", "cost", F.lit(60)).where("chosen").select("event_id", "candidate_id", "total")


@query("""SELECT event_id, row_id, rk AS rank FROM (SELECT event_id, row_id, row_number() OVER (PARTITION BY event_id ORDER BY coalesce(raw_is_evidence, false) DESC, sent_idx NULLS LAST, row_id) AS rk FROM sentence_items WHERE event_id IS NOT NULL) WHERE rk <= 5""")
def g_raw_label_topk(spark, d):
    """Rows marked as evidence first, padded by the others in their order."""
    rows = table(spark, d, "sentence_items").where("event_id IS NOT NULL").withColumn("e", F.coalesce("raw_is_evidence", F.lit(False)))
    return top_k(rows, ["event_id"], [F.desc("e"), F.asc_nulls_last("sent_idx"), F.asc("row_id")], 5).select("event_id", "row_id", "rank")


@query(f"""WITH m AS (SELECT event_id, {KEY.format("text")} AS key, max(coalesce(evidence_map_quality_score, 0.0)) AS score, arg_min(candidate_id, struct_pack(s := -coalesce(evidence_map_quality_score, 0.0), c := candidate_id)) AS candidate_id FROM evidence_candidates WHERE event_id IS NOT NULL AND text IS NOT NULL GROUP BY 1, 2)
    SELECT event_id, candidate_id, rk AS rank FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY score DESC, candidate_id) AS rk FROM m) WHERE rk <= 5""")
def g_reranker_topk(spark, d):
    """Equal texts keep their best outside score, then the top five."""
    rows = table(spark, d, "evidence_candidates").where("event_id IS NOT NULL AND text IS NOT NULL").withColumn("s", F.coalesce("evidence_map_quality_score", F.lit(0.0)))
    best = rows.groupBy("event_id", T.canonical_key("text").alias("key")).agg(F.max("s").alias("score"), F.min_by("candidate_id", F.struct(-F.col("s"), F.col("candidate_id"))).alias("candidate_id"))
    return top_k(best, ["event_id"], best_first("score", "candidate_id"), 5).select("event_id", "candidate_id", "rank")


def annotated(spark, d):
    """Candidates with everything the step-by-step selectors read; missing values are empty, neutral or 0."""
    rows = table(spark, d, "evidence_candidates").where("event_id IS NOT NULL").select("candidate_id", T.canonical_key("text").alias("key"), F.lower("map_directness").alias("directness_name"), F.size(T.content_tokens("text")).alias("cost"))
    feats = map_features(spark, d).select("candidate_id", "event_id", F.coalesce("covered_atom_ids", F.array().cast("array<string>")).alias("atoms"), F.coalesce(F.lower("map_relation"), F.lit("irrelevant")).alias("relation"), "directness", "polarity", "background", "confidence", F.coalesce("source_group", F.lit("")).alias("source"), F.coalesce("duplicate_group", F.lit("")).alias("dup"), F.coalesce("base_score", F.lit(0.0)).alias("base"), F.coalesce("evidence_map_quality_score", F.lit(0.0)).alias("quality"))
    return rows.join(feats, "candidate_id").fillna({"directness_name": "none", "key": "", "cost": 0})


def stepwise(spark, d, schema: str, choose, pool: int | None = POOL):
    """``choose`` yields rows without the event for an annotated pool, all of the event if None; atoms all weigh 1."""
    def run(p: S.Pool):
        p["atoms"] = [sorted(set(a)) for a in p["atoms"]]
        return choose(p, {a: 1.0 for a in sorted({a for x in p["atoms"] for a in x})})

    return S.grouped(annotated(spark, d), ["event_id"], best_first("base", "candidate_id"), pool, run, schema)


#: The annotated pool of an event, best twenty by base score.
POOL_SQL = f"""a AS (SELECT event_id, candidate_id, coalesce({KEY.format("text")}, '') AS key, coalesce(base_score, 0.0) AS base, coalesce(evidence_map_quality_score, 0.0) AS quality, list_sort(list_distinct(coalesce(covered_atom_ids, []))) AS atoms, r AS relation, directness, polarity, background, confidence, coalesce(lower(map_directness), 'none') AS direct_name, len({CONTENT.format("coalesce(text, '')")}) AS cost, coalesce(source_group, '') AS source, coalesce(duplicate_group, '') AS dup FROM ({MAP_SQL}) WHERE event_id IS NOT NULL),
    pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY base DESC, candidate_id) AS rk FROM a) WHERE rk <= 20)"""
_NEW = "len(list_filter(c.atoms, lambda x: NOT list_contains(p.covered, x)))"
_SLOT = f"c.base + 0.2 * c.directness + 0.1 * c.polarity - 0.2 * c.background + 0.35 * {_NEW} - 0.15 * (CASE WHEN c.dup = '' THEN 0 ELSE len(list_filter(p.dups, lambda x: x = c.dup)) END) - 0.08 * len(list_filter(p.sources, lambda x: x = c.source))"


@query(f"""WITH RECURSIVE {POOL_SQL},
    {greedy_sql(5, _SLOT, {"covered": ("[]::VARCHAR[]", "c.atoms"), "sources": ("[]::VARCHAR[]", "[c.source]"), "dups": ("[]::VARCHAR[]", "[c.dup]")})}
    SELECT event_id, step AS slot, candidate_id, v AS score FROM steps JOIN pool USING (event_id, rk)""")
def g_slot_greedy(spark, d):
    return stepwise(spark, d, "slot int, candidate_id long, score double", lambda p, a: [(n, p["candidate_id"][i], s) for n, (i, s) in enumerate(S.slot_greedy(p, 5), 1)])


@query(f"""WITH m AS (SELECT *, coalesce(evidence_map_quality_score, 0.0) AS q, coalesce(base_score, 0.0) AS b FROM ({MAP_SQL}) WHERE event_id IS NOT NULL), u AS (SELECT event_id, candidate_id, 'retrieval' AS variant, b AS x, q AS y FROM m UNION ALL SELECT event_id, candidate_id, 'quality', q, b FROM m UNION ALL SELECT event_id, candidate_id, 'directness', directness, q FROM m)
    SELECT event_id, variant, candidate_id, rk AS rank FROM (SELECT *, row_number() OVER (PARTITION BY event_id, variant ORDER BY x DESC, y DESC, candidate_id) AS rk FROM u) WHERE rk <= 3""")
def g_map_ablations(spark, d):
    """The same pool ordered by retrieval, by map quality and by directness."""
    m = annotated(spark, d)
    variants = F.array(*(F.struct(F.lit(n).alias("variant"), F.col(x).alias("x"), F.col(y).alias("y")) for n, x, y in (("retrieval", "base", "quality"), ("quality", "quality", "base"), ("directness", "directness", "quality"))))
    return top_k(m.select("event_id", "candidate_id", F.inline(variants)), ["event_id", "variant"], [F.desc("x"), F.desc("y"), F.asc("candidate_id")], 3).select("event_id", "variant", "candidate_id", "rank")


@query(f"""WITH RECURSIVE {POOL_SQL}, {greedy_sql(5, _NEW, {"covered": ("[]::VARCHAR[]", "c.atoms")}, "v > 0")} SELECT event_id, step, candidate_id, v AS gain FROM steps JOIN pool USING (event_id, rk)""")
def g_set_cover(spark, d):
    return stepwise(spark, d, "step int, candidate_id long, gain double", lambda p, a: [(n, p["candidate_id"][i], g) for n, (i, g) in enumerate(S.set_cover(list(p["atoms"]), a, 5), 1)])


@query(f"""WITH RECURSIVE {POOL_SQL}, {greedy_sql(5, _NEW, {"covered": ("[]::VARCHAR[]", "c.atoms")}, "v > 0")},
    own AS (SELECT event_id, list(struct_pack(id := candidate_id, atoms := atoms) ORDER BY step) AS own FROM steps JOIN pool USING (event_id, rk) GROUP BY 1),
    cut AS (SELECT event_id, own, len(own) AS i, range(1, len(own) + 1) AS keep FROM own UNION ALL
    SELECT event_id, own, i - 1, CASE WHEN list_has_all(flatten(list_transform(list_filter(keep, lambda j: j <> i), lambda j: own[j].atoms)), own[i].atoms) THEN list_filter(keep, lambda j: j <> i) ELSE keep END FROM cut WHERE i > 0)
    SELECT event_id, CAST(step AS INT) AS step, own[step].id AS candidate_id, list_contains(keep, step) AS minimal FROM (SELECT *, unnest(range(1, len(own) + 1)) AS step FROM cut WHERE i = 0)""")
def g_minimal_cover(spark, d):
    """The cover without those that the others make needless."""
    def choose(p, atoms):
        chosen = [i for i, _ in S.set_cover(list(p["atoms"]), atoms, 5)]
        small = S.minimal_group(list(p["atoms"]), chosen)
        return [(n, p["candidate_id"][i], i in small) for n, i in enumerate(chosen, 1)]

    return stepwise(spark, d, "step int, candidate_id long, minimal boolean", choose)


@query(f"""WITH r AS ({RANKED_CAND}), u AS (SELECT event_id, candidate_id, 'hybrid' AS variant, -coalesce(base_score, 0.0) AS x, '' AS y FROM r UNION ALL SELECT event_id, candidate_id, 'random', 0.0, md5('7|' || event_id || '|' || candidate_id) FROM r)
    SELECT event_id, variant, candidate_id, rk AS rank FROM (SELECT *, row_number() OVER (PARTITION BY event_id, variant ORDER BY x, y, candidate_id) AS rk FROM u) WHERE rk <= 3""")
def g_mechanisms(spark, d):
    """A pool by score against one in hashed random order."""
    r = ranked_candidates(spark, d)
    both = F.array(F.struct(F.lit("hybrid").alias("variant"), (-F.col("b")).alias("x"), F.lit("").alias("y")), F.struct(F.lit("random").alias("variant"), F.lit(0.0).alias("x"), F.md5(F.concat_ws("|", F.lit("7"), "event_id", F.col("candidate_id").cast("string"))).alias("y")))
    return top_k(r.select("event_id", "candidate_id", F.inline(both)), ["event_id", "variant"], [F.asc("x"), F.asc("y"), F.asc("candidate_id")], 3).select("event_id", "variant", "candidate_id", "rank")


@query("""WITH x AS (SELECT event_id, source_group, CAST(least(10, 1 + floor(10 * base_score)) AS INT) AS bucket, coalesce(map_confidence, 0.0) AS mass FROM evidence_candidates WHERE event_id IS NOT NULL AND base_score IS NOT NULL),
    n AS (SELECT *, count(*) OVER (PARTITION BY event_id, source_group) AS n FROM x) SELECT event_id, bucket, round(pow(sum(mass / sqrt(n)) + 0.1, 1.5), 6) AS mass FROM n GROUP BY 1, 2""")
def g_bucket_masses(spark, d):
    x = table(spark, d, "evidence_candidates").where("event_id IS NOT NULL AND base_score IS NOT NULL").select("event_id", "source_group", F.least(F.lit(10), 1 + F.floor(10 * F.col("base_score"))).cast("int").alias("bucket"), F.coalesce("map_confidence", F.lit(0.0)).alias("m"))
    return pools.amplified_buckets(x, ["event_id"], "bucket", "m", "source_group").withColumn("mass", F.round("mass", 6))


@query(f"""WITH {POOL_SQL}, b AS (SELECT *, CAST(least(10, 1 + floor(10 * base)) AS INT) AS bucket FROM pool), m AS (SELECT event_id, candidate_id, bucket, pow(sum(confidence) OVER (PARTITION BY event_id, bucket) + 0.1, 1.5) / row_number() OVER (PARTITION BY event_id, bucket ORDER BY rk) AS share FROM b)
    SELECT event_id, slot, candidate_id, bucket FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY round(share, 9) DESC, bucket) AS slot FROM m) WHERE slot <= 5""")
def g_bucket_slots(spark, d):
    """Slots go to the bucket of greatest mass per (1 + slots it has); within it by rank."""
    def choose(p, _):
        bucket = np.minimum(10, 1 + np.floor(10 * p["base"])).astype(int)
        mass = {b: float((p["confidence"][bucket == b].sum() + 0.1) ** 1.5) for b in sorted(set(bucket))}
        left = {b: list(np.flatnonzero(bucket == b)) for b in mass}
        held = dict.fromkeys(mass, 0)
        out = []
        while len(out) < 5 and any(left.values()):
            b = max((b for b in mass if left[b]), key=lambda b: (round(mass[b] / (1 + held[b]), 9), -b))
            out.append((len(out) + 1, p["candidate_id"][left[b].pop(0)], int(b)))
            held[b] += 1
        return out

    return stepwise(spark, d, "slot int, candidate_id long, bucket int", choose)


def _word_sim(p: S.Pool) -> np.ndarray:
    words = [set(k.split()) for k in p["key"]]
    return np.array([[len(a & b) / max(1, len(a | b)) for b in words] for a in words])


@query()
def g_factions(spark, d):
    def choose(p, _):
        clusters = S.factions(_word_sim(p), 0.3, 2, 5)
        heads = S.one_per_faction(clusters, 5)
        return [(f"F{n}", p["candidate_id"][i], i in heads) for n, c in enumerate(clusters, 1) for i in c]

    return stepwise(spark, d, "faction string, candidate_id long, chosen boolean", choose)


SIDE = "CASE WHEN r = 'support' THEN 'S' WHEN r = 'refute' THEN 'R' WHEN r IN ('qualify', 'mixed') THEN 'Q' ELSE 'U' END"


@query(f"""WITH p AS (SELECT event_id, candidate_id AS id, coalesce({KEY.format("text")}, '') AS key, coalesce(duplicate_group, '') AS dup, coalesce(source_group, '') AS source, list_distinct(coalesce(covered_atom_ids, [])) AS atoms, r AS relation, {SIDE} AS side,
    coalesce(lower(map_directness), 'none') IN ('direct', 'partial') AS direct, r IN ('background', 'irrelevant') OR coalesce(lower(map_directness), 'none') IN ('context', 'none') AS back FROM ({MAP_SQL.replace("FROM evidence_candidates)", f"FROM ({RANKED_CAND.replace(' AND text IS NOT NULL', '')}) WHERE rk <= 20)")})),
    x AS (SELECT a.event_id, a.id AS a, b.id AS b, (a.key <> '' AND a.key = b.key) OR (a.dup <> '' AND a.dup = b.dup) AS dup, a.source <> '' AND a.source = b.source AS same, len(a.atoms) AS na, len(b.atoms) AS nb, len(list_intersect(a.atoms, b.atoms)) AS shared, a.side AS sa, b.side AS sb, a.relation = b.relation AS agree, a.direct OR b.direct AS direct, (a.back AND b.direct) OR (b.back AND a.direct) AS bridge FROM p a JOIN p b ON a.event_id = b.event_id AND a.id < b.id),
    y AS (SELECT *, na + nb - shared AS uni, na + nb - 2 * shared AS diff FROM x)
    SELECT event_id, a, b, 'duplicate' AS kind, 1.0 AS weight FROM y WHERE dup UNION ALL SELECT event_id, a, b, 'bridge', 0.55 FROM y WHERE bridge AND (shared > 0 OR same)
    UNION ALL SELECT event_id, a, b, 'complements', round(0.45 + 0.55 * diff / greatest(uni, 1), 6) FROM y WHERE NOT dup AND na > 0 AND nb > 0 AND diff > 0 AND direct
    UNION ALL SELECT event_id, a, b, 'corroborates', 0.75 FROM y WHERE shared > 0 AND sa <> 'U' AND agree AND NOT same UNION ALL SELECT event_id, a, b, 'tension', 0.85 FROM y WHERE shared > 0 AND sa <> 'U' AND sb <> 'U' AND sa <> sb""")
def g_evidence_edges(spark, d):
    """Ties of the twenty best; candidates have no sentence number, so none is tied as a neighbour within its source."""
    side = F.when(F.col("relation") == "support", "S").when(F.col("relation") == "refute", "R").when(F.col("relation").isin("qualify", "mixed"), "Q").otherwise("U")
    name = F.col("directness_name")
    background = F.col("relation").isin(*chains.BACKGROUND) | name.isin("context", "none")
    pool = top_k(annotated(spark, d), ["event_id"], best_first("base", "candidate_id"), POOL).select("event_id", F.col("candidate_id").alias("id"), "key", "dup", "source", F.array_distinct("atoms").alias("atoms"), "relation", side.alias("side"), name.isin(*chains.DIRECT).alias("direct"), background.alias("background"))
    return pools.evidence_edges(pool, "event_id").withColumn("weight", F.round("weight", 6))


@query()
def g_beam_chains(spark, d):
    def choose(p, _):
        g = chains.Graph(p)
        score, chain = g.beam()[0]
        return [(n, p["candidate_id"][i], score) for n, i in enumerate(g.best_order(chain), 1)]

    return stepwise(spark, d, "position int, candidate_id long, score double", choose)


_SIDE = "CASE WHEN c.relation = 'support' THEN 'S' WHEN c.relation = 'refute' THEN 'R' WHEN c.relation IN ('qualify', 'mixed') THEN 'Q' ELSE 'U' END"
_OTHER = f"len(list_filter(c.atoms, lambda x: list_contains(p.covered, x) AND NOT list_contains(p.seen, x || ':' || {_SIDE})))"
_RULE = f"CASE WHEN {_SIDE} <> 'U' AND {_NEW} > 0 THEN 1000 + 10 * {_NEW} + c.quality WHEN {_SIDE} <> 'U' AND {_OTHER} > 0 THEN 500 + c.quality WHEN p.n < 5 THEN c.quality ELSE -1 END"


@query(f"""WITH RECURSIVE {POOL_SQL}, {greedy_sql(10, _RULE, {"covered": ("[]::VARCHAR[]", "c.atoms"), "seen": ("[]::VARCHAR[]", f"list_transform(c.atoms, lambda x: x || ':' || {_SIDE})")}, "v >= 0")}
    SELECT event_id, step, candidate_id, CASE WHEN v >= 1000 THEN 'P1' WHEN v >= 500 THEN 'P2' ELSE 'P3' END AS rule FROM steps JOIN pool USING (event_id, rk)""")
def g_rule_steps(spark, d):
    return stepwise(spark, d, "step int, candidate_id long, rule string", lambda p, a: [(n, p["candidate_id"][i], r) for n, (i, r) in enumerate(S.rule_steps(p), 1)])


_ATOMS = "atoms_of AS (SELECT event_id, count(DISTINCT x) AS atoms FROM (SELECT event_id, unnest(atoms) AS x FROM pool) GROUP BY 1)"


@query(f"""WITH RECURSIVE {POOL_SQL}, {_ATOMS}, {greedy_sql(10, _NEW, {"covered": ("[]::VARCHAR[]", "c.atoms")}, "v > 0")},
    s AS (SELECT steps.event_id, step, rk, v, sum(v) OVER (PARTITION BY steps.event_id ORDER BY step) / atoms_of.atoms AS share, (sum(v) OVER (PARTITION BY steps.event_id ORDER BY step) - v) / atoms_of.atoms AS before FROM steps JOIN atoms_of USING (event_id)),
    side AS (SELECT *, CASE WHEN relation = 'support' THEN 'S' WHEN relation = 'refute' THEN 'R' ELSE '' END AS side FROM pool), taken AS (SELECT s.event_id, s.step, s.rk, candidate_id, share, side FROM s JOIN side USING (event_id, rk) WHERE before < 0.8),
    sum AS (SELECT event_id, max(step) AS n, max(share) AS share, bool_or(side = 'S') AS has_s, bool_or(side = 'R') AS has_r FROM taken GROUP BY 1),
    more AS (SELECT sum.event_id, arg_max(candidate_id, struct_pack(q := round(quality, 9), r := -rk)) AS candidate_id FROM sum JOIN side USING (event_id) WHERE (has_s OR has_r) AND ((side = 'S' AND NOT has_s) OR (side = 'R' AND NOT has_r)) AND NOT EXISTS (SELECT 1 FROM taken WHERE taken.event_id = sum.event_id AND taken.rk = side.rk) GROUP BY 1),
    flag AS (SELECT sum.event_id, n, round(share, 9) AS covered, (more.candidate_id IS NOT NULL) OR (has_s AND has_r) AS contradicted, more.candidate_id AS extra FROM sum LEFT JOIN more USING (event_id))
    SELECT event_id, CAST(step AS INT) AS step, candidate_id, covered, contradicted FROM taken JOIN flag USING (event_id) UNION ALL SELECT event_id, CAST(n + 1 AS INT), extra, covered, contradicted FROM flag WHERE extra IS NOT NULL AND n < 10""")
def g_sufficiency(spark, d):
    def choose(p, atoms):
        chosen, share, against = S.sufficiency_chain(p, atoms)
        return [(n, p["candidate_id"][i], share, against) for n, i in enumerate(chosen, 1)]

    return stepwise(spark, d, "step int, candidate_id long, covered double, contradicted boolean", choose)


@query()
def g_budgeted_chain(spark, d):
    return stepwise(spark, d, "step int, candidate_id long, gain double", lambda p, a: [(n, p["candidate_id"][i], g) for n, (i, g) in enumerate(S.budgeted_chain(p), 1)])


@query()
def g_atom_order(spark, d):
    return stepwise(spark, d, "step int, candidate_id long, atom string, role string", lambda p, a: [(n, p["candidate_id"][i], x, r) for n, (i, x, r) in enumerate(S.atom_order(p, list(a)), 1)])


#: An atom's state from what was noted of it: qualified once is qualified for good, both sides are a conflict, else the side.
_KNOWN = lambda x, side: f"list_contains(p.seen, {x} || ':{side}')"
_OPEN = f"NOT {_KNOWN('x', 'S')} AND NOT {_KNOWN('x', 'R')} AND NOT {_KNOWN('x', 'Q')}"
_ONE_SIDE = lambda a, b: f"{_KNOWN('x', a)} AND NOT {_KNOWN('x', b)} AND NOT {_KNOWN('x', 'Q')}"
_COUNT = lambda condition: f"len(list_filter(c.atoms, lambda x: {condition}))"
_OPENS = f"CASE WHEN {_SIDE} = 'U' THEN 0 ELSE {_COUNT(_OPEN)} END"
_CONTRASTS = f"CASE {_SIDE} WHEN 'Q' THEN {_COUNT(f'NOT ({_OPEN})')} WHEN 'S' THEN {_COUNT(_ONE_SIDE('R', 'S'))} WHEN 'R' THEN {_COUNT(_ONE_SIDE('S', 'R'))} ELSE 0 END"
_AGREES = f"CASE {_SIDE} WHEN 'S' THEN {_COUNT(_ONE_SIDE('S', 'R'))} WHEN 'R' THEN {_COUNT(_ONE_SIDE('R', 'S'))} ELSE 0 END"
_HELD_SOURCE = "0.2 * (CASE WHEN list_contains(p.sources, c.source) THEN 0 ELSE 1 END) - 0.8 * (CASE WHEN c.dup <> '' AND list_contains(p.dups, c.dup) THEN 1 ELSE 0 END)"
_TOTAL = "greatest(1, coalesce((SELECT atoms FROM atoms_of WHERE atoms_of.event_id = p.event_id), 1))"
_MARGINAL = f"({_NEW} + ({_OPENS}) + 0.6 * ({_CONTRASTS}) + 0.3 * ({_AGREES})) / {_TOTAL} + 0.5 * c.directness + 0.4 * c.polarity + 0.4 * c.quality + 0.2 * c.confidence + 0.3 * c.base + {_HELD_SOURCE} - 0.5 * c.background"
_MARGINAL_STATE = {"covered": ("[]::VARCHAR[]", "c.atoms"), "seen": ("[]::VARCHAR[]", f"CASE WHEN {_SIDE} = 'U' THEN [] ELSE list_transform(c.atoms, lambda x: x || ':' || {_SIDE}) END"), "sources": ("[]::VARCHAR[]", "[c.source]"), "dups": ("[]::VARCHAR[]", "[c.dup]")}


@query(f"""WITH RECURSIVE {POOL_SQL}, {_ATOMS}, {greedy_sql(8, _MARGINAL, _MARGINAL_STATE, "(n < 1 OR v > 0.6)")} SELECT event_id, CAST(step AS INT) AS step, candidate_id, v AS utility FROM steps JOIN pool USING (event_id, rk)""")
def g_marginal(spark, d):
    return stepwise(spark, d, "step int, candidate_id long, utility double", lambda p, a: [(n, p["candidate_id"][i], u) for n, (i, u) in enumerate(S.marginal_greedy(p, a), 1)])


@query(f"""WITH RECURSIVE {POOL_SQL}, {greedy_sql(8, f"0.3 * c.base + {_HELD_SOURCE}", {k: _MARGINAL_STATE[k] for k in ("sources", "dups")}, "(n < 1 OR v > 0.2)")} SELECT event_id, CAST(step AS INT) AS step, candidate_id, v AS utility FROM steps JOIN pool USING (event_id, rk)""")
def g_marginal_no_map(spark, d):
    """The marginal selector without the evidence map's features."""
    w = {k: v for k, v in S.MARGINAL.items() if k in ("base", "new_source", "duplicate")}
    return stepwise(spark, d, "step int, candidate_id long, utility double", lambda p, a: [(n, p["candidate_id"][i], u) for n, (i, u) in enumerate(S.marginal_greedy(p, a, w, stop=0.2), 1)])


_MARKS = "CASE WHEN c.dup = '' THEN ['k:' || c.key] ELSE ['k:' || c.key, 'd:' || c.dup] END"


_WEAK = "c.direct_name IN ('none', 'context', '')"
_LEAST = lambda condition: f"list_min(list_filter(c.atoms, lambda x: {condition}))"
_OPPOSED = f"CASE {_SIDE} WHEN 'Q' THEN {_LEAST(f'NOT ({_OPEN})')} WHEN 'S' THEN {_LEAST(_ONE_SIDE('R', 'S'))} WHEN 'R' THEN {_LEAST(_ONE_SIDE('S', 'R'))} END"
_SAME = f"CASE {_SIDE} WHEN 'S' THEN {_LEAST(_ONE_SIDE('S', 'R'))} WHEN 'R' THEN {_LEAST(_ONE_SIDE('R', 'S'))} END"
#: The best step that a candidate allows: its value, and the least of the atoms that allow it.
_STEP = f"CASE WHEN {_SIDE} = 'U' THEN CASE WHEN {_WEAK} AND len(c.atoms) > 0 THEN 10 END WHEN {_OPENS} > 0 THEN 100 WHEN ({_OPPOSED}) IS NOT NULL THEN 80 WHEN ({_SAME}) IS NOT NULL THEN 35 END"
_AT = f"CASE WHEN {_SIDE} = 'U' THEN list_min(c.atoms) WHEN {_OPENS} > 0 THEN {_LEAST(_OPEN)} ELSE coalesce({_OPPOSED}, {_SAME}) END"
_STATE = "CASE WHEN list_contains(p.seen, a || ':Q') THEN 'Q' WHEN list_contains(p.seen, a || ':S') AND list_contains(p.seen, a || ':R') THEN 'C' WHEN list_contains(p.seen, a || ':S') THEN 'S' WHEN list_contains(p.seen, a || ':R') THEN 'R' ELSE 'U' END"
_RESOLVED = f"len(list_distinct(list_transform(p.seen, lambda x: split_part(x, ':', 1)))) >= 0.8 * {_TOTAL}"
_CHAIN = f"CASE WHEN {_RESOLVED} OR list_has_any(p.marks, {_MARKS}) THEN -1 ELSE coalesce(({_STEP}) + 10 + c.quality + 0.1 * c.base, -1) END"
_NOTE = f"[({_STEP}) || '|' || ({_AT}) || '|' || list_transform([{_AT}], lambda a: {_STATE})[1] || '|' || {_SIDE}]"


@query(f"""WITH RECURSIVE {POOL_SQL}, {_ATOMS}, {greedy_sql(10, _CHAIN, {"seen": ("[]::VARCHAR[]", f"CASE WHEN {_SIDE} = 'U' THEN [] ELSE [({_AT}) || ':' || {_SIDE}] END"), "marks": ("[]::VARCHAR[]", _MARKS), "notes": ("[]::VARCHAR[]", _NOTE)}, "v >= 0").replace("arg_max(gains, n) AS gains FROM", "arg_max(gains, n) AS gains, arg_max(notes, n) AS notes, arg_max(seen, n) AS seen FROM")},
    y AS (SELECT steps.event_id, step, candidate_id, v, string_split(notes[step], '|') AS y, CASE WHEN len(done.chosen) >= 10 THEN 'max_steps' WHEN len(list_distinct(list_transform(seen, lambda x: split_part(x, ':', 1)))) >= 0.8 * atoms_of.atoms THEN 'target_resolved' ELSE 'no_transition' END AS stop FROM steps JOIN pool USING (event_id, rk) JOIN done USING (event_id) JOIN atoms_of USING (event_id))
    SELECT event_id, CAST(step AS INT) AS step, candidate_id, y[2] AS atom, CASE y[1] WHEN '100' THEN 'OPEN' WHEN '80' THEN 'CONTRAST' WHEN '35' THEN 'CORROBORATE' ELSE 'BRIDGE' END AS op, y[3] AS before,
    CASE WHEN y[1] = '10' THEN y[3] WHEN y[1] = '80' AND y[4] <> 'Q' THEN 'C' ELSE y[4] END AS after, v AS utility, stop FROM y""")
def g_resolving_chain(spark, d):
    def choose(p, atoms):
        steps, _, reason = S.resolving_chain(p, atoms)
        return [(n, p["candidate_id"][s.at], s.atom, s.step, s.before, s.after, s.utility, reason) for n, s in enumerate(steps, 1)]

    return stepwise(spark, d, "step int, candidate_id long, atom string, op string, before string, after string, utility double, stop string", choose)


@query(f"""WITH RECURSIVE {POOL_SQL}, {greedy_sql(5, f"CASE WHEN list_has_any(p.marks, {_MARKS}) THEN -1 ELSE c.quality END", {"marks": ("[]::VARCHAR[]", _MARKS)}, "v >= 0")} SELECT event_id, step, candidate_id FROM steps JOIN pool USING (event_id, rk)""")
def g_map_quality_greedy(spark, d):
    """Best map quality first, one of each duplicate group and text."""
    def choose(p, _):
        order, seen, out = sorted(range(len(p)), key=lambda i: (-round(p["quality"][i], 9), i)), set(), []
        for i in order:
            marks = {("k", p["key"][i])} | ({("d", p["dup"][i])} if p["dup"][i] else set())
            if len(out) < 5 and not marks & seen:
                out.append((len(out) + 1, p["candidate_id"][i]))
                seen |= marks
        return out

    return stepwise(spark, d, "step int, candidate_id long", choose)


def _items(p: S.Pool, atoms: list[str]) -> list[cover.Item]:
    level = {"direct": 2, "partial": 1}
    return [cover.Item(f"{p['candidate_id'][i]:012d}", tuple(level.get(p["directness_name"][i], 0) if a in p["atoms"][i] else 0 for a in atoms), int(p["cost"][i])) for i in range(len(p))]


@query()
def g_exact_cover(spark, d):
    """Exact cover of up to six atoms by at most four evidences of at most 160 tokens, then filled to three."""
    def choose(p, atoms):
        names = list(atoms)[:6]
        items = _items(p, names)
        answer = cover.solve(items, (1,) * len(names), 4, 160) if names else cover.Answer(0, 0, 0, ())
        assert cover.replay(items, (1,) * len(names), answer, 4, 160)
        filled = cover.soft_fill(items, answer.keys, min(3, len(items)), 160)
        return [(n, int(k), answer.utility, answer.time, k in answer.keys) for n, k in enumerate(filled, 1)]

    return stepwise(spark, d, "position int, candidate_id long, utility int, time int, exact boolean", choose)


@query(f"SELECT event_id, candidate_id, rk AS rank FROM ({RANKED_CAND}) WHERE rk <= 5")
def g_likelihood_topk(spark, d):
    return ranked_candidates(spark, d, 5).select("event_id", "candidate_id", "rank")


_HELD = "c.quality - 0.1 * len(list_filter(p.sources, lambda x: x = c.source)) - 0.05 * len(list_filter(p.stances, lambda x: x = c.relation))"


@query(f"""WITH RECURSIVE {POOL_SQL}, {greedy_sql(5, f"CASE WHEN p.n < 2 THEN 1000 - c.rk ELSE {_HELD} END", {"sources": ("[]::VARCHAR[]", "[c.source]"), "stances": ("[]::VARCHAR[]", "[c.relation]")})} SELECT event_id, step, candidate_id FROM steps JOIN pool USING (event_id, rk)""")
def g_constrained_likelihood(spark, d):
    return stepwise(spark, d, "step int, candidate_id long", lambda p, a: [(n, p["candidate_id"][i]) for n, i in enumerate(S.constrained_likelihood(list(p["quality"]), list(p["source"]), list(p["relation"]), 2, 5), 1)])


@query(f"""WITH r AS ({RANKED_CAND}), w AS (SELECT *, round(coalesce(base_score, 0.0) - 0.1 * (row_number() OVER (PARTITION BY event_id, source_group ORDER BY coalesce(base_score, 0.0) DESC, candidate_id) - 1), 9) AS value FROM r)
    SELECT event_id, candidate_id, value, k AS rank FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY value DESC, candidate_id) AS k FROM w) WHERE k <= 5""")
def g_source_diverse(spark, d):
    rows = table(spark, d, "evidence_candidates").where("event_id IS NOT NULL AND text IS NOT NULL").withColumn("b", F.coalesce("base_score", F.lit(0.0)))
    return pools.source_diverse(rows, ["event_id"], "b", "source_group", "candidate_id", 5, 0.1).select("event_id", "candidate_id", "value", "rank")


@query("""WITH x AS (SELECT event_id, candidate_id, unnest(['confidence', 'quality', 'sum', 'product', 'min']) AS mode, unnest([c, q, c + q, c * q, least(c, q)]) AS s FROM (SELECT event_id, candidate_id, coalesce(map_confidence, 0.0) AS c, coalesce(evidence_map_quality_score, 0.0) AS q FROM evidence_candidates WHERE event_id IS NOT NULL))
    SELECT event_id, mode, candidate_id, rk AS rank FROM (SELECT *, row_number() OVER (PARTITION BY event_id, mode ORDER BY round(s, 9) DESC, candidate_id) AS rk FROM x) WHERE rk <= 3""")
def g_score_modes(spark, d):
    """Static selection under five ways of scoring."""
    c, q = F.coalesce("map_confidence", F.lit(0.0)), F.coalesce("evidence_map_quality_score", F.lit(0.0))
    modes = {"confidence": c, "quality": q, "sum": c + q, "product": c * q, "min": F.least(c, q)}
    each = F.array(*(F.struct(F.lit(k).alias("mode"), F.round(v, 9).alias("s")) for k, v in modes.items()))
    rows = table(spark, d, "evidence_candidates").where("event_id IS NOT NULL").select("event_id", "candidate_id", F.inline(each))
    return top_k(rows, ["event_id", "mode"], best_first("s", "candidate_id"), 3).select("event_id", "mode", "candidate_id", "rank")


@query(f"""WITH p AS (SELECT event_id, candidate_id AS i, round(coalesce(map_confidence, 0.0) - 0.05 * rk, 9) AS s FROM ({RANKED_CAND})), t AS (SELECT a.event_id, [a.i, b.i, c.i] AS set, round(a.s + b.s + c.s, 9) AS total FROM p a JOIN p b ON a.event_id = b.event_id AND a.i < b.i JOIN p c ON b.event_id = c.event_id AND b.i < c.i)
    SELECT event_id, array_to_string(set, ',') AS set, total FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY total DESC, set) AS n FROM t) WHERE n = 1""")
def g_exhaustive_sets(spark, d):
    """The best three by summed score: a sum is greatest for the three best, and of equal ones the least items come first."""
    p = ranked_candidates(spark, d).select("event_id", F.col("candidate_id").alias("i"), F.round(F.coalesce("map_confidence", F.lit(0.0)) - 0.05 * F.col("rank"), 9).alias("s"))
    sets = top_k(p, ["event_id"], best_first("s", "i"), 3).groupBy("event_id").agg(F.sort_array(F.collect_list("i")).alias("set"), F.round(F.sum("s"), 9).alias("total"))
    return sets.where(F.size("set") == 3).withColumn("set", F.array_join("set", ","))


@query("""WITH s AS (SELECT event_id, evidence_arm AS arm, avg(prompt_token_count) AS u FROM prepared_samples WHERE event_id IS NOT NULL AND evidence_arm IS NOT NULL AND prompt_token_count IS NOT NULL GROUP BY 1, 2)
    SELECT a.event_id, a.arm AS winner, b.arm AS loser, round(a.u - b.u, 6) AS gap FROM s a JOIN s b ON a.event_id = b.event_id AND a.u - b.u >= 5""")
def g_preference_pairs(spark, d):
    """Winner and loser of an event's arms, by a utility gap of at least 5."""
    s = table(spark, d, "prepared_samples").where("event_id IS NOT NULL AND evidence_arm IS NOT NULL AND prompt_token_count IS NOT NULL").groupBy("event_id", F.col("evidence_arm").alias("arm")).agg(F.avg("prompt_token_count").alias("u"))
    pairs = s.alias("a").join(s.alias("b"), F.expr("a.event_id = b.event_id AND a.u - b.u >= 5"))
    return pairs.select("a.event_id", F.col("a.arm").alias("winner"), F.col("b.arm").alias("loser"), F.round(F.col("a.u") - F.col("b.u"), 6).alias("gap"))


@query(f"SELECT event_id, candidate_id, rk AS rank, row_number() OVER (PARTITION BY event_id ORDER BY md5('13|' || event_id || '|' || candidate_id)) AS shuffled FROM ({RANKED_CAND}) WHERE rk <= 5")
def g_shuffle_control(spark, d):
    """The chosen five in a hashed random order."""
    top = ranked_candidates(spark, d, 5).withColumn("h", F.md5(F.concat_ws("|", F.lit("13"), "event_id", F.col("candidate_id").cast("string"))))
    return top_k(top, ["event_id"], [F.asc("h")], name="shuffled").select("event_id", "candidate_id", "rank", "shuffled")


@query(f"""WITH r AS (SELECT event_id, candidate_id, rk, len({CONTENT.format("text")}) AS cost FROM ({RANKED_CAND})), t AS (SELECT *, sum(cost) OVER (PARTITION BY event_id ORDER BY rk) AS total FROM r)
    SELECT event_id, count(*) FILTER (rk <= 5) AS fixed_k, greatest(least(count(*), 2), count(*) FILTER (total <= 80)) AS min_budget, count(*) FILTER (total <= 80) AS budget FROM t GROUP BY event_id""")
def g_prompt_policies(spark, d):
    """How many ranked evidences a fixed number, a budget, and a budget with a minimum keep."""
    from pyspark.sql import Window

    w = Window.partitionBy("event_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    t = ranked_candidates(spark, d).withColumn("total", F.sum(F.size(T.content_tokens("text"))).over(w))
    fits = F.count_if(F.col("total") <= 80)
    return t.groupBy("event_id").agg(F.count_if(F.col("rank") <= 5).alias("fixed_k"), F.greatest(F.least(F.count("*"), F.lit(2)), fits).alias("min_budget"), fits.alias("budget"))


@query(f"""WITH {POOL_SQL}, t AS (SELECT event_id, rk, sum(cost) OVER (PARTITION BY event_id ORDER BY rk) AS total, len(list_distinct(flatten(list(atoms) OVER (PARTITION BY event_id ORDER BY rk)))) AS state FROM pool),
    up AS (SELECT event_id, rk, rk - lag(rk) OVER (PARTITION BY event_id ORDER BY rk) AS gap FROM (SELECT *, lag(state) OVER (PARTITION BY event_id ORDER BY rk) AS before FROM t) WHERE total <= 120 AND (before IS NULL OR state > before)),
    kept AS (SELECT event_id, max(rk) AS kept FROM (SELECT *, max(gap) OVER (PARTITION BY event_id ORDER BY rk) AS worst FROM up) WHERE coalesce(worst, 0) <= 3 GROUP BY 1)
    SELECT event_id, CAST(coalesce(kept, 0) AS INT) AS kept FROM (SELECT DISTINCT event_id FROM pool) LEFT JOIN kept USING (event_id)""")
def g_state_budget(spark, d):
    """Prefix kept by a token budget that ends when the atoms covered stop growing."""
    def choose(p, _):
        seen, state = set(), []
        for a in p["atoms"]:
            seen |= set(a)
            state.append(float(len(seen)))
        return [(S.state_budget(list(p["cost"]), state, 120),)]

    return stepwise(spark, d, "kept int", choose)


@query(f"""WITH r AS (SELECT event_id, candidate_id, rk, {CONTENT.format("text")} AS toks FROM ({RANKED_CAND})), b AS (SELECT *, 50 - coalesce(sum(len(toks)) OVER (PARTITION BY event_id ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM r)
    SELECT event_id, candidate_id, array_to_string(toks[1:CAST(room AS INT)], ' ') AS kept FROM b WHERE room > 0""")
def g_tail_truncation(spark, d):
    """Ranked evidence cut to 50 tokens: the last one that fits is clipped."""
    rows = ranked_candidates(spark, d).withColumn("toks", T.content_tokens("text"))
    return pools.fit_budget(rows, ["event_id"], "rank", "toks", F.lit(50)).select("event_id", "candidate_id", F.array_join("toks", " ").alias("kept"))


@query(f"""WITH r AS (SELECT event_id, candidate_id, rk, coalesce(map_confidence, 0.0) AS s FROM ({RANKED_CAND})), a AS (SELECT event_id, list(candidate_id ORDER BY rk) AS anchors, sum(s) AS base FROM r WHERE rk <= 2 GROUP BY event_id)
    SELECT event_id, array_to_string(list_append(anchors, candidate_id), ',') AS set, round(s - base / 2, 6) AS delta, s > base / 2 AS positive FROM a JOIN r USING (event_id) WHERE rk > 2""")
def g_anchor_sets(spark, d):
    """The first two fixed, with each further candidate: its score above theirs."""
    rows = table(spark, d, "evidence_candidates").where("event_id IS NOT NULL AND text IS NOT NULL").select("event_id", "candidate_id", F.coalesce("map_confidence", F.lit(0.0)).alias("s"))
    r = ranked_candidates(spark, d, 2).withColumn("s", F.coalesce("map_confidence", F.lit(0.0)))
    a = r.groupBy("event_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "candidate_id"))), lambda x: x["candidate_id"]).alias("anchors"), F.sum("s").alias("base"))
    j = rows.join(a, "event_id").where(~F.array_contains("anchors", F.col("candidate_id")))
    return j.select("event_id", F.array_join(F.array_append("anchors", F.col("candidate_id")), ",").alias("set"), F.round(F.col("s") - F.col("base") / 2, 6).alias("delta"), (F.col("s") > F.col("base") / 2).alias("positive"))


@query()
def g_set_search(spark, d):
    """The best three by chain score, found greedily and by beam among all candidates, and exhaustively among the first fifteen."""
    def choose(p, atoms):
        value = functools.cache(chains.Graph(p).score)
        found = {"greedy": S.greedy_set(len(p), 3, value), "beam": S.beam_set(len(p), 3, value, 4), "exhaustive": S.exhaustive_set(min(15, len(p)), 3, value)}
        return [(how, [int(p["candidate_id"][i]) for i in s], value(s)) for how, s in found.items()]

    return stepwise(spark, d, "search string, candidate_ids array<long>, score double", choose, None)


@query()
def g_trajectories(spark, d):
    """Choices under four lambda schedules, with the mean relevance of each."""
    runs = dense_runs(spark, d, {str(seed): S.hashed_schedule(seed, 5, LAMBDAS) for seed in range(4)})
    mean = F.round(V.total(F.col("chosen.s")) / F.size("chosen"), 9)
    at = runs.select("label", F.col("run").cast("int").alias("schedule"), "lams", mean.alias("utility"), F.posexplode("chosen").alias("n", "c"))
    return at.select("label", "schedule", (F.col("n") + 1).alias("step"), F.get("lams", F.col("n")).alias("lam"), "c.vec_id", "utility")


@query(f"""WITH r AS (SELECT event_id, candidate_id, rk, coalesce(map_confidence, 0.0) AS c FROM ({RANKED_CAND}) WHERE rk <= 5), u AS (SELECT event_id, candidate_id, 'trace' AS mode, rk::DOUBLE AS x, '' AS y FROM r UNION ALL SELECT event_id, candidate_id, 'same_set_score', -c, '' FROM r UNION ALL SELECT event_id, candidate_id, 'same_set_random', 0.0, md5('3|' || event_id || '|' || candidate_id) FROM r)
    SELECT event_id, mode, candidate_id, row_number() OVER (PARTITION BY event_id, mode ORDER BY x, y, candidate_id) AS rank FROM u""")
def g_selection_modes(spark, d):
    """The chosen five in their own order, by an outside score, and at random."""
    r = ranked_candidates(spark, d, 5)
    h = F.md5(F.concat_ws("|", F.lit("3"), "event_id", F.col("candidate_id").cast("string")))
    modes = F.array(*(F.struct(F.lit(n).alias("mode"), x.cast("double").alias("x"), y.alias("y")) for n, x, y in (("trace", F.col("rank"), F.lit("")), ("same_set_score", -F.coalesce("map_confidence", F.lit(0.0)), F.lit("")), ("same_set_random", F.lit(0.0), h))))
    return top_k(r.select("event_id", "candidate_id", F.inline(modes)), ["event_id", "mode"], [F.asc("x"), F.asc("y"), F.asc("candidate_id")]).select("event_id", "mode", "candidate_id", "rank")
