"""Queries of the evaluation operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from attestra.functions import text as T
from attestra.functions import vectors as V
from attestra.operators import metrics as M
from attestra.operators.ranking import top_k
from attestra.plans.common import CONTENT, HYBRID_SQL, KEY, CLAIMS_SQL, claims
from attestra.plans.ranking_queries import VARIANTS, r_hybrid_variants, ranked
from attestra.plans.selection_queries import DENSE_SQL, RANKED_CAND, best_first, dense_pool, ranked_candidates
from attestra.plans.text_queries import SCHEMAS
from attestra.registry import query, table

#: Predictions: the label that the claims table gives an event, against the sample's gold label.
PRED_SQL = f"""WITH c AS ({CLAIMS_SQL}), lab AS (SELECT * FROM (VALUES {", ".join(f"('{s}', {i}, '{x}')" for s, v in SCHEMAS.items() for i, x in enumerate(v))}) t(label_schema, label, name)),
    p AS (SELECT s.sample_id, s.event_id, s.label_schema, s.evidence_arm AS arm, s.prompt_token_count AS tokens, s.gold_id AS gold, coalesce(lab.label, -1) AS pred FROM prepared_samples s LEFT JOIN c ON c.event_id = s.event_id LEFT JOIN lab ON lab.label_schema = s.label_schema AND lab.name = c.label WHERE s.label_schema IS NOT NULL)"""
LABELS = [(s, i, x) for s, v in SCHEMAS.items() for i, x in enumerate(v)]


def labels(spark):
    return spark.createDataFrame(LABELS, "label_schema string, label int, name string")


def predictions(spark, d):
    c = claims(spark, d).select("event_id", F.col("label").alias("name"))
    s = table(spark, d, "prepared_samples").where("label_schema IS NOT NULL").select("sample_id", "event_id", "label_schema", F.col("evidence_arm").alias("arm"), F.col("prompt_token_count").alias("tokens"), F.col("gold_id").alias("gold"))
    # The label table is a fixed list of a few rows.
    return s.join(c, "event_id", "left").join(F.broadcast(labels(spark)), ["label_schema", "name"], "left").select("sample_id", "event_id", "label_schema", "arm", "tokens", "gold", F.coalesce("label", F.lit(-1)).alias("pred"))


CONF_SQL = f"{PRED_SQL}, conf AS (SELECT label_schema, gold, greatest(pred, -1) AS pred, count(*) AS n FROM p WHERE gold >= 0 GROUP BY ALL), seen AS (SELECT DISTINCT label_schema FROM conf)"
CLASS_SQL = f"{CONF_SQL}, g AS (SELECT label_schema, gold AS label, sum(n) AS ng, sum(n) FILTER (gold = pred) AS tp FROM conf GROUP BY 1, 2), q AS (SELECT label_schema, pred AS label, sum(n) AS np FROM conf GROUP BY 1, 2), k AS (SELECT label_schema, label, coalesce(ng, 0) AS ng, coalesce(np, 0) AS np, coalesce(tp, 0) AS tp FROM lab JOIN seen USING (label_schema) LEFT JOIN g USING (label_schema, label) LEFT JOIN q USING (label_schema, label))"


def r6(df, *names):
    return df.select(*(F.round(c, 6).alias(c) if c in names else c for c in df.columns))


def declared(spark, conf):
    return labels(spark).select("label_schema", "label").join(conf.select("label_schema").distinct(), "label_schema")


_PR = "tp / (np + 1e-12) AS precision, tp / (ng + 1e-12) AS recall"


@query(f"{CLASS_SQL}, s AS (SELECT *, {_PR} FROM k) SELECT label_schema, label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(2 * precision * recall / (precision + recall + 1e-12), 6) AS f1, CAST(ng AS BIGINT) AS ng FROM s")
def a_class_scores(spark, d):
    conf = M.confusion(predictions(spark, d), ["label_schema"])
    return r6(M.class_scores(conf, ["label_schema"], declared(spark, conf)), "precision", "recall", "f1")


@query(f"{CLASS_SQL}, s AS (SELECT *, {_PR} FROM k), m AS (SELECT label_schema, avg(precision) AS mp, avg(recall) AS mr, avg(2 * precision * recall / (precision + recall + 1e-12)) AS mf, count(*) AS labels FROM s GROUP BY 1), r AS (SELECT label_schema, sum(n) AS rows, sum(n) FILTER (gold = pred) AS ok, sum(n) FILTER (pred < 0) AS bad, sum(n * abs(pred - gold)) FILTER (pred >= 0) AS off, sum(n) FILTER (pred >= 0) AS valid, sum(n) FILTER (pred >= 0 AND abs(pred - gold) >= 3) AS far FROM conf GROUP BY 1)"
       " SELECT label_schema, CAST(rows AS BIGINT) AS rows, round(coalesce(ok, 0) / rows, 6) AS accuracy, round(coalesce(bad, 0) / rows, 6) AS parse_errors, round(off / valid, 6) AS mae, round(coalesce(far, 0) / valid, 6) AS extreme, round(mp, 6) AS macro_precision, round(mr, 6) AS macro_recall, round(mf, 6) AS macro_f1, labels, round(off / valid / greatest(labels - 1, 1), 6) AS mae_share FROM r JOIN m USING (label_schema)")
def a_classification(spark, d):
    rows = predictions(spark, d)
    out = M.classification(rows, ["label_schema"], declared(spark, rows.where("gold >= 0")))
    return r6(out, "accuracy", "parse_errors", "mae", "extreme", "macro_precision", "macro_recall", "macro_f1", "mae_share")


@query(f"{CONF_SQL} SELECT * FROM conf")
def a_confusion(spark, d):
    return M.confusion(predictions(spark, d), ["label_schema"])


@query(f"{CLASS_SQL} SELECT label_schema, label, round(CASE WHEN np + ng > 0 THEN 2 * tp / (np + ng) ELSE 0.0 END, 6) AS f1 FROM k")
def a_f1_zero_division(spark, d):
    conf = M.confusion(predictions(spark, d), ["label_schema"])
    return r6(M.class_scores(conf, ["label_schema"], declared(spark, conf), eps=0).select("label_schema", "label", "f1"), "f1")


@query(f"""{PRED_SQL}, a AS (SELECT event_id, min(gold) = max(gold) AND count(DISTINCT arm) = 2 AS valid, count(DISTINCT arm) AS arms FROM p WHERE event_id IS NOT NULL AND arm IS NOT NULL AND gold >= 0 GROUP BY 1),
    f AS (SELECT p.arm, avg((gold = pred)::INT) AS accuracy, count(*) AS n FROM p JOIN a USING (event_id) WHERE valid AND gold >= 0 AND arm IS NOT NULL GROUP BY 1) SELECT arm, round(accuracy, 6) AS accuracy, n, CAST((SELECT count(*) FROM a WHERE NOT valid) AS BIGINT) AS invalid_events FROM f""")
def a_arm_balanced(spark, d):
    """Accuracy per arm over the events that have exactly two arms and one gold label; the others are counted as invalid."""
    p = predictions(spark, d).where("event_id IS NOT NULL AND arm IS NOT NULL AND gold >= 0")
    a = p.groupBy("event_id").agg(((F.min("gold") == F.max("gold")) & (F.count_distinct("arm") == 2)).alias("valid"))
    per = p.join(a, "event_id").where("valid").groupBy("arm").agg(F.round(F.avg((F.col("gold") == F.col("pred")).cast("int")), 6).alias("accuracy"), F.count("*").alias("n"))
    return per.join(F.broadcast(a.agg(F.count_if(~F.col("valid")).alias("invalid_events"))))  # one row of one number


@query(f"""{PRED_SQL}, f AS (SELECT label_schema, tokens // 100 AS step, avg((gold = pred)::INT) AS score, count(*) AS n FROM p WHERE gold >= 0 AND tokens IS NOT NULL GROUP BY 1, 2), b AS (SELECT label_schema, max(round(score, 9)) AS best, arg_max(sqrt(score * (1 - score) / n), struct_pack(s := round(score, 9), t := -step)) AS se, arg_max(step, struct_pack(s := round(score, 9), t := -step)) AS best_step FROM f GROUP BY 1)
    SELECT label_schema, best_step, min(step) AS one_se_step FROM f JOIN b USING (label_schema) WHERE score >= best - se - 1e-9 GROUP BY 1, 2""")
def a_checkpoint_selection(spark, d):
    """The step of the best score (ties to the earlier), and the earliest within one standard error of it."""
    p = predictions(spark, d).where("gold >= 0 AND tokens IS NOT NULL")
    f = p.groupBy("label_schema", F.expr("tokens div 100").alias("step")).agg(F.avg((F.col("gold") == F.col("pred")).cast("int")).alias("score"), F.count("*").alias("n"))
    key = F.struct(F.round("score", 9), -F.col("step"))
    b = f.groupBy("label_schema").agg(F.max(F.round("score", 9)).alias("best"), F.max_by(F.sqrt(F.col("score") * (1 - F.col("score")) / F.col("n")), key).alias("se"), F.max_by("step", key).alias("best_step"))
    return f.join(b, "label_schema").where("score >= best - se - 1e-9").groupBy("label_schema", "best_step").agg(F.min("step").alias("one_se_step"))


ORDER_SQL = """o AS (SELECT event_id, candidate_id AS item, row_number() OVER (PARTITION BY event_id ORDER BY coalesce(evidence_map_quality_score, 0.0) DESC, candidate_id) AS oracle, row_number() OVER (PARTITION BY event_id ORDER BY coalesce(base_score, 0.0) DESC, candidate_id) AS pred FROM evidence_candidates WHERE event_id IS NOT NULL)"""
_ORDERED = f"""WITH {ORDER_SQL}, r AS (SELECT *, CASE WHEN oracle <= 5 THEN greatest(5 - (oracle - 1), 1) ELSE 0 END AS rel FROM o WHERE oracle <= 5 OR pred <= 5),
    b AS (SELECT event_id, count(*) FILTER (oracle <= 5) AS no, count(*) FILTER (pred <= 5) AS np, count(*) FILTER (oracle <= 5 AND pred <= 5) AS shared, count(*) FILTER (oracle = pred AND oracle <= 5) AS same, max(CASE WHEN oracle = 1 AND pred = 1 THEN 1.0::DOUBLE ELSE 0.0 END) AS top1, count(*) FILTER (oracle = pred AND oracle <= 2) AS pre2,
    sum(CASE WHEN pred <= 5 THEN (pow(2.0, rel) - 1) / log2(pred + 1) ELSE 0 END) AS dcg, sum(CASE WHEN oracle <= 5 THEN (pow(2.0, rel) - 1) / log2(oracle + 1) ELSE 0 END) AS idcg FROM r GROUP BY 1),
    q AS (SELECT x.event_id, count(*) AS pairs, avg((x.pred < y.pred)::INT) AS order_acc FROM r x JOIN r y ON x.event_id = y.event_id AND x.oracle < y.oracle WHERE x.oracle <= 5 AND x.pred <= 5 AND y.oracle <= 5 AND y.pred <= 5 GROUP BY 1),
    m AS (SELECT event_id, shared / greatest(no, 1) AS recall, shared / greatest(np, 1) AS precision, shared / (no + np - shared) AS jaccard, top1, same / greatest(no, 1) AS position_hits, CASE WHEN no >= 2 AND np >= 2 AND pre2 = 2 THEN 1.0::DOUBLE ELSE 0.0 END AS prefix2, CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0.0 END AS ndcg, coalesce(order_acc, 0.0) AS order_acc, coalesce(pairs, 0) AS pairs FROM b LEFT JOIN q USING (event_id))"""
_MEASURES = ["recall", "precision", "jaccard", "top1", "position_hits", "prefix2", "ndcg", "order_acc"]


def orders(spark, d):
    rows = table(spark, d, "evidence_candidates").where("event_id IS NOT NULL").select("event_id", F.col("candidate_id").alias("item"), F.coalesce("evidence_map_quality_score", F.lit(0.0)).alias("q"), F.coalesce("base_score", F.lit(0.0)).alias("b"))
    a, b = top_k(rows, ["event_id"], best_first("q", "item"), 5, "oracle"), top_k(rows, ["event_id"], best_first("b", "item"), 5, "pred")
    return a.select("event_id", "item", "oracle").join(b.select("event_id", "item", "pred"), ["event_id", "item"], "full_outer")


@query(f"{_ORDERED} SELECT event_id, {', '.join(f'round({m}, 6) AS {m}' for m in _MEASURES)}, pairs FROM m")
def a_ordered_selection(spark, d):
    """Order by map quality as the oracle against the order by base score."""
    return r6(M.ordered_selection(orders(spark, d), ["event_id"], 5), *_MEASURES)


@query(f"{_ORDERED}, c AS ({CLAIMS_SQL}) SELECT label, grouping(label) AS overall, {', '.join(f'round(avg({m}), 6) AS {m}' for m in _MEASURES[:-1])}, round(sum(order_acc * pairs) / nullif(sum(pairs), 0), 6) AS order_acc, count(*) AS events FROM m JOIN c USING (event_id) GROUP BY ROLLUP (label)")
def a_selection_summary(spark, d):
    """Means overall and by label; the order measure is weighted by its pairs."""
    m = M.ordered_selection(orders(spark, d), ["event_id"], 5).join(claims(spark, d).select("event_id", "label"), "event_id")
    return m.rollup("label").agg(F.grouping("label").cast("long").alias("overall"), *(F.round(F.avg(c), 6).alias(c) for c in _MEASURES[:-1]), F.round(F.sum(F.col("order_acc") * F.col("pairs")) / F.nullif(F.sum("pairs"), F.lit(0)), 6).alias("order_acc"), F.count("*").alias("events"))


ORACLE_TEXTS = f"SELECT DISTINCT event_id, {KEY.format('text')} AS key FROM sentence_items WHERE raw_is_evidence AND event_id IS NOT NULL AND {KEY.format('text')} <> ''"


@query(f"""{HYBRID_SQL}, top AS (SELECT * FROM (SELECT event_id, key, row_number() OVER (PARTITION BY event_id ORDER BY hybrid DESC, cand) AS rk FROM hybrid) WHERE rk <= 5), o AS ({ORACLE_TEXTS}),
    e AS (SELECT o.event_id, count(*) AS oracle, count(rk) AS hits, max(CASE WHEN rk = 1 THEN 1.0 ELSE 0.0 END) AS top1 FROM o LEFT JOIN top USING (event_id, key) GROUP BY 1), n AS (SELECT event_id, count(*) AS chosen FROM top GROUP BY 1)
    SELECT count(*) AS events, round(sum(hits) / sum(oracle), 6) AS micro_recall, round(avg(hits / (oracle + coalesce(chosen, 0) - hits)), 6) AS jaccard, round(avg((hits > 0)::INT), 6) AS any_hit, round(avg((hits = oracle)::INT), 6) AS all_hit, round(avg(top1), 6) AS top1 FROM e LEFT JOIN n USING (event_id)""")
def a_retrieval_metrics(spark, d):
    """The hybrid top five against the sentences marked as evidence; events without any are skipped."""
    o = table(spark, d, "sentence_items").where("raw_is_evidence AND event_id IS NOT NULL").select("event_id", T.canonical_key("text").alias("key")).where("key <> ''").distinct()
    top = top_k(ranked(spark, d), ["event_id"], best_first("hybrid", "cand"), 5).select("event_id", "key", "rank")
    e = o.join(top, ["event_id", "key"], "left").groupBy("event_id").agg(F.count("*").alias("oracle"), F.count("rank").alias("hits"), F.max(F.when(F.col("rank") == 1, 1.0).otherwise(0.0)).alias("top1"))
    e = e.join(top.groupBy("event_id").agg(F.count("*").alias("chosen")), "event_id", "left").na.fill(0, ["chosen"])
    h, n = F.col("hits"), F.col("oracle")
    return e.agg(F.count("*").alias("events"), F.round(F.sum(h) / F.sum(n), 6).alias("micro_recall"), F.round(F.avg(h / (n + F.col("chosen") - h)), 6).alias("jaccard"), F.round(F.avg((h > 0).cast("int")), 6).alias("any_hit"), F.round(F.avg((h == n).cast("int")), 6).alias("all_hit"), F.round(F.avg("top1"), 6).alias("top1"))


@query(f"""{HYBRID_SQL}, v AS (SELECT *, round(a * mcos + b * mlex + c * mbm25, 9) AS score FROM hybrid, (VALUES {", ".join(f"('{k}', {a!r}, {b!r}, {c!r})" for k, (a, b, c) in VARIANTS.items())}) t(variant, a, b, c)), top AS (SELECT * FROM (SELECT event_id, variant, cand, key, row_number() OVER (PARTITION BY event_id, variant ORDER BY score DESC, cand) AS rk FROM v) WHERE rk <= 3),
    o AS ({ORACLE_TEXTS}), n AS (SELECT event_id, count(*) AS oracle FROM o GROUP BY 1), h AS (SELECT variant, event_id, count(*) AS chosen, count(o.key) AS hits FROM top LEFT JOIN o USING (event_id, key) GROUP BY 1, 2)
    SELECT variant, count(*) AS events, round(avg(hits / oracle), 6) AS recall, round(avg(hits / chosen), 6) AS precision, round(avg((hits > 0)::INT), 6) AS hit FROM h JOIN n USING (event_id) GROUP BY 1""")
def a_pool_recall(spark, d):
    """Recall and precision of the top three under each weighting."""
    o = table(spark, d, "sentence_items").where("raw_is_evidence AND event_id IS NOT NULL").select("event_id", T.canonical_key("text").alias("key")).where("key <> ''").distinct()
    keys = ranked(spark, d).select("event_id", "cand", "key")
    top = r_hybrid_variants(spark, d).join(keys, ["event_id", "cand"]).join(o.withColumn("hit", F.lit(1)), ["event_id", "key"], "left")
    h = top.groupBy("variant", "event_id").agg(F.count("*").alias("chosen"), F.count("hit").alias("hits")).join(o.groupBy("event_id").agg(F.count("*").alias("oracle")), "event_id")
    return h.groupBy("variant").agg(F.count("*").alias("events"), F.round(F.avg(F.col("hits") / F.col("oracle")), 6).alias("recall"), F.round(F.avg(F.col("hits") / F.col("chosen")), 6).alias("precision"), F.round(F.avg((F.col("hits") > 0).cast("int")), 6).alias("hit"))


@query(f"WITH {DENSE_SQL} SELECT label, round(avg(sim), 6) AS redundancy FROM sim WHERE i < j AND j <= 5 GROUP BY label")
def a_redundancy(spark, d):
    """Mean similarity of pairs within the top five."""
    p = top_k(dense_pool(spark, d), ["label"], best_first("s", "vec_id"), 5)
    x, y = p.alias("x"), p.alias("y")
    pairs = x.join(y, F.expr("x.label = y.label AND x.rank < y.rank"))
    return pairs.groupBy("x.label").agg(F.round(F.avg(F.round(V.dot(F.col("x.v"), F.col("y.v")), 9)), 6).alias("redundancy"))


@query(f"WITH {ORDER_SQL}, p AS (SELECT x.event_id, sign(x.oracle - y.oracle) * sign(x.pred - y.pred) AS s FROM o x JOIN o y ON x.event_id = y.event_id AND x.item < y.item WHERE x.oracle <= 10 AND y.oracle <= 10) SELECT event_id, round(avg(s), 6) AS tau FROM p GROUP BY 1")
def a_kendall(spark, d):
    """Kendall's tau between two orders over the oracle's first ten."""
    rows = table(spark, d, "evidence_candidates").where("event_id IS NOT NULL").select("event_id", F.col("candidate_id").alias("item"), F.coalesce("evidence_map_quality_score", F.lit(0.0)).alias("q"), F.coalesce("base_score", F.lit(0.0)).alias("b"))
    top = top_k(rows, ["event_id"], best_first("q", "item"), 10, "oracle")
    # Among the first ten, the order by base score says who is ahead; ties fall to the smaller item.
    x, y = top.alias("x"), top.alias("y")
    ahead = F.when((F.col("x.b") > F.col("y.b")) | ((F.col("x.b") == F.col("y.b")) & (F.col("x.item") < F.col("y.item"))), -1).otherwise(1)
    pairs = x.join(y, F.expr("x.event_id = y.event_id AND x.item < y.item"))
    return pairs.groupBy("x.event_id").agg(F.round(F.avg(F.signum(F.col("x.oracle") - F.col("y.oracle")) * ahead), 6).alias("tau"))


_STAT = "round(avg(b) + 1e-9, 6) AS mean, round(stddev_pop(b), 6) AS std, round(min(b), 6) AS low, round(max(b), 6) AS high"


@query(f"""WITH x AS (SELECT event_id, base_score AS b, map_confidence AS c, row_number() OVER (PARTITION BY event_id ORDER BY base_score, candidate_id) AS i, count(*) OVER (PARTITION BY event_id) AS n, max(base_score) OVER (PARTITION BY event_id) AS m FROM evidence_candidates WHERE event_id IS NOT NULL AND base_score IS NOT NULL)
    SELECT event_id, count(*) AS n, {_STAT}, round(quantile_cont(b, 0.5) + 1e-9, 6) AS median, round(quantile_cont(b, 0.9) + 1e-9, 6) AS p90, round(ln(sum(exp(b - m))) - sum(exp(b - m) * (b - m)) / sum(exp(b - m)), 6) AS entropy, round(CASE WHEN sum(b) = 0 THEN 0 ELSE sum(b * (2 * i - n - 1)) / (any_value(n) * sum(b)) END, 6) AS gini FROM x GROUP BY 1""")
def a_feature_vector(spark, d):
    """Shape of an event's scores: moments, quantiles, softmax entropy and Gini coefficient."""
    x = table(spark, d, "evidence_candidates").where("event_id IS NOT NULL AND base_score IS NOT NULL").select("event_id", "candidate_id", F.col("base_score").alias("b"))
    x = top_k(x, ["event_id"], [F.asc("b"), F.asc("candidate_id")], name="i").join(x.groupBy("event_id").agg(F.max("b").alias("m"), F.count("*").alias("k")), "event_id")
    e = F.exp(F.col("b") - F.col("m"))
    return x.groupBy("event_id").agg(
        F.count("*").alias("n"), F.round(F.avg("b") + 1e-9, 6).alias("mean"), F.round(F.stddev_pop("b"), 6).alias("std"), F.round(F.min("b"), 6).alias("low"), F.round(F.max("b"), 6).alias("high"),
        F.round(F.percentile("b", 0.5) + 1e-9, 6).alias("median"), F.round(F.percentile("b", 0.9) + 1e-9, 6).alias("p90"),
        F.round(F.log(F.sum(e)) - F.sum(e * (F.col("b") - F.col("m"))) / F.sum(e), 6).alias("entropy"),
        F.round(F.when(F.sum("b") == 0, 0.0).otherwise(F.sum(F.col("b") * (2 * F.col("i") - F.col("k") - 1)) / (F.first("k") * F.sum("b"))), 6).alias("gini"),
    )


@query("SELECT split, count(*) AS n, " + ", ".join(f"round(quantile_cont(prompt_token_count, {q}), 6) AS p{int(q * 100)}" for q in (0.5, 0.9, 0.95, 0.99)) + ", count(*) FILTER (prompt_token_count > 200) AS over_limit, round(avg((prompt_token_count > 200)::INT), 6) AS over_rate FROM prepared_samples WHERE prompt_token_count IS NOT NULL GROUP BY split")
def a_length_percentiles(spark, d):
    x = table(spark, d, "prepared_samples").where("prompt_token_count IS NOT NULL")
    t = F.col("prompt_token_count")
    return x.groupBy("split").agg(F.count("*").alias("n"), *(F.round(F.percentile(t, q), 6).alias(f"p{int(q * 100)}") for q in (0.5, 0.9, 0.95, 0.99)), F.count_if(t > 200).alias("over_limit"), F.round(F.avg((t > 200).cast("int")), 6).alias("over_rate"))


@query("WITH x AS (SELECT sample_id, unnest(['truncated', 'no_evidence', 'long_claim']) AS category, unnest([was_truncated, no_evidence, long_claim]) AS flag FROM prepared_samples) SELECT category, sample_id, rk AS rank FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY sample_id) AS rk FROM x WHERE flag) WHERE rk <= 3")
def a_category_samples(spark, d):
    each = F.array(*(F.struct(F.lit(n).alias("category"), F.col(c).alias("flag")) for n, c in (("truncated", "was_truncated"), ("no_evidence", "no_evidence"), ("long_claim", "long_claim"))))
    return top_k(table(spark, d, "prepared_samples").select("sample_id", F.inline(each)).where("flag"), ["category"], [F.asc("sample_id")], 3).select("category", "sample_id", "rank")


@query("SELECT label_schema, coverage_label, grouping(label_schema) * 2 + grouping(coverage_label) AS level, count(*) AS n FROM prepared_samples GROUP BY CUBE (label_schema, coverage_label)")
def a_cross_counts(spark, d):
    return table(spark, d, "prepared_samples").cube("label_schema", "coverage_label").agg((F.grouping("label_schema").cast("long") * 2 + F.grouping("coverage_label").cast("long")).alias("level"), F.count("*").alias("n"))


@query("WITH l AS (SELECT label_schema, gold_id, count(*) AS c FROM prepared_samples WHERE gold_id >= 0 GROUP BY 1, 2) SELECT label_schema, gold_id, c AS n, round(sum(c) OVER w / (count(*) OVER w * c), 6) AS weight FROM l WINDOW w AS (PARTITION BY label_schema)")
def a_class_weights(spark, d):
    """Balanced weights n / (classes x count)."""
    c = table(spark, d, "prepared_samples").where("gold_id >= 0").groupBy("label_schema", "gold_id").agg(F.count("*").alias("n"))
    w = Window.partitionBy("label_schema")  # over one row per class
    return c.select("label_schema", "gold_id", "n", F.round(F.sum("n").over(w) / (F.count("*").over(w) * F.col("n")), 6).alias("weight"))


_BIN = "FROM (SELECT coalesce(lower(map_relation), 'none') AS g, map_confidence AS s, lower(map_directness) = 'direct' AS y FROM evidence_candidates WHERE map_confidence IS NOT NULL AND map_directness IS NOT NULL)"


def binary(spark, d):
    return table(spark, d, "evidence_candidates").where("map_confidence IS NOT NULL AND map_directness IS NOT NULL").select(F.coalesce(F.lower("map_relation"), F.lit("none")).alias("g"), F.col("map_confidence").alias("s"), (F.lower("map_directness") == "direct").alias("y"))


@query(f"""WITH c AS (SELECT g, s, count(*) FILTER (y) AS p, count(*) FILTER (NOT y) AS n {_BIN} GROUP BY 1, 2), w AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY g ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb, sum(p) OVER (PARTITION BY g ORDER BY s DESC) AS pc, sum(p + n) OVER (PARTITION BY g ORDER BY s DESC) AS tc FROM c)
    SELECT g, round(sum(p * (nb + 0.5 * n)) / nullif(sum(p) * sum(n), 0), 6) AS auc, round(sum(p * pc / tc) / nullif(sum(p), 0), 6) AS average_precision FROM w GROUP BY g""")
def a_roc_auc(spark, d):
    return r6(M.roc_auc(binary(spark, d), ["g"], "s", "y"), "auc", "average_precision")


_CAL = f"c AS (SELECT g, CAST(least(floor(s * 10), 9) AS INT) AS bin, count(*) AS n, avg(s) AS confidence, avg(y::INT) AS accuracy {_BIN} GROUP BY 1, 2)"


@query(f"WITH {_CAL} SELECT g, bin, n, round(confidence, 6) AS confidence, round(accuracy, 6) AS accuracy FROM c")
def a_calibration(spark, d):
    return r6(M.calibration(binary(spark, d), ["g"], "s", "y"), "confidence", "accuracy")


@query(f"WITH {_CAL} SELECT g, round(sum(n * abs(confidence - accuracy)) / sum(n), 6) AS ece FROM c GROUP BY g")
def a_ece(spark, d):
    return r6(M.expected_calibration_error(M.calibration(binary(spark, d), ["g"], "s", "y"), ["g"]), "ece")


@query(f"SELECT g, round(avg(pow(s - y::INT, 2)), 6) AS brier {_BIN} GROUP BY g")
def a_brier(spark, d):
    return binary(spark, d).groupBy("g").agg(F.round(F.avg(F.pow(F.col("s") - F.col("y").cast("int"), 2)), 6).alias("brier"))


_XY = "x AS (SELECT event_id, floor(base_score * 100) AS a, floor(map_confidence * 100) AS b FROM evidence_candidates WHERE event_id IS NOT NULL AND base_score IS NOT NULL AND map_confidence IS NOT NULL)"


@query(f"""WITH {_XY.replace("event_id, ", "coalesce(lower(map_relation), 'none') AS g, ")}, ra AS (SELECT g, a, sum(count(*)) OVER (PARTITION BY g ORDER BY a) - count(*) + (count(*) + 1) / 2 AS ra FROM x GROUP BY 1, 2), rb AS (SELECT g, b, sum(count(*)) OVER (PARTITION BY g ORDER BY b) - count(*) + (count(*) + 1) / 2 AS rb FROM x GROUP BY 1, 2)
    SELECT g, round(corr(a, b), 6) AS pearson, round(corr(ra, rb), 6) AS spearman, count(*) AS n FROM x JOIN ra USING (g, a) JOIN rb USING (g, b) GROUP BY g""")
def a_correlation(spark, d):
    x = table(spark, d, "evidence_candidates").where("event_id IS NOT NULL AND base_score IS NOT NULL AND map_confidence IS NOT NULL").select(F.coalesce(F.lower("map_relation"), F.lit("none")).alias("g"), F.floor(F.col("base_score") * 100).cast("double").alias("a"), F.floor(F.col("map_confidence") * 100).cast("double").alias("b"))
    x = M.average_ranks(M.average_ranks(x, ["g"], "a", "ra"), ["g"], "b", "rb")
    return x.groupBy("g").agg(F.round(F.corr("a", "b"), 6).alias("pearson"), F.round(F.corr("ra", "rb"), 6).alias("spearman"), F.count("*").alias("n"))


@query(f"""{PRED_SQL}, k AS (SELECT label_schema AS g, gold AS a, pred AS b, count(*) AS n FROM p WHERE gold >= 0 AND pred >= 0 GROUP BY ALL), t AS (SELECT g, sum(n) AS t, sum(n) FILTER (a = b) AS same, sum(abs(a - b) * n) AS off FROM k GROUP BY 1),
    na AS (SELECT g, a AS c, sum(n) AS na FROM k GROUP BY 1, 2), nb AS (SELECT g, b AS d, sum(n) AS nb FROM k GROUP BY 1, 2), x AS (SELECT g, sum(na * nb) FILTER (c = d) AS pe, sum(abs(c - d) * na * nb) AS pw FROM na JOIN nb USING (g) GROUP BY 1),
    m AS (SELECT g, c, sum(n) AS m FROM (SELECT g, a AS c, n FROM k UNION ALL SELECT g, b, n FROM k) GROUP BY 1, 2), e AS (SELECT g, sum(m / (2 * t) * (1 - m / (2 * t))) / 5 AS ge FROM m JOIN t USING (g) GROUP BY 1),
    z AS (SELECT g, t, coalesce(same, 0) / t AS po, coalesce(pe, 0) / (t * t) AS pe, off, pw, ge FROM t JOIN x USING (g) JOIN e USING (g))
    SELECT g, CAST(t AS BIGINT) AS n, round(po, 6) AS agreement, round(CASE WHEN abs(1 - pe) > 1e-12 THEN (po - pe) / (1 - pe) END, 6) AS kappa, round(CASE WHEN pw > 0 THEN 1 - off * t / pw END, 6) AS weighted_kappa, round(CASE WHEN abs(1 - ge) > 1e-12 THEN (po - ge) / (1 - ge) END, 6) AS ac1 FROM z""")
def a_agreement(spark, d):
    """Gold and predicted labels as two raters, per schema."""
    p = predictions(spark, d).where("gold >= 0 AND pred >= 0").groupBy(F.col("label_schema").alias("g"), F.col("gold").alias("a"), F.col("pred").alias("b")).agg(F.count("*").alias("n"))
    return r6(M.agreement(p, ["g"], 6), "agreement", "kappa", "weighted_kappa", "ac1")


ARM_PAIRS = "a AS (SELECT event_id, arm, max((gold = pred)::INT) AS ok, avg(tokens) AS tokens FROM p WHERE event_id IS NOT NULL AND arm IS NOT NULL AND gold >= 0 AND tokens IS NOT NULL GROUP BY 1, 2), ab AS (SELECT x.event_id, x.arm || '-' || y.arm AS pair, x.ok AS xo, y.ok AS yo, x.tokens - y.tokens AS delta FROM a x JOIN a y ON x.event_id = y.event_id AND x.arm < y.arm)"


def arm_pairs(spark, d):
    a = predictions(spark, d).where("event_id IS NOT NULL AND arm IS NOT NULL AND gold >= 0 AND tokens IS NOT NULL").groupBy("event_id", "arm").agg(F.max((F.col("gold") == F.col("pred")).cast("int")).alias("ok"), F.avg("tokens").alias("tokens"))
    x, y = a.alias("x"), a.alias("y")
    return x.join(y, F.expr("x.event_id = y.event_id AND x.arm < y.arm")).select("x.event_id", F.concat_ws("-", "x.arm", "y.arm").alias("pair"), F.col("x.ok").alias("xo"), F.col("y.ok").alias("yo"), (F.col("x.tokens") - F.col("y.tokens")).alias("delta"))


@query(f"{PRED_SQL}, {ARM_PAIRS} SELECT pair, count(*) AS events, count(*) FILTER (xo > yo) AS b, count(*) FILTER (xo < yo) AS c FROM ab GROUP BY pair")
def a_mcnemar_counts(spark, d):
    return arm_pairs(spark, d).groupBy("pair").agg(F.count("*").alias("events"), F.count_if(F.expr("xo > yo")).alias("b"), F.count_if(F.expr("xo < yo")).alias("c"))


@query(f"""{PRED_SQL}, {ARM_PAIRS}, t AS (SELECT pair, count(*) AS events, count(*) FILTER (xo > yo) AS b, count(*) FILTER (xo < yo) AS c FROM ab GROUP BY pair)
    SELECT *, round(CASE WHEN b + c = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(b, c) + 1), lambda k: exp(lgamma(b + c + 1) - lgamma(k + 1) - lgamma(b + c - k + 1) - (b + c) * ln(2.0))))) END, 9) AS p FROM t""")
def a_mcnemar(spark, d):
    return a_mcnemar_counts(spark, d).withColumn("p", F.round(M.mcnemar_column(F.col("b"), F.col("c")), 9))


def _draws_sql(seed: int) -> str:
    """Numbers of each pair's events in 200 draws."""
    h = "('0x' || substr(md5('{0}|' || {1}), 1, 8))::BIGINT % 2147483647"
    return f"""{PRED_SQL}, {ARM_PAIRS}, d AS (SELECT k, {h.format(seed, "k")} AS f FROM range(1, 201) t(k)), u AS (SELECT pair, k, delta, (({h.format(seed, "event_id")}) * f) % 2147483647 AS x FROM ab, d WHERE delta IS NOT NULL)"""


_WEIGHT = " + ".join(f"(x >= {limit})::INT" for limit in M.poisson_limits())


@query(f"""{_draws_sql(17)}, m AS (SELECT pair, k, sum(({_WEIGHT}) * delta) / nullif(sum({_WEIGHT}), 0) AS m FROM u GROUP BY 1, 2), s AS (SELECT pair, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high, stddev_samp(m) AS se FROM m GROUP BY 1)
    SELECT pair, round(mean, 6) AS mean, round(low, 6) AS low, round(high, 6) AS high, round(se, 6) AS se FROM (SELECT pair, avg(delta) AS mean FROM ab GROUP BY 1) JOIN s USING (pair)""")
def a_bootstrap(spark, d):
    return r6(M.bootstrap(arm_pairs(spark, d), ["pair"], "event_id", "delta"), "mean", "low", "high", "se")


@query(f"""{_draws_sql(23)}, t AS (SELECT pair, k, sum((1 - 2 * (x % 2)) * delta) AS s FROM u GROUP BY 1, 2), o AS (SELECT pair, sum(delta) AS observed, count(delta) AS n FROM ab GROUP BY 1)
    SELECT pair, round(any_value(observed) / any_value(n), 6) AS mean, round((1 + count(*) FILTER (abs(s) >= abs(observed) - 1e-12)) / 201, 6) AS p FROM t JOIN o USING (pair) GROUP BY pair""")
def a_permutation(spark, d):
    return r6(M.permutation_test(arm_pairs(spark, d), ["pair"], "event_id", "delta"), "mean", "p")


_P = "SELECT coalesce(lower(map_relation), 'none') AS g, candidate_id AS i, round(1 - map_confidence, 6) AS p FROM evidence_candidates WHERE map_confidence IS NOT NULL AND duplicate_group IS NOT NULL"


@query(f"WITH x AS ({_P}), r AS (SELECT *, least(1.0, (count(*) OVER (PARTITION BY g) - row_number() OVER (PARTITION BY g ORDER BY p, i) + 1) * p) AS s, row_number() OVER (PARTITION BY g ORDER BY p, i) AS k FROM x) SELECT g, i, round(max(s) OVER (PARTITION BY g ORDER BY k), 6) AS adjusted FROM r")
def a_holm(spark, d):
    x = table(spark, d, "evidence_candidates").where("map_confidence IS NOT NULL AND duplicate_group IS NOT NULL").select(F.coalesce(F.lower("map_relation"), F.lit("none")).alias("g"), F.col("candidate_id").alias("i"), F.round(1 - F.col("map_confidence"), 6).alias("p"))
    return r6(M.holm(x, ["g"], "p", "i").select("g", "i", "adjusted"), "adjusted")


@query(f"{PRED_SQL}, {ARM_PAIRS} SELECT pair, round(avg(delta) / nullif(stddev_samp(delta), 0), 6) AS dz, round(((count(*) FILTER (xo > yo)) + 0.5) / ((count(*) FILTER (xo < yo)) + 0.5), 6) AS odds FROM ab GROUP BY pair")
def a_effect_sizes(spark, d):
    """Cohen's d of paired differences, and the odds of discordant pairs with half a count added to each."""
    return arm_pairs(spark, d).groupBy("pair").agg(F.round(F.avg("delta") / F.nullif(F.stddev_samp("delta"), F.lit(0.0)), 6).alias("dz"), F.round((F.count_if(F.expr("xo > yo")) + 0.5) / (F.count_if(F.expr("xo < yo")) + 0.5), 6).alias("odds"))


@query("""WITH a AS (SELECT event_id, evidence_count AS k, avg(prompt_token_count) AS t, round(avg(abs(coalesce(gold_id, 0) - 2)) / (1 + evidence_count) + 0.001 * avg(prompt_token_count), 9) AS cost FROM prepared_samples WHERE event_id IS NOT NULL AND evidence_count IS NOT NULL AND prompt_token_count IS NOT NULL GROUP BY 1, 2),
    b AS (SELECT event_id, min(cost) AS best, arg_min(k, struct_pack(c := cost, t := t, k := k)) AS best_k FROM a GROUP BY 1) SELECT event_id, k, best_k, round(cost - best, 6) AS regret FROM a JOIN b USING (event_id)""")
def a_capacity_regret(spark, d):
    """Cost of each evidence count an event was tried with, over that of its best one (fewer tokens, then fewer items, of equals)."""
    x = table(spark, d, "prepared_samples").where("event_id IS NOT NULL AND evidence_count IS NOT NULL AND prompt_token_count IS NOT NULL")
    loss = F.avg(F.abs(F.coalesce("gold_id", F.lit(0)) - 2)) / (1 + F.col("evidence_count"))
    a = x.groupBy("event_id", "evidence_count").agg(F.avg("prompt_token_count").alias("t"), F.round(loss + 0.001 * F.avg("prompt_token_count"), 9).alias("cost")).withColumnRenamed("evidence_count", "k")
    b = a.groupBy("event_id").agg(F.min("cost").alias("best"), F.min_by("k", F.struct("cost", "t", "k")).alias("best_k"))
    return a.join(b, "event_id").select("event_id", "k", "best_k", F.round(F.col("cost") - F.col("best"), 6).alias("regret"))


@query(f"""WITH o AS ({ORACLE_TEXTS}), p AS (SELECT event_id, {KEY.format("text")} AS key, rk FROM ({RANKED_CAND}) WHERE rk <= 3), po AS (SELECT DISTINCT event_id, key FROM p), h AS (SELECT event_id, count(*) AS n FROM o GROUP BY 1), m AS (SELECT event_id, count(*) AS predicted, count(o.key) AS hits FROM po LEFT JOIN o USING (event_id, key) GROUP BY 1)
    SELECT CAST(sum(coalesce(hits, 0)) AS BIGINT) AS hits, CAST(sum(coalesce(predicted, 0)) AS BIGINT) AS predicted, CAST(sum(coalesce(n, 0)) AS BIGINT) AS gold, count(*) FILTER (n = hits) AS contained FROM h FULL JOIN m USING (event_id)""")
def a_rationale(spark, d):
    """Micro counts of the first three predicted sentences against the gold set, and events whose gold set they contain."""
    o = table(spark, d, "sentence_items").where("raw_is_evidence AND event_id IS NOT NULL").select("event_id", T.canonical_key("text").alias("key")).where("key <> ''").distinct()
    p = ranked_candidates(spark, d, 3).select("event_id", T.canonical_key("text").alias("key")).distinct()
    m = p.join(o.withColumn("hit", F.lit(1)), ["event_id", "key"], "left").groupBy("event_id").agg(F.count("*").alias("predicted"), F.count("hit").alias("hits"))
    both = o.groupBy("event_id").agg(F.count("*").alias("n")).join(m, "event_id", "full_outer")
    return both.agg(*(F.sum(F.coalesce(c, F.lit(0))).alias(a) for c, a in (("hits", "hits"), ("predicted", "predicted"), ("n", "gold"))), F.count_if(F.col("n") == F.col("hits")).alias("contained"))


@query(f"WITH h AS (SELECT coalesce(len(covered_atom_ids), 0) AS hops, coalesce(map_confidence, 0.0) AS r FROM evidence_candidates) SELECT hops, grouping(hops) AS overall, count(*) AS n, round(avg(r), 6) AS recall, round(avg((r >= 0.5)::INT), 6) AS all_recall FROM h GROUP BY ROLLUP (hops)")
def a_by_hop(spark, d):
    """A measure overall and by the number of hops, here atoms covered."""
    h = table(spark, d, "evidence_candidates").select(F.coalesce(F.size("covered_atom_ids"), F.lit(0)).alias("hops"), F.coalesce("map_confidence", F.lit(0.0)).alias("r"))
    return h.rollup("hops").agg(F.grouping("hops").cast("long").alias("overall"), F.count("*").alias("n"), F.round(F.avg("r"), 6).alias("recall"), F.round(F.avg((F.col("r") >= 0.5).cast("int")), 6).alias("all_recall"))


@query(f"""WITH c AS ({CLAIMS_SQL}), w AS (SELECT event_id, list_distinct({CONTENT.format("claim")}) AS cw FROM c), e AS (SELECT event_id, list_distinct(flatten(list({CONTENT.format("text")}))) AS tw, max(coalesce(base_score, 0.0)) AS best FROM evidence_candidates WHERE event_id IS NOT NULL AND text IS NOT NULL GROUP BY 1),
    s AS (SELECT event_id, best, CASE WHEN len(cw) = 0 THEN 0.0 ELSE len(list_filter(cw, lambda x: list_contains(tw, x))) * 1.0 / len(cw) END AS cov FROM w JOIN e USING (event_id))
    SELECT event_id, round(0.72 * cov + 0.2 * cov + 0.08 * best, 6) AS score, CASE WHEN round(0.92 * cov + 0.08 * best, 6) >= 0.7 THEN 'covered' WHEN round(0.85 * cov + 0.15 * best, 6) >= 0.35 THEN 'weak_covered' ELSE 'uncovered' END AS coverage FROM s""")
def a_coverage_rule(spark, d):
    """Coverage of the claim's words by its evidence, with the best retrieval score, as covered, weakly covered or not."""
    c = claims(spark, d).select("event_id", F.array_distinct(T.content_tokens("claim")).alias("cw"))
    rows = table(spark, d, "evidence_candidates").where("event_id IS NOT NULL AND text IS NOT NULL")
    words = rows.select("event_id", F.explode(T.content_tokens("text")).alias("t")).distinct()
    wanted = c.select("event_id", F.explode("cw").alias("t")).join(words, ["event_id", "t"], "left_semi").groupBy("event_id").agg(F.count("*").alias("hit"))
    best = rows.groupBy("event_id").agg(F.max(F.coalesce("base_score", F.lit(0.0))).alias("best"))
    s = c.join(best, "event_id").join(wanted, "event_id", "left").withColumn("cov", F.when(F.size("cw") == 0, 0.0).otherwise(F.coalesce("hit", F.lit(0)) / F.size("cw")))
    score, weak = F.round(0.92 * F.col("cov") + 0.08 * F.col("best"), 6), F.round(0.85 * F.col("cov") + 0.15 * F.col("best"), 6)
    return s.select("event_id", score.alias("score"), F.when(score >= 0.7, "covered").when(weak >= 0.35, "weak_covered").otherwise("uncovered").alias("coverage"))


@query("WITH l AS (SELECT event_id, arg_max(label, struct_pack(t := loaded_at, l := coalesce(label, ''))) AS label, max(loaded_at) AS loaded_at, count(*) AS deliveries FROM claims WHERE event_id IS NOT NULL AND loaded_at IS NOT NULL GROUP BY 1) SELECT event_id, label, deliveries FROM l")
def a_latest_rows(spark, d):
    """The latest delivery of each event, and how many there were."""
    c = table(spark, d, "claims").where("event_id IS NOT NULL AND loaded_at IS NOT NULL")
    return c.groupBy("event_id").agg(F.max_by("label", F.struct("loaded_at", F.coalesce("label", F.lit("")))).alias("label"), F.count("*").alias("deliveries"))


@query("WITH m AS (SELECT label_schema AS run, avg(prompt_token_count) AS prompt, avg(target_token_count) AS target, avg(evidence_count) AS evidence FROM prepared_samples WHERE label_schema IS NOT NULL GROUP BY 1), u AS (UNPIVOT m ON prompt, target, evidence INTO NAME metric VALUE value) SELECT metric, arg_max(run, struct_pack(v := round(value, 9), r := run)) AS leader, round(max(value), 6) AS value FROM u GROUP BY metric")
def a_metric_leaders(spark, d):
    m = table(spark, d, "prepared_samples").where("label_schema IS NOT NULL").groupBy(F.col("label_schema").alias("run")).agg(F.avg("prompt_token_count").alias("prompt"), F.avg("target_token_count").alias("target"), F.avg("evidence_count").alias("evidence"))
    u = m.unpivot("run", ["prompt", "target", "evidence"], "metric", "value")
    return u.groupBy("metric").agg(F.max_by("run", F.struct(F.round("value", 9), "run")).alias("leader"), F.round(F.max("value"), 6).alias("value"))


@query(f"""{PRED_SQL}, g AS (SELECT unnest([0.0, 50.0, 100.0, 150.0, 200.0]::DOUBLE[]) AS threshold) SELECT threshold, count(*) AS n, round(avg((gold = CASE WHEN tokens >= threshold THEN pred ELSE 1 END)::INT), 6) AS accuracy FROM p, g WHERE gold >= 0 AND tokens IS NOT NULL GROUP BY 1""")
def a_gate_grid(spark, d):
    """Accuracy at each threshold of a gate between a prediction and a constant one."""
    p = predictions(spark, d).where("gold >= 0 AND tokens IS NOT NULL").withColumn("threshold", F.explode(F.array(*(F.lit(float(x)) for x in (0, 50, 100, 150, 200)))))
    gated = F.when(F.col("tokens") >= F.col("threshold"), F.col("pred")).otherwise(1)
    return p.groupBy("threshold").agg(F.count("*").alias("n"), F.round(F.avg((F.col("gold") == gated).cast("int")), 6).alias("accuracy"))


@query("SELECT source, CAST(sum(prompt_token_count) AS BIGINT) AS prompt_sum, round(avg(prompt_token_count), 6) AS prompt_mean, round(quantile_cont(prompt_token_count, 0.95), 6) AS prompt_p95, CAST(sum(target_token_count) AS BIGINT) AS target_sum, count(*) AS n FROM prepared_samples GROUP BY source")
def a_usage(spark, d):
    return table(spark, d, "prepared_samples").groupBy("source").agg(F.sum("prompt_token_count").alias("prompt_sum"), F.round(F.avg("prompt_token_count"), 6).alias("prompt_mean"), F.round(F.percentile("prompt_token_count", 0.95), 6).alias("prompt_p95"), F.sum("target_token_count").alias("target_sum"), F.count("*").alias("n"))


@query("WITH r AS (SELECT source, label_schema, evidence_arm, avg(prompt_token_count) AS m FROM prepared_samples WHERE source IS NOT NULL GROUP BY 1, 2, 3), b AS (SELECT source, label_schema, avg(m) AS m FROM r GROUP BY 1, 2) SELECT source, round(avg(m), 6) AS mean FROM b GROUP BY 1")
def a_hierarchical_mean(spark, d):
    """Mean of means: arm within schema within source, each with equal weight."""
    r = table(spark, d, "prepared_samples").where("source IS NOT NULL").groupBy("source", "label_schema", "evidence_arm").agg(F.avg("prompt_token_count").alias("m"))
    return r.groupBy("source", "label_schema").agg(F.avg("m").alias("m")).groupBy("source").agg(F.round(F.avg("m"), 6).alias("mean"))
