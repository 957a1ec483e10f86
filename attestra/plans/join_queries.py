"""Queries of the joins, set operations and learners' data side."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestra.functions import text as T
from attestra.operators import joins as J
from attestra.operators.ranking import top_k
from attestra.plans.common import CLAIMS_SQL, KEY, claims
from attestra.plans.metric_queries import ORACLE_TEXTS
from attestra.plans.selection_queries import RANKED_CAND, best_first, ranked_candidates
from attestra.plans.text_queries import _split_sql
from attestra.registry import query, table

CANDS = "SELECT candidate_id, event_id FROM evidence_candidates WHERE event_id IS NOT NULL"


@query(f"WITH c AS ({CLAIMS_SQL}) SELECT candidate_id, event_id, label FROM ({CANDS}) JOIN c USING (event_id)")
def j_strict_inner(spark, d):
    """Candidates with their claim; every one must have one."""
    return J.strict_inner(table(spark, d, "evidence_candidates").where("event_id IS NOT NULL").select("candidate_id", "event_id"), claims(spark, d).select("event_id", "label"), ["event_id"])


@query(f"WITH c AS ({CLAIMS_SQL}) SELECT event_id FROM c WHERE event_id NOT IN (SELECT event_id FROM evidence_candidates WHERE event_id IS NOT NULL)")
def j_anti(spark, d):
    """Claims without a candidate."""
    return J.unmatched(claims(spark, d).select("event_id"), table(spark, d, "evidence_candidates").where("event_id IS NOT NULL"), ["event_id"])


@query("""WITH a AS (SELECT DISTINCT event_id FROM anchors WHERE event_id IS NOT NULL), s AS (SELECT DISTINCT event_id FROM sentence_items WHERE event_id IS NOT NULL)
    SELECT event_id, CASE WHEN s.event_id IS NULL THEN 'left' ELSE 'right' END AS side FROM (SELECT event_id, 1 AS l FROM a) a FULL JOIN s USING (event_id) WHERE l IS NULL OR s.event_id IS NULL""")
def j_key_difference(spark, d):
    return J.key_difference(table(spark, d, "anchors").where("event_id IS NOT NULL"), table(spark, d, "sentence_items").where("event_id IS NOT NULL"), ["event_id"])


_A = f"SELECT event_id, {KEY.format('text')} AS key, rk AS rank, base_score AS score, 'base' AS route FROM ({RANKED_CAND}) WHERE rk <= 5"
_B = f"SELECT event_id, {KEY.format('text')} AS key, row_number() OVER (PARTITION BY event_id ORDER BY coalesce(map_confidence, 0.0) DESC, candidate_id) AS rank, map_confidence AS score, 'map' AS route FROM evidence_candidates WHERE event_id IS NOT NULL AND text IS NOT NULL"


@query(f"SELECT event_id, key, min(rank) AS rank, round(max(score), 6) AS score, array_to_string(list_sort(list_distinct(list(route))), ',') AS routes FROM ({_A} UNION ALL SELECT * FROM ({_B}) WHERE rank <= 5) GROUP BY 1, 2")
def j_merge_candidates(spark, d):
    """Two rankings of an event merged on the text: best rank, best score, both routes."""
    one = ranked_candidates(spark, d, 5).select("event_id", T.canonical_key("text").alias("key"), "rank", F.col("base_score").alias("score"), F.array(F.lit("base")).alias("routes"))
    rows = table(spark, d, "evidence_candidates").where("event_id IS NOT NULL AND text IS NOT NULL").withColumn("c", F.coalesce("map_confidence", F.lit(0.0)))
    two = top_k(rows, ["event_id"], best_first("c", "candidate_id"), 5).select("event_id", T.canonical_key("text").alias("key"), "rank", F.col("map_confidence").alias("score"), F.array(F.lit("map")).alias("routes"))
    fold = lambda df: df.groupBy("event_id", "key").agg(F.min("rank").alias("rank"), F.max("score").alias("score"), F.first("routes").alias("routes"))
    return J.merge_candidates(fold(one), fold(two), ["event_id", "key"], ["rank"], ["score"], ["routes"]).withColumns({"score": F.round("score", 6), "routes": F.array_join("routes", ",")})


@query("""WITH m AS (SELECT report_id, max(sentence_count) AS sentences, max(status) AS status FROM strategy_renders WHERE report_id IS NOT NULL GROUP BY 1), r AS (SELECT DISTINCT report_id FROM anchors WHERE report_id IS NOT NULL)
    SELECT report_id, coalesce(sentences, -1) AS sentences, coalesce(status, 'none') AS status FROM r LEFT JOIN m USING (report_id)""")
def j_attach(spark, d):
    """Reports with what their renders say, or fall-backs."""
    notes = table(spark, d, "strategy_renders").where("report_id IS NOT NULL").groupBy("report_id").agg(F.max("sentence_count").alias("sentences"), F.max("status").alias("status"))
    return J.attach(table(spark, d, "anchors").where("report_id IS NOT NULL").select("report_id").distinct(), notes, ["report_id"], {"sentences": -1, "status": "none"})


@query(f"""WITH o AS ({ORACLE_TEXTS}), p AS (SELECT DISTINCT event_id, {KEY.format("text")} AS key FROM evidence_candidates WHERE event_id IS NOT NULL AND text IS NOT NULL), f AS (SELECT event_id, o.key IS NOT NULL AS a, p.key IS NOT NULL AS b FROM (SELECT event_id, key FROM o) o FULL JOIN p USING (event_id, key))
    SELECT event_id, count(*) FILTER (a AND b) AS both_sides, count(*) FILTER (a AND NOT b) AS dropped, count(*) FILTER (b AND NOT a) AS added FROM f GROUP BY 1""")
def j_pool_compare(spark, d):
    """Marked evidence against the candidate pool: kept, dropped and added texts."""
    o = table(spark, d, "sentence_items").where("raw_is_evidence AND event_id IS NOT NULL").select("event_id", T.canonical_key("text").alias("key")).where("key <> ''").distinct().withColumn("a", F.lit(True))
    p = table(spark, d, "evidence_candidates").where("event_id IS NOT NULL AND text IS NOT NULL").select("event_id", T.canonical_key("text").alias("key")).distinct().withColumn("b", F.lit(True))
    f = o.join(p, ["event_id", "key"], "full_outer").fillna(False, ["a", "b"])
    return f.groupBy("event_id").agg(F.count_if(F.expr("a AND b")).alias("both_sides"), F.count_if(F.expr("a AND NOT b")).alias("dropped"), F.count_if(F.expr("b AND NOT a")).alias("added"))


@query("SELECT sample_id, split FROM prepared_samples")
def j_shard_merge(spark, d):
    """The table dealt to four shards by key and put together again, with no key twice."""
    rows = table(spark, d, "prepared_samples").select("sample_id", "split").withColumn("shard", J.shard_of(F.col("sample_id"), 4))
    return J.merge_shards([rows.where(F.col("shard") == i).drop("shard") for i in range(4)], ["sample_id"])


@query(f"""WITH p AS (SELECT event_id, candidate_id AS i, coalesce(base_score, 0.0) AS b, coalesce(map_confidence, 0.0) AS c, coalesce(lower(map_directness), '') = 'direct' AS pos FROM ({RANKED_CAND}))
    SELECT x.event_id, x.i AS winner, y.i AS loser, round(x.b - y.b, 6) AS b, round(x.c - y.c, 6) AS c FROM p x JOIN p y ON x.event_id = y.event_id AND x.pos AND NOT y.pos""")
def j_pairwise_differences(spark, d):
    return pair_features(spark, d).select("event_id", "winner", "loser", F.round("b", 6).alias("b"), F.round("c", 6).alias("c"))


def pair_features(spark, d):
    """Differences of all an event's direct and other candidates."""
    p = table(spark, d, "evidence_candidates").where("event_id IS NOT NULL AND text IS NOT NULL").select("event_id", F.col("candidate_id").alias("i"), F.coalesce("base_score", F.lit(0.0)).alias("b"), F.coalesce("map_confidence", F.lit(0.0)).alias("c"), (F.coalesce(F.lower("map_directness"), F.lit("")) == "direct").alias("pos"))
    return J.differences(p, ["event_id"], "pos", ["b", "c"], "i")


@query("SELECT event_id, sample_id FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY sample_id) AS n FROM prepared_samples WHERE event_id IS NOT NULL) WHERE n = 1")
def j_keep_first(spark, d):
    return J.keep_first(table(spark, d, "prepared_samples").where("event_id IS NOT NULL"), ["event_id"], [F.asc("sample_id")]).select("event_id", "sample_id")


@query("SELECT report_id, arg_max(row_id, struct_pack(t := loaded_at, r := row_id)) AS row_id, arg_max(text, struct_pack(t := loaded_at, r := row_id)) AS text FROM sentence_items WHERE report_id IS NOT NULL AND sent_idx = 0 AND loaded_at IS NOT NULL AND text IS NOT NULL GROUP BY 1")
def s_latest_by_key(spark, d):
    """The last delivery of each report's first sentence."""
    rows = table(spark, d, "sentence_items").where("report_id IS NOT NULL AND sent_idx = 0 AND loaded_at IS NOT NULL AND text IS NOT NULL").select("report_id", "row_id", "text", "loaded_at")
    return J.latest(rows, ["report_id"], "loaded_at", "row_id").select("report_id", "row_id", "text")


@query("SELECT render_id FROM strategy_renders r WHERE report_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM strategy_renders x WHERE x.report_id = r.report_id AND x.strategy = r.strategy AND x.status = 'ok') AND strategy IS NOT NULL")
def s_pending_jobs(spark, d):
    """Renders of which no delivery of the same report and strategy went well."""
    rows = table(spark, d, "strategy_renders").where("report_id IS NOT NULL AND strategy IS NOT NULL")
    return J.pending(rows, rows, ["report_id", "strategy"], F.col("status") == "ok").select("render_id")


@query("SELECT event_id, rk AS rank FROM (SELECT event_id, row_number() OVER (ORDER BY md5('5|' || event_id)) AS rk FROM (SELECT DISTINCT event_id FROM claims WHERE event_id IS NOT NULL)) WHERE rk <= 100")
def s_seeded_sample(spark, d):
    """A seeded sample of a hundred claims without replacement: the first by a hash of seed and key."""
    from pyspark.sql import Window

    first = table(spark, d, "claims").where("event_id IS NOT NULL").select("event_id").distinct().withColumn("h", F.md5(F.concat_ws("|", F.lit("5"), "event_id"))).orderBy("h").limit(100)
    return first.select("event_id", F.row_number().over(Window.orderBy("h")).alias("rank"))  # over the hundred rows


@query("""SELECT e.event_id, p.label, count(*) AS rows, count(DISTINCT a.report_id) AS reports FROM (SELECT event_id, min(lower(label)) AS label FROM claims WHERE event_id IS NOT NULL GROUP BY 1) p JOIN anchors a ON a.event_id = p.event_id LEFT JOIN (SELECT DISTINCT event_id FROM evidence_candidates) e ON e.event_id = p.event_id WHERE e.event_id IS NOT NULL GROUP BY ALL""")
def s_annotation_join(spark, d):
    """Three tables joined, two inner and one left, then counted."""
    p = table(spark, d, "claims").where("event_id IS NOT NULL").groupBy("event_id").agg(F.min(F.lower("label")).alias("label"))
    e = table(spark, d, "evidence_candidates").select("event_id").distinct()
    rows = table(spark, d, "anchors").select("event_id", "report_id").join(p, "event_id").join(e, "event_id", "left_semi")
    return rows.groupBy("event_id", "label").agg(F.count("*").alias("rows"), F.count_distinct("report_id").alias("reports"))


_M3 = "round(1 / (1 + exp(-(-1.0 + 1.5 * coalesce(base_score, 0.0) + 0.8 * coalesce(map_confidence, 0.0) - 0.2 * ln(1 + length(text))))), 6)"


@query(f"SELECT event_id, candidate_id, score, rk AS rank FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY score DESC, candidate_id) AS rk FROM (SELECT event_id, candidate_id, {_M3} AS score FROM evidence_candidates WHERE event_id IS NOT NULL AND text IS NOT NULL)) WHERE rk <= 5")
def m_pointwise_scores(spark, d):
    """A linear scorer's probabilities with given weights, best five of an event."""
    z = -1.0 + 1.5 * F.coalesce("base_score", F.lit(0.0)) + 0.8 * F.coalesce("map_confidence", F.lit(0.0)) - 0.2 * F.log(1 + F.length("text"))
    rows = table(spark, d, "evidence_candidates").where("event_id IS NOT NULL AND text IS NOT NULL").select("event_id", "candidate_id", F.round(1 / (1 + F.exp(-z)), 6).alias("score"))
    return top_k(rows, ["event_id"], best_first("score", "candidate_id"), 5)


@query()
def m_pairwise_logistic(spark, d):
    """Weights of a pairwise logistic ranker, fitted by full-batch gradient steps on aggregated gradients."""
    from attestra.operators.learners import fit_pairwise

    w = fit_pairwise(pair_features(spark, d), ["b", "c"])
    return spark.createDataFrame(list(w.items()), "feature string, weight double")


@query()
def m_cross_fit(spark, d):
    """Out-of-fold scores: each event is scored by weights fitted on the other folds."""
    from attestra.operators.learners import cross_fit

    rows = table(spark, d, "evidence_candidates").where("event_id IS NOT NULL AND text IS NOT NULL").select("event_id", "candidate_id", F.coalesce("base_score", F.lit(0.0)).alias("b"), F.coalesce("map_confidence", F.lit(0.0)).alias("c"), (F.coalesce(F.lower("map_directness"), F.lit("")) == "direct").cast("double").alias("y"))
    return cross_fit(rows, "event_id", ["b", "c"], "y", 3)


@query("SELECT candidate_id, CAST((z > 0)::INT + (z - 0.4 > 0)::INT + (z - 0.8 > 0)::INT AS INT) AS level FROM (SELECT candidate_id, 4 * base_score - 2 AS z FROM evidence_candidates WHERE base_score IS NOT NULL)")
def m_coral_decode(spark, d):
    """Ordinal level from cumulative logits."""
    from attestra.functions.vectors import coral_decode

    z = 4 * F.col("base_score") - 2
    return table(spark, d, "evidence_candidates").where("base_score IS NOT NULL").select("candidate_id", coral_decode(F.array(z, z - 0.4, z - 0.8)).alias("level"))


@query()
def m_hashed_vectors(spark, d):
    """Hashed bag-of-words vectors, the offline stand-in for an encoder: 64 signed buckets, unit length."""
    from attestra.operators.learners import hashed_vectors

    return hashed_vectors(table(spark, d, "evidence_candidates").where("text IS NOT NULL"), "candidate_id", "text", 64)


_SPLIT = _split_sql("body")


@query(f"""WITH r AS (SELECT event_id, report_id, max(report_content) AS body, min(link) AS link, min(domain) AS domain FROM anchors WHERE event_id IS NOT NULL AND report_id IS NOT NULL AND report_content IS NOT NULL GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY report_id) - 1 AS report_no FROM r),
    s AS (SELECT event_id, report_no, report_id, link, domain, generate_subscripts(x, 1) - 1 AS sent_idx, unnest(x) AS text FROM (SELECT *, {_SPLIT} AS x FROM n)) SELECT * FROM s WHERE length(text) >= 10""")
def s_content_sentences(spark, d):
    """Claims with their reports nested, then scanned as sentences; short ones are dropped after numbering."""
    from attestra.sources.readers import TOKENIZED, content_sentences

    rows = table(spark, d, "anchors").where("event_id IS NOT NULL AND report_id IS NOT NULL AND report_content IS NOT NULL")
    reports = rows.groupBy("event_id", "report_id").agg(F.max("report_content").alias("content"), F.min("link").alias("link"), F.min("domain").alias("domain"))
    nested = reports.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("report_id", "link", "domain", "content", F.lit(None).cast(TOKENIZED).alias("tokenized"))), lambda a, b: F.when(a["report_id"] < b["report_id"], -1).when(a["report_id"] > b["report_id"], 1).otherwise(0)).alias("reports"))
    return content_sentences(nested)
