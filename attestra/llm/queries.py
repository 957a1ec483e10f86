"""Queries of the training-data operators over the project's tables, and their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm import boilerplate, glyphs, leakage, neardup, overlap, packing, sentences, splitting
from attestra.llm.runtime import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.report_sentences(table(spark, d, "anchors")).select("report_id", "char_start", "char_end")


def p1_units(spark: SparkSession, d: str) -> DataFrame:
    return sentences.report_sentences(table(spark, d, "anchors"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.similar_pairs(table(spark, d, "evidence_candidates"))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.groups(table(spark, d, "evidence_candidates"))


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.pieces(splitting.oversized(table(spark, d, "anchors"), table(spark, d, "strategy_renders")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_pieces(spark, d).where("piece_idx = 0").select("origin", "item_key")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.repeated_rows(table(spark, d, "sentence_items"), table(spark, d, "anchors"))


def p4_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "sentence_items")
    return boilerplate.line_list(rows, boilerplate.repeated_lines(rows))


def p4_sentences(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "sentence_items")
    left = boilerplate.strip_sentences(rows, boilerplate.boilerplate_lines(rows))
    return left.withColumns({c: F.unix_micros(F.col(c).cast("timestamp")) for c in ("fetched_at", "loaded_at")})


def p4_reports(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.strip_reports(table(spark, d, "anchors"), boilerplate.boilerplate_lines(table(spark, d, "sentence_items")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.found(table(spark, d, "prepared_samples"))


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.report(table(spark, d, "prepared_samples"))


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(packing.pack(table(spark, d, "documents"))).withColumn("share", F.round("share", 6))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_leaks(spark, d).select("doc_id", "item_id")


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "heldout_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return glyphs.same_look_pairs(table(spark, d, "documents"))


def p8_forms(spark: SparkSession, d: str) -> DataFrame:
    return glyphs.fold_column(table(spark, d, "documents"), "doc_id", "text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (p1_found, p1_units, p2_found, p2_groups, p3_found, p3_pieces, p4_found, p4_lines, p4_sentences, p4_reports)
    return {f.__name__: f for f in (*found, p5_found, p5_report, p6_containers, p6_fill, p7_found, p7_leaks, p8_found, p8_forms)}


WORDS = r"list_distinct(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+'))"
LINE = r"regexp_replace(trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), '\p{{Nd}}+', '0', 'g')"
DOMAIN = r"regexp_replace(lower(trim(domain)), '^www\.', '')"


def _similar(rows: str, t: float, where: str) -> str:
    """Pairs by shared words, from ``rows(id, side, words)``."""
    return f"""
    WITH r AS (SELECT * FROM ({rows}) q WHERE len(words) > 0),
    w AS (SELECT id, side, len(words) AS n, unnest(words) AS w FROM r)
    SELECT x.id AS i, y.id AS j FROM w x JOIN w y ON x.w = y.w AND x.id < y.id AND {where}
    GROUP BY x.id, y.id, x.n, y.n HAVING count(*) >= {t} * (x.n + y.n - count(*)) - 1e-9"""


def oracle_sql() -> dict[str, str]:
    lines = f"""
    SELECT dom, line, count(DISTINCT report_id) AS n_reports, count(DISTINCT CAST(fetched_at AS DATE)) AS n_days
    FROM (SELECT report_id, fetched_at, {DOMAIN} AS dom, {LINE.format("text")} AS line FROM sentence_items)
    WHERE dom IS NOT NULL AND line <> '' AND report_id IS NOT NULL GROUP BY dom, line HAVING count(DISTINCT report_id) >= 6"""
    sides = r"""
    SELECT sample_id AS id, lower(trim(split)) = 'train' AS side, regexp_replace(lower(trim(event_id)), '\.json$', '') AS event, claim
    FROM prepared_samples WHERE split IS NOT NULL"""
    return {
        "p2_found": f"SELECT i AS candidate_id_a, j AS candidate_id_b FROM ({_similar(f'SELECT candidate_id AS id, true AS side, {WORDS.format("text")} AS words FROM evidence_candidates', 0.7, 'true')})",
        "p3_found": "SELECT DISTINCT 'report' AS origin, report_id AS item_key FROM anchors WHERE length(report_content) > 1500 UNION ALL SELECT 'render', CAST(render_id AS VARCHAR) FROM strategy_renders WHERE length(text) > 1500",
        "p4_found": f"""
    WITH rep AS ({lines})
    SELECT 'sentence_items' AS origin, row_id FROM (SELECT row_id, {DOMAIN} AS dom, {LINE.format("text")} AS line FROM sentence_items) JOIN rep USING (dom, line)
    UNION ALL SELECT 'anchors', anchor_id FROM (SELECT anchor_id, {DOMAIN} AS dom, {LINE.format("source_sentence")} AS line FROM anchors) JOIN rep USING (dom, line)""",
        "p4_sentences": f"""
    WITH o AS (SELECT DISTINCT report_id, {DOMAIN} AS dom, {LINE.format("text")} AS line FROM sentence_items), u AS (SELECT * FROM o WHERE dom IS NOT NULL AND line <> '' AND report_id IS NOT NULL),
    g AS (SELECT dom, report_id, md5(string_agg(line, chr(10) ORDER BY line)) AS same FROM u GROUP BY 1, 2), rep AS (SELECT dom, line FROM u JOIN g USING (dom, report_id) GROUP BY 1, 2 HAVING count(DISTINCT same) >= 6)
    SELECT s.* REPLACE (epoch_us(fetched_at) AS fetched_at, epoch_us(loaded_at) AS loaded_at) FROM sentence_items s WHERE NOT EXISTS (SELECT 1 FROM rep WHERE rep.dom = {DOMAIN.replace("domain", "s.domain")} AND rep.line = {LINE.format("s.text")})""",
        "p5_found": f"""
    WITH s AS ({sides}), alike AS ({_similar(f'SELECT id, side, {WORDS.format("claim")} AS words FROM s', 0.75, 'x.side <> y.side')})
    SELECT i AS sample_id_a, j AS sample_id_b FROM alike
    UNION SELECT least(x.id, y.id), greatest(x.id, y.id) FROM s x JOIN s y ON x.event = y.event AND x.side AND NOT y.side""",
    }
