"""Queries of the text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestra.functions import text as T
from attestra.plans.common import CLAIMS_SQL, CLEAN, CONTENT, KEY, SENTENCES_SQL, TOKENS, WORDS, claims, sentences
from attestra.registry import query, table

# The labels of each schema, least to most true.
SCHEMAS = {
    "liar6": ["pants-fire", "false", "barely-true", "half-true", "mostly-true", "true"],
    "rawfc3": ["false", "half", "true"],
    "hover2": ["supported", "not_supported"],
    "scifact2": ["support", "contradict"],
    "scifact3": ["support", "contradict", "nei"],
}


@query(f"SELECT doc_id, {CLEAN.format('text')} AS clean FROM documents")
def t_clean_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.clean_text("text").alias("clean"))


def _split_sql(text: str) -> str:
    body = CLEAN.format(text)
    for a in T.ABBREVIATIONS:
        parts = [p for p in a.split(".") if p]
        body = f"regexp_replace({body}, '(?i){''.join(f'({p})\\.' for p in parts)}', concat({', '.join(f"'\\{i}', chr(1)" for i in range(1, len(parts) + 1))}), 'g')"
    cut = f"""regexp_replace({body}, '([.!?])\\s+(["''(\\[]*[A-Z0-9])', concat('\\1', chr(2), '\\2'), 'g')"""
    return f"list_filter(list_transform(string_split({cut}, chr(2)), lambda x: trim(replace(x, chr(1), '.'))), lambda x: x <> '')"


@query(f"SELECT doc_id, unnest({_split_sql('text')}) AS sentence FROM documents")
def t_sentence_split(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(T.split_sentences("text")).alias("sentence"))


@query(f"SELECT doc_id, array_to_string({WORDS.format('text')}, ' ') AS words FROM documents WHERE text IS NOT NULL")
def t_word_tokens(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.array_join(T.word_tokens("text"), " ").alias("words"))


@query(f"SELECT row_id, array_to_string({CONTENT.format('text')}, ' ') AS content FROM sentence_items WHERE text IS NOT NULL")
def t_content_tokens(spark, d):
    return table(spark, d, "sentence_items").where("text IS NOT NULL").select("row_id", F.array_join(T.content_tokens("text"), " ").alias("content"))


@query(f"SELECT row_id, t AS term, count(*) AS tf FROM (SELECT row_id, unnest({CONTENT.format('text')}) AS t FROM sentence_items WHERE text IS NOT NULL) GROUP BY row_id, t")
def t_token_counts(spark, d):
    rows = table(spark, d, "sentence_items").select("row_id", F.explode(T.content_tokens("text")).alias("term"))
    return rows.groupBy("row_id", "term").agg(F.count("*").alias("tf"))


@query(f"""WITH c AS ({CLAIMS_SQL}), p AS ({SENTENCES_SQL}) SELECT event_id, cand, round(CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 1.0
    ELSE len(list_intersect(list_distinct(a), list_distinct(b))) * 1.0 / len(list_distinct(list_concat(a, b))) END, 6) AS jaccard
    FROM (SELECT event_id, cand, {WORDS.format("claim")} AS a, {WORDS.format("text")} AS b FROM p JOIN c USING (event_id))""")
def t_token_jaccard(spark, d):
    both = sentences(spark, d).join(claims(spark, d), "event_id")
    return both.select("event_id", "cand", F.round(T.jaccard(T.word_tokens("claim"), T.word_tokens("text")), 6).alias("jaccard"))


@query(f"SELECT doc_id, round(n / (1.0 + abs(n)), 6) AS squashed FROM (SELECT doc_id, n_chars / 1000.0 AS n FROM documents)")
def t_squash(spark, d):
    x = F.col("n_chars") / 1000.0
    return table(spark, d, "documents").select("doc_id", F.round(x / (1 + F.abs(x)), 6).alias("squashed"))


@query(f"SELECT event_id, {KEY.format('text')} AS key, count(*) AS n, min(row_id) AS first_row FROM sentence_items WHERE {KEY.format('text')} <> '' GROUP BY 1, 2")
def t_canonical_dedupe(spark, d):
    rows = table(spark, d, "sentence_items").select("event_id", "row_id", T.canonical_key("text").alias("key")).where("key <> ''")
    return rows.groupBy("event_id", "key").agg(F.count("*").alias("n"), F.min("row_id").alias("first_row"))


# RE2 takes accented letters for word ends; a low line in their place gives the word ends of the Unicode rules.
ASCII_CLAIM = r"regexp_replace(lower(claim), '[^\x00-\x7F]', '_', 'g')"


def _in(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _hits(pattern: str, text: str) -> str:
    return f"len(regexp_extract_all({text}, '{pattern.replace(chr(39), chr(39) * 2)}'))"


@query(f"""SELECT event_id, len(w) AS num_tokens, len(list_filter(w, lambda x: x IN ({_in(T.CLAUSE_WORDS)}))) AS connectors, len(list_filter(w, lambda x: x IN ({_in(T.TIME_WORDS)}))) AS times,
    len(list_filter(w, lambda x: x IN ({_in(T.COMPARISON_WORDS)}))) AS comparisons, {_hits("[0-9]", "claim")} AS digits, {_hits("[,;:()]", "claim")} AS marks,
    contains(claim, '%')::INT AS has_percent, contains(claim, '$')::INT AS has_money FROM (SELECT event_id, claim, {WORDS.format("claim")} AS w FROM ({CLAIMS_SQL}))""")
def t_complexity_signals(spark, d):
    return claims(spark, d).select("event_id", *(c.alias(k) for k, c in T.complexity_signals("claim").items()))


@query(f"""SELECT event_id, len({CONTENT.format("claim")}) AS claim_tokens, len(w) AS claim_words, len(list_filter(w, lambda x: regexp_matches(x, '^[A-Z]'))) AS capitalised,
    {_hits(T.NUMBER, "claim")} AS numbers, {_hits(T.SURFACE["time_count"], ASCII_CLAIM)} AS time_count,
    {", ".join(f"regexp_matches({'lower(claim)' if k in ('quote', 'percent') else ASCII_CLAIM}, '{T.SURFACE[k].replace(chr(39), chr(39) * 2)}')::INT AS {k}" for k in ("negation", "comparison", "superlative", "percent", "quote"))}
    FROM (SELECT event_id, claim, list_filter(regexp_split_to_array(claim, '\\s+'), lambda x: x <> '') AS w FROM ({CLAIMS_SQL}))""")
def t_claim_surface(spark, d):
    return claims(spark, d).select("event_id", *(c.alias(k) for k, c in T.claim_surface("claim").items()))


@query(f"""WITH c AS ({CLAIMS_SQL}), f AS (SELECT candidate_id, trim(text) AS text, claim, {TOKENS.format("trim(text)")} AS w FROM evidence_candidates JOIN c USING (event_id) WHERE text IS NOT NULL),
    g AS (SELECT candidate_id, len(w) BETWEEN 6 AND 96 AND length(text) >= 32 AS length_ok, len(list_filter(w, lambda x: x IN ({_in(T.PREDICATE_WORDS)}) OR regexp_matches(x, '(ed|ing)$'))) > 0 AS has_predicate,
    regexp_matches(text, '[.?!"'']$') OR len(w) >= 10 AS boundary_ok, len({CONTENT.format("text")}) >= 4 AND NOT ({" OR ".join(f"regexp_matches(text, '{p}')" for p in T.FRAGMENTS)}) AS sound,
    list_has_any({CONTENT.format("text")}, {CONTENT.format("claim")}) AS overlap FROM f)
    SELECT candidate_id, length_ok, has_predicate, boundary_ok, length_ok AND sound AS not_fragment, overlap,
    round(0.25::DOUBLE * length_ok::INT + 0.2 * has_predicate::INT + 0.15 * boundary_ok::INT + 0.15 * (length_ok AND sound)::INT + 0.25 * overlap::INT, 6) AS completeness FROM g""")
def t_fragment_flags(spark, d):
    rows = table(spark, d, "evidence_candidates").where("text IS NOT NULL").join(claims(spark, d), "event_id")
    flagged = rows.select("candidate_id", *(c.alias(k) for k, c in T.fragment_flags("text", "claim").items()))
    return flagged.withColumn("completeness", F.round(T.completeness({k: F.col(k) for k in flagged.columns[1:]}), 6))


HOST = r"lower(trim(regexp_extract(coalesce(nullif(domain, ''), nullif(link, ''), ''), '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#]*)', 1)))"


@query(f"""SELECT row_id, host, CASE WHEN report_id <> '' THEN 'report:' || report_id WHEN host <> '' THEN 'domain:' || host ELSE 'candidate:' || row_id END AS grp
    FROM (SELECT row_id, report_id, {HOST} AS host FROM sentence_items)""")
def t_source_domain(spark, d):
    rows = table(spark, d, "sentence_items").select("row_id", "report_id", T.source_domain(F.col("domain"), F.col("link")).alias("host"))
    return rows.select("row_id", "host", T.source_group(F.lit(None).cast("string"), F.col("report_id"), F.col("host"), F.col("row_id").cast("string")).alias("grp"))


@query("SELECT row_id, substr(sha1(concat_ws('|', event_id, text)), 1, 12) AS uid FROM sentence_items")
def t_stable_uid(spark, d):
    return table(spark, d, "sentence_items").select("row_id", T.stable_uid(F.col("event_id"), F.col("text")).alias("uid"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS fingerprint FROM documents")
def t_fingerprint(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("fingerprint"))


def _label_sql(labels: list[str], text: str) -> str:
    letters = "".join(chr(65 + i) for i in range(len(labels)))
    ranked = sorted(labels, key=len, reverse=True)

    def named(where: str) -> str:
        whens = " ".join(f"WHEN regexp_matches({where}, '\\b{x.replace('-', '[-_ ]')}\\b') THEN {labels.index(x)}" for x in ranked)
        return f"CASE {whens} END"

    def letter(p: str) -> str:
        return f"CASE WHEN regexp_extract({text}, '{p}', 1) <> '' THEN ascii(upper(regexp_extract({text}, '{p}', 1))) - 65 END"

    line = f"lower(regexp_extract({text}, '(?mi)^\\s*label\\s*:\\s*([^\\n\\r]+)', 1))"
    return f"coalesce({letter(f'(?mi)^\\s*label\\s*:\\s*([{letters}])\\b')}, {letter(f'(?is)^\\s*([{letters}])\\s*$')}, {named(line)}, {named(f'lower({text})')}, -1)"


@query(" UNION ALL ".join(f"SELECT sample_id, {_label_sql(v, 'coalesce(target, {0})'.format(chr(39) * 2))} AS label_id FROM prepared_samples WHERE label_schema = '{k}'" for k, v in SCHEMAS.items()))
def t_label_parse(spark, d):
    rows = table(spark, d, "prepared_samples")
    out = F.lit(None).cast("int")
    for k, v in SCHEMAS.items():
        out = F.when(F.col("label_schema") == k, T.parse_label("target", v)).otherwise(out)
    return rows.where(F.col("label_schema").isin(*SCHEMAS)).select("sample_id", out.alias("label_id"))


def _numbers_sql(text: str) -> str:
    return f"list_distinct(regexp_extract_all({text}, '\\d+(?:[,.]\\d+)*'))"


@query(f"""WITH c AS ({CLAIMS_SQL}), x AS (SELECT candidate_id, list_distinct({CONTENT.format("claim")}) AS cw, {CONTENT.format("text")} AS tw, {_numbers_sql("claim")} AS cn, {_numbers_sql("text")} AS tn
    FROM evidence_candidates JOIN c USING (event_id) WHERE text IS NOT NULL)
    SELECT candidate_id, round(CASE WHEN len(cw) = 0 THEN 0.0 ELSE len(list_filter(cw, lambda w: list_contains(tw, w))) * 1.0 / len(cw) END, 6) AS content_coverage,
    round(CASE WHEN len(cn) = 0 THEN 1.0 ELSE len(list_filter(cn, lambda w: list_contains(tn, w))) * 1.0 / len(cn) END, 6) AS number_coverage FROM x""")
def t_coverage(spark, d):
    rows = table(spark, d, "evidence_candidates").where("text IS NOT NULL").join(claims(spark, d), "event_id")
    numbers = lambda c: F.regexp_extract_all(c, F.lit(f"({T.NUMBER})"), F.lit(1))
    return rows.select(
        "candidate_id",
        F.round(T.coverage(F.array_distinct(T.content_tokens("claim")), T.content_tokens("text"), 0.0), 6).alias("content_coverage"),
        F.round(T.coverage(F.array_distinct(numbers(F.col("claim"))), numbers(F.col("text")), 1.0), 6).alias("number_coverage"),
    )


@query(r"""SELECT event_id, unnest(list_transform(regexp_extract_all(claim, '[$€£]?\d[\d,]*(?:\.\d+)?%?'), lambda x: regexp_replace(regexp_replace(lower(trim(x)), '[$€£,%\s]', '', 'g'), '\.0+$', ''))) AS number
    FROM (""" + CLAIMS_SQL + ")")
def t_normalize_number(spark, d):
    raw = F.regexp_extract_all("claim", F.lit(r"([$€£]?\d[\d,]*(?:\.\d+)?%?)"), F.lit(1))
    return claims(spark, d).select("event_id", F.explode(F.transform(raw, T.normalize_number)).alias("number"))


@query("""SELECT event_id, string_agg('[' || (rk) || '] ' || text, chr(10) ORDER BY rk) AS block FROM (SELECT event_id, text, row_number() OVER (PARTITION BY event_id ORDER BY base_score DESC NULLS LAST, candidate_id) AS rk
    FROM evidence_candidates WHERE text IS NOT NULL AND event_id IS NOT NULL) WHERE rk <= 5 GROUP BY event_id""")
def t_prompt_render(spark, d):
    from attestra.operators.ranking import top_k

    best = top_k(table(spark, d, "evidence_candidates").where("text IS NOT NULL AND event_id IS NOT NULL"), ["event_id"], [F.desc_nulls_last("base_score"), F.asc("candidate_id")], 5)
    ordered = best.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("r"))
    return ordered.select("event_id", T.evidence_block(F.transform("r", lambda x: x["text"])).alias("block"))


@query(r"""SELECT sample_id, len(regexp_extract_all(prompt, '(?m)^\[\d+\] [^\n]*')) AS evidence FROM prepared_samples WHERE prompt IS NOT NULL""")
def t_prompt_parse(spark, d):
    return table(spark, d, "prepared_samples").where("prompt IS NOT NULL").select("sample_id", F.size(T.parse_evidence_block("prompt")).alias("evidence"))
