"""Claim collections as DataFrames: ``event_id, claim, label, explain, reports, metadata``.

Each reader states its schema, so nothing is inferred by a second pass, and keeps unknown labels as an error at the row that
has them. ``read_claims`` picks the reader by the collection's kind.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.functions.text import clean_text, split_sentences

TOKENIZED = "array<struct<sent:string,sentence:string,text:string,is_evidence:string>>"
REPORT = f"report_id:string,link:string,domain:string,content:string,tokenized:{TOKENIZED}"
# Numeric labels of evidence-list claims, and the labels of report claims.
NUMERIC = {"1": "false", "3": "half", "5": "true"}
SIX = ("pants-fire", "false", "barely-true", "half-true", "mostly-true", "true")
LEAST_CHARS = 10


def checked(label: Column, allowed: tuple[str, ...]) -> Column:
    """The label, or an error naming it; null stays null."""
    return F.when(label.isNull() | label.isin(*allowed), label).otherwise(F.raise_error(F.concat(F.lit("unknown label "), label)))


def _map(**values: Column) -> Column:
    pairs = F.array(*(F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in values.items())).cast("array<struct<key:string,value:string>>")
    return F.map_from_entries(F.filter(pairs, lambda e: e["value"].isNotNull()))


def report_claims(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of claims with their reports."""
    schema = f"event_id string, claim string, label string, explain string, reports array<struct<{REPORT}>>"
    rows = spark.read.schema(schema).json(path, multiLine=True)
    return rows.select("event_id", clean_text("claim").alias("claim"), checked(F.lower(F.trim("label")), SIX).alias("label"), clean_text("explain").alias("explain"), F.coalesce("reports", F.array().cast(f"array<struct<{REPORT}>>")).alias("reports"), _map().alias("metadata"))


def evidence_claims(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of claims with evidence strings; each non-empty one is a report named by its place in the list."""
    rows = spark.read.schema("id string, claim string, label string, explanation string, evidence array<string>").json(path, multiLine=True)
    numbered = F.transform(F.coalesce("evidence", F.array().cast("array<string>")), lambda e, i: F.struct(i.cast("string").alias("report_id"), F.lit(None).cast("string").alias("link"), F.lit(None).cast("string").alias("domain"), e.alias("content"), F.lit(None).cast(TOKENIZED).alias("tokenized")))
    label = F.create_map(*(F.lit(x) for kv in NUMERIC.items() for x in kv))
    named = F.coalesce(F.try_element_at(label, F.trim("label")), F.lower(F.trim("label")))
    return rows.select(F.col("id").alias("event_id"), clean_text("claim").alias("claim"), checked(named, ("false", "half", "true")).alias("label"), clean_text("explanation").alias("explain"), F.filter(numbered, lambda r: F.trim(r["content"]) != "").alias("reports"), _map().alias("metadata"))


def multihop_claims(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of claims with supporting facts in other documents, kept in the metadata."""
    rows = spark.read.schema("uid string, claim string, label string, supporting_facts array<struct<title:string,sent:int>>, num_hops int, hpqa_id string").json(path, multiLine=True)
    label = F.regexp_replace(F.lower(F.trim("label")), "[ -]", "_")
    return rows.select(F.col("uid").alias("event_id"), clean_text("claim").alias("claim"), checked(label, ("supported", "not_supported")).alias("label"), F.lit(None).cast("string").alias("explain"), F.array().cast(f"array<struct<{REPORT}>>").alias("reports"), _map(num_hops=F.col("num_hops"), hpqa_id=F.col("hpqa_id"), supporting_facts=F.to_json("supporting_facts")).alias("metadata"))


def rationale_claims(spark: SparkSession, path: str, three_classes: bool = False, unlabelled: bool = False) -> DataFrame:
    """JSON lines of claims with rationales by cited document. The first label counts; ``conflict`` tells if others differ.

    A claim without rationales is ``nei`` with three classes, else has the empty label; unlabelled sets have none at all.
    """
    rows = spark.read.schema("id string, claim string, evidence map<string,array<struct<label:string,sentences:array<int>>>>, cited_doc_ids array<string>").json(path)
    labels = F.transform(F.flatten(F.map_values("evidence")), lambda e: F.lower(e["label"]))
    first = F.coalesce(F.when(F.size("evidence") > 0, F.get(labels, 0)), F.lit("nei" if three_classes else ""))
    label = F.lit("") if unlabelled else first
    return rows.select(F.col("id").alias("event_id"), clean_text("claim").alias("claim"), checked(label, ("support", "contradict", "nei", "")).alias("label"), F.lit(None).cast("string").alias("explain"), F.array().cast(f"array<struct<{REPORT}>>").alias("reports"), _map(conflict=F.size(F.array_distinct(F.coalesce(labels, F.array().cast("array<string>")))) > 1, evidence=F.to_json("evidence"), cited=F.to_json("cited_doc_ids")).alias("metadata"))


def abstracts(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of abstracts, one row per non-empty sentence: ``doc_id, title, sent_idx, text``."""
    rows = spark.read.schema("doc_id string, title string, abstract array<string>, structured boolean").json(path)
    return rows.select("doc_id", "title", F.posexplode("abstract").alias("sent_idx", "text")).where(F.trim("text") != "")


def pages(spark: SparkSession, path: str) -> DataFrame:
    """Page dumps as JSON lines, plain or compressed (by suffix): ``title, sent_idx, text``; text may be a string or a list of strings."""
    raw = spark.read.schema("title string, id string, text string").json(path)
    listed = F.from_json("text", "array<string>")
    return raw.select("title", F.posexplode(F.coalesce(listed, split_sentences("text"))).alias("sent_idx", "text")).where(F.trim("text") != "")


READERS: dict[str, Callable[..., DataFrame]] = {"reports": report_claims, "evidence": evidence_claims, "multihop": multihop_claims, "rationales": rationale_claims}


def read_claims(spark: SparkSession, path: str, kind: str, **options) -> DataFrame:
    if kind not in READERS:
        raise ValueError(f"unknown kind {kind!r}; known: {', '.join(sorted(READERS))}")
    return READERS[kind](spark, path, **options)


def content_sentences(claims: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """``event_id, report_no, report_id, sent_idx, text, link, domain`` split from the reports' content.

    Short sentences are dropped after numbering, so the numbers have gaps.
    """
    r = claims.select("event_id", F.posexplode("reports").alias("report_no", "r"))
    s = r.select("event_id", "report_no", "r.report_id", F.posexplode(split_sentences("r.content")).alias("sent_idx", "text"), "r.link", "r.domain")
    return s.where(F.length("text") >= least)


def truth(value: Column) -> Column:
    """``true``, ``1`` or ``yes`` in any case; other values are false, null stays null."""
    return F.lower(F.trim(value)).isin("true", "1", "yes", "1.0")


def tokenized_sentences(claims: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """The same from sentences that come split, with ``is_evidence``; the first of three fields with text is read."""
    r = claims.select("event_id", F.posexplode("reports").alias("report_no", "r"))
    s = r.select("event_id", "report_no", "r.report_id", F.posexplode("r.tokenized").alias("sent_idx", "t"), "r.link", "r.domain")
    text = clean_text(F.coalesce(*(F.when(F.trim(f"t.{c}") != "", F.col(f"t.{c}")) for c in ("sent", "sentence", "text"))))
    return s.select("event_id", "report_no", "report_id", "sent_idx", text.alias("text"), truth(F.col("t.is_evidence")).alias("is_evidence"), "link", "domain").where(F.length("text") >= least)


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines are no rows."""
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", "true").csv(path)


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """Parquet by the committer's atomic rename; with ``by`` rows are gathered per directory first, so files stay few."""
    out = df.repartition(*by) if by else df
    writer = out.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def append_results(done: DataFrame, new: DataFrame, on: list[str], path: str) -> DataFrame:
    """Rows of ``new`` that have no result yet are appended to ``path``; what was appended is returned."""
    todo = new.join(done.select(*on).distinct(), on, "left_anti")
    todo.write.mode("append").parquet(path)
    return todo
