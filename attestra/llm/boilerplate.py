"""Problem 4: lines repeated across one domain's reports.

Reports with the same lines are collapsed into one cluster first, so a republished article brings each of its lines to the
count once, with the number of reports it stands for. Each line of a domain is then counted over clusters, reports and
publication dates. A line is repeated if it stands in at least ``min_reports`` different reports; ``n_clusters`` and
``n_dates`` tell boilerplate from a text republished often, and ``min_clusters`` / ``min_dates`` ask for them where wanted:
``repeated_lines`` counts reports, as the statement of the problem does, ``boilerplate_lines`` clusters, and these are what is
removed, so that the lines of an article that was republished stay.

Domains are compared trimmed, lower-cased and without a leading ``www.``; a null domain has no lines. Two lines are equal if
their words, joined by single spaces and with each run of digits as ``0``, are equal; texts without a word are no lines.
Rows with a null report do not count, as they name no report, but are cases where their line is repeated. Re-delivered rows
count once. Line keys are compared by two independent 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_REPORTS = 6


def domain_key(domain: str) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.col(domain))), r"^www\.", "")


def line_key(text: str | Column) -> Column:
    """Words joined by single spaces, each run of digits replaced by ``0``."""
    low = F.lower(F.col(text) if isinstance(text, str) else text)
    return F.regexp_replace(F.trim(F.regexp_replace(low, r"[^\p{L}\p{N}]+", " ")), r"\p{Nd}+", "0")


def keyed(df: DataFrame, domain: str, text: str, *keep: str) -> DataFrame:
    """``dom, h1, h2`` and the kept columns; rows without a domain or a word are left out."""
    out = df.select(*keep, domain_key(domain).alias("dom"), line_key(text).alias("line")).where("dom IS NOT NULL AND line <> ''")
    return out.select(*keep, "dom", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def line_counts(sentences: DataFrame, domain: str = "domain", text: str = "text", report: str = "report_id", date: str = "fetched_at") -> DataFrame:
    """``dom, h1, h2, n_reports, n_clusters, n_dates`` of every line.

    The distinct occurrences are spread by line and report, so one hot domain, report or line is many small groups, each
    pre-aggregated before it is shuffled.
    """
    when = F.to_date(F.col(date)) if date in sentences.columns else F.lit(None).cast("date")
    rows = sentences.select(F.col(domain), F.col(text), F.col(report).alias("report"), when.alias("day"))
    occurrence = keyed(rows, domain, text, "report", "day").where("report IS NOT NULL").groupBy("dom", "report", "h1", "h2").agg(F.min("day").alias("day"))
    reports = occurrence.groupBy("dom", "report").agg(F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2"), F.count("*").alias("n"), F.min("day").alias("day"))
    clusters = reports.groupBy("dom", "x1", "x2", "n").agg(F.min("report").alias("report"), F.count("*").alias("weight"), F.collect_set("day").alias("days"))
    lines = occurrence.select("dom", "report", "h1", "h2").join(clusters.select("dom", "report", "weight", "days"), ["dom", "report"])
    # Distinct dates of a line: its occurrences by date first, so that the second count has at most one row per date.
    dated = lines.select("dom", "h1", "h2", "weight", F.explode_outer("days").alias("day"), F.size("days").alias("k"), F.element_at(F.when(F.size("days") > 0, F.col("days")), 1).alias("head"))
    once = F.when(F.col("day").eqNullSafe(F.col("head")), 1).otherwise(0)
    by_day = dated.groupBy("dom", "h1", "h2", "day").agg(F.sum(once * F.col("weight")).alias("n_reports"), F.sum(once).alias("n_clusters"))
    return by_day.groupBy("dom", "h1", "h2").agg(F.sum("n_reports").alias("n_reports"), F.sum("n_clusters").alias("n_clusters"), F.count("day").alias("n_dates"))


def repeated_lines(sentences: DataFrame, min_reports: int = MIN_REPORTS, min_clusters: int = 1, min_dates: int = 0, **columns: str) -> DataFrame:
    """``dom, h1, h2`` and counts of the repeated lines."""
    return line_counts(sentences, **columns).where((F.col("n_reports") >= min_reports) & (F.col("n_clusters") >= min_clusters) & (F.col("n_dates") >= min_dates))


def boilerplate_lines(sentences: DataFrame, least: int = MIN_REPORTS, **columns: str) -> DataFrame:
    """The lines to be removed: those in at least ``least`` clusters of different reports."""
    return repeated_lines(sentences, least, least, **columns)


def in_lines(df: DataFrame, lines: DataFrame, row_id: str, domain: str, text: str) -> DataFrame:
    """Ids of the rows whose text is one of the lines of their domain."""
    return keyed(df, domain, text, row_id).join(lines.select("dom", "h1", "h2"), ["dom", "h1", "h2"], "left_semi").select(row_id)


def repeated_rows(sentences: DataFrame, anchors: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """``origin, row_id``: rows of ``sentences.text`` and ``anchors.source_sentence`` that are repeated lines of their domain."""
    lines = repeated_lines(sentences) if lines is None else lines
    both = sentences.select(F.lit("sentence_items").alias("origin"), F.col("row_id"), "domain", "text").unionByName(
        anchors.select(F.lit("anchors").alias("origin"), F.col("anchor_id").alias("row_id"), "domain", F.col("source_sentence").alias("text"))
    )
    return keyed(both, "domain", "text", "origin", "row_id").join(lines.select("dom", "h1", "h2"), ["dom", "h1", "h2"], "left_semi").select("origin", "row_id")


def line_list(sentences: DataFrame, lines: DataFrame) -> DataFrame:
    """``domain, line, n_reports, n_clusters, n_dates``: the repeated lines of each domain as words."""
    text = sentences.select(domain_key("domain").alias("dom"), line_key("text").alias("line")).where("dom IS NOT NULL AND line <> ''")
    text = text.select("dom", "line", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))
    hit = text.join(lines, ["dom", "h1", "h2"]).groupBy("dom", "line").agg(F.first("n_reports").alias("n_reports"), F.first("n_clusters").alias("n_clusters"), F.first("n_dates").alias("n_dates"))
    return hit.withColumnRenamed("dom", "domain")


def strip_sentences(sentences: DataFrame, lines: DataFrame) -> DataFrame:
    """The rows of ``sentences`` that are no repeated line of their domain, with all their columns."""
    mine = sentences.withColumns({"__dom": domain_key("domain"), "__line": line_key("text")}).withColumns({"__h1": F.xxhash64("__line"), "__h2": F.xxhash64(F.lit(1), "__line")})
    gone = lines.select(F.col("dom").alias("__dom"), F.col("h1").alias("__h1"), F.col("h2").alias("__h2"))
    return mine.join(gone, ["__dom", "__h1", "__h2"], "left_anti").select(*sentences.columns)


def strip_reports(anchors: DataFrame, lines: DataFrame, id_col: str = "anchor_id", text: str = "report_content") -> DataFrame:
    """``anchor_id, source_sentence, report_content`` with repeated lines gone.

    Each block set off by blank lines is held against the list as one line, so that a hard-wrapped notice goes, and each line
    between line breaks within the blocks that stay. A null text stays null, a ``source_sentence`` that is a repeated line
    becomes null. Rows without an id are given back as they are. Only keys are shuffled with the list, a text once with its hits.
    """
    base = anchors.select(F.col(id_col).alias("id"), domain_key("domain").alias("dom"), "source_sentence", F.col(text).alias("body")).withColumn("blocks", F.split("body", r"\n[ \t\r]*\n"))
    parts = F.flatten(F.transform("blocks", lambda b, i: F.concat(F.array(F.struct(i.alias("pos"), F.lit(-1).alias("at"), b.alias("piece"))), _lines(b, i))))
    sentence = F.array(F.struct(F.lit(-1).alias("pos"), F.lit(-1).alias("at"), F.col("source_sentence").alias("piece")))
    pieces = base.where("id IS NOT NULL AND dom IS NOT NULL").select("id", "dom", F.explode(F.concat(sentence, F.coalesce(parts, F.array().cast(PIECES)))).alias("p"))
    keys = pieces.select("id", "dom", "p.pos", "p.at", line_key("p.piece").alias("line")).where("line <> ''")
    keys = keys.select("id", "dom", "pos", "at", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))
    hits = keys.join(lines.select("dom", "h1", "h2"), ["dom", "h1", "h2"], "left_semi").groupBy("id").agg(F.collect_set(F.struct("pos", "at")).alias("hits"))
    known = lambda pos, at: F.array_contains("hits", F.struct(pos.cast("int").alias("pos"), at.cast("int").alias("at")))

    def kept(b: Column, i: Column) -> Column:
        left = F.filter(F.split(b, "\n"), lambda l, j: ~known(i, j))
        return F.when(known(i, F.lit(-1)) | (F.size(left) == 0), None).when(F.instr(b, "\n") > 0, F.array_join(left, "\n")).otherwise(b)

    both = base.join(hits, "id", "left")
    body = F.array_join(F.filter(F.transform("blocks", kept), lambda b: b.isNotNull()), "\n\n")
    return both.select(
        F.col("id").alias(id_col),
        F.when(F.col("hits").isNotNull() & known(F.lit(-1), F.lit(-1)), None).otherwise(F.col("source_sentence")).alias("source_sentence"),
        F.when(F.col("hits").isNull(), F.array_join("blocks", "\n\n")).otherwise(body).alias(text),
    )


PIECES = "array<struct<pos:int,at:int,piece:string>>"


def _lines(block: Column, i: Column) -> Column:
    """The lines of a block of several, with their places."""
    lines = F.transform(F.split(block, "\n"), lambda l, j: F.struct(i.alias("pos"), j.alias("at"), l.alias("piece")))
    return F.when(F.instr(block, "\n") > 0, lines).otherwise(F.array().cast(PIECES))
