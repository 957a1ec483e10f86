"""Text column functions: cleaning, splitting, tokens, similarity, surface signals, keys, label parsing.

All are expressions of built-in functions; nulls give nulls unless stated.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stop words left out of content tokens.
STOP_WORDS = (
    "a an the and or to of on in for by with is are was were be been being that this it as at from will would could should can may might do "
    "does did have has had not but if than then into their there about literally"
).split()
# Abbreviations whose full stops end no sentence.
ABBREVIATIONS = ["mr.", "mrs.", "ms.", "dr.", "prof.", "sr.", "jr.", "st.", "vs.", "etc.", "i.e.", "e.g.", "u.s.", "u.k.", "no.", "fig."]
# Words that hint at clauses, times and comparisons.
CLAUSE_WORDS = "and or but while although because if when since after before whereas unless despite however than".split()
TIME_WORDS = "year years month months week weeks day days today yesterday tomorrow before after during".split()
COMPARISON_WORDS = "more less fewer higher lower greater smaller increase decrease double half compared than".split()
# Verbs taken for a predicate, and texts that are no sentence.
PREDICATE_WORDS = "am are be been being can claim did do does found had has have is made said say says show shows was were will".split()
FRAGMENTS = [r"(?i)skip to (content|navigation)", r"(?i)update your browser", r"^\W*\d+\W*$", r"(?i)^(home|menu|share|subscribe|advertisement)\W*$"]
# Surface patterns of a claim, on its lower-cased text.
SURFACE = {
    "time_count": r"\b(?:19|20)\d{2}\b|\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\b",
    "negation": r"\b(?:no|not|never|n't|none|without|neither|nor)\b",
    "comparison": r"\b(?:more|less|fewer|higher|lower|greater|smaller|larger|than|compared|increase|decrease)\b",
    "superlative": r"\b(?:most|least|highest|lowest|largest|smallest|best|worst|first|last)\b",
    "percent": r"[%]|percent|percentage",
    "quote": "[\"'“”‘’]",
}

TOKEN, CONTENT_TOKEN, NUMBER = r"[A-Za-z0-9%$]+", r"[A-Za-z0-9_'-]+", r"\d+(?:[,.]\d+)*"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _strings(values: list[str]) -> Column:
    return F.array(*(F.lit(v) for v in values))


def _all(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(f"({pattern})"), F.lit(1))


def clean_text(c: Column | str) -> Column:
    """Every run of white space, no-break spaces included, as one space; none at the ends."""
    return F.trim(F.regexp_replace(_col(c), r"[\s\p{Z}]+", " "))


def canonical_key(c: Column | str) -> Column:
    """The key by which equal sentences are found: lower case, single spaces."""
    return F.lower(clean_text(c))


def split_sentences(c: Column | str) -> Column:
    """Array of sentences: cut after an end mark before white space and a capital or digit, abbreviations kept whole."""
    text = clean_text(c)
    # One pass that stops at full stops only: one that ends an abbreviation, or stands within it, is marked.
    whole = [a.replace(".", r"\.") for a in ABBREVIATIONS]
    inside = [rf"(?<={a.split('.')[0]}\.)(?={a.split('.')[1]}\.)" for a in ABBREVIATIONS if a.count(".") == 2]
    text = F.regexp_replace(text, rf"(?i)\.(?:(?<={'|'.join(whole)})|{'|'.join(inside)})", "\x01")
    pieces = F.split(text, r"(?<=[.!?])\s+(?=[\"'(\[]*[A-Z0-9])")
    return F.filter(F.transform(pieces, lambda p: F.trim(F.translate(p, "\x01", "."))), lambda p: p != "")


def word_tokens(c: Column | str) -> Column:
    return F.transform(_all(clean_text(c), TOKEN), F.lower)


def tokens(c: Column | str) -> Column:
    return F.transform(_all(_col(c), CONTENT_TOKEN), F.lower)


def content_tokens(c: Column | str) -> Column:
    """Tokens without stop words."""
    return F.filter(tokens(c), lambda t: ~t.isin(*STOP_WORDS))


def count_in(words: Column, among: list[str]) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(*among)))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays as sets; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def coverage(wanted: Column, found: Column, empty: float) -> Column:
    """Share of the wanted values found; ``empty`` where none is wanted."""
    n = F.size(F.array_distinct(wanted))
    return F.when(n == 0, empty).otherwise(F.size(F.array_intersect(wanted, found)) / n)


def complexity_signals(c: Column | str) -> dict[str, Column]:
    text, words = _col(c), word_tokens(c)
    return {
        "num_tokens": F.size(words),
        "connectors": count_in(words, CLAUSE_WORDS),
        "times": count_in(words, TIME_WORDS),
        "comparisons": count_in(words, COMPARISON_WORDS),
        "digits": F.regexp_count(text, F.lit("[0-9]")),
        "marks": F.regexp_count(text, F.lit("[,;:()]")),
        "has_percent": text.contains("%").cast("int"),
        "has_money": text.contains("$").cast("int"),
    }


def claim_surface(c: Column | str) -> dict[str, Column]:
    text = _col(c)
    low = F.lower(text)
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    out = {
        "claim_tokens": F.size(content_tokens(text)),
        "claim_words": F.size(words),
        "capitalised": F.size(F.filter(words, lambda w: w.rlike("^[A-Z]"))),
        "numbers": F.regexp_count(text, F.lit(NUMBER)),
        "time_count": F.regexp_count(low, F.lit(SURFACE["time_count"])),
    }
    return out | {k: low.rlike(SURFACE[k]).cast("int") for k in ("negation", "comparison", "superlative", "percent", "quote")}


def fragment_flags(c: Column | str, claim: Column | str) -> dict[str, Column]:
    """Whether a text reads as a whole sentence; ``overlap`` with the claim's content tokens stands for relevance too."""
    text = F.trim(_col(c))
    words = tokens(text)
    n = F.size(words)
    length_ok = n.between(6, 96) & (F.length(text) >= 32)
    predicate = F.exists(words, lambda w: w.isin(*PREDICATE_WORDS) | w.rlike("(ed|ing)$"))
    fragment = F.lit(False)
    for p in FRAGMENTS:
        fragment = fragment | text.rlike(p)
    return {
        "length_ok": length_ok,
        "has_predicate": predicate,
        "boundary_ok": text.rlike("[.?!\"']$") | (n >= 10),
        "not_fragment": length_ok & ~fragment & (F.size(content_tokens(text)) >= 4),
        "overlap": F.arrays_overlap(content_tokens(text), content_tokens(_col(claim))),
    }


def completeness(flags: dict[str, Column]) -> Column:
    parts = {"length_ok": 0.25, "has_predicate": 0.20, "boundary_ok": 0.15, "not_fragment": 0.15, "overlap": 0.25}
    total = F.lit(0.0)
    for name, w in parts.items():
        total = total + w * flags[name].cast("int")
    return total


def source_domain(*values: Column) -> Column:
    """Host, with its port, of the first non-empty value; a bare host is read as one."""
    raw = F.coalesce(*(F.when(v != "", v) for v in values), F.lit(""))
    host = F.regexp_extract(raw, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#]*)", 1)
    return F.lower(F.trim(host))


def source_group(group: Column, report: Column, domain: Column, uid: Column) -> Column:
    return F.coalesce(
        F.when(F.trim(group) != "", F.trim(group)),
        F.when(report != "", F.concat(F.lit("report:"), report)),
        F.when(domain != "", F.concat(F.lit("domain:"), domain)),
        F.concat(F.lit("candidate:"), F.coalesce(uid, F.lit(""))),
    )


def stable_uid(*parts: Column) -> Column:
    """First 12 hex digits of the SHA-1 of the parts joined by bars."""
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 12)


def normalize_number(c: Column | str) -> Column:
    """Digits without grouping commas, currency and percent signs, or a fraction of zeros."""
    bare = F.regexp_replace(F.lower(F.trim(_col(c))), r"[$€£,%\s]", "")
    return F.regexp_replace(bare, r"\.0+$", "")


def normalize_decade(c: Column | str) -> Column:
    """``1990's`` and ``the 90s`` as ``1990s``: four digits and an s; two digits are read as the 1900s."""
    digits = F.regexp_extract(F.lower(_col(c)), r"(\d{2,4})'?s", 1)
    return F.when(digits == "", None).when(F.length(digits) == 2, F.concat(F.lit("19"), digits, F.lit("s"))).otherwise(F.concat(digits, F.lit("s")))


def parse_label(c: Column | str, labels: list[str], aliases: list[tuple[str, str]] | None = None) -> Column:
    """Id of the label named in a free text, -1 if none: a ``Label: X`` letter, a bare letter, a ``Label: name`` line, any label's name.

    ``aliases``: ``(label, pattern)`` in the order in which they are tried; longer names must come first.
    """
    text = F.coalesce(_col(c), F.lit(""))
    letters = "".join(chr(65 + i) for i in range(len(labels)))
    of_letter = lambda x: F.when(x != "", F.ascii(F.upper(x)) - 65)
    line = F.lower(F.regexp_extract(text, r"(?mi)^\s*label\s*:\s*([^\n\r]+)", 1))
    aliases = aliases or [(x, rf"\b{x.replace('-', '[-_ ]')}\b") for x in sorted(labels, key=len, reverse=True)]

    def named(where: Column) -> Column:
        out = F.when(where.rlike(aliases[0][1]), labels.index(aliases[0][0]))
        for label, pattern in aliases[1:]:
            out = out.when(where.rlike(pattern), labels.index(label))
        return out

    return F.coalesce(
        of_letter(F.regexp_extract(text, rf"(?mi)^\s*label\s*:\s*([{letters}])\b", 1)),
        of_letter(F.regexp_extract(text, rf"(?is)^\s*([{letters}])\s*$", 1)),
        named(line),
        named(F.lower(text)),
        F.lit(-1),
    ).cast("int")


def evidence_block(texts: Column) -> Column:
    """``[1] first``, ``[2] second`` ... one to a line."""
    return F.array_join(F.transform(texts, lambda t, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), t)), "\n")


def parse_evidence_block(c: Column | str) -> Column:
    """The texts of an ``[i] text`` block."""
    return F.transform(_all(_col(c), r"(?m)(?<=^|\n)\[\d+\] [^\n]*"), lambda x: F.regexp_replace(x, r"^\[\d+\] ", ""))


def chat_messages(c: Column | str) -> Column:
    """Role and content of the ``<|im_start|>role\\ncontent<|im_end|>`` messages of a prompt, up to the open assistant turn."""
    pattern = r"(?s)<\|im_start\|>(\w+)\n(.*?)<\|im_end\|>"
    text = _col(c)
    return F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("role"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("content"))
