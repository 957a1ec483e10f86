"""Rule-based parts of a claim (aspects, anchors), and atoms read from a model's JSON answer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestra.functions.text import clean_text, content_tokens

# Where a claim falls into clauses, and what its parts are known by.
CLAUSE_CUT = r"(?i)\s*(?:;|,\s+(?:but|and|where|because|otherwise|instead|then)\b|\b(?:but instead|otherwise)\b)\s*"
ENTITY = r"\b[A-Z][A-Za-z0-9'.-]+(?:\s+(?:of\s+|the\s+|and\s+)?[A-Z][A-Za-z0-9'.-]+)*"
QUANTITY = r"(?i)(?:\$\s?\d[\d,]*(?:\.\d+)?|\d+(?:\.\d+)?\s?(?:percent|%|million|billion|people|jobs|days|years|dollars)?)"
YEAR = r"\b(?:19|20)\d{2}\b"
CONTEXT_START = r"(?i)^(?:instead|otherwise|where|because|but|then)\b"
PRONOUN = r"(?i)\b(?:he|she|it|they|this|that|these|those|them)\b"
MAX_ASPECTS, MAX_ATOMS = 8, 6


def _matches(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(f"({pattern})"), F.lit(1))


def retrievability(c: Column) -> Column:
    """How well a part of a claim serves as a query of its own: +1 for an entity, a quantity and 5 to 18 tokens; -2 for a
    pronoun without an entity or a leaning start, -1 for fewer than 4 tokens."""
    n = F.size(content_tokens(c))
    entity = c.rlike(ENTITY)
    return (
        entity.cast("int")
        + c.rlike(QUANTITY).cast("int")
        + n.between(5, 18).cast("int")
        - 2 * (c.rlike(PRONOUN) & ~entity).cast("int")
        - 2 * c.rlike(CONTEXT_START).cast("int")
        - (n < 4).cast("int")
    )


def aspects(claim: Column | str, least: int = 1, most: int = MAX_ASPECTS) -> Column:
    """The whole claim and its clauses, in order, each once but for case and spaces, if retrievable enough: ``text, score``."""
    text = clean_text(claim)
    parts = F.filter(F.transform(F.concat(F.array(text), F.split(text, CLAUSE_CUT)), lambda p: F.regexp_replace(p, r"^[\s,.;:\"]+|[\s,.;:\"]+$", "")), lambda p: p != "")
    keys = F.transform(parts, F.lower)
    once = F.filter(parts, lambda p, i: F.array_position(keys, F.lower(p)) == i + 1)
    scored = F.transform(once, lambda p: F.struct(p.alias("text"), retrievability(p).alias("score")))
    return F.slice(F.filter(scored, lambda s: s["score"] >= least), 1, most)


def anchors(claim: Column | str) -> Column:
    """Values to look for in evidence: ``kind, value`` of years, other numbers and entities of two words and more, each once."""
    text = clean_text(claim)
    years = F.array_distinct(_matches(text, YEAR))
    numbers = F.array_except(F.array_distinct(_matches(text, r"\d+(?:[,.]\d+)*")), years)
    entities = F.filter(F.array_distinct(F.transform(_matches(text, ENTITY), F.lower)), lambda e: e.contains(" "))
    kind = lambda name, a: F.transform(a, lambda v: F.struct(F.lit(name).alias("kind"), v.alias("value")))
    return F.concat(kind("year", years), kind("number", numbers), kind("entity", entities))


ATOM = "struct<proposition:string,text:string,importance:double,type:string,keywords:array<string>>"


def parse_atoms(answer: Column | str, claim: Column | str) -> Column:
    """Atoms of the first JSON object in a free answer: ``atom_id, proposition, importance, type``.

    Fences and talk around the object are passed over. Propositions are cleaned, empty ones dropped, each kept once;
    importance is held within 0..1 (0.5 if missing). Where nothing can be read, or there are more than six, the claim itself
    is the only atom.
    """
    text = F.coalesce(F.col(answer) if isinstance(answer, str) else answer, F.lit(""))
    body = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    listed = F.from_json(body, f"claim_atoms array<{ATOM}>")["claim_atoms"]
    named = F.transform(listed, lambda a: F.struct(clean_text(F.coalesce(F.when(F.trim(a["proposition"]) != "", a["proposition"]), a["text"], F.lit(""))).alias("proposition"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(a["importance"], F.lit(0.5)))).alias("importance"), F.coalesce(F.lower(F.trim(a["type"])), F.lit("other")).alias("type")))
    kept = F.filter(named, lambda a: a["proposition"] != "")
    keys = F.transform(kept, lambda a: F.lower(a["proposition"]))
    once = F.filter(kept, lambda a, i: F.array_position(keys, F.lower(a["proposition"])) == i + 1)
    own = F.array(F.struct(clean_text(claim).alias("proposition"), F.lit(1.0).alias("importance"), F.lit("other").alias("type")))
    good = F.coalesce((F.size(listed) <= MAX_ATOMS) & (F.size(once) > 0), F.lit(False))
    return F.transform(F.when(good, once).otherwise(own), lambda a, i: F.struct(F.concat(F.lit("A"), (i + 1).cast("string")).alias("atom_id"), a["proposition"].alias("proposition"), a["importance"].alias("importance"), a["type"].alias("type")))
