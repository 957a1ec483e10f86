"""Chunks of consecutive sentences.

Whole texts, windows and candidates are array expressions on a document's own row, so no sentence is shuffled. The semantic
strategies are window plans over rows ``doc, idx, vector``; the claim-aware one keeps its sequential split and merge steps
in one function per document.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.functions import vectors as V
from attestra.functions.text import canonical_key, split_sentences
from attestra.operators.selection import Pool, per_row

# Words with which a sentence leans on the one before.
LEANING = "he she it they this that these those his her its their him them such".split()


def explode_sentences(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys, idx, sent``."""
    return df.select(*keys, F.posexplode(split_sentences(text)).alias("idx", "sent"))


def sentence_arrays(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys, s``: the sentences of each document in order; those without a sentence are left out.

    The array of one is exploded so that a text is split once, however often its sentences are used above.
    """
    return df.select(*keys, F.explode(F.array(split_sentences(text))).alias("s")).where("size(s) > 0")


def raw_chunks(arrays: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, chunk, sentences``: the whole document, its sentences joined by spaces."""
    return arrays.select(*keys, F.array_join("s", " ").alias("chunk"), F.size("s").alias("sentences"))


def context_windows(arrays: DataFrame, keys: list[str], k: int = 1) -> DataFrame:
    """``keys, idx, chunk, members``: each sentence with k before and after it; one repeated in the window, but for case and spaces, is kept once."""
    keyed = arrays.select(*keys, "s", F.transform("s", canonical_key).alias("__k"))

    def members(i: Column) -> Column:
        # A sentence stays if the first place of its key within the window is its own.
        first = F.greatest(F.lit(0), i - k)
        near = F.sequence(first, F.least(F.size("s") - 1, i + k))
        return F.filter(near, lambda j: F.array_position(F.slice("__k", first + 1, j - first + 1), F.get("__k", j)) == j - first + 1)

    # Windows are made in the document's row, so that its arrays aren't copied for each sentence.
    placed = keyed.select(*keys, "s", F.transform("s", lambda x, i: members(i)).alias("__m"))
    chunk = lambda m: F.array_join(F.transform(m, lambda j: F.get("s", j)), " ")
    return placed.select(*keys, F.inline(F.transform("__m", lambda m, i: F.struct(i.alias("idx"), chunk(m).alias("chunk"), m.alias("members")))))


def islands(df: DataFrame, keys: list[str], idx: str, starts: Column, name: str = "chunk") -> DataFrame:
    """Chunk numbers from 0: a row where ``starts`` holds begins a new one; the first row of a group always does."""
    w = Window.partitionBy(*keys).orderBy(idx)
    first = F.row_number().over(w) == 1
    return df.withColumn("__new", F.when(first | F.coalesce(starts, F.lit(False)), 1).otherwise(0)).withColumn(name, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("__new")


def semantic_chunks(df: DataFrame, keys: list[str], idx: str, embedding: str, threshold: float) -> DataFrame:
    """``chunk``: a sentence joins the one before if their dot product exceeds the threshold."""
    before = df.withColumn("__prev", F.lag(embedding).over(Window.partitionBy(*keys).orderBy(idx)))
    out = islands(before, keys, idx, F.round(V.dot(F.col("__prev"), F.col(embedding)), 9) <= threshold)
    return out.drop("__prev")


def context_semantic_chunks(df: DataFrame, keys: list[str], idx: str, embedding: str, k: int, threshold: float) -> DataFrame:
    """Windows of k sentences, each the normalised mean of its vectors, merged as in ``semantic_chunks``: ``keys, window, first, last, chunk``."""
    placed = df.withColumn("__pos", F.row_number().over(Window.partitionBy(*keys).orderBy(idx)) - 1).withColumn("window", F.floor(F.col("__pos") / k))
    mean = placed.select(*keys, "window", idx, F.posexplode(embedding).alias("dim", "x")).groupBy(*keys, "window", "dim").agg(F.avg(F.col("x").cast("double")).alias("x"), F.min(idx).alias("first"), F.max(idx).alias("last"))
    vec = mean.groupBy(*keys, "window").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("v"), F.min("first").alias("first"), F.max("last").alias("last"))
    unit = vec.withColumn("v", F.transform("v", lambda x: x / F.greatest(V.norm(F.col("v")), F.lit(1e-12))))
    return semantic_chunks(unit, keys, "window", "v", threshold).drop("v")


def claim_aware_spans(rel: np.ndarray, sims: np.ndarray, leaning: list[bool], lengths: list[int], w_sem: float = 0.75, w_rel: float = 0.25, spread: float = 0.5, discount: float = 0.1, max_sentences: int = 3, max_tokens: int = 150, min_tokens: int = 20, keep_alone: float = 0.55) -> list[tuple[int, int]]:
    """Spans of sentences: cut at peaks of dissimilarity and of change in relevance, then overlong spans are cut further at
    their strongest boundary, and short irrelevant ones joined to the more similar neighbour (the right one of equals)."""
    n = len(rel)
    if n == 0:
        return []
    score = w_sem * (1 - sims) + w_rel * np.abs(np.diff(rel))
    score = np.where(leaning[1:], np.maximum(0.0, score - discount), score)
    if n > 1:
        left, right = np.append(-1.0, score[:-1]), np.append(score[1:], -1.0)
        peak = (score > 0) & (score >= left) & (score >= right) & (score >= score.mean() + spread * score.std())
    else:
        peak = np.zeros(0, bool)
    ends = [*np.flatnonzero(peak).tolist(), n - 1]
    todo = [(a, b) for a, b in zip([0, *(e + 1 for e in ends[:-1])], ends)][::-1]
    total = np.concatenate(([0], np.cumsum(lengths)))
    fits = lambda a, b: b - a < max_sentences and total[b + 1] - total[a] <= max_tokens
    spans: list[tuple[int, int]] = []
    while todo:
        a, b = todo.pop()
        if a == b or fits(a, b):
            spans.append((a, b))
            continue
        at = a + int(np.argmax(score[a:b]))
        todo += [(at + 1, b), (a, at)]
    out: list[tuple[int, int]] = []
    for i in range(len(spans)):
        a, b = spans[i]
        if total[b + 1] - total[a] >= min_tokens or rel[a : b + 1].max() >= keep_alone:
            out.append((a, b))
            continue
        options = []
        if out and fits(out[-1][0], b):
            options.append((sims[a - 1], rel[out[-1][0] : out[-1][1] + 1].max(), 0))
        if i + 1 < len(spans) and fits(a, spans[i + 1][1]):
            options.append((sims[b], rel[spans[i + 1][0] : spans[i + 1][1] + 1].max(), 1))
        if not options:
            out.append((a, b))
        elif max(options)[2]:
            spans[i + 1] = (a, spans[i + 1][1])
        else:
            out[-1] = (out[-1][0], b)
    return out


#: A tighter setting: weaker peaks cut, and a chunk has at most two sentences.
TIGHT = {"spread": 0.35, "w_sem": 0.65, "w_rel": 0.35, "max_sentences": 2}


def claim_aware_chunks(df: DataFrame, keys: list[str], **settings) -> DataFrame:
    """``keys, first, last, sentences, tokens, relevance, anchor`` from rows ``keys, idx, sent, rel, sim_next, tokens``.

    ``rel`` is the sentence's relevance to the claim, ``sim_next`` its similarity to the next one. ``anchor`` is the most
    relevant sentence, the first of equals.
    """
    leaning = F.regexp_replace(F.lower(F.element_at(F.split("sent", " "), 1)), "[\"'“(]", "").isin(*LEANING)
    packed = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("idx", "rel", F.coalesce("sim_next", F.lit(0.0)).alias("sim"), F.col("tokens").cast("long").alias("tokens"), leaning.alias("leaning"))), lambda a, b: a["idx"] - b["idx"]).alias("s"))

    def run(p: Pool):
        rel, idx, lengths = p["rel"], p["idx"], p["tokens"].tolist()
        for a, b in claim_aware_spans(rel, p["sim"][:-1], p["leaning"], lengths, **settings):
            yield idx[a], idx[b], b - a + 1, sum(lengths[a : b + 1]), rel[a : b + 1].max(), idx[a + int(np.argmax(rel[a : b + 1]))]

    return per_row(packed, keys, "s", run, "first int, last int, sentences int, tokens int, relevance double, anchor int")


def materialise(chunks: DataFrame, keys: list[str], group: str, order: list[str]) -> DataFrame:
    """Chunks as candidates: those without an anchor are dropped, and of chunks with the same text within ``group`` the first in
    ``order`` stays. ``chunks``: ``keys, chunk_id, text, anchor``, the anchor being the first kept sentence or null."""
    rows = chunks.where("anchor IS NOT NULL").withColumn("key", canonical_key("text"))
    first = rows.groupBy(group, "key").agg(F.min_by(F.struct(*keys, "chunk_id", "anchor", "text"), F.struct(*order)).alias("r"))
    return first.select(group, "key", *(F.col(f"r.{c}").alias(c) for c in [*keys, "chunk_id", "anchor", "text"] if c != group))


def windowed_evidence(gold: DataFrame, corpus: DataFrame, doc: str, text: str, window: int = 1) -> DataFrame:
    """Gold sentence of each row with its neighbours; an index past the end is the last sentence and flagged.

    ``gold``: ``id, doc, sent_idx``; ``corpus``: ``doc, text``, one row per document. Rows whose document is missing or has no sentence have null evidence.
    """
    sents = sentence_arrays(corpus, [doc], text)
    last = F.size("s") - 1
    at = F.least(F.col("sent_idx").cast("int"), last)
    first = F.greatest(F.lit(0), at - window)
    near = F.array_join(F.slice("s", first + 1, F.least(last, at + window) - first + 1), " ")
    return gold.join(sents, doc, "left").select("id", doc, "sent_idx", (F.col("sent_idx") > last).alias("clamped"), F.when(F.col("s").isNotNull() & (at + window >= 0), near).alias("evidence"))
