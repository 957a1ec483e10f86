"""Problem 5: records shared between the training split and the evaluation splits.

Claims are read as the sequence of their different words from rare to common, so that reordering changes nothing. The
suffixes of these sequences form a sparse suffix array: of each claim only those that start at one of its rarest words,
``n - o + 1`` of them and a few more, as two similar claims share one (``setjoin``). Suffixes are named by their first word, or, where
that is frequent, by it and one or two later words, since an edit may stand between; they are spread and sorted by name,
and a merge of the training suffixes with the evaluation suffixes meets the neighbours of different splits. Neighbours whose
word bitmaps differ by more than the similarity allows are passed over.

The sequences of two neighbours are then laid against each other whole: each common prefix of their suffixes is a shared
span, and the spans of a pair, merged, are the part of either record that is covered. A pair is similar if the covered
words are ``t`` of the words of both, so the coverage decides, exactly (words are compared by 64-bit hash). A name with a
third of all rows is split by adaptive execution.

Training means ``split`` is ``train`` in any case; other non-null splits are evaluation. Event ids are compared trimmed,
lower-cased and without a trailing ``.json``; null equals nothing. Null claims and those without a word are similar to nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.llm.runtime import checkpoint
from attestra.llm.setjoin import SLACK, key_rows, prepare, sequences, sizes, sketch, within

SIMILARITY = 0.75


def event_key(name: str = "event_id") -> Column:
    return F.regexp_replace(F.lower(F.trim(F.col(name))), r"\.json$", "")


def sides(samples: DataFrame) -> DataFrame:
    """``id, train, event, split, source, claim`` of the rows with a split."""
    s = F.lower(F.trim(F.col("split")))
    return samples.where("split IS NOT NULL").select(F.col("sample_id").alias("id"), (s == "train").alias("train"), event_key().alias("event"), s.alias("split"), F.col("source"), F.col("claim"))


def neighbours(sets: DataFrame, marked: DataFrame, counts, t: float = SIMILARITY) -> DataFrame:
    """``a, b``: training and evaluation classes with suffixes of one name. ``marked``: ``cls, in_train, in_eval``."""
    array = key_rows(sets.join(marked, "cls"), t, counts, ("in_train", "in_eval"))
    x, y = array.where("in_train").alias("x"), array.where("in_eval").alias("y").hint("merge")
    met = x.join(y, F.expr(f"x.seed = y.seed AND x.cls <> y.cls AND {sizes(t)} AND {within(t)}"))
    return met.select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b")).distinct()


def shared_spans(pairs: DataFrame, words: DataFrame, t: float = SIMILARITY) -> DataFrame:
    """``a, b, spans, covered, size, similarity``: the pairs whose spans cover enough of both records.

    A span has the places ``a`` and ``b`` of its first word in either sequence of ``words`` and its length ``n``; it goes on
    while both sequences go on with the same word. ``size`` is the number of words of b.
    """
    both = pairs.join(words.select(F.col("cls").alias("a"), F.col("words").alias("wa")), "a").join(words.select(F.col("cls").alias("b"), F.col("words").alias("wb")), "b")
    at = F.expr("filter(transform(wa, (w, i) -> named_struct('a', i, 'b', int(array_position(wb, w)) - 1)), p -> p.b >= 0)")
    starts = F.expr("filter(sequence(0, size(at) - 1), i -> i = 0 OR at[i].a <> at[i - 1].a + 1 OR at[i].b <> at[i - 1].b + 1)")
    spans = F.expr("transform(starts, (s, k) -> named_struct('a', at[s].a, 'b', at[s].b, 'n', coalesce(get(starts, k + 1), size(at)) - s))")
    covered = F.expr("aggregate(spans, 0, (n, s) -> n + s.n)")
    out = both.withColumn("at", at).where("size(at) > 0").withColumn("starts", starts).withColumn("spans", spans).withColumn("covered", covered)
    out = out.withColumn("similarity", F.col("covered") / (F.size("wa") + F.size("wb") - F.col("covered"))).where(F.col("similarity") >= t - SLACK)
    return out.select("a", "b", "spans", "covered", F.size("wb").alias("size"), "similarity")


def claim_links(rows: DataFrame, t: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """``a, b, spans, covered, size, similarity`` of training and evaluation classes (size of b's set), and ``cls, id, train``.

    A class in both splits is linked to itself by one span over all its words.
    """
    keyed, sets = prepare(rows, "id", "claim")
    members = sets.select("k1", "k2", "cls").join(keyed.select("k1", "k2", "id"), ["k1", "k2"]).select("cls", "id").join(rows.select("id", "train").distinct(), "id")
    marked = members.groupBy("cls").agg(F.max("train").alias("in_train"), F.max(~F.col("train")).alias("in_eval"))
    counts = sketch(sets)
    near = shared_spans(neighbours(sets, marked, counts, t), sequences(sets, counts), t)
    whole = F.expr("array(named_struct('a', 0, 'b', 0, 'n', size(toks)))").alias("spans")
    same = marked.where("in_train AND in_eval").join(sets, "cls").select(F.col("cls").alias("a"), F.col("cls").alias("b"), whole, F.size("toks").alias("covered"), F.size("toks").alias("size"), F.lit(1.0).alias("similarity"))
    return near.unionByName(same), members


def overlaps(samples: DataFrame, t: float = SIMILARITY) -> DataFrame:
    """``train_id, eval_id, same_event, similarity, covered``: every pair of a training and an evaluation row that overlap, once.

    ``similarity`` and ``covered``, the words in shared spans, are null where only the event is the same and the claims are
    less similar than ``t``.
    """
    rows = sides(samples)
    links, members = claim_links(rows, t)
    return _pairs(rows, links, members)


def _pairs(rows: DataFrame, links: DataFrame, members: DataFrame) -> DataFrame:
    left, right = members.where("train").select(F.col("cls").alias("a"), F.col("id").alias("train_id")), members.where("NOT train").select(F.col("cls").alias("b"), F.col("id").alias("eval_id"))
    alike = links.join(left, "a").join(right, "b").select("train_id", "eval_id", F.lit(False).alias("same_event"), "similarity", "covered")
    e1, e2 = rows.where("train").select("event", F.col("id").alias("train_id")), rows.where("NOT train").select("event", F.col("id").alias("eval_id"))
    met = e1.join(e2, "event").select("train_id", "eval_id", F.lit(True).alias("same_event"), F.lit(None).cast("double").alias("similarity"), F.lit(None).cast("int").alias("covered"))
    return alike.unionByName(met).groupBy("train_id", "eval_id").agg(F.max("same_event").alias("same_event"), F.max("similarity").alias("similarity"), F.max("covered").alias("covered"))


def found(samples: DataFrame, t: float = SIMILARITY) -> DataFrame:
    """``sample_id_a, sample_id_b``, smaller id first."""
    return overlaps(samples, t).select(F.least("train_id", "eval_id").alias("sample_id_a"), F.greatest("train_id", "eval_id").alias("sample_id_b"))


def coverage(samples: DataFrame, t: float = SIMILARITY) -> DataFrame:
    """``sample_id, words, covered, train_records``: each evaluation row whose claim is like a training claim.

    ``covered`` of its ``words`` different words are in spans that it shares with any of these; ``train_records`` counts their
    different claims.
    """
    links, members = claim_links(sides(samples), t)
    return _coverage(links, members)


def _coverage(links: DataFrame, members: DataFrame) -> DataFrame:
    places = links.select("b", F.explode("spans").alias("s")).select("b", F.explode(F.expr("sequence(s.b, s.b + s.n - 1)")).alias("at")).distinct()
    per = links.groupBy("b").agg(F.max("size").alias("words"), F.count("*").alias("train_records")).join(places.groupBy("b").agg(F.count("*").alias("covered")), "b")
    return members.where("NOT train").select(F.col("cls").alias("b"), F.col("id").alias("sample_id")).join(per, "b").select("sample_id", "words", "covered", "train_records")


def report(samples: DataFrame, t: float = SIMILARITY) -> DataFrame:
    """Per evaluation split and source (null kept): ``split, source, rows, leaked_rows, pairs, same_event_pairs, similar_pairs, similar_rows, words, covered_words``.

    The last two are the words of the rows with a similar training claim and those of them that shared spans cover.
    """
    rows = sides(samples)
    links, members = claim_links(rows, t)
    links = checkpoint(links)
    mine = rows.where("NOT train").select("id", "split", "source")
    per = _pairs(rows, links, members).groupBy(F.col("eval_id").alias("id")).agg(F.count("*").alias("pairs"), F.count(F.when(F.col("same_event"), 1)).alias("same_event_pairs"), F.count("similarity").alias("similar_pairs"))
    held = _coverage(links, members).select(F.col("sample_id").alias("id"), "words", F.col("covered").alias("covered_words"))
    return mine.join(per, "id", "left").join(held, "id", "left").groupBy("split", "source").agg(
        F.count("*").alias("rows"),
        F.count("pairs").alias("leaked_rows"),
        F.count("words").alias("similar_rows"),
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("pairs", "same_event_pairs", "similar_pairs", "words", "covered_words")),
    )
