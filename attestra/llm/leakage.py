"""Problem 7: passages of held-out items inside corpus documents.

Items and documents are brought to the one form of ``glyphs``, lower-cased and reduced to words joined by single spaces.
Every run of ``n`` consecutive words of an item (the whole item where it is shorter) is a pattern of one Aho-Corasick
automaton; each document is read through it once, and every hit is mapped back to the code points of the original text.

The item table is the broadcast side, and its size is checked: patterns are cut into automata of at most
``BLOCK_PATTERN_CHARS`` characters, and the corpus is read once through each. Item tables of more than ``BROADCAST_CHARS``
characters are no broadcast: there the runs of items and documents are joined by 128-bit hashes, after a bitmap of fixed size
has dropped the documents' runs that no item has. Both give the same rows. Null or empty texts, and items without a word, are
in no result; repeated items are hits of each of their ids.
"""

from __future__ import annotations

import re
import unicodedata as ud
import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm.glyphs import SIZE, fold_points, points
from attestra.llm.runtime import blocks, strings

WORDS = 12
BLOCK_PATTERN_CHARS = 4_000_000
#: Characters of items, each of which is in up to ``n`` patterns, that automata are built for.
BROADCAST_CHARS = 1_000_000
BITMAP_BITS = 26
SPACE, END = 0x20, 0x0A


@cache
def word_tables() -> tuple[np.ndarray, np.ndarray]:
    """Lower case of each code point, and whether it is a letter or digit."""
    lower, is_word = np.arange(SIZE, dtype=np.uint32), np.zeros(SIZE, bool)
    for cp in (c for span in (range(0xD800), range(0xF900, 0x32400)) for c in span):
        ch = chr(cp)
        is_word[cp] = ud.category(ch)[0] in "LN"
        if (low := ch.lower()) != ch:
            lower[cp] = ord(low[0])
    return lower, is_word


def normalise(texts: list[str]) -> tuple[str, np.ndarray]:
    """The texts' words joined by single spaces, each text ended by a line feed; with each character's place in the input."""
    lower, is_word = word_tables()
    raw = points(texts)
    a, at = fold_points(raw)
    # The one letter whose lower case is two code points, the second being no letter.
    dotted = np.flatnonzero(a == 0x130) + 1
    if len(dotted):
        a, at = np.insert(a, dotted, 0x307), np.insert(at, dotted, at[dotted - 1])
    a = lower[a]
    w = is_word[a]
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    end = np.zeros(len(a), bool)
    end[np.searchsorted(at, ends)] = True
    after_word = np.concatenate(([False], w[:-1]))
    keep = w | end | after_word
    a = np.where(end, END, np.where(w, a, SPACE))[keep]
    return a.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass"), at[keep]


def patterns(items: list[tuple[int, str]], n: int = WORDS) -> dict[str, list[int]]:
    """Each run of ``n`` words of an item, or the whole shorter item, with the ids that have it."""
    out: dict[str, set[int]] = defaultdict(set)
    for item_id, text in items:
        w = normalise([text])[0].split()
        for i in range(max(1, len(w) - n + 1) if w else 0):
            out[" ".join(w[i : i + n])].add(item_id)
    return {k: sorted(v) for k, v in out.items()}


def pattern_blocks(found: dict[str, list[int]], limit: int = BLOCK_PATTERN_CHARS) -> list[list[tuple[str, list[int]]]]:
    out, size = [[]], 0
    for k, ids in sorted(found.items()):
        if out[-1] and size + len(k) > limit:
            out.append([])
            size = 0
        out[-1].append((k, ids))
        size += len(k)
    return out


_automata: dict[str, object] = {}


def _automaton(key: str, block: list[tuple[str, list[int]]]):
    """Built once per worker and block."""
    import ahocorasick

    if key not in _automata:
        for other in [x for x in _automata if x.split("-")[0] != key.split("-")[0]]:
            del _automata[other]
        a = ahocorasick.Automaton()
        for k, ids in block:
            a.add_word(k, (len(k), ids))
        a.make_automaton()
        _automata[key] = a
    return _automata[key]


def scan(texts: list[str], automaton) -> Iterator[tuple[int, int, int, int]]:
    """``(text index, item, start, end)`` of each hit, in code points of the original text."""
    for lo, hi in blocks(texts):
        part = texts[lo:hi]
        line, at = normalise(part)
        begins = np.cumsum([0] + [len(t) + 1 for t in part[:-1]])
        for last, (size, ids) in automaton.iter(line):
            first = last - size + 1
            if (first and line[first - 1] not in " \n") or line[last + 1] not in " \n":
                continue
            s, e = int(at[first]), int(at[last]) + 1
            doc = int(np.searchsorted(begins, s, "right")) - 1
            base = int(begins[doc])
            for i in ids:
                yield lo + doc, i, s - base, e - base


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching spans joined, in order."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


SPANS = "array<struct<char_start:int,char_end:int>>"


def merged(spans: str) -> F.Column:
    """Spans of a list in order, overlapping or touching ones joined."""
    step = "if(size(a) = 0 OR s.char_start > element_at(a, -1).char_end, array_append(a, s), array_append(slice(a, 1, size(a) - 1), named_struct('char_start', element_at(a, -1).char_start, 'char_end', greatest(element_at(a, -1).char_end, s.char_end))))"
    return F.expr(f"aggregate(array_sort({spans}), cast(array() AS {SPANS}), (a, s) -> {step})")


def run_hashes(line: str, at: np.ndarray, lengths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(h1, h2, start, end)`` of each run of that many words of one normalised text, in places of the input."""
    found = [(m.start(), m.end()) for m in re.finditer("[^ \n]+", line)]
    hashed = pd.util.hash_array(np.array([line[a:b] for a, b in found], object)) if found else np.zeros(0, np.uint64)
    begin, end = np.array([at[a] for a, _ in found], np.int64), np.array([at[b - 1] + 1 for _, b in found], np.int64)
    out = []
    for n in lengths:
        k = max(0, len(found) - n + 1)
        h = [np.full(k, n, np.uint64), np.full(k, n, np.uint64)]
        for j in range(n if k else 0):
            for side, factor in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)):
                h[side] = (h[side] ^ hashed[j : j + k]) * np.uint64(factor)
                h[side] ^= h[side] >> np.uint64(29 + side)
        out.append((h[0].view(np.int64), h[1].view(np.int64), begin[:k], end[n - 1 : n - 1 + k]))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 4


def text_runs(texts: DataFrame, lengths: tuple[int, ...], n: int, whole: bool, bitmap: np.ndarray | None = None) -> DataFrame:
    """``id, h1, h2, char_start, char_end``: runs of each text, of ``n`` words and, with ``whole``, all of a shorter one."""
    shared = None if bitmap is None else texts.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, text in enumerate(strings(b.column(1))):
                line, at = normalise([text])
                words = len(line.split())
                h1, h2, s, e = run_hashes(line, at, (min(words, n),) if whole and words else () if whole else lengths)
                if shared is not None:
                    cell = h1 & ((1 << BITMAP_BITS) - 1)
                    hit = np.flatnonzero(shared.value[cell >> 3] >> (cell & 7).astype(np.uint8) & 1)
                    h1, h2, s, e = h1[hit], h2[hit], s[hit], e[hit]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.full(len(h1), i))), pa.array(h1), pa.array(h2), pa.array(s, pa.int32()), pa.array(e, pa.int32())], ["id", "h1", "h2", "char_start", "char_end"])

    return texts.mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, h1 bigint, h2 bigint, char_start int, char_end int")


def joined_runs(field: DataFrame, source: DataFrame, n: int) -> DataFrame:
    """``id, item, spans`` by a join of hashed runs: for item tables of any size."""
    wanted = text_runs(source.select(F.col("i").alias("id"), "t"), (), n, True).select(F.col("id").alias("item"), "h1", "h2").distinct()
    counted = source.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([min(n, len(normalise([t])[0].split())) for t in strings(b.column(1))], pa.int32())], ["k"]) for b in batches), "k int")
    lengths = tuple(sorted(r.k for r in counted.distinct().collect() if r.k))  # at most n numbers
    # One bit for each hash bucket: of the items' runs only the numbers of full bytes reach the driver, whatever there is of them.
    bits = wanted.select(F.expr(f"h1 & {(1 << BITMAP_BITS) - 1}").alias("c")).groupBy(F.expr("c >> 3").alias("byte")).agg(F.expr("bit_or(1 << int(c & 7))").alias("v")).toArrow()
    bitmap = np.zeros(1 << (BITMAP_BITS - 3), np.uint8)
    bitmap[bits.column("byte").to_numpy()] = bits.column("v").to_numpy().astype(np.uint8)
    hits = text_runs(field, lengths, n, False, bitmap).join(wanted, ["h1", "h2"])
    return hits.groupBy("id", "item").agg(F.collect_list(F.struct("char_start", "char_end")).alias("spans"))


def leaks(documents: DataFrame, items: DataFrame, n: int = WORDS, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """``doc_id, item_id, spans, chars``: one row per document and leaked item; spans are merged code-point ranges of the text."""
    source = items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).where("i IS NOT NULL AND t IS NOT NULL")
    field = documents.select(F.col(doc_id).alias("id"), F.col(text).alias("t")).where("t IS NOT NULL AND t <> ''")
    small = (source.agg(F.sum(F.length("t"))).first()[0] or 0) <= broadcast_chars
    out = (scanned_runs if small else joined_runs)(field, source, n)
    out = out.select(F.col("id").alias(doc_id), F.col("item").alias(item_id), merged("spans").alias("spans"))
    return out.withColumn("chars", F.expr("aggregate(spans, 0, (n, s) -> n + s.char_end - s.char_start)"))


def scanned_runs(field: DataFrame, source: DataFrame, n: int) -> DataFrame:
    """``id, item, spans`` by Aho-Corasick automata over the items' runs: for item tables small enough to be broadcast."""
    found = pattern_blocks(patterns([(r.i, r.t) for r in source.collect()], n))
    sc = field.sparkSession.sparkContext
    run_id = uuid.uuid4().hex
    shared = [sc.broadcast(b) for b in found]

    def reader(k: int):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = None
            for b in batches:
                automaton = automaton or _automaton(f"{run_id}-{k}", shared[k].value)
                hits: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
                for doc, item, s, e in scan(strings(b.column(1)), automaton):
                    hits[doc, item].append((s, e))
                spans = {key: merge(v) for key, v in hits.items()}
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(pa.array([d for d, _ in spans], pa.int32())),
                        pa.array([i for _, i in spans], pa.int64()),
                        pa.array([[{"char_start": s, "char_end": e} for s, e in v] for v in spans.values()], pa.list_(pa.struct([("char_start", pa.int32()), ("char_end", pa.int32())]))),
                    ],
                    ["id", "item", "spans"],
                )

        return run

    kind = field.schema["id"].dataType.simpleString()
    schema = f"id {kind}, item long, spans {SPANS}"
    parts = [field.mapInArrow(reader(k), schema) for k in range(len(found)) if found[k]]
    if not parts:
        return field.select("id", F.lit(None).cast("long").alias("item"), F.expr(f"cast(array() as {SPANS})").alias("spans")).where("false")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if len(parts) > 1:  # an item's runs may lie in several automata
        out = out.groupBy("id", "item").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    return out
