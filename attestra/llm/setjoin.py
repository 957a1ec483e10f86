"""Word sets, their segments and their keys, shared by the operators on similar texts.

A text is its set of words, as sorted 64-bit hashes. Words are ordered from rare to common by a frequency sketch: counts of
word occurrences in ``2 ** SKETCH_BITS`` hash buckets, so what is collected and broadcast has a fixed size at any scale.
Any order gives the same result; a sharper one gives fewer candidates.

Two sets of n and m words with similarity (Jaccard) ``t`` share at least ``o = ceil(t * max(n, m))`` words. The words are cut
into segments: the rare ones, and the others by their hash. Of the ``n - o + 1 + E`` rarest words of either set they share
at least ``1 + E``, ``E`` being ``DEPTH - 1`` for each segment of frequent words, so they share a rare word, or ``DEPTH``
words of one segment of frequent words (pigeonhole). The first word is a key if it is rare, one for all sizes of partner; else
the first two, if not many sets have them, or the first three. A word of one set alone is no key, as it meets nothing. The number of a set's keys is bounded however frequent all its words are, as
larger sets have more segments (``bands``), and no key of one or two words is in many sets.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm.runtime import checkpoint, shuffles_dropped, words

SKETCH_BITS = 22
#: Words, and pairs of words, up to this frequency in their sketch are keys by themselves.
RARE = 128
DEPTH = 3
#: Pairs that must share fewer words than this are in one segment of frequent words; each doubling doubles the segments.
ONE_SEGMENT = 33
SLACK = 1e-9


def bands() -> np.ndarray:
    """The least o of each band: band 0 has single words only, band k ``2 ** (k - 1)`` segments of frequent words."""
    return np.array([1, DEPTH, ONE_SEGMENT, *(((ONE_SEGMENT - 1) << k) + 1 for k in range(1, 26))])


def word_sets(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """``id, toks, k1, k2``: each row's set of words as sorted hashes, and a 128-bit key of the set; rows without a word are left out."""
    toks = F.array_sort(F.array_distinct(F.transform(words(text), lambda w: F.xxhash64(w))))
    # A filter on toks would be pushed below them, and the words found twice.
    rows = df.where(F.lower(F.col(text)).rlike(r"[\p{L}\p{N}]")).select(F.col(id_col).alias("id"), toks.alias("toks"))
    return rows.select("id", "toks", F.xxhash64("toks").alias("k1"), F.xxhash64(F.lit(1), "toks").alias("k2"))


def classes(rows: DataFrame) -> DataFrame:
    """``cls, toks, k1, k2, n``: each different set once, with the least id and the number of its rows."""
    return rows.groupBy("k1", "k2", "toks").agg(F.min("id").alias("cls"), F.count("*").alias("n"))


def pack(b: np.ndarray, c: np.ndarray) -> bytes:
    """Buckets and their counts in some two bytes each: steps from bucket to bucket and counts, byte by byte of their numbers."""
    order = np.argsort(b)
    numbers = np.concatenate((np.diff(b[order], prepend=0), c[order])).astype("<i4")
    return zlib.compress(numbers.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    numbers = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T.copy().view("<i4").ravel()
    steps, c = np.split(numbers, 2)
    return np.cumsum(steps), c


def cells(counted: DataFrame, bits: int) -> np.ndarray:
    """Counts of ``counted(b int, c bigint)`` by bucket. Each task packs its buckets, so the driver gets two bytes a bucket."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(x.column(0).to_numpy(), np.minimum(x.column(1).to_numpy(), np.iinfo(np.int32).max)) for x in batches if x.num_rows]
        if got:
            yield pa.RecordBatch.from_arrays([pa.array([pack(*map(np.concatenate, zip(*got, strict=True)))])], ["packed"])

    out = np.zeros(1 << bits, np.int32)
    with shuffles_dropped(counted.sparkSession):
        parts = counted.mapInArrow(run, "packed binary").toArrow().column("packed")
    for part in parts:
        b, c = unpack(part.as_py())
        out[b] = c
    return out


def sketch(sets: DataFrame, bits: int = SKETCH_BITS) -> np.ndarray:
    """Occurrences of words by hash bucket: at most ``2 ** bits`` buckets reach the driver, whatever the input."""
    mask = (1 << bits) - 1
    counted = sets.select(F.explode("toks").alias("w")).groupBy(F.col("w").bitwiseAND(F.lit(mask)).cast("int").alias("b")).agg(F.count("*").alias("c"))
    return cells(counted, bits)


def rare_first(flat: np.ndarray, lengths: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of each set from rare to common, and their frequencies."""
    freq = counts[flat & (len(counts) - 1)]
    order = np.lexsort((flat, freq, np.repeat(np.arange(len(lengths)), lengths)))
    return flat[order], freq[order]


def mix(*values: np.ndarray) -> np.ndarray:
    """64-bit hashes of rows of words."""
    h = np.full(len(values[-1]), 0x9E3779B97F4A7C15 * len(values) & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for v in values:
        h = (h ^ np.asarray(v).astype(np.int64).view(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    return h.view(np.int64)


def segment_of(flat: np.ndarray, segments: int) -> np.ndarray:
    """Segment of each word, from bits of its hash; twice the segments halve each one."""
    return (flat.view(np.uint64) >> np.uint64(32 - (segments.bit_length() - 1)) & np.uint64(segments - 1)).astype(np.int64)


def _spread(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and number, from 0, of ``count[i]`` items of each i."""
    owner = np.repeat(np.arange(len(count)), count)
    return owner, np.arange(len(owner)) - (np.cumsum(count) - count)[owner]


def segment_keys(flat: np.ndarray, freq: np.ndarray, lengths: np.ndarray, t: float, frequent_pairs: np.ndarray | None = None, rare: int = RARE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(set, key, words in the key)`` of sets whose words are in rare-first order.

    ``frequent_pairs``: whether a bucket of two-word keys is full. Without it all keys of frequent words have two, to be counted.
    """
    starts = bands()
    begin = np.cumsum(lengths) - lengths
    n = lengths.astype(np.int64)
    o = np.ceil(t * n - SLACK).astype(np.int64)
    # A set meets the partners of its own band, and larger ones: a pair shares no more than n words.
    low, high = (np.searchsorted(starts, x, side="right") - 1 for x in (o, n))
    longest = np.zeros(len(n), np.int64)
    out: list[tuple[np.ndarray, np.ndarray, int]] = []
    for k in range(int(low.min(initial=0)), int(high.max(initial=-1)) + 1):
        segments = 1 << max(0, k - 1)
        extra = segments * (DEPTH - 1) if k else 0
        sets = np.flatnonzero((low <= k) & (high >= k))
        # The pair shares at least ``starts[k]`` words, so that many less ``extra`` may be left unread.
        reach = n[sets] - np.maximum(o[sets], starts[k]) + 1 + extra
        owner, at = _spread(reach)
        at += begin[sets][owner]
        word, often = flat[at], freq[at]
        space = np.int64(k)
        if k == 0:
            shared = often != 1
            out.append((sets[owner[shared]], mix(np.full(int(shared.sum()), space), word[shared]), 1))
            continue
        longest[sets] = np.maximum(longest[sets], reach)
        owner, word = owner[often > rare], word[often > rare]
        seg = segment_of(word, segments)
        order = np.lexsort((np.arange(len(word)), seg, owner))
        owner, word, seg = owner[order], word[order], seg[order]
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(owner)), bool), (owner[1:] != owner[:-1]) | (seg[1:] != seg[:-1]))))
        size = np.diff(np.append(first, len(owner)))
        left = np.repeat(first + size, size) - np.arange(len(owner)) - DEPTH  # first words of a key that still follow
        head = np.flatnonzero(left >= 0)
        i, j = _spread(left[head] + 1)
        a, b, rest = head[i], head[i] + 1 + j, left[head][i] - j
        key = mix(np.full(len(a), space), word[a], word[b])
        two = np.ones(len(key), bool) if frequent_pairs is None else ~frequent_pairs[key & (len(frequent_pairs) - 1)]
        out.append((sets[owner[a[two]]], key[two], 2))
        a, b, rest = a[~two], b[~two], rest[~two]
        i, j = _spread(rest + 1)
        a, b, c = a[i], b[i], b[i] + 1 + j
        out.append((sets[owner[a]], mix(np.full(len(a), space), word[a], word[b], word[c]), 3))
    # Rare words are the same keys in all bands, so a set has each once. A bucket of one occurrence is a word of one set.
    owner, at = _spread(longest)
    at += begin[owner]
    single = (freq[at] <= rare) & (freq[at] != 1)
    out.append((owner[single], mix(np.ones(int(single.sum()), np.int64), flat[at[single]]), 1))
    if not len(n):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int8)
    return np.concatenate([d for d, _, _ in out]), np.concatenate([x for _, x, _ in out]), np.concatenate([np.full(len(d), w, np.int8) for d, _, w in out])


def masks(flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """256 bits of each set as four 64-bit numbers: bit ``hash >> 24 & 255`` is set for each word; eight segments of 32 bits."""
    out = np.zeros(len(lengths) * 4, np.uint64)
    bit = flat.view(np.uint64) >> np.uint64(24) & np.uint64(255)
    cell = np.repeat(np.arange(len(lengths)), lengths) * 4 + (bit >> np.uint64(6)).astype(np.int64)
    np.bitwise_or.at(out, cell, np.uint64(1) << (bit & np.uint64(63)))
    return out.view(np.int64).reshape(-1, 4)


def flat_lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.diff(column.offsets.to_numpy())
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), lengths


def frequent_pairs(sets: DataFrame, shared: Broadcast, t: float, rare: int = RARE, bits: int = SKETCH_BITS) -> np.ndarray:
    """Whether a hash bucket of two-word keys holds more than ``rare`` of them; at most ``2 ** bits`` buckets reach the driver. ``shared``: the sketch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << bits, np.int32)
        for b in batches:
            flat, lengths = flat_lists(b.column(0))
            _, key, size = segment_keys(*rare_first(flat, lengths, shared.value), lengths, t, None, rare)
            np.add.at(held, key[size == 2] & (len(held) - 1), 1)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(held[at])], ["b", "c"])

    counted = sets.select("toks").mapInArrow(run, "b int, c int").groupBy("b").agg(F.sum("c").alias("c")).where(F.col("c") > rare)
    return cells(counted, bits) > 0


def key_rows(sets: DataFrame, t: float, counts: np.ndarray | None = None, carry: tuple[str, ...] = (), rare: int = RARE) -> DataFrame:
    """``seed, cls, size, m0..m3`` of each key of each set, and the carried columns, which are never null."""
    sc, counts = sets.sparkSession.sparkContext, sketch(sets) if counts is None else counts
    shared = sc.broadcast(counts)
    pairs = sc.broadcast(frequent_pairs(sets, shared, t, rare))
    field = sets.select("cls", "toks", *carry)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, lengths = flat_lists(b.column(1))
            flat, freq = rare_first(flat, lengths, shared.value)
            doc, key, _ = segment_keys(flat, freq, lengths, t, pairs.value, rare)
            m, take = masks(flat, lengths)[doc], pa.array(doc)
            cols = [pa.array(key), b.column(0).take(take), pa.array(lengths[doc], pa.int32()), *(pa.array(m[:, i]) for i in range(4)), *(b.column(2 + i).take(take) for i in range(len(carry)))]
            yield pa.RecordBatch.from_arrays(cols, ["seed", "cls", "size", "m0", "m1", "m2", "m3", *carry])

    kind = {c: field.schema[c].dataType.simpleString() for c in ("cls", *carry)}
    columns = {"seed": "bigint", "cls": kind["cls"], "size": "int", **dict.fromkeys(("m0", "m1", "m2", "m3"), "bigint"), **{c: kind[c] for c in carry}}
    return field.mapInArrow(run, ", ".join(f"{n} {k} not null" for n, k in columns.items()))


def sequences(sets: DataFrame, counts: np.ndarray) -> DataFrame:
    """``cls, words``: each set's words from rare to common."""
    shared = sets.sparkSession.sparkContext.broadcast(counts)
    field = sets.select("cls", "toks")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, lengths = flat_lists(b.column(1))
            flat, _ = rare_first(flat, lengths, shared.value)
            offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["cls", "words"])

    return field.mapInArrow(run, f"cls {field.schema['cls'].dataType.simpleString()}, words array<bigint>")


def tau(t: float) -> str:
    """SQL: words in which sets x and y of similarity t may differ. A literal without D would be a decimal."""
    return f"int({(1 - t) / (1 + t)!r}D * (x.size + y.size) + {SLACK!r}D)"


def within(t: float) -> str:
    """SQL condition: the differing bits of x and y, at most their differing words, are within ``tau``."""
    return f"{' + '.join(f'bit_count(x.m{i} ^ y.m{i})' for i in range(4))} <= {tau(t)}"


def sizes(t: float) -> str:
    """SQL condition: the sizes of x and y allow similarity t."""
    return f"least(x.size, y.size) >= {t!r}D * greatest(x.size, y.size) - {SLACK!r}D"


def verify(pairs: DataFrame, sets: DataFrame, t: float) -> DataFrame:
    """``a, b, similarity`` of the candidate pairs that reach ``t``, by their whole sets."""
    left, right = sets.select(F.col("cls").alias("a"), F.col("toks").alias("ta")), sets.select(F.col("cls").alias("b"), F.col("toks").alias("tb"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").withColumn("o", F.size(F.array_intersect("ta", "tb")))
    union = F.size("ta") + F.size("tb") - F.col("o")
    return both.select("a", "b", (F.col("o") / union).alias("similarity")).where(F.col("similarity") >= t - SLACK)


def prepare(df: DataFrame, id_col: str, text: str) -> tuple[DataFrame, DataFrame]:
    """``id, k1, k2`` of the rows, and the different sets, both written to the checkpoint folder.

    The words are found twice, as written once for the rows and again for the sets they are the most of what is on disk.
    """
    rows = word_sets(df, id_col, text)
    return checkpoint(rows.select("id", "k1", "k2")), checkpoint(classes(rows), drop=True)
