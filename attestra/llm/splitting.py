"""Problem 3: oversized items cut at natural boundaries.

Every position of a text has a strength: paragraph break, sentence end, clause mark or line break, white space, none, and
lowest inside a character with its marks. A sparse table answers range-maximum queries over them, so each cut is the
strongest in its permissible window, the rightmost of equals. The window is the upper half of the limit; where that has no
sentence end, the whole of it. The next piece starts at the leftmost sentence start within ``overlap`` characters of the
cut, else the leftmost word start, else exactly that far back.

Pieces are ranges of the text as delivered and lose nothing: each piece without what it repeats, put together, is the text.
Null and empty texts, and those of at most ``limit`` characters, are not cut and have no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm.runtime import strings
from attestra.llm.sentences import distinct_reports, split_blocks, units

LIMIT, OVERLAP = 1500, 150
PARAGRAPH, SENTENCE, CLAUSE, WORD, ANY, NEVER = 5, 4, 3, 2, 1, 0
PAGE = 1 << 16
GAP = re.compile(r"([,;:，、；：،؛]?)(\s+)")
MARKS = re.compile("[̀-ͯ҃-҉֑-ֽؐ-ًؚ-ٟऀ-ःऺ-ॏ॑-ॗัิ-ฺ็-๎᪰-᫿᷀-᷿​-‍⃐-⃿゙゚︀-️🏻-🏿]")


class RangeMax:
    """Place of the greatest strength in a range, the rightmost of equals; tables are made page by page, so memory is bounded."""

    def __init__(self, strength: np.ndarray, reach: int):
        self.strength, self.reach, self.page, self.levels = strength, reach, -1, []

    def _load(self, page: int) -> None:
        lo = page * PAGE
        part = self.strength[lo : lo + PAGE + self.reach + 1].astype(np.int64)
        level = part << 40 | np.arange(lo, lo + len(part))
        self.page, self.levels, k = page, [level], 1
        while 2 * k <= min(self.reach + 1, len(part)):
            level = np.maximum(level[:-k], level[k:])
            self.levels.append(level)
            k *= 2

    def best(self, lo: int, hi: int) -> tuple[int, int]:
        """``(place, strength)`` within ``lo..hi``, both counted, at most ``reach`` apart."""
        if (page := lo // PAGE) != self.page:
            self._load(page)
        a, n = lo - page * PAGE, hi - lo + 1
        k = n.bit_length() - 1
        v = max(int(self.levels[k][a]), int(self.levels[k][a + n - (1 << k)]))
        return v & (1 << 40) - 1, v >> 40


def strengths(text: str, found: list[tuple[int, int]]) -> np.ndarray:
    """Strength of a cut before each position; white space stays with what it follows."""
    s = np.full(len(text) + 1, ANY, np.int8)
    for m in MARKS.finditer(text):
        s[m.start()] = NEVER
    for m in GAP.finditer(text):
        s[m.start() + len(m[1]) + 1 : m.end()] = NEVER
        s[m.end()] = CLAUSE if m[1] or "\n" in m[2] else WORD
    for start, _ in found[1:]:
        s[start] = SENTENCE
    for start, _ in list(split_blocks(text))[1:]:
        s[start] = PARAGRAPH
    return s


def cut(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Ranges of the pieces, and the text's sentence units."""
    if limit <= 2 * overlap:
        raise ValueError("the limit must be more than twice the overlap")
    found = units(text)
    s = strengths(text, found)
    index = RangeMax(s, limit)
    pieces, start, done = [], 0, 0
    while len(text) - start > limit:
        top = start + limit
        end, strength = index.best(max(done + 1, start + limit // 2), top)
        if strength < SENTENCE:
            far, stronger = index.best(max(done + 1, start + overlap + 1), top)
            if stronger > strength:
                end = far
        pieces.append((start, end))
        done = end
        back = s[end - overlap : end]
        for least in (SENTENCE, WORD):
            if len(at := np.flatnonzero(back >= least)):
                start = end - overlap + int(at[0])
                break
        else:
            start = end - overlap
            while start < end and s[start] == NEVER:
                start += 1
    pieces.append((start, len(text)))
    return pieces, found


def pieces(items: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``origin, item_key, piece_idx, char_start, char_end, repeated, span, sentence_count, piece`` of rows ``origin, item_key, text``."""
    field = items.select("origin", F.col("item_key").cast("string").alias("item_key"), F.col("text")).where(F.length("text") > limit)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, cols = [], [[] for _ in range(7)]
            for i, text in enumerate(strings(b.column(2))):
                ranges, found = cut(text, limit, overlap)
                starts, ends = np.array([x for x, _ in found]), np.array([x for _, x in found])
                before = 0
                for k, (lo, hi) in enumerate(ranges):
                    first, last = int(np.searchsorted(ends, lo, "right")), int(np.searchsorted(starts, hi, "left")) - 1
                    n = max(0, last - first + 1)
                    span = "unknown" if n == 0 else f"S{first:02d}" if n == 1 else f"S{first:02d}-S{last:02d}"
                    rows.append(i)
                    for col, v in zip(cols, (k, lo, hi, before - lo if k else 0, span, n, text[lo:hi])):
                        col.append(v)
                    before = hi
            at = pa.array(rows, pa.int32())
            kinds = [pa.int32()] * 4 + [pa.string(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), *(pa.array(c, t) for c, t in zip(cols, kinds))], ["origin", "item_key", "piece_idx", "char_start", "char_end", "repeated", "span", "sentence_count", "piece"])

    return field.mapInArrow(run, "origin string, item_key string, piece_idx int, char_start int, char_end int, repeated int, span string, sentence_count int, piece string")


def oversized(anchors: DataFrame, renders: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``origin, item_key, text`` of the reports, once each, and renders of more than ``limit`` characters."""
    long = distinct_reports(anchors.where(F.length("report_content") > limit))
    return long.select(F.lit("report").alias("origin"), F.col("report_id").alias("item_key"), F.col("report_content").alias("text")).unionByName(
        renders.where(F.length("text") > limit).select(F.lit("render").alias("origin"), F.col("render_id").cast("string").alias("item_key"), "text")
    )
