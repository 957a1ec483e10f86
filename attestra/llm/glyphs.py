"""Problem 8: one form for texts that look the same.

A text is exploded into positioned code points held in columnar arrays; small mapping tables, identical on every worker,
are joined to them by code point (compatibility forms, look-alike letters, spaces, invisible characters); combining marks
are put in order of their class, recomposed, and the strings rebuilt. The arrays of a whole Arrow batch go through each
step at once, so no Python code runs per character and no row per character is shuffled.

Folded: full- and half-width and other compatibility forms of letters, digits, kana and ideographs; ligatures; canonical
equivalents; invisible characters (dropped); every space character and the tab (to U+0020); letters of different scripts
drawn alike. Kept: case, accents, punctuation, line breaks, number of spaces, raised and lowered digits, fractions.
Null text gives a null form, an empty text an empty one.
"""

from __future__ import annotations

import unicodedata as ud
from collections.abc import Iterable, Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm.runtime import blocks, strings

# Letters drawn alike in different scripts, "prototype: look-alikes".
LOOKALIKES = """
A: А Α Ꭺ ꓮ
B: В Β Ᏼ ꓐ Ⲃ
C: С Ϲ Ꮯ ꓚ Ⲥ
D: Ꭰ ꓓ
E: Е Ε Ꭼ ꓰ
F: Ϝ ꓝ
G: Ԍ Ꮐ ꓖ
H: Н Η Ꮋ ꓧ Ⲏ
I: І Ι Ӏ ꓲ Ⲓ
J: Ј Ϳ Ꭻ ꓙ
K: К Κ Ꮶ ꓗ Ⲕ
L: Լ Ꮮ ꓡ
M: М Μ Ϻ Ꮇ ꓟ Ⲙ
N: Ν ꓠ Ⲛ
O: О Ο Օ ꓳ Ⲟ
P: Р Ρ Ꮲ ꓑ Ⲣ
Q: Ԛ
R: Ꭱ ꓣ
S: Ѕ Տ Ꮪ ꓢ
T: Т Τ Ꭲ ꓔ Ⲧ
U: Ս ꓴ
V: Ѵ Ꮩ ꓦ
W: Ԝ Ꮃ ꓪ
X: Х Χ ꓫ Ⲭ
Y: У Υ Ү Ꭹ ꓬ Ⲩ
Z: Ζ Ꮓ ꓜ
a: а α ɑ
c: с ϲ ⲥ ꮯ
d: ԁ
e: е
g: ɡ ց
h: һ հ
i: і ι ɩ ꭵ
j: ј ϳ
k: к κ ⲕ
l: ӏ
n: ո
o: о ο օ ⲟ
p: р ρ ⲣ
q: ԛ զ
s: ѕ ꮪ
u: υ ս
v: ν ѵ ꮩ
w: ԝ ꮃ
x: х χ ⲭ
y: у γ ү
r: ꮁ
z: ꮓ
ə: ә
Ə: Ә
æ: ӕ
Æ: Ӕ
ε: ɛ
θ: ѳ
Γ: Г Ⲅ
Δ: Ⲇ
Θ: Ѳ Ⲑ
Λ: Ʌ Ⲗ
Π: П Ⲡ
Σ: Ʃ
Φ: Ф Ⲫ
ç: ҫ
Ç: Ҫ
ロ: 口
ニ: 二
カ: 力
エ: 工
ハ: 八
タ: 夕
ト: 卜
オ: 才
ヘ: へ
リ: り
ー: 一
"""
# Decomposition tags whose forms can be told apart by eye.
VISIBLE_TAGS = {"<super>", "<sub>", "<fraction>"}
# Format characters that are drawn (number and verse signs), as ranges.
DRAWN_FORMATS = [(0x600, 0x605), (0x6DD, 0x6DD), (0x70F, 0x70F), (0x890, 0x891), (0x8E2, 0x8E2), (0x110BD, 0x110BD), (0x110CD, 0x110CD)]
# Further ranges without a mark of their own (joiners, fillers, variation selectors).
IGNORABLE = [(0x34F, 0x34F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xE0000, 0xE0FFF)]
LAYOUT = {0x0A, 0x0B, 0x0C, 0x0D, 0x85, 0x2028, 0x2029}
SIZE = 0x110000
L_BASE, V_BASE, T_BASE, S_BASE, V_COUNT, T_COUNT, S_COUNT = 0x1100, 0x1161, 0x11A7, 0xAC00, 21, 28, 11172


class Tables(NamedTuple):
    length: np.ndarray  # code points that a code point becomes
    single: np.ndarray  # the first of them
    start: np.ndarray  # their place in pool
    pool: np.ndarray
    mark: np.ndarray  # may move or join with what stands before
    ccc: np.ndarray  # canonical combining class
    cd_length: np.ndarray
    cd_start: np.ndarray
    cd_pool: np.ndarray
    pair_key: np.ndarray  # first << 21 | second
    pair_to: np.ndarray


def _within(cp: int, ranges: list[tuple[int, int]]) -> bool:
    return any(a <= cp <= b for a, b in ranges)


def _compat(ch: str) -> str:
    tag, _, rest = ud.decomposition(ch).partition(" ")
    if not tag.startswith("<") or tag in VISIBLE_TAGS:
        return ch
    to = "".join(chr(int(x, 16)) for x in rest.split())
    if ud.category(ch)[0] != "L" and ud.category(ch) not in ("Nd", "Nl") and not all(ud.category(c)[0] in "LNM" for c in to):
        return ch
    if any(ud.decomposition(c).partition(" ")[0] in VISIBLE_TAGS for c in to):
        return ch
    return "".join(_compat(c) for c in ud.normalize("NFD", to))


def _form(cp: int, alike: dict[str, str]) -> str:
    ch, kind = chr(cp), ud.category(chr(cp))
    if kind == "Zs" or cp == 9:
        return " "
    if cp in LAYOUT:
        return ch
    if kind in ("Cf", "Cc") and not _within(cp, DRAWN_FORMATS) or _within(cp, IGNORABLE):
        return ""
    out = "".join(alike.get(y, y) for x in ud.normalize("NFD", ch) for y in ud.normalize("NFD", _compat(x)))
    return ud.normalize("NFC", out)


@cache
def tables() -> Tables:
    """Mapping tables over all code points, made by rule from the Unicode data of the standard library."""
    alike = {}
    for line in LOOKALIKES.strip().splitlines():
        to, _, who = line.partition(": ")
        alike |= dict.fromkeys(who.split(), to)
    length, single = np.ones(SIZE, np.uint8), np.arange(SIZE, dtype=np.uint32)
    start, cd_start = np.zeros(SIZE, np.int32), np.zeros(SIZE, np.int32)
    cd_length, mark, ccc = np.ones(SIZE, np.uint8), np.zeros(SIZE, bool), np.zeros(SIZE, np.uint8)
    pool, cd_pool, pairs = [0], [0], {}
    # Unified ideographs, Hangul syllables and private use have no mapping of their own; the few alike ideographs are added.
    spans = [range(0x3400), range(0xA000, 0xAC00), range(0xD7A4, 0xD800), range(0xF900, 0x20000), range(0x2F800, 0x2FA20), range(0xE0000, 0xE1000), (ord(c) for c in alike)]
    for cp in (c for span in spans for c in span):
        ch = chr(cp)
        ccc[cp] = ud.combining(ch)
        if (form := _form(cp, alike)) != ch:
            length[cp], start[cp], single[cp] = len(form), len(pool), ord(form[0]) if form else 0
            pool += map(ord, form)
        dec = ud.decomposition(ch)
        if dec and dec[0] != "<":
            full = ud.normalize("NFD", ch)
            cd_length[cp], cd_start[cp] = len(full), len(cd_pool)
            cd_pool += map(ord, full)
            two = [int(x, 16) for x in dec.split()]
            if len(two) == 2 and ud.normalize("NFC", ch) == ch:
                pairs[two[0] << 21 | two[1]] = cp
                mark[two[1]] = True
    mark |= ccc > 0
    mark[V_BASE : V_BASE + V_COUNT] = mark[T_BASE + 1 : T_BASE + T_COUNT] = True
    key = np.array(sorted(pairs), np.int64)
    return Tables(length, single, start, np.array(pool, np.uint32), mark, ccc, cd_length, cd_start, np.array(cd_pool, np.uint32), key, np.array([pairs[k] for k in key.tolist()], np.uint32))


def _expand(a: np.ndarray, length: np.ndarray, start: np.ndarray, pool: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each code point replaced by its sequence in pool (``keep`` where that is one); with the index it came from."""
    n = length[a]
    at = np.repeat(np.arange(len(a)), n)
    first = np.cumsum(n, dtype=np.int64) - n
    out = keep[a[at]]
    many = n[at] > 1
    where = at[many]
    out[many] = pool[start[a[where]] + (np.flatnonzero(many) - first[where])]
    return out, at


def _composite(first: np.ndarray, second: np.ndarray, t: Tables) -> np.ndarray:
    """Primary composite of each pair, 0 where there is none."""
    key = first.astype(np.int64) << 21 | second
    at = np.minimum(np.searchsorted(t.pair_key, key), len(t.pair_key) - 1)
    out = np.where(t.pair_key[at] == key, t.pair_to[at], 0).astype(np.int64)
    l, v, s, tail = first.astype(np.int64) - L_BASE, second.astype(np.int64) - V_BASE, first.astype(np.int64) - S_BASE, second.astype(np.int64) - T_BASE
    out = np.where((l >= 0) & (l < 19) & (v >= 0) & (v < V_COUNT), S_BASE + (l * V_COUNT + v) * T_COUNT, out)
    return np.where((s >= 0) & (s < S_COUNT) & (s % T_COUNT == 0) & (tail > 0) & (tail < T_COUNT), S_BASE + s + tail, out)


def _order_and_compose(a: np.ndarray, at: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray]:
    """Marks after each starter in order of class, then joined with it as far as a composite exists."""
    c = t.ccc[a].astype(np.int64)
    if np.any((c[1:] > 0) & (c[:-1] > c[1:])):
        order = np.lexsort((np.arange(len(a)), c, np.cumsum(c == 0)))
        a, at, c = a[order], at[order], c[order]
    while len(a) > 1:
        i = np.arange(len(a))
        starter = np.maximum.accumulate(np.where(c == 0, i, -1))
        before = np.concatenate(([-1], starter[:-1]))  # the last starter in front of i
        previous = np.concatenate(([0], c[:-1]))
        free = (before >= 0) & ((i - 1 == before) | (c > previous) & (c > 0))
        j = np.flatnonzero(free)
        to = _composite(a[before[j]], a[j], t)
        j, to = j[to > 0], to[to > 0]
        if not len(j):
            break
        head, once = np.unique(before[j], return_index=True)
        # A starter that itself joins with the one in front waits for the next turn.
        ok = ~np.isin(head, j[once])
        a = a.copy()
        a[head[ok]] = to[once][ok]
        keep = np.ones(len(a), bool)
        keep[j[once][ok]] = False
        a, at, c = a[keep], at[keep], c[keep]
    return a, at


def fold_points(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points of an array and, for each, the index of the one it came from."""
    t = tables()
    at = np.arange(len(a))
    if np.any(t.length[a] != 1):
        a, at = _expand(a, t.length, t.start, t.pool, t.single)
    else:
        a = t.single[a]
    mark = t.mark[a]
    if not mark.any():
        return a, at
    member = mark.copy()
    member[:-1] |= mark[1:]
    sub = np.flatnonzero(member)
    b, back = _expand(a[sub], t.cd_length, t.cd_start, t.cd_pool, np.arange(SIZE, dtype=np.uint32))
    # A group starts at a starter; runs that stand apart in the text must not join.
    gap = np.flatnonzero(np.diff(sub) > 1) + 1
    wall = np.searchsorted(back, gap)
    b, back = np.insert(b, wall, 0x0A), np.insert(back, wall, -1)
    b, back = _order_and_compose(b, back, t)
    b, back = b[back >= 0], back[back >= 0]
    count = np.ones(len(a), np.int64)
    count[sub] = np.bincount(back, minlength=len(sub))
    out_at = np.repeat(np.arange(len(a)), count)
    out = a[out_at]
    out[member[out_at]] = b  # runs keep their order, so only the count of each place matters
    return out, at[out_at]


def points(texts: list[str]) -> np.ndarray:
    """Code points of the texts, each followed by a line feed so that none joins with the next."""
    return np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), "<u4")


def fold_texts(texts: list[str]) -> list[str]:
    """The one form of each text."""
    out: list[str] = []
    t = tables()
    for lo, hi in blocks(texts):
        part = texts[lo:hi]
        a = points(part)
        if not (t.mark[a].any() or np.any(t.length[a] != 1) or np.any(t.single[a] != a)):
            out += part
            continue
        ends = np.cumsum([len(x) + 1 for x in part])
        b, at = fold_points(a)
        cut = np.searchsorted(at, ends - 1)  # places of the line feeds set between texts
        whole = b.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        begin = 0
        for e in cut.tolist():
            out.append(whole[begin:e])
            begin = e + 1
    return out


def _digest(text: str) -> bytes:
    return xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))


def fold_column(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id_col, form``: the one form of each row's text; null stays null."""
    field = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(1)
            forms = fold_texts(strings(raw))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f if ok else None for f, ok in zip(forms, raw.is_valid().to_pylist())], pa.string())], ["id", "form"])

    kind = field.schema["id"].dataType.simpleString()
    return field.mapInArrow(run, f"id {kind}, form string").select(F.col("id").alias(id_col), "form")


def form_keys(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, form_key, raw_key``: 128-bit digests of the one form and of the text as it is; blank and null texts are left out."""
    field = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where(F.col("t").isNotNull())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = strings(b.column(1))
            forms = fold_texts(texts)
            keep = [bool(f.strip()) for f in forms]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).filter(pa.array(keep, pa.bool_())),
                    pa.array([_digest(f) for f, k in zip(forms, keep) if k], pa.binary()),
                    pa.array([_digest(t) for t, k in zip(texts, keep) if k], pa.binary()),
                ],
                ["id", "form_key", "raw_key"],
            )

    kind = field.schema["id"].dataType.simpleString()
    return field.mapInArrow(run, f"id {kind}, form_key binary, raw_key binary")


def same_look_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``{id}_a, {id}_b``: rows, smaller id first, whose texts look the same but differ code point by code point.

    Groups in which all texts are equal are dropped by a partial aggregate before the join, so a large group of plain
    copies costs one row per partition; the join runs on 16-byte keys only. Repeated ids are one row each of their own.
    """
    keys = form_keys(df, id_col, text_col)
    mixed = keys.groupBy("form_key").agg(F.min("raw_key").alias("lo"), F.max("raw_key").alias("hi")).where("lo < hi").select("form_key")
    part = keys.join(mixed, "form_key", "left_semi")
    a = part.select("form_key", F.col("id").alias("a"), F.col("raw_key").alias("ra"))
    b = part.select("form_key", F.col("id").alias("b"), F.col("raw_key").alias("rb"))
    return a.join(b, "form_key").where("a < b AND ra <> rb").select(F.col("a").alias(f"{id_col}_a"), F.col("b").alias(f"{id_col}_b"))
