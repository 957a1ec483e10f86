"""Problem 1: sentence units across languages and scripts.

A pushdown automaton reads the marks of a text (list markers, end marks, quotes, brackets, Thai spaces) from left to right.
Its stack holds the levels of the list that is open, each with its indentation, kind of marker and last number or letter,
and within an item the open quotes and brackets; an end mark ends a unit only where no quote or bracket is open, a quote or
bracket may end one where it closes. Full stops are looked up in a trie of abbreviations, read backwards from the stop. Offsets are
code points of the text as delivered; a unit has no white space at either end.

Rules: a blank line ends a unit, a single line break does not, a list marker does, and belongs to the unit that it opens. A quote with the words that introduce or
attribute it is one unit; a sentence in parentheses of its own is one. In Thai running text a space ends a unit unless a
digit, a Latin letter or a full stop stands beside it. Null, empty and blank texts have no units. A quote or bracket that is
never closed within its block is read as an ordinary character. The time is linear in the text, whatever its marks.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm.runtime import strings

# Abbreviations after which a sentence always goes on.
INNER_ABBREVIATIONS = """
mr mrs ms dr prof gov sen rep gen lt col capt sgt maj rev hon pres supt no nos vs fig figs sec secs art arts p pp vol ed eds eq ch
approx ca cf e.g i.e viz est dept ave
sr sra srta dra ee núm pág págs cap d.ª dª
m mm mme mlle mgr me p.ex ex env
hr fr nr abs bzw z.b d.h u.a s.o vgl mio mrd tsd str bd evtl ggf inkl zzgl
г-н г-жа д-р проф ул стр рис им млн млрд тыс т.е т.д т.п напр гг см ср
डॉ श्री प्रो
د أ م
"""
# Abbreviations that may end a sentence, which goes on only before a small letter or a mark.
FINAL_ABBREVIATIONS = "etc usw jr inc ltd co corp al u.s u.k u.n a.m p.m st km руб г гг uu jan feb mar apr jun jul aug sep sept oct nov dec"
# Month names that follow an ordinal number and its full stop.
MONTHS = "januar februar märz april mai juni juli august september oktober november dezember jänner"
# Words of saying, in the ten languages read.
SAYING = (
    r"\b(?:said|says|asked|asks|shouted|shouts|replied|replies|told|tells|added|adds|answered|wrote|writes|explained|claimed|warned|insisted|noted|stated|argued|cried|whispered|"
    r"dijo|dice|preguntó|respondió|contestó|gritó|añadió|afirmó|explicó|aseguró|"
    r"dit|répondu|demandé|crié|déclaré|ajouté|affirmé|expliqué|répond|affirme|"
    r"sagte|sagt|fragte|rief|antwortete|erklärte|schrieb|meinte|betonte|"
    r"сказал|сказала|спросил|спросила|ответил|ответила|заявил|заявила|добавил|добавила)\b|"
    r"قال|قالت|سأل|أضاف|صرح|कहा|पूछा|बोले|बताया|说|問|问|表示|称|喊道|答道|回答|写道|กล่าว|บอก|ถาม|と|って"
)
CLOSES = {"“": "”", "„": "“”", "«": "»", "‹": "›", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "【": "】", '"': '"', "‘": "’", "《": "》", "〈": "〉"}
BRACKETS = set("(（[【《〈")
CLOSERS = set("".join(CLOSES.values()))
OPENERS = set(CLOSES)
STRONG = set("!?。！？｡؟।॥۔։")
ENDS = STRONG | set(".．…")
THAI = "฀-๿"
EVENT = re.compile(rf"[.．…!?。！？｡؟।॥۔։]+|[“”„«»‹›「」『』()（）\[\]【】《》〈〉\"‘’]|(?<=[{THAI}”»])[ \t ]+(?=[{THAI}“«(])")
BLANK = re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+|\r(?:[^\S\r\n]*\r)+")
SPACE = re.compile(r"\s*")
WORD = re.compile(r"[^\W_]")
MARKER = re.compile(r"^([ \t]*)([•‣◦▪●*\-–—]|(?:\d{1,3}|[A-Za-z])[.)])[ \t]+(?=\S)", re.M)
SAID = re.compile(SAYING)
CLAUSE_END = re.compile(r"[.!?。！？؟।]")
IN_TOKEN = re.compile(r"(\s)|/|@|www\.")
HIRAGANA = re.compile("[ぁ-ゟ]")
CJK = re.compile("[぀-ヿ㐀-鿿豈-﫿]")
CAMEL = re.compile(r"[^\W\d_]?[a-zà-ÿ]{1,2}[A-ZÀ-Ý]")
THAI_NOTICE = re.compile(rf"[^\w{THAI}]*โดย")  # a byline


class Trie:
    """Abbreviations by letters from the last to the first."""

    def __init__(self, words: str):
        self.root: dict = {}
        for w in words.split():
            node = self.root
            for ch in reversed(w):
                node = node.setdefault(ch, {})
            node[""] = True

    def ends_at(self, text: str, at: int, least: int) -> bool:
        """Whether an abbreviation that starts at a word's start ends just before ``at``."""
        node, i = self.root, at
        while i > least:
            node = node.get(text[i - 1].lower())
            if node is None:
                return False
            i -= 1
            if "" in node and (i == least or not (text[i - 1].isalnum() or text[i - 1] in "-.")):
                return True
        return False


INNER, FINAL = Trie(INNER_ABBREVIATIONS), Trie(FINAL_ABBREVIATIONS)
MONTH = frozenset(MONTHS.split())


class Reader:
    """What the automaton looks up in a block ``s[lo:hi]``, each part of which is read once however often it is asked for."""

    def __init__(self, s: str, lo: int, hi: int):
        self.s, self.lo, self.hi = s, lo, hi
        self.last: dict[str, int] = {}
        self.ahead: dict[re.Pattern, tuple[int, int, int]] = {}
        self.read, self.space, self.mark = lo, lo - 1, lo - 1

    def comes(self, ch: str, at: int) -> bool:
        """Whether ``ch`` stands at ``at`` or later."""
        if ch not in self.last:
            self.last[ch] = self.s.rfind(ch, self.lo, self.hi)
        return self.last[ch] >= at

    def next(self, pattern: re.Pattern, at: int) -> tuple[int, int]:
        """Range of the first match from ``at`` on, or the block's end; ``at`` may only grow."""
        since, begin, end = self.ahead.get(pattern, (at + 1, 0, 0))
        if not since <= at <= begin:
            m = pattern.search(self.s, at, self.hi)
            begin, end = m.span() if m else (self.hi, self.hi + 1)
            self.ahead[pattern] = (at, begin, end)
        return begin, end

    def token(self, at: int) -> tuple[int, bool]:
        """Start of the run of visible characters before ``at``, and whether an address or a slash is in it."""
        for m in IN_TOKEN.finditer(self.s, self.read, at):
            if m.group(1):
                self.space = m.start()
            else:
                self.mark = m.start()
        self.read = max(self.read, at - 3 if self.s.startswith("www", at - 3) else at)
        return self.space + 1, self.mark > self.space


def _stop_ends(s: str, lo: int, i: int, j: int, hi: int, r: Reader) -> bool:
    """Whether the single full stop at ``i`` (``j`` just after it) ends the sentence begun at ``lo``."""
    prev = s[i - 1] if i > lo else " "
    nxt = s[j]
    if nxt.isspace():
        k = SPACE.match(s, j, hi).end()
        start = s[k]
    else:
        # No space between two sentences: a word of small letters or a number, then a capital or a letter of its own script.
        if nxt in ",;:-–/@" or nxt in CLOSERS and nxt not in OPENERS:
            return False
        w, address = r.token(i)
        if address or i - max(w, lo) < 2 or INNER.ends_at(s, i, lo):
            return False
        if nxt.isupper() or nxt in "¿¡" or nxt in OPENERS and nxt not in "(（[":
            return prev.islower() or prev.isdigit() or prev in CLOSERS
        return nxt.isalpha() and prev.isalpha() and not nxt.islower() and not (prev.isascii() or CJK.match(nxt) or "฀" <= nxt <= "๿") and nxt >= "֐"
    if "฀" <= start <= "๿" or CJK.match(start):
        return False
    if INNER.ends_at(s, i, lo):
        return False
    word = prev.isalnum() or "ऀ" <= prev <= "ॿ" or prev in CLOSERS
    if not word and not prev.isspace():
        word = prev in "%°€$)»”"
    # One letter by itself is an initial or an abbreviation.
    if prev.isalpha() and (i - 2 < lo or not (s[i - 2].isalnum() or s[i - 2] in "'’-." or "ऀ" <= s[i - 2] <= "ॿ")):
        return False
    final = FINAL.ends_at(s, i, lo)
    if start.islower():
        if CAMEL.match(s, k):
            return True
        if "Ѐ" <= start <= "ӿ":
            w = i
            while w > lo and s[w - 1].isalpha():
                w -= 1
            return not final and i - w >= 3
        return False
    if prev == "." or (i - 2 >= lo and s[i - 2] == "." and prev.isalpha()):
        return final  # letters with stops between them
    if prev.isdigit() and start.isupper():
        w = i
        while w > lo and s[w - 1].isdigit():
            w -= 1
        e = k
        while e < hi and s[e].isalpha():
            e += 1
        if i - w <= 2 and s[k:e].lower() in MONTH:
            return False
    return word


def _next_goes_on(s: str, j: int, hi: int) -> bool:
    """Whether what follows a strong mark or a closed quote goes on with the same sentence."""
    k = SPACE.match(s, j, hi).end()
    if k >= hi:
        return False
    ch = s[k]
    if ch in ",;:，、；：،؛–—-":
        return True
    if ch.islower():
        return not CAMEL.match(s, k)
    return k == j and bool(HIRAGANA.match(ch)) and SAID.match(s, k) is not None


def _attributed(s: str, j: int, r: Reader) -> bool:
    """Whether the clause after a closed quote tells who said it."""
    k = SPACE.match(s, j, r.hi).end()
    if k < r.hi and s[k] in OPENERS:
        return False
    return r.next(SAID, j)[1] <= r.next(CLAUSE_END, j)[0]


def _block_units(s: str, lo: int, hi: int, out: list[tuple[int, int]], body: int) -> None:
    """Units of ``s[lo:hi]``, which begins and ends with a visible character; up to ``body`` it is a list marker."""
    r = Reader(s, body, hi)
    stack: list[tuple[str, int, bool]] = []
    closing = Counter()  # how many open marks each closing mark would close
    thai = not THAI_NOTICE.match(s, body, hi)
    start = begin = lo
    done = body  # events before it are spent
    low = False  # whether a low opening quote has been seen
    word = r.next(WORD, body)[0]  # the first letter or digit of the unit

    def cut(end: int) -> int:
        nonlocal start, word
        while end > start and s[end - 1].isspace():
            end -= 1
        out.append((start, end))
        start = SPACE.match(s, end, hi).end()
        word = r.next(WORD, start)[0]
        return start

    for m in EVENT.finditer(s, body, hi):
        i, j = m.span()
        low = low or s[i] == "„"
        if i < done:
            if j <= done:
                continue
            i = done
        ch = s[i]
        if ch.isspace():
            if thai and not stack and word < i:
                done = cut(i)
            continue
        if ch in ENDS:
            if stack or j >= hi:
                continue
            run = s[i:j]
            end = j
            while end < hi and s[end] in CLOSERS and (s[end] not in OPENERS or s[end] == '"' and not s[end + 1 : end + 2].isalnum()):
                end += 1
            if end >= hi:
                continue
            if len(run) == 1 and ch in ".．":
                over = _stop_ends(s, start, i, j, hi, r) if end == j else not _next_goes_on(s, end, hi)
            elif not (set(run) & STRONG):
                k = SPACE.match(s, end, hi).end()
                over = k > end and not s[k].islower() and (s[k].isupper() or s[k] in OPENERS or s[k] in "¿¡")
            else:
                over = not _next_goes_on(s, end, hi)
            if over and word < i:
                done = cut(end)
            continue
        if stack and ch in CLOSES[stack[-1][0]]:
            opener, at, introduced = stack.pop()
            closing.subtract(CLOSES[opener])
            if stack:
                continue
            k = i
            while k > at and s[k - 1].isspace():
                k -= 1
            ended = s[k - 1] in ENDS
            if not ended or j >= hi or _next_goes_on(s, j, hi):
                continue
            if opener in BRACKETS:
                over = not introduced
            else:
                over = introduced or not _attributed(s, j, r)
            if over:
                done = cut(j)
            continue
        if ch in OPENERS:
            if ch == "‘" and i > lo and s[i - 1].isalnum():
                continue
            if ch == "“" and i > lo and s[i - 1] in ENDS and low:
                continue  # a stray closing mark
            closers = CLOSES[ch]
            if any(r.comes(c, j) for c in closers):
                stack.append((ch, i, word < i))
                closing.update(closers)
            continue
        # A closing mark that the top of the stack doesn't expect: an inner quote was left open.
        while closing[ch] > 0:
            opener = stack.pop()[0]
            closing.subtract(CLOSES[opener])
            if ch in CLOSES[opener]:
                break
    if start < hi:
        if begin < start and word >= hi and out:
            out[-1] = (out[-1][0], hi)  # marks left over belong to the unit before
        else:
            out.append((start, hi))


def _after_colon(s: str, lo: int, at: int) -> bool:
    while at > lo and s[at - 1].isspace():
        at -= 1
    return at > lo and s[at - 1] in ":："


def _list_items(s: str, lo: int, hi: int) -> list[tuple[int, int]]:
    """``(start, end of the marker)`` of the list items of a block, whose lists begin it or follow a colon.

    A stack holds the open levels. A marker goes on with the innermost level of its kind and indentation whose number or
    letter it follows, closing the levels inside; else it opens a level inside the item before, with its first number or
    letter. Levels of one item are no lists; lines that fit nowhere are text.
    """
    if s.find("\n", lo, hi) < 0 and not MARKER.match(s, lo, hi):
        return []
    levels: list[list[tuple[int, int]]] = []
    stack: list[tuple[int, str, int, list[tuple[int, int]]]] = []
    last = lo
    for m in MARKER.finditer(s, lo, hi):
        if m.start() > lo and s[m.start() - 1] != "\n":
            continue
        indent, mark = len(m.group(1).expandtabs(4)), m.group(2)
        kind, value = (mark, 0) if len(mark) == 1 else ("0" + mark[-1], int(mark[:-1])) if mark[0].isdigit() else (("A" if mark[0].isupper() else "a") + mark[-1], ord(mark[0].lower()) - 96)
        step = int(len(mark) > 1)
        at = next((d for d in range(len(stack) - 1, -1, -1) if stack[d][1] == kind and abs(stack[d][0] - indent) <= 1 and stack[d][2] + step == value), None)
        if at is not None:
            del stack[at + 1 :]
            stack[at] = (indent, kind, value, stack[at][3])
        elif (stack and value <= 1) or m.start() == lo or _after_colon(s, last, m.start()):
            # Where a level of this kind and indentation is open, a new list takes its place.
            again = next((d for d, x in enumerate(stack) if x[1] == kind and abs(x[0] - indent) <= 1), len(stack))
            del stack[again:]
            stack.append((indent, kind, value, []))
            levels.append(stack[-1][3])
        else:
            continue
        stack[-1][3].append((m.start(2), m.end()))
        last = m.end()
    return sorted(x for level in levels if len(level) > 1 for x in level)


def split_blocks(s: str) -> Iterator[tuple[int, int]]:
    """Ranges set off by blank lines, without white space at either end."""
    at = 0
    for m in [*BLANK.finditer(s), None]:
        lo, hi = at, m.start() if m else len(s)
        at = m.end() if m else at
        lo = SPACE.match(s, lo, hi).end()
        while hi > lo and s[hi - 1].isspace():
            hi -= 1
        if lo < hi:
            yield lo, hi


def units(s: str) -> list[tuple[int, int]]:
    """``(start, end)`` of each sentence unit of ``s``, in order."""
    out: list[tuple[int, int]] = []
    for lo, hi in split_blocks(s):
        items = _list_items(s, lo, hi)
        edges = [(lo, lo), *items] if not items or items[0][0] > lo else items
        for (a, body), b in zip(edges, [*(x for x, _ in edges[1:]), hi]):
            while b > a and s[b - 1].isspace():
                b -= 1
            if a < b:
                _block_units(s, a, b, out, min(body, b))
    return out


def distinct_reports(anchors: DataFrame, report: str = "report_id", text: str = "report_content") -> DataFrame:
    """``report_id, report_content``: each report once, with its non-empty content.

    Rows of one report carry the same content; should they differ, the greatest by code unit is taken. Rows without a report
    id are told apart by their content. Copies are dropped within each partition before the shuffle.
    """
    rows = anchors.select(F.col(report).alias("report_id"), F.col(text).alias("report_content")).where("report_content IS NOT NULL AND trim(report_content) <> ''")
    stray = F.when(F.col("report_id").isNull(), F.xxhash64("report_content"))
    return rows.groupBy("report_id", stray.alias("stray")).agg(F.max("report_content").alias("report_content")).drop("stray")


def sentence_units(texts: DataFrame, id_col: str, text: str) -> DataFrame:
    """``id, sent_idx, char_start, char_end``: the units of each row's text, numbered anew from 0."""
    field = texts.select(F.col(id_col).alias("id"), F.col(text).alias("t")).where("t IS NOT NULL")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [units(t) for t in strings(b.column(1))]
            rows = [i for i, u in enumerate(found) for _ in u]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(rows, pa.int32())),
                    pa.array([k for u in found for k in range(len(u))], pa.int32()),
                    pa.array([x for u in found for x, _ in u], pa.int32()),
                    pa.array([x for u in found for _, x in u], pa.int32()),
                ],
                ["id", "sent_idx", "char_start", "char_end"],
            )

    kind = field.schema["id"].dataType.simpleString()
    return field.mapInArrow(run, f"id {kind}, sent_idx int, char_start int, char_end int").withColumnRenamed("id", id_col)


def report_sentences(anchors: DataFrame) -> DataFrame:
    """Sentence units of every report of ``anchors``."""
    return sentence_units(distinct_reports(anchors), "report_id", "report_content")
