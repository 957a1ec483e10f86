import random

import pytest

from attestra.llm.splitting import LIMIT, OVERLAP, RangeMax, cut, oversized, pieces, strengths


def test_range_max_takes_the_rightmost():
    import numpy as np

    rng = random.Random(1)
    s = np.array([rng.randrange(4) for _ in range(200_000)], np.int8)
    index = RangeMax(s, 300)
    for _ in range(500):
        lo = rng.randrange(len(s) - 301)
        hi = lo + rng.randrange(300)
        part = s[lo : hi + 1]
        assert index.best(lo, hi) == (lo + max(i for i, v in enumerate(part) if v == part.max()), part.max())


@pytest.mark.parametrize("text", ["word " * 900, "x" * 5000, " " * 4000, "A sentence here. " * 300, "para one.\n\n" * 400, "é" * 4000, "日本語の文。" * 700])
def test_pieces_rebuild_the_text(text):
    ranges, found = cut(text)
    out, before = "", 0
    for k, (lo, hi) in enumerate(ranges):
        assert hi - lo <= LIMIT and 0 <= before - lo <= OVERLAP * bool(k)
        out += text[before:hi]
        before = hi
    assert out == text


def test_cuts_fall_between_sentences_and_keep_marks():
    text = "This is a plain sentence of words. " * 200
    ranges, found = cut(text)
    starts = {a for a, _ in found}
    assert all(hi in starts for _, hi in ranges[:-1]) and all(lo in starts for lo, _ in ranges)
    marks = "é" * 3000
    assert all(hi % 2 == 0 for _, hi in cut(marks)[0])
    assert len(strengths(text, found)) == len(text) + 1


def test_limit_must_exceed_overlap():
    with pytest.raises(ValueError):
        cut("x" * 100, 20, 10)


def test_tables(spark):
    long = "One sentence. " * 200
    anchors = spark.createDataFrame([("r1", long), ("r1", long), ("r2", "x" * 1500), ("r3", None), ("r4", "")], "report_id string, report_content string")
    renders = spark.createDataFrame([(7, long, "S0"), (8, "short", None), (9, None, "x")], "render_id long, text string, span string")
    rows = pieces(oversized(anchors, renders)).collect()
    assert {(r.origin, r.item_key) for r in rows} == {("report", "r1"), ("render", "7")}
    first = next(r for r in rows if r.origin == "report" and r.piece_idx == 0)
    assert first.span.startswith("S00-S") and first.sentence_count == int(first.span[5:]) + 1 and first.repeated == 0
    assert pieces(oversized(anchors.limit(0), renders.limit(0))).count() == 0
