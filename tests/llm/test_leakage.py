from attestra.llm import leakage

LONG = " ".join(f"word{i}" for i in range(20))


def frames(spark, docs, items):
    return spark.createDataFrame([(*r, "c", 1) for r in docs], "doc_id long, text string, t string, item int"), spark.createDataFrame(items, "item_id long, text string")


def test_hits_and_offsets(spark):
    items = [(1, LONG), (2, "Short one-liner!"), (3, None), (4, " .. "), (5, LONG), (6, "word5 word6 word7 word8 word9 word10 word11 word12 word13 word14 word15 word16 other")]
    wide = "".join(chr(ord(c) + 0xFEE0) if c.isascii() and c.isalnum() else c for c in "short")
    docs = [
        (1, "intro " + LONG.upper().replace(" ", " - ") + " end"),
        (2, " ".join(LONG.split()[:11])),
        (3, "xshort one liner"),
        (4, f"a {wide}​  ONE\nliner b"),
        (5, None),
        (6, ""),
        (7, " ".join(LONG.split()[3:17])),
        (8, "short one"),
        (9, "liner"),
    ]
    d, i = frames(spark, docs, items)
    rows = {(r.doc_id, r.item_id): r for r in leakage.leaks(d, i).collect()}
    assert set(rows) == {(1, 1), (1, 5), (1, 6), (4, 2), (7, 1), (7, 5), (7, 6)}
    span = rows[4, 2].spans[0]
    assert docs[3][1][span.char_start : span.char_end] == f"{wide}​  ONE\nliner"
    (s,) = rows[1, 1].spans
    assert docs[0][1][s.char_start : s.char_end].lower().replace(" - ", " ") == LONG


def test_patterns_in_blocks_give_the_same(spark, monkeypatch):
    d, i = frames(spark, [(1, "x " + LONG + " y"), (2, "nothing")], [(1, LONG), (2, LONG + " tail")])
    whole = {(r.doc_id, r.item_id, r.chars) for r in leakage.leaks(d, i).collect()}
    monkeypatch.setattr(leakage, "BLOCK_PATTERN_CHARS", 200)
    monkeypatch.setattr(leakage.pattern_blocks, "__defaults__", (200,))
    assert {(r.doc_id, r.item_id) for r in leakage.leaks(d, i).collect()} == {(a, b) for a, b, _ in whole}


def test_join_of_runs_gives_the_same(spark):
    items = [(1, LONG), (2, "Short one-liner!"), (3, None), (4, " .. "), (5, LONG), (6, "word5 word6 word7 word8 word9 word10 word11 word12 word13 word14 word15 word16 other"), (7, "İstanbul calls")]
    docs = [(1, "intro " + LONG.upper().replace(" ", " - ") + " end " + LONG), (2, " ".join(LONG.split()[:11])), (3, "a short  ONE\nliner b"), (4, None), (5, " ".join(LONG.split()[3:17])), (6, "i stanbul calls"), (7, "x")]
    d, i = frames(spark, docs, items)
    plain = lambda df: {(r.doc_id, r.item_id): ([tuple(s) for s in r.spans], r.chars) for r in df.collect()}
    scanned, joined = plain(leakage.leaks(d, i)), plain(leakage.leaks(d, i, broadcast_chars=0))
    assert scanned == joined and {(1, 1), (5, 6), (3, 2), (6, 7)} <= set(scanned) and len(scanned[1, 1][0]) == 2
    assert leakage.leaks(d, i.where("item_id = 4"), broadcast_chars=-1).count() == 0


def test_empty(spark):
    d, i = frames(spark, [(1, LONG)], [(1, LONG)])
    for limit in (leakage.BROADCAST_CHARS, -1):
        assert leakage.leaks(d.limit(0), i, broadcast_chars=limit).count() == 0
        assert leakage.leaks(d, i.limit(0), broadcast_chars=limit).columns == ["doc_id", "item_id", "spans", "chars"]
        assert leakage.leaks(d, i.limit(0), broadcast_chars=limit).count() == 0
