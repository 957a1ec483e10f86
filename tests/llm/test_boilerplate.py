from attestra.llm import boilerplate as B

SENTENCES = "row_id long, report_id string, domain string, text string, fetched_at timestamp, dom string, line string, h1 string"
ANCHORS = "anchor_id long, domain string, source_sentence string, report_content string"


def frames(spark):
    import datetime as dt

    day = lambda n: dt.datetime(2024, 1, n)
    rows, k = [], 0
    for r in range(6):
        for text in ("Share this, 12 times!", f"own line {'abcdef'[r]}"):
            rows.append((k, f"r{r}", "www.A.example" if r % 2 else "a.example", text, day(r + 1), "x", "y", "z"))
            k += 1
    rows += [(100, "r0", "a.example", "Share this 9 times", day(1), "", "", ""), (101, None, "a.example", "share THIS 1 times", None, "", "", ""), (102, "r9", None, "share this 1 times", None, "", "", "")]
    rows += [(103, "r1", "b.example", "share this 1 times", None, "", "", ""), (104, "r1", "a.example", None, None, "", "", ""), (105, "r1", "a.example", " .. ", None, "", "", "")]
    # Seven copies of one article: its lines recur in seven reports of one cluster.
    rows += [(200 + i, f"c{i}", "c.example", "republished line", day(3), "", "", "") for i in range(7)]
    anchors = [(1, "A.example", "Share this 3 times", "Text.\n\nshare this, 4 times\n\nEnd."), (2, None, "Share this 3 times", None), (3, "a.example", None, "Share this 1 times"), (4, "a.example", "other", "")]
    return spark.createDataFrame(rows, SENTENCES), spark.createDataFrame(anchors, ANCHORS)


def test_found(spark):
    s, a = frames(spark)
    got = {(r.origin, r.row_id) for r in B.repeated_rows(s, a).collect()}
    assert got == {("sentence_items", i) for i in [0, 2, 4, 6, 8, 10, 100, 101, *range(200, 207)]} | {("anchors", 1)}
    assert B.repeated_rows(s.limit(0), a).count() == 0


def test_clusters_and_dates(spark):
    s, _ = frames(spark)
    lines = {r.line: r for r in B.line_list(s, B.repeated_lines(s)).collect()}
    assert (lines["share this 0 times"].n_reports, lines["share this 0 times"].n_clusters, lines["share this 0 times"].n_dates) == (6, 6, 6)
    assert (lines["republished line"].n_reports, lines["republished line"].n_clusters, lines["republished line"].n_dates) == (7, 1, 1)
    assert {r.line for r in B.line_list(s, B.repeated_lines(s, min_clusters=2)).collect()} == {"share this 0 times"}


def test_removal(spark):
    s, a = frames(spark)
    lines = B.boilerplate_lines(s)
    left = B.strip_sentences(s, lines)
    # The lines of the republished article (200 to 206) stay: they are in one cluster.
    assert left.columns == s.columns and {r.row_id for r in left.collect()} == {1, 3, 5, 7, 9, 11, 102, 103, 104, 105, *range(200, 207)}
    more = [(5, "a.example", "x", "Body text.\nShare this 2 now\nshare this 7\nMore."), (6, "a.example", "x", "share this 1\nshare this 2\n\nEnd."), (None, "a.example", "x", "share this 1"), (7, "a.example", "x", "share\nthis 12\n\nb")]
    got = {r.anchor_id: (r.source_sentence, r.report_content) for r in B.strip_reports(a.unionByName(spark.createDataFrame(more, ANCHORS)), lines).collect()}
    assert got[5] == ("x", "Body text.\nShare this 2 now\nshare this 7\nMore.")  # not these lines: other words
    assert {k: got[k] for k in (1, 2, 3, 4)} == {1: (None, "Text.\n\nEnd."), 2: ("Share this 3 times", None), 3: (None, ""), 4: ("other", "")}
    assert got[None] == ("x", "share this 1")
    wrapped = [(1, "a.example", "y", "Body.\nShare this 2 times\nMore."), (2, "a.example", "y", "share\nthis 12 times\n\nb"), (3, "a.example", "y", "Share this 1 times\nshare this 2 times\n\nEnd.")]
    got = {r.anchor_id: r.report_content for r in B.strip_reports(spark.createDataFrame(wrapped, ANCHORS), lines).collect()}
    assert got == {1: "Body.\nMore.", 2: "b", 3: "End."}
