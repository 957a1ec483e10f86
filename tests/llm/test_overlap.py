import random

from attestra.llm import overlap
from tests.llm.test_neardup import brute, edited

SCHEMA = "sample_id long, split string, source string, event_id string, claim string, id int, train string, event string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA)


def test_pairs_equal_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice(["train", "Train", " train ", "test", "VAL"]), rng.choice(["a", None]), rng.choice([None, f"ev-{rng.randrange(60)}", f" EV-{rng.randrange(60)}.JSON"]), x) for i, x in enumerate(edited(rng, 220))]
    rows += [(900, None, "a", "ev-1", rows[0][4]), (901, "train", "a", "ev-x", None), (902, "test", "a", "EV-X.json", None), (903, "dev", "a", None, ""), (904, "train", "a", "zz", rows[1][4]), (905, "test", "a", None, rows[1][4])]
    side = {r[0]: r[1].strip().lower() == "train" for r in rows if r[1]}
    key = lambda e: e.strip().lower().removesuffix(".json")
    want = {p for p in brute([(r[0], r[4]) for r in rows if r[1]], 0.75) if side[p[0]] != side[p[1]]}
    want |= {(min(x[0], y[0]), max(x[0], y[0])) for x in rows for y in rows if x[1] and y[1] and side[x[0]] and not side[y[0]] and x[3] and y[3] and key(x[3]) == key(y[3])}
    df = frame(spark, rows)
    got = [tuple(r) for r in overlap.found(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    report = overlap.report(df).collect()
    assert sum(r.pairs for r in report) == len(want) and sum(r.rows for r in report) == sum(not s for s in side.values())


def test_spans_cover_what_is_shared(spark):
    a = "one two three four five six seven eight nine ten eleven twelve"
    b = a.replace("seven", "seventy")
    rows = [(1, "train", "s", "e1", a), (2, "test", "s", "e2", b), (3, "test", "s", "e3", a), (4, "train", "s", "e4", "others"), (5, "dev", "s", "e5", "nothing alike here")]
    df = frame(spark, rows)
    got = {(r.train_id, r.eval_id): (r.covered, round(r.similarity, 6)) for r in overlap.overlaps(df).collect()}
    assert got == {(1, 2): (11, round(11 / 13, 6)), (1, 3): (12, 1.0)}
    assert {r.sample_id: (r.words, r.covered, r.train_records) for r in overlap.coverage(df).collect()} == {2: (12, 11, 1), 3: (12, 12, 1)}
    report = {r.split: (r.similar_rows, r.words, r.covered_words) for r in overlap.report(df).collect()}
    assert report == {"test": (2, 24, 23), "dev": (0, 0, 0)}
    spans = overlap.claim_links(overlap.sides(df))[0].where("a <> b").first().spans
    assert sum(s.n for s in spans) == 11 and len(spans) <= 3


def test_empty(spark):
    df = frame(spark, [])
    assert overlap.found(df).count() == 0 and overlap.report(df).count() == 0
