import random

import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from attestra.llm import neardup, setjoin
from attestra.llm.components import components

WORD = regex.compile(r"[\p{L}\p{N}]+")


def brute(rows, t):
    sets = [(i, set(WORD.findall(x.lower()))) for i, x in rows if x]
    sets = [(i, s) for i, s in sets if s]
    return sorted((min(i, j), max(i, j)) for n, (i, a) in enumerate(sets) for j, b in sets[:n] if len(a & b) / len(a | b) >= t - 1e-9)


def edited(rng, n):
    vocabulary = [f"w{i}" for i in range(60)] + [f"rare{i}" for i in range(400)]
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.5:
            words = rng.choice(texts).split()
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rng.shuffle(words)
        else:
            words = [rng.choice(vocabulary[: rng.choice([20, 60, 460])]) for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 12, 40, 120, 180]))]
        texts.append(" ".join(words))
    return texts


def frame(spark, rows):
    return spark.createDataFrame(rows, "candidate_id long, text string, id string, toks string, n int, cls int")


def test_pairs_equal_brute_force(spark):
    rows = list(enumerate(edited(random.Random(5), 260)))
    rows += [(1000, None), (1001, ""), (1002, " .. "), (1003, rows[0][1]), (1004, rows[0][1].upper())]
    df = frame(spark, [(i, x, "a", "b", 1, 2) for i, x in rows])
    for t in (0.7, 0.8, 0.9):
        for rare in (128, 4):  # a low limit makes keys of two and three words
            got = sorted(tuple(r) for r in neardup.similar_pairs(df, t=t, rare=rare).collect())
            assert got == brute(rows, t)
    assert neardup.similar_pairs(df.limit(0)).count() == 0


def test_groups(spark):
    same = "alpha beta gamma delta epsilon"
    rows = [(1, same), (2, same + " zeta"), (3, same), (4, "something else"), (5, None), (6, "")]
    got = {r.candidate_id: (r.duplicate_group, r.links) for r in neardup.groups(frame(spark, [(i, x, "", "", 0, 0) for i, x in rows])).collect()}
    assert got == {1: ("g1", 2), 2: ("g1", 2), 3: ("g1", 2), 4: (None, 0), 5: (None, 0), 6: (None, 0)}
    assert neardup.groups(frame(spark, [])).count() == 0


def test_components(spark):
    path = [(i, i + 1) for i in range(1, 40)] + [(100, 7), (200, 201), (201, 200), (300, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 1, 200: 200, 201: 200}


def test_ring_prunes_before_the_whole_distance(spark):
    rows = list(enumerate(edited(random.Random(6), 300)))
    sets = setjoin.prepare(frame(spark, [(i, x, "", "", 0, 0) for i, x in rows]), "candidate_id", "text")[1]
    keys = setjoin.checkpoint(setjoin.key_rows(sets, 0.7, rare=4))
    met = neardup.met(keys, 0.7)
    kept = met.where(neardup.ring(0.7))
    similar = {(r.a, r.b) for r in neardup.class_pairs(sets, 0.7).collect()}
    n, left = met.count(), kept.selectExpr("x.cls AS a", "y.cls AS b").collect()
    assert 0 < len(left) < n  # pairs dropped by the ring alone
    assert similar <= {(r.a, r.b) for r in left}
    assert met.where(neardup.ring(0.7, 1)).count() >= len(left)  # a longer chain drops more


def test_rows_are_kept_without_their_words(spark):
    rows, sets = setjoin.prepare(frame(spark, [(1, "one two", "", "", 0, 0), (2, "two ONE", "", "", 0, 0), (3, "one", "", "", 0, 0)]), "candidate_id", "text")
    assert rows.columns == ["id", "k1", "k2"] and rows.count() == 3
    assert sorted((r.cls, r.n, len(r.toks)) for r in sets.collect()) == [(1, 2, 2), (3, 1, 1)]


def test_the_sketch_reaches_the_driver_packed(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    b = rng.permutation(np.flatnonzero(rng.random(1 << 16) < 0.1)).astype(np.int32)
    c = rng.geometric(0.2, len(b)).astype(np.int64)
    c[0] = np.iinfo(np.int32).max
    data = setjoin.pack(b, c)
    assert len(data) < 3 * len(b)
    got = setjoin.unpack(data)
    assert dict(zip(*(x.tolist() for x in got))) == dict(zip(b.tolist(), c.tolist()))
    sets = spark.range(300).selectExpr("array(id % 7, id + 10, -id - 1) AS toks")
    want = np.zeros(1 << 12, np.int32)
    np.add.at(want, np.array([w for r in sets.collect() for w in r.toks]) & 4095, 1)
    assert (setjoin.sketch(sets, 12) == want).all() and not setjoin.sketch(sets.limit(0), 12).any()


def test_shuffle_files_go_before_the_check(spark):
    import time

    def files():
        return spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(",").count("shuffle_")

    rows = list(enumerate(edited(random.Random(7), 80)))
    df, before = frame(spark, [(i, x, "", "", 0, 0) for i, x in rows]), files()
    neardup.class_pairs(setjoin.prepare(df, "candidate_id", "text")[1])
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.2)
    assert files() <= before


def test_a_rare_word_is_one_key_and_a_word_of_one_set_none():
    import numpy as np

    flat, lengths = np.arange(40, dtype=np.int64) + 1000, np.array([40])  # in two bands for t = 0.7
    for often, least in ((2, 15), (1, 0)):
        doc, key, size = setjoin.segment_keys(flat, np.full(40, often, np.int32), lengths, 0.7, None)
        assert len(key) == len(set(key.tolist())) == least and (size == 1).all() and not doc.any()


@given(st.lists(st.integers(0, 9), min_size=8, max_size=8), st.integers(0, 40), st.integers(1, 8))
def test_ring_keeps_every_pair_within_the_budget(d, budget, chain):
    viable = any(all(8 * sum(d[(i + k) % 8] for k in range(n)) <= n * budget for n in range(1, chain + 1)) for i in range(8))
    assert viable or sum(d) > budget


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 90), min_size=1, max_size=80), min_size=2, max_size=12), st.sampled_from([0.5, 0.7, 0.75, 0.9]), st.sampled_from([0, 1, 500]))
def test_similar_sets_share_a_key(sets, t, common):
    import numpy as np

    sets += [s ^ {min(s)} | {95} for s in sets]
    flat = np.array([hash(("w", x)) for s in sets for x in sorted(s)], np.int64)
    lengths = np.array([len(s) for s in sets])
    counts = np.zeros(1 << setjoin.SKETCH_BITS, np.int32)
    np.add.at(counts, flat & (len(counts) - 1), common)
    ordered, freq = setjoin.rare_first(flat, lengths, counts)
    full = np.zeros(1 << 8, bool)
    full[::2] = True
    for pairs in (full, None):
        doc, key, _ = setjoin.segment_keys(ordered, freq, lengths, t, pairs, 3)
        of = [set(key[doc == i].tolist()) for i in range(len(sets))]
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if len(a & b) / len(a | b) >= t:
                    assert of[i] & of[j]
