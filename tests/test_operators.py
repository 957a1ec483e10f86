import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from attestra.functions import text as T
from attestra.functions import vectors as V
from attestra.operators import chunking as C
from attestra.operators import chains, cover, joins, learners, metrics, pools, ranking, scoring
from attestra.operators import selection as S


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_text_functions(spark):
    say = lambda e: one(spark, e)
    assert say(T.clean_text(F.lit(" a b\n\tc "))) == "a b c"
    assert say(T.split_sentences(F.lit("Dr. No came at 5 p.m. It rained. e.g. this? \"Yes\" (1) ok"))) == ["Dr. No came at 5 p.m.", "It rained. e.g. this?", "\"Yes\" (1) ok"]
    assert say(T.split_sentences(F.lit(""))) == []
    assert say(T.content_tokens(F.lit("The U.S. isn't at x_1 literally"))) == ["u", "s", "isn't", "x_1"]
    assert say(T.word_tokens(F.lit("50% of $3 é"))) == ["50%", "of", "$3"]
    assert say(T.jaccard(F.array(), F.array())) == 1.0
    assert say(T.normalize_number(F.lit(" $1,200.00 "))) == "1200" and say(T.normalize_decade(F.lit("the 90s"))) == "1990s" and say(T.normalize_decade(F.lit("x"))) is None
    assert say(T.source_domain(F.lit(None).cast("string"), F.lit("https://A.example:80/x?y"))) == "a.example:80"
    six = ["pants-fire", "false", "barely-true", "half-true", "mostly-true", "true"]
    for text, want in (("Label: C", 2), (" b ", 1), ("label: Mostly True", 4), ("I think half-true fits", 3), ("nothing", -1), (None, -1)):
        assert say(T.parse_label(F.lit(text).cast("string"), six)) == want
    assert say(T.parse_evidence_block(T.evidence_block(F.array(F.lit("a"), F.lit("b c"))))) == ["a", "b c"]
    chat = "<|im_start|>system\nBe brief.<|im_end|>\n<|im_start|>user\nHi\nyou<|im_end|>\n<|im_start|>assistant\n"
    assert [tuple(m) for m in say(T.chat_messages(F.lit(chat)))] == [("system", "Be brief."), ("user", "Hi\nyou")]


def test_vector_functions(spark):
    say = lambda e: one(spark, e)
    arr = lambda *x: F.array(*(F.lit(float(v)) for v in x))
    assert say(V.cosine(arr(1, 0), arr(1, 0, 0))) == 0 and say(V.cosine(arr(3, 4), arr(3, 4))) == pytest.approx(1) and say(V.cosine(arr(0, 0), arr(1, 1))) == 0
    assert say(V.softmax(arr(0, 0))) == [0.5, 0.5] and say(V.entropy(arr(1, 0))) == 0 and say(V.argmax(arr(1, 3, 3))) == 1
    assert say(V.margin(arr(5))) == 0 and say(V.margin(arr(1, 4, 2))) == 2
    assert say(V.sparsemax(arr(2, 0, 0))) == [1, 0, 0] and say(V.sparsemax(arr(0.5, 0.5, -9))) == pytest.approx([0.5, 0.5, 0])
    assert say(V.gini(arr(0, 0))) == 0 and say(V.gini(arr(1, 1))) == 0 and say(V.gini(arr(0, 1))) == 0.5
    assert say(V.coral_decode(arr(1, 0.1, -2))) == 2


def test_minmax_rrf_and_topk(spark):
    df = spark.createDataFrame([("e", 1, 1.0), ("e", 2, 3.0), ("f", 3, 5.0), ("f", 4, 5.0)], "g string, i int, s double")
    assert {r.i: r.mm_s for r in ranking.minmax(df, ["g"], ["s"]).collect()} == {1: 0.0, 2: 1.0, 3: 0.0, 4: 0.0}
    assert [r.i for r in ranking.top_k(df, ["g"], [F.desc("s"), F.asc("i")], 1).orderBy("g").collect()] == [2, 3]
    routes = spark.createDataFrame([("e", "k", "A1", 1, 0.5, 10), ("e", "k", "A2", 1, 0.9, 11), ("e", "z", "A1", 2, 0.1, 12)], "g string, key string, route string, rank int, score double, idx int")
    r = {x.key: x for x in ranking.rrf(routes, ["g"], "key", "route", "rank", "score", "idx").collect()}
    assert r["k"].hits == 2 and r["k"].idx == 11 and r["k"].rrf == pytest.approx(2 / 61, abs=1e-9)
    assert ranking.top_k(df.limit(0), ["g"], [F.asc("i")], 3).count() == 0


def test_lexical_scores_by_hand(spark):
    q = spark.createDataFrame([("e", "tax tax rise")], "g string, claim string")
    c = spark.createDataFrame([("e", 1, "tax rise rise now"), ("e", 2, "nothing"), ("e", 3, "")], "g string, i int, text string")
    got = {r.i: r for r in scoring.lexical_scores(q, c, ["g"], ["i"]).collect()}
    assert got[1].lex == pytest.approx(2 * (2 / 4) * (2 / 3) / (2 / 4 + 2 / 3)) and got[2].lex == got[3].lex == 0
    idf = lambda tf: math.log(1 + 1 / (1 + tf)) + 0.5
    den = lambda tf: tf + 1.2 * (0.25 + 0.75 * 4 / 18)
    assert got[1].bm25 == pytest.approx(idf(1) * 2.2 / den(1) + idf(2) * 4.4 / den(2))


def test_chunking(spark):
    s = spark.createDataFrame([("d", "A one. A  ONE. B two. C three."), ("e", ""), ("f", None)], "k string, text string")
    w = {r.idx: (r.chunk, r.members) for r in C.context_windows(C.sentence_arrays(s, ["k"], "text"), ["k"], 1).collect()}
    assert [(r.k, r.chunk, r.sentences) for r in C.raw_chunks(C.sentence_arrays(s, ["k"], "text"), ["k"]).collect()] == [("d", "A one. A ONE. B two. C three.", 4)]
    assert w[0] == ("A one.", [0]) and w[1] == ("A one. B two.", [0, 2]) and w[3] == ("B two. C three.", [2, 3])
    e = spark.createDataFrame([("d", 0, [1.0, 0.0]), ("d", 1, [1.0, 0.0]), ("d", 2, [0.0, 1.0]), ("d", 3, [0.0, 1.0])], "k string, idx int, v array<double>")
    assert [r.chunk for r in C.semantic_chunks(e, ["k"], "idx", "v", 0.7).orderBy("idx").collect()] == [0, 0, 1, 1]
    assert [(r.first, r.last, r.chunk) for r in C.context_semantic_chunks(e, ["k"], "idx", "v", 2, 0.7).orderBy("window").collect()] == [(0, 1, 0), (2, 3, 1)]
    spans = C.claim_aware_spans(np.array([0.9, 0.8, 0.1, 0.0]), np.array([0.9, 0.1, 0.9]), [False] * 4, [20] * 4)
    assert spans == [(0, 1), (2, 3)]
    assert C.claim_aware_spans(np.array([0.1] * 6), np.array([0.9] * 5), [False] * 6, [50] * 6, max_tokens=100) != [] and C.claim_aware_spans(np.array([]), np.array([]), [], []) == []
    covered = [i for a, b in C.claim_aware_spans(np.linspace(0, 1, 30), np.cos(np.arange(29)), [False] * 30, [9] * 30) for i in range(a, b + 1)]
    assert covered == list(range(30))
    g = spark.createDataFrame([("q", "d", 9), ("r", "none", 0), ("s", "e", 0)], "id string, k string, sent_idx int")
    got = {r.id: r for r in C.windowed_evidence(g, s, "k", "text", 1).collect()}
    assert got["q"].clamped and got["q"].evidence == "B two. C three." and got["r"].evidence is None and got["s"].evidence is None


def test_mmr_rules():
    score, sim = np.array([1.0, 0.9, 0.5]), np.array([[1, 0.95, -0.5], [0.95, 1, 0], [-0.5, 0, 1.0]])
    assert S.mmr(score, sim, 2, 0.5) == [0, 2] and S.mmr(score, sim, 3, 0.5) == [0, 1, 2] and S.mmr(score, sim, 5) == [0, 1, 2]
    assert S.mmr(np.array([]), np.zeros((0, 0)), 3) == [] and S.mmr(np.array([1.0, 1.0, 1.0]), np.eye(3), 2) == [0, 1]
    # Unlikeness is not rewarded: with the gain capped at 0 the better score wins.
    assert S.mmr(np.array([1.0, 0.6, 0.55]), np.array([[1, 0, -1], [0, 1, 0], [-1, 0, 1.0]]), 2, 0.5) == [0, 1]
    assert S.mmr(score, sim, 2, [1.0, 1.0]) == [0, 1]


def candidates(rows):
    base = dict(atoms=[], relation="background", directness_name="none", dup="", source="", key="", base=0.0, quality=0.5, cost=5, directness=0.0, polarity=0.0, background=0.0, confidence=0.5)
    return pd.DataFrame([base | {"key": str(i)} | r for i, r in enumerate(rows)])


POOL = [
    dict(relation="background", base=0.9),
    dict(atoms=["A1"], relation="support", directness_name="direct", dup="g", base=0.8, quality=0.9),
    dict(atoms=["A1"], relation="support", directness_name="direct", dup="g", base=0.7, quality=0.9),
    dict(atoms=["A2"], relation="refute", directness_name="direct", base=0.6, quality=0.8),
    dict(atoms=["A1"], relation="refute", directness_name="direct", base=0.5, quality=0.7),
]


def test_resolving_chain():
    steps, states, reason = S.resolving_chain(candidates(POOL), {"A1": 1.0, "A2": 1.0}, target=1.0)
    assert [(s.at, s.step) for s in steps] == [(1, "OPEN"), (3, "OPEN")] and states == {"A1": "S", "A2": "R"} and reason == "target_resolved"
    steps, states, _ = S.resolving_chain(candidates(POOL), {"A1": 1.0, "A2": 1.0}, target=1.0, contrast_after=True)
    assert [s.step for s in steps] == ["OPEN", "OPEN", "CONTRAST"] and states["A1"] == "C"
    assert S.resolving_chain(candidates(POOL), {"A1": 1.0, "A2": 1.0}, budget=7)[2] == "token_budget"
    assert S.resolving_chain(candidates(POOL[:1]), {"A1": 1.0})[2] == "no_transition"
    for state, relation, direct, want in (("U", "support", "direct", ("OPEN", "S")), ("S", "support", "direct", ("CORROBORATE", "S")), ("S", "refute", "x", ("CONTRAST", "C")), ("R", "mixed", "x", ("CONTRAST", "Q")), ("U", "background", "none", ("BRIDGE", "U")), ("C", "support", "direct", ("FALLBACK", "C"))):
        assert S.transition(state, relation, direct) == want


def test_chains():
    g = chains.Graph(candidates(POOL))
    # By hand: base, coverage, direct, ties of the pair, less repeats and background.
    assert g.score([1, 3]) == pytest.approx(0.45 * 0.7 + 0.35 + 0.15 + 0.12)
    assert g.score([2, 1]) == pytest.approx(0.45 * 0.75 + 0.35 / 2 + 0.15 + 0.08 - 0.25 / 2)
    assert g.score([1, 4]) == pytest.approx(0.45 * 0.65 + 0.35 / 2 + 0.15 + 0.08)
    assert g.score([0, 1]) == pytest.approx(0.45 * 0.85 + 0.35 / 2 + 0.15 / 2 - 0.15 / 2)
    assert {k: np.argwhere(np.triu(m)).tolist() for k, m in g.ties.items()} == {"duplicate": [[1, 2]], "complements": [[1, 3], [2, 3], [3, 4]], "corroborates": [[1, 2]], "tension": [[1, 4], [2, 4]], "bridge": []}
    assert g.extensions([1], 9) == [2, 3, 4] and g.extensions([0], 2) == [1, 2]
    assert g.beam(12, 2)[0][0] == max(g.score(p) for p in itertools.combinations(range(5), 2))
    # Order of [1, 3]: both atoms new, early directness, atoms in order, complements side by side.
    assert g.order_score([1, 3]) == pytest.approx(1 + 0.5 + 0.35 * 1.5 + 0.15 + 0.35) and g.order_score([3, 1]) == pytest.approx(1 + 0.5 + 0.35 * 1.5 - 0.35 + 0.35)
    best = g.best_order([3, 1, 4, 0])
    assert best[-1] == 0 and g.order_score(best) == max(g.order_score(o) for o in itertools.permutations([0, 1, 3, 4]))
    lone = chains.Graph(candidates(POOL[:1]))
    assert lone.beam() == [(pytest.approx(0.45 * 0.9 - 0.15), [0])] and lone.best_order([0]) == [0]


def test_edges(spark):
    rows = [("e", 1, "k1", "", "s", ["A"], "support", "S", True, False, 1), ("e", 2, "k2", "", "s", [], "background", "U", False, True, 4), ("e", 3, "k3", "", "t", ["A", "B"], "support", "S", False, True, 9), ("e", 4, "k4", "", "u", ["A"], "mixed", "Q", True, False, None)]
    df = spark.createDataFrame(rows, "ev string, id int, key string, dup string, source string, atoms array<string>, relation string, side string, direct boolean, background boolean, place int")
    got = {(r.a, r.b, r.kind): round(r.weight, 4) for r in pools.evidence_edges(df, "ev").collect()}
    assert got == {(1, 2, "bridge"): 0.55, (1, 2, "same_source"): 0.45, (1, 3, "complements"): 0.725, (1, 3, "corroborates"): 0.75, (1, 3, "bridge"): 0.55, (1, 4, "tension"): 0.85, (3, 4, "complements"): 0.725, (3, 4, "tension"): 0.85, (3, 4, "bridge"): 0.55}


def test_step_selectors():
    c = candidates(POOL)
    atoms = {"A1": 1.0, "A2": 1.0}
    assert [i for i, _ in S.set_cover(list(c["atoms"]), atoms, 5)] == [1, 3] and S.minimal_group(list(c["atoms"]), [1, 2, 3]) == [1, 3]
    order = [i for i, _ in S.slot_greedy(c, 5)]
    assert sorted(order) == [0, 1, 2, 3, 4] and order[-1] in (2, 4)
    assert [r for _, r in S.rule_steps(c, least=4)][:3] == ["P1", "P1", "P2"]
    chosen, share, against = S.sufficiency_chain(c, atoms)
    assert chosen == [1, 3] and share == 1.0 and against
    assert [(i, r) for i, _, r in S.atom_order(c, ["A1", "A2"], 4)] == [(1, "primary"), (4, "opposing"), (3, "primary"), (0, "fallback")]
    assert S.marginal_greedy(c, atoms)[0][0] == 1 and S.budgeted_chain(c)[0][0] in range(5)
    assert S.constrained_likelihood([0.5, 0.9, 0.89], ["a", "b", "b"], ["x", "y", "y"], 1, 3) == [0, 1, 2]
    assert S.state_budget([10, 10, 10, 10], [1, 2, 2, 2], 100, patience=1) == 2 and S.state_budget([50, 60], [1, 2], 100) == 1 and S.state_budget([], [], 5) == 0
    sim = np.array([[1, 0.9, 0.1], [0.9, 1, 0.1], [0.1, 0.1, 1]])
    assert S.factions(sim, 0.5, 1, 5) == [[0, 1], [2]] and S.factions(sim, 0.95, 1, 2) == [[0, 1], [2]] and len(S.factions(sim, 0.05, 3, 5)) == 3
    assert S.one_per_faction([[0, 1], [2]], 3) == [0, 2, 1]
    assert S.sensitivity_gate(np.array([1.0, 0.9]), np.eye(2), 5)[0] == 0.7 and S.sensitivity_gate(np.ones(8), np.eye(8), 3)[0] == 0.7


def test_exact_cover_equals_brute_force():
    rng = random.Random(7)
    for _ in range(150):
        atoms, n = rng.randint(1, 4), rng.randint(0, 6)
        items = [cover.Item(f"k{i}", tuple(rng.choice([0, 0, 1, 2]) for _ in range(atoms)), rng.randint(0, 9)) for i in range(n)]
        weights, k, budget = tuple(rng.randint(1, 4) for _ in range(atoms)), rng.randint(0, 4), rng.choice([None, 5, 12])
        got, want = cover.solve(items, weights, k, budget), cover.brute_force(items, weights, k, budget)
        assert (got.utility, got.time, len(got.keys), got.cost) == (want.utility, want.time, len(want.keys), want.cost)
        assert cover.replay(items, weights, got, k, budget) and cover.objective(got) == cover.objective(want)
        filled = cover.soft_fill(items, got.keys, 3, budget)
        assert filled[: len(got.keys)] == got.keys and len(set(filled)) == len(filled)
    assert not cover.replay([], (1,), cover.Answer(1, 1, 1, ("x",)), 3)


def test_pools(spark):
    base = spark.createDataFrame([("e", "shared", 1, 0.9), ("e", "base", 2, 0.8)], "g string, key string, brk int, h double")
    routes = spark.createDataFrame([("e", "shared", 1, 0.03), ("e", "atom only", 2, 0.02)], "g string, key string, rrk int, r double")
    u = pools.union_pools(base, routes, ["g"], "key")
    assert {(r.key, r.in_base, r.in_routes) for r in u.collect()} == {("shared", True, True), ("base", True, False), ("atom only", False, True)}
    assert [r.key for r in pools.interleave(u, ["g"], "brk", "rrk", "key", 3).orderBy("rank").collect()] == ["shared", "base", "atom only"]
    rows = spark.createDataFrame([("e", i, 30) for i in range(1, 6)], "g string, rank int, cost int")
    assert pools.prefix_budget(rows, ["g"], "rank", "cost", F.lit(60)).where("chosen").count() == 2
    assert pools.prefix_budget(rows, ["g"], "rank", "cost", F.lit(45)).where("chosen").count() == 1  # both 15 away: below the target wins
    assert pools.prefix_budget(rows, ["g"], "rank", "cost", F.lit(-50)).where("chosen").count() == 1
    toks = spark.createDataFrame([("e", 1, ["a"] * 3), ("e", 2, ["b"] * 3), ("e", 3, ["c"])], "g string, rank int, t array<string>")
    assert [r.t for r in pools.fit_budget(toks, ["g"], "rank", "t", F.lit(5)).orderBy("rank").collect()] == [["a"] * 3, ["b"] * 2]


def test_metrics(spark):
    order = spark.createDataFrame([("e", x, o, p) for x, o, p in ((4, 1, 2), (2, 2, 1), (7, 3, 3), (1, 4, 4), (11, 5, 5))], "g string, item int, oracle int, pred int")
    m = metrics.ordered_selection(order, ["g"], 5).first()
    assert m.recall == m.jaccard == 1 and m.top1 == 0 and m.prefix2 == 0 and m.order_acc == pytest.approx(0.9) and m.pairs == 10 and 0 < m.ndcg < 1
    p = spark.createDataFrame([("s", 0, 0), ("s", 1, -1), ("s", 2, 5), ("s", -1, 3)], "g string, gold int, pred int")
    labels = spark.createDataFrame([("s", i) for i in range(6)], "g string, label int")
    c = metrics.classification(p, ["g"], labels).first()
    assert c.rows == 3 and c.accuracy == pytest.approx(1 / 3) and c.parse_errors == pytest.approx(1 / 3) and c.mae == 1.5 and c.extreme == 0.5 and c.macro_f1 == pytest.approx(1 / 6)
    s = spark.createDataFrame([("g", 0.9, True), ("g", 0.9, False), ("g", 0.1, False), ("g", 0.5, True)], "g string, s double, y boolean")
    r = metrics.roc_auc(s, ["g"], "s", "y").first()
    assert r.auc == pytest.approx((0.5 + 1 + 0 + 1) / 4)
    assert metrics.mcnemar(0, 0) == 1 and metrics.mcnemar(0, 5) == pytest.approx(2 / 32) and metrics.mcnemar(3, 3) == 1
    for b, k in ((0, 0), (0, 5), (2, 9), (40, 60)):
        assert one(spark, metrics.mcnemar_column(F.lit(b), F.lit(k))) == pytest.approx(metrics.mcnemar(b, k))
    h = spark.createDataFrame([("g", 1, 0.01), ("g", 2, 0.04), ("g", 3, 0.03), ("g", 4, 0.9)], "g string, i int, p double")
    assert {x.i: round(x.adjusted, 6) for x in metrics.holm(h, ["g"], "p", "i").collect()} == {1: 0.04, 3: 0.09, 2: 0.09, 4: 0.9}
    k = spark.createDataFrame([("g", 0, 0, 10)], "g string, a int, b int, n int")
    a = metrics.agreement(k, ["g"], 2).first()
    assert a.agreement == 1 and a.kappa is None and a.ac1 == 1
    d = spark.createDataFrame([("g", i, 1.0 if i % 10 else -1.0) for i in range(200)], "g string, u int, x double")
    for b_, c_ in ((0, 0), (3, 9), (5000, 5100)):
        n = b_ + c_
        want = min(1.0, 2 * sum(math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2)) for k in range(min(b_, c_) + 1))) if n else 1.0
        assert spark.range(1).select(metrics.mcnemar_column(F.lit(b_), F.lit(c_))).first()[0] == pytest.approx(want)
    b = metrics.bootstrap(d, ["g"], "u", "x", 200).first()
    assert b.low < b.mean < b.high and 0.02 < b.se < 0.08 and b.mean == pytest.approx(0.8)
    assert metrics.permutation_test(d, ["g"], "u", "x", 100).first().p == pytest.approx(1 / 101)
    assert metrics.dz([1.0, 1.0]) == 0 and metrics.dz([1.0, 3.0]) == pytest.approx(math.sqrt(2))


def test_joins(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(1, "p")], "k int, w string")
    with pytest.raises(Exception, match="no partner"):
        joins.strict_inner(a, b, ["k"]).collect()
    assert joins.strict_inner(a.where("k = 1"), b, ["k"]).count() == 1
    with pytest.raises(Exception, match="repeated key"):
        joins.merge_shards([a, a], ["k"]).collect()
    assert joins.merge_shards([a, a.withColumn("k", F.col("k") + 10)], ["k"]).count() == 4
    assert {(r.k, r.side) for r in joins.key_difference(a, b, ["k"]).collect()} == {(2, "left")}
    m = spark.createDataFrame([("t", 3, 0.1, ["a"])], "key string, rank int, score double, routes array<string>")
    n = spark.createDataFrame([("t", 1, None, ["b"]), ("u", 2, 0.5, None)], "key string, rank int, score double, routes array<string>")
    got = {r.key: r for r in joins.merge_candidates(m, n, ["key"], ["rank"], ["score"], ["routes"]).collect()}
    assert (got["t"].rank, got["t"].score, got["t"].routes) == (1, 0.1, ["a", "b"]) and got["u"].routes == []


def test_learners(spark):
    rng = random.Random(3)
    rows = [(f"e{i // 6}", i, rng.random(), rng.random()) for i in range(300)]
    df = spark.createDataFrame([(e, i, b, c, float(b + 0.1 * c > 0.6)) for e, i, b, c in rows], "g string, i int, b double, c double, y double")
    diffs = joins.differences(df.withColumn("pos", F.col("y") > 0), ["g"], "pos", ["b", "c"], "i")
    w = learners.fit_pairwise(diffs, ["b", "c"])
    assert w["b"] > 2 * abs(w["c"])
    out = learners.cross_fit(df, "g", ["b", "c"], "y", 3)
    assert metrics.roc_auc(out.withColumn("t", F.col("y") > 0), [], "score", "t").first().auc > 0.95
    assert learners.fit_pairwise(diffs.limit(0), ["b"]) == {"b": 0.0}
    v = {r.i: r.vector for r in learners.hashed_vectors(spark.createDataFrame([(1, "tax rise"), (2, "rise tax"), (3, "")], "i int, text string"), "i", "text", 16).collect()}
    assert v[1] == v[2] and sum(x * x for x in v[1]) == pytest.approx(1) and v[3] == [0.0] * 16
