"""Queries see whole groups: nothing is cut from events and labels larger than any pool."""

import itertools
import os
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from attestra import registry
from attestra.functions import text as T
from attestra.operators import chains, joins
from attestra.operators import selection as S
from attestra.plans import selection_queries
from attestra.plans.ranking_queries import ranked

FIELDS = "candidate_id long, event_id string, text string, base_score double, map_confidence double, map_directness string"


@pytest.fixture(scope="module")
def candidates(spark, tmp_path_factory):
    """One event of thirty candidates: the later ones are direct and have the greater confidence."""
    rows = [(i, "e", f"text {i}", 1 - i / 100, (i * 7 % 30) / 30 if i < 25 else 0.9 + i / 1000, "direct" if i % 3 == 0 or i > 26 else "none") for i in range(30)]
    d = str(tmp_path_factory.mktemp("candidates"))
    spark.createDataFrame(rows, FIELDS).write.parquet(os.path.join(d, "evidence_candidates.parquet"))
    return d, rows


def test_pairs_of_all_candidates(spark, candidates):
    d, rows = candidates
    got = {(r.winner, r.loser): (r.b, r.c) for r in registry.queries()["j_pairwise_differences"](spark, d).collect()}
    want = {(x[0], y[0]): (round(x[3] - y[3], 6), round(x[4] - y[4], 6)) for x in rows for y in rows if x[5] == "direct" != y[5]}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)


def test_pairs_of_a_dealt_group(spark):
    df = spark.createDataFrame([("e", i, float(i), i < 9) for i in range(20)] + [("f", 20, 1.0, True), ("g", 21, 1.0, False)], "g string, i int, s double, pos boolean")
    got = sorted((r.g, r.winner, r.loser, r.s) for r in joins.differences(df, ["g"], "pos", ["s"], "i", dealt=2).collect())
    assert got == sorted(("e", a, b, float(a - b)) for a in range(9) for b in range(9, 20))


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    """Two labels of sixty vectors in tight bunches, so that the twenty best of a label are much alike, and one of four."""
    rng = np.random.default_rng(3)
    rows = []
    for label, n in ((0, 60), (1, 60), (2, 4)):
        heads = np.abs(rng.normal(size=(6, 8)))
        for i in range(n):
            v = heads[i % 6] + 0.05 * rng.normal(size=8)
            rows.append((100 * label + i, (v / np.linalg.norm(v)).tolist(), label))
    d = str(tmp_path_factory.mktemp("vectors"))
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(os.path.join(d, "embeddings.parquet"))
    groups = {}
    for label in range(3):
        own = [r for r in rows if r[2] == label]
        m = np.array([r[1] for r in own])
        sim = np.round(m @ m.T, 9)
        best = np.lexsort((np.arange(len(own)), -sim[0]))  # ties go to the earlier by score, then id
        groups[label] = [own[i][0] for i in best], sim[0][best], sim[np.ix_(best, best)]
    return d, groups


def chosen(df, *by):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["step"]):
        out.setdefault(tuple(r[b] for b in by), []).append(r["vec_id"])
    return out


def test_mmr_over_whole_labels(spark, vectors):
    d, groups = vectors
    q = registry.queries()
    for name, k, lam in (("g_mmr", 5, 0.7), ("g_mmr_pool", 12, 0.7), ("g_mmr_stepwise", 5, [0.7, 0.9, 0.7, 0.5, 0.3])):
        assert chosen(q[name](spark, d), "label") == {(x,): [ids[i] for i in S.mmr(s, sim, k, lam)] for x, (ids, s, sim) in groups.items()}
    want = {x: [ids[i] for i in sorted(S.mmr(s, sim, 5), key=lambda i: (-s[i], i))] for x, (ids, s, sim) in groups.items()}
    got = q["g_mmr_resorted"](spark, d).collect()
    assert {x: [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.label == x] for x in want} == want


def test_trajectories_and_gate_over_whole_labels(spark, vectors):
    d, groups = vectors
    q = registry.queries()
    plans = {seed: S.hashed_schedule(seed, 5, [0.3, 0.5, 0.7, 0.9]) for seed in range(4)}
    got = q["g_trajectories"](spark, d)
    assert chosen(got, "label", "schedule") == {(x, seed): [ids[i] for i in S.mmr(s, sim, 5, plan)] for x, (ids, s, sim) in groups.items() for seed, plan in plans.items()}
    for r in got.collect():
        ids, s, sim = groups[r.label]
        assert r.lam == plans[r.schedule][r.step - 1] and r.utility == pytest.approx(s[S.mmr(s, sim, 5, plans[r.schedule])].mean(), abs=2e-9)
    gates = {r.label: (r["lambda"], r.sensitivity, r.redundancy) for r in q["g_sensitivity_gate"](spark, d).collect()}
    assert gates.keys() == groups.keys()
    for x, (_, s, sim) in groups.items():
        assert gates[x] == pytest.approx(S.sensitivity_gate(s, sim, 5), abs=2e-6)


def test_anchor_sets_of_all_candidates(spark, candidates):
    d, rows = candidates
    got = {r.set: (r.delta, r.positive) for r in registry.queries()["g_anchor_sets"](spark, d).collect()}
    base = (rows[0][4] + rows[1][4]) / 2
    assert got.keys() == {f"0,1,{i}" for i in range(2, 30)}
    assert all(got[f"0,1,{r[0]}"] == (pytest.approx(r[4] - base, abs=1e-6), r[4] > base) for r in rows[2:])


def test_cross_fit_scores_all_candidates(spark, candidates):
    d, rows = candidates
    got = registry.queries()["m_cross_fit"](spark, d).collect()
    assert sorted(r.candidate_id for r in got) == [r[0] for r in rows] and all(r.score is not None for r in got)


def test_token_mmr_over_whole_events(spark, tmp_path):
    """Forty near-copies of the best sentence push weaker ones of other words beyond rank twenty."""
    words, stops = [f"w{i}" for i in range(12)], sorted(T.STOP_WORDS)[:20]
    rows = [(i, "e", " ".join([*words[:8], *stops, f"copy{i}"]), "r", i) for i in range(40)] + [(40 + i, "e", " ".join([*words[:8], f"other{i}", f"more{i}"]), "r", 40 + i) for i in range(6)]
    rows += [(100 + i, "e", f"far{i} away{i}", "r", 100 + i) for i in range(3)]
    spark.createDataFrame(rows, "row_id long, event_id string, text string, report_id string, sent_idx int").write.parquet(str(tmp_path / "sentence_items.parquet"))
    spark.createDataFrame([("e", " ".join(words), "true", "s")], "event_id string, claim string, label string, label_schema string").write.parquet(str(tmp_path / "claims.parquet"))
    pool = ranked(spark, str(tmp_path)).orderBy(F.desc("hybrid"), "cand").collect()
    want = [pool[i].cand for i in S.token_mmr([r.hybrid for r in pool], [set(r.key.split()) for r in pool], 5)]
    assert any(w >= 40 for w in want)
    assert chosen(registry.queries()["g_token_mmr"](spark, str(tmp_path)).withColumnRenamed("cand", "vec_id"), "event_id") == {("e",): want}


def test_rows_left_out_never_win(spark):
    rnd = random.Random(5)
    rows = [(g, i, round(rnd.random(), 2), " ".join(rnd.sample("abcdefgh", 3))) for g in range(20) for i in range(rnd.choice((3, 60)))]
    df = spark.createDataFrame(rows, "g int, i int, s double, key string")
    kept = S.may_win(df, ["g"], [F.desc("s"), F.asc("i")], "s", 5).collect()
    assert len(kept) < len(rows)
    pick = lambda own: [own[i][1] for i in S.token_mmr([r[2] for r in own], [set(r[3].split()) for r in own], 5)]
    best = lambda rs, g: sorted((tuple(r) for r in rs if r[0] == g), key=lambda r: (-r[2], r[1]))
    assert all(pick(best(kept, g)) == pick(best(rows, g)) for g in range(20))


def test_best_summed_set_of_all_candidates(spark, tmp_path):
    """A late candidate whose confidence outweighs its rank belongs to the best set."""
    rnd = random.Random(2)
    rows = [(i, g, f"text {i}", 1 - i / 100, round(rnd.random() / 10 + 0.06 * (i % 20), 3), "none") for g, n in (("e", 20), ("f", 3), ("g", 2)) for i in range(n)]
    spark.createDataFrame(rows, FIELDS).write.parquet(str(tmp_path / "evidence_candidates.parquet"))
    got = {r.event_id: (r.set, r.total) for r in registry.queries()["g_exhaustive_sets"](spark, str(tmp_path)).collect()}
    want = {}
    for g in ("e", "f"):
        value = {r[0]: round(r[4] - 0.05 * (r[0] + 1), 9) for r in rows if r[1] == g}
        best = min(itertools.combinations(sorted(value), 3), key=lambda s: (-round(sum(value[i] for i in s), 9), s))
        want[g] = ",".join(map(str, best)), pytest.approx(sum(value[i] for i in best), abs=1e-8)
    assert got == want and max(map(int, want["e"][0].split(","))) >= 8


@pytest.fixture(scope="module")
def annotated_pool(spark):
    """Thirty candidates of an event; the late ones cover more atoms at nearly the same base score."""
    atoms = lambda i: [f"A{i % 7}"] if i < 13 else [f"A{i % 7}", f"B{i}"]
    rows = [("e", i, f"k{i}", atoms(i), "support" if i % 2 else "refute", "direct", f"s{i}", "", 1 - i / 1000, 0.1 if i < 13 else 0.9, 1.0, 1.0, 0.0, 0.5, 5) for i in range(30)]
    names = "event_id string, candidate_id long, key string, atoms array<string>, relation string, directness_name string, source string, dup string, base double, quality double, directness double, polarity double, background double, confidence double, cost int"
    return spark.createDataFrame(rows, names), S.Pool({k: [r[i] for r in rows] for i, k in enumerate(x.split()[0] for x in names.split(", "))})


def test_set_search_over_all_candidates(spark, annotated_pool, monkeypatch):
    df, p = annotated_pool
    monkeypatch.setattr(selection_queries, "annotated", lambda *_: df)
    got = {r.search: tuple(r.candidate_ids) for r in registry.queries()["g_set_search"](spark, "").collect()}
    value = chains.Graph(p).score
    assert got == {"greedy": S.greedy_set(30, 3, value), "beam": S.beam_set(30, 3, value, 4), "exhaustive": S.exhaustive_set(15, 3, value)}
    assert max(got["greedy"]) >= 8 and max(got["beam"]) >= 8


def test_beam_chains_extend_to_all_twenty(spark, annotated_pool, monkeypatch):
    df, p = annotated_pool
    monkeypatch.setattr(selection_queries, "annotated", lambda *_: df)
    got = registry.queries()["g_beam_chains"](spark, "").collect()
    score, chain = chains.Graph(p.head(20)).beam()[0]
    assert sorted(r.candidate_id for r in got) == sorted(chain) and max(chain) >= 12
    assert {r.score for r in got} == {score}
