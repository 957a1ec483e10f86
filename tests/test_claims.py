import json

from pyspark.sql import functions as F

from attestra.functions import claims as K
from attestra.operators import selection as S


def run(spark, rows, expr):
    return [r.x for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, claim string, answer string").orderBy("i").select(expr.alias("x")).collect()]


def test_aspects(spark):
    got = run(spark, [("The Senate cut taxes by 5 percent, but the Senate CUT taxes by 5 percent; it grew.", ""), ("", ""), (None, "")], K.aspects("claim"))
    assert [a.text for a in got[0]][0].startswith("The Senate cut taxes by 5 percent, but") and len({a.text.lower() for a in got[0]}) == len(got[0])
    assert all(a.score >= 1 for a in got[0]) and got[1] == [] and got[2] is None


def test_anchors(spark):
    (got,) = run(spark, [("In 2019 the House of Lords spent 1,200 and 1,200 with Bob", "")], K.anchors("claim"))
    assert {(a.kind, a.value) for a in got} == {("year", "2019"), ("number", "1,200"), ("entity", "house of lords")}


def test_parse_atoms(spark):
    good = json.dumps({"claim_atoms": [{"proposition": " Tax  rose ", "importance": 7, "type": " Event "}, {"text": "tax rose"}, {"proposition": ""}, {"text": "Jobs fell", "importance": -1}]})
    many = json.dumps({"claim_atoms": [{"proposition": f"p{i}"} for i in range(7)]})
    rows = [("c", f"Here:\n```json\n{good}\n```\nDone."), ("c  x", "no json"), ("c", ""), ("c", None), ("c", many), ("c", "{broken"), ("c", '{"claim_atoms": []}')]
    got = run(spark, rows, K.parse_atoms("answer", "claim"))
    assert [(a.atom_id, a.proposition, a.importance, a.type) for a in got[0]] == [("A1", "Tax rose", 1.0, "event"), ("A2", "Jobs fell", 0.0, "other")]
    assert all([(a.atom_id, a.importance) for a in g] == [("A1", 1.0)] for g in got[1:]) and got[1][0].proposition == "c x"


def test_set_searches():
    worth = {0: 1.0, 1: 0.9, 2: 0.8, 3: 0.1}
    value = lambda s: round(sum(worth[i] for i in s) - 0.95 * ({0, 1} <= set(s)), 9)
    assert S.exhaustive_set(4, 2, value) == S.greedy_set(4, 2, value) == S.beam_set(4, 2, value, 2) == (0, 2)
    trap = lambda s: 10.0 if s == (2, 3) else sum(worth[i] for i in s)
    assert S.exhaustive_set(4, 2, trap) == (2, 3) and S.greedy_set(4, 2, trap) == (0, 1) and S.beam_set(4, 2, trap, 4) == (2, 3)
    assert S.greedy_set(0, 2, value) == () and S.beam_set(1, 3, value, 2) == (0,)
    assert S.hashed_schedule(1, 3, [0.3, 0.7]) == S.hashed_schedule(1, 3, [0.3, 0.7])
