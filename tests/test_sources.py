import gzip
import json

import pytest

from attestra.sources import readers as R


def put(path, rows, lines=False):
    path.write_text("\n\n".join(json.dumps(r, ensure_ascii=False) for r in rows) if lines else json.dumps(rows, ensure_ascii=False), encoding="utf-8")
    return str(path)


def test_report_claims(spark, tmp_path):
    tokenized = [{"sent": "A first sentence here.", "is_evidence": 1}, {"sentence": "too short", "is_evidence": 0}, {"text": "Another one that stays.", "is_evidence": "true"}]
    rows = [{"event_id": "e1", "claim": " A claim\n here ", "label": " Half-True", "explain": None, "reports": [{"report_id": 7, "link": "l", "domain": "d", "content": "It was long enough. Short. Dr. Who came back again.", "tokenized": tokenized}]}, {"event_id": "e2", "claim": "x", "label": None, "explain": "y"}]
    df = R.read_claims(spark, put(tmp_path / "a.json", rows), "reports")
    got = {r.event_id: r for r in df.collect()}
    assert got["e1"].claim == "A claim here" and got["e1"].label == "half-true" and got["e2"].label is None and got["e2"].reports == []
    assert [(r.report_id, r.sent_idx, r.text) for r in R.content_sentences(df).orderBy("sent_idx").collect()] == [("7", 0, "It was long enough."), ("7", 2, "Dr. Who came back again.")]
    assert [(r.sent_idx, r.is_evidence) for r in R.tokenized_sentences(df).orderBy("sent_idx").collect()] == [(0, True), (2, True)]
    with pytest.raises(Exception, match="unknown label"):
        R.report_claims(spark, put(tmp_path / "b.json", [{"event_id": "e", "claim": "c", "label": "odd"}])).collect()


def test_evidence_claims(spark, tmp_path):
    rows = [{"id": 1, "claim": "c", "label": 3, "explanation": "x", "evidence": ["one", " ", "", "two"]}, {"id": 2, "claim": "c", "label": "5", "explanation": None, "evidence": []}]
    got = R.read_claims(spark, put(tmp_path / "a.json", rows), "evidence").orderBy("event_id").collect()
    assert [r.label for r in got] == ["half", "true"] and [(x.report_id, x.content) for x in got[0].reports] == [("0", "one"), ("3", "two")] and got[1].reports == []


def test_multihop_claims(spark, tmp_path):
    rows = [{"uid": "u", "claim": "c", "label": "NOT_SUPPORTED", "supporting_facts": [{"title": "T", "sent": 2}], "num_hops": 3, "hpqa_id": "h"}]
    (r,) = R.read_claims(spark, put(tmp_path / "a.json", rows), "multihop").collect()
    assert r.label == "not_supported" and r.metadata["num_hops"] == "3" and json.loads(r.metadata["supporting_facts"]) == [{"title": "T", "sent": 2}]


def test_rationale_claims(spark, tmp_path):
    rows = [{"id": 1, "claim": "a", "evidence": {"5": [{"label": "SUPPORT", "sentences": [1]}], "6": [{"label": "CONTRADICT", "sentences": [0, 2]}]}, "cited_doc_ids": [5, 6]}, {"id": 2, "claim": "b", "evidence": {}, "cited_doc_ids": []}]
    path = put(tmp_path / "a.jsonl", rows, lines=True)
    two = {r.event_id: r for r in R.read_claims(spark, path, "rationales").collect()}
    assert two["1"].label == "support" and two["1"].metadata["conflict"] == "true" and two["2"].label == "" and two["2"].metadata["conflict"] == "false"
    assert {r.event_id: r.label for r in R.rationale_claims(spark, path, three_classes=True).collect()} == {"1": "support", "2": "nei"}
    assert {r.label for r in R.rationale_claims(spark, path, unlabelled=True).collect()} == {""}


def test_abstracts_pages_and_sinks(spark, tmp_path):
    a = R.abstracts(spark, put(tmp_path / "c.jsonl", [{"doc_id": "d", "title": "t", "abstract": ["One.", " ", "Two."], "structured": False}], lines=True))
    assert [(r.sent_idx, r.text) for r in a.orderBy("sent_idx").collect()] == [(0, "One."), (2, "Two.")]
    with gzip.open(tmp_path / "p.json.gz", "wt") as f:
        f.write(json.dumps({"title": "A", "text": ["x", "y"]}) + "\n" + json.dumps({"title": "B", "text": "One went. Two came."}) + "\n")
    assert R.pages(spark, str(tmp_path / "p.json.gz")).count() == 4
    R.write_jsonl(a, str(tmp_path / "o1"))
    R.write_csv(a, str(tmp_path / "o2"))
    R.write_parquet(a, str(tmp_path / "o3"), ["doc_id"])
    assert R.jsonl(spark, str(tmp_path / "o1"), "doc_id string, text string").count() == spark.read.parquet(str(tmp_path / "o3")).count() == 2
    done = spark.read.parquet(str(tmp_path / "o3"))
    more = spark.createDataFrame([("t", 2, "Two.", "d"), ("t", 9, "Nine.", "d")], "title string, sent_idx int, text string, doc_id string")
    R.append_results(done.select("sent_idx"), more, ["sent_idx"], str(tmp_path / "o4"))
    assert [r.sent_idx for r in spark.read.parquet(str(tmp_path / "o4")).collect()] == [9]
    with pytest.raises(ValueError):
        R.read_claims(spark, "x", "odd")
