import os
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from attestra.llm import packing

tokens = pytest.mark.skipif(not os.path.exists(packing.TOKENIZER), reason="no vocabulary")


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 60), max_size=15))
def test_fillings_use_every_item_once(numbers):
    out = packing.fillings(numbers, 40)
    used = Counter()
    for times, take in out:
        assert times > 0 and sum(k * n for k, n in take.items()) <= 40
        for k, n in take.items():
            used[k] += times * n
    assert used == Counter(numbers)


def test_fillings_are_close_to_the_least():
    numbers = {k: 1000 // k + 3 for k in range(1, 101)}
    bins = sum(t for t, _ in packing.fillings(numbers, 100))
    assert bins <= -(-sum(k * n for k, n in numbers.items()) // 100) + 1
    assert packing.fillings({60: 3, 40: 3}, 100) == [(3, {60: 1, 40: 1})]
    assert packing.fillings({}, 100) == []


@tokens
def test_documents(spark):
    texts = ["word " * n for n in (1, 5, 700, 300, 1024, 1500, 4000, 5, 20)] + [None, "", "x" * 30_000]
    df = spark.createDataFrame([(i, t, "e", 1) for i, t in enumerate(texts)] + [(3, texts[3], "again", 2)], "doc_id long, text string, part string, n_tokens int")
    rows = packing.pack(df, 1024).collect()
    room = Counter()
    for r in rows:
        room[r.container_id] += r.n_tokens
    assert max(room.values()) <= 1024
    whole = Counter()
    for r in rows:
        whole[r.doc_id] += r.n_tokens
    assert whole == Counter({i: packing.count_tokens(t or "") * (2 if i == 3 else 1) for i, t in enumerate(texts)})
    parts = Counter(r.doc_id for r in rows)
    assert all(parts[i] == (2 if i == 3 else max(1, -(-packing.count_tokens(t or "") // 1024))) for i, t in enumerate(texts))
    assert packing.pack(df.limit(0), 1024).count() == 0
    assert packing.fill(packing.pack(df, 1024)).first().fullest <= 1024


@tokens
def test_tokens_give_the_text_back():
    enc = packing.encoding()
    for text in ("", "hello world", " ไทย 日本 été\n\n x²"):
        assert enc.decode(enc.encode_ordinary(text)) == text and packing.count_tokens(text) == len(enc.encode_ordinary(text))
