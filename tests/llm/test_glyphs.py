import unicodedata as ud

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from attestra.llm import glyphs

SAME = [("ﬁre", "fire"), ("ﾊﾞｶﾞ", "バガ"), ("１２Ａ", "12A"), ("a​b­", "ab"), ("x y\tz　", "x y z "), ("раура", "paypa"), ("é", "é"), ("á̧", "á̧"), ("각", "각"), ("ﻻ", "لا"), ("豈", "豈"), ("𝐀", "A"), ("Ё", "Ë"), ("ヘ", "へ")]
DIFFERENT = [("x²", "x2"), ("A", "a"), ("é", "e"), ("a!", "a！"), ("a b", "a  b"), ("a\nb", "a b"), ("...", "…"), ("½", "1/2"), ("バ", "ハ"), ("a.", "a")]


@pytest.mark.parametrize("a,b", SAME)
def test_same(a, b):
    assert glyphs.fold_texts([a, "q", b])[0] == glyphs.fold_texts([b])[0] != ""


@pytest.mark.parametrize("a,b", DIFFERENT)
def test_different(a, b):
    x, y = glyphs.fold_texts([a, b])
    assert x != y


PLAIN = [*range(0x41, 0x5B), 0xE9, 0x1E69, 0x1E0B, 0x300, 0x301, 0x323, 0x307, 0x327, 0x345, 0x928, 0x93C, 0x929, 0x94D, 0x1100, 0x1161, 0x11A8, 0xAC00, 0xAC01, 0x304B, 0x3099, 0x9C7, 0x9BE, 0xE48, 0xE38, 0x344, 0x958]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text([chr(c) for c in PLAIN], max_size=9), min_size=1, max_size=5))
def test_without_folds_it_is_the_canonical_form(texts):
    assert glyphs.fold_texts(texts) == [ud.normalize("NFC", t) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=12), min_size=1, max_size=6))
def test_form_is_stable_and_of_each_text_alone(texts):
    once = glyphs.fold_texts(texts)
    assert once == [glyphs.fold_texts([t])[0] for t in texts]
    assert glyphs.fold_texts(once) == once


def test_pairs(spark):
    rows = [(1, "paypal ﬁ"), (2, "раypal fi"), (3, "paypal ﬁ"), (4, "Paypal fi"), (5, None), (6, ""), (7, "​"), (8, " "), (9, "x" * 200_000), (10, "x" * 200_000 + "​")]
    df = spark.createDataFrame([(*r, b"1", "t") for r in rows], "doc_id long, text string, form_key binary, t string")
    assert sorted(tuple(r) for r in glyphs.same_look_pairs(df).collect()) == [(1, 2), (2, 3), (9, 10)]
    assert glyphs.same_look_pairs(df.limit(0)).count() == 0
    forms = {r.doc_id: r.form for r in glyphs.fold_column(df, "doc_id", "text").collect()}
    assert forms[5] is None and forms[6] == "" and forms[1] == forms[2]
