"""Normal form, leaks and tokens (problems 7 to 9)."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kmerloom.llm import bpe, leaks
from kmerloom.llm import visual_form as vf

SAME = [("é", "é"), ("ё", "ë"), ("Ｆｕｌｌ　１", "Full 1"), ("a​b", "ab"), ("x y z", "x y z"), ("раураӏ", "paypal"), ("ＥΧＡ", "EXA"), ("ế", "ế"), ("가", "가"), ("ｶﾞ", "ガ")]
SAME += [("ραικ", "paik"), ("օ", "o"), ("Ꭺ", "A"), ("ɡı", "gi"), ("ꓐꓲ", "BI"), ("a\u2011b", "a-b"), ("a\ufe0fb", "ab"), ("\u202aa\u202c\u2066b\u2069", "ab"), ("a\u3164\U000e0041", "a"), ("x\U0001bca0", "x")]
OTHER = [("A", "a"), ("e", "é"), ("a b", "a  b"), ("a\nb", "a b"), ("x²", "x2"), ("½", "1/2"), ("“a”", '"a"'), ("👩‍💻", "👩💻"), ("З", "3"), ("…", "...")]
OTHER += [("❤\ufe0f", "❤"), ("🏴\U000e0067\U000e0062\U000e007f", "🏴"), ("–", "-"), ("𝐚", "a"), ("ⓐ", "a")]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same_look(a, b):
    assert vf.visual_form(a) == vf.visual_form(b)


@pytest.mark.parametrize(("a", "b"), OTHER)
def test_other_look(a, b):
    assert vf.visual_form(a) != vf.visual_form(b)


alphabet = st.sampled_from(list("ab e.\n") + ["é", "́", "̈", "е", "ё", "и", "̆", "​", "‍", "Ａ", " ", "😀", "가", "ᄀ", "ᅡ", "ᆨ", "中", "क", "‌", "�"])


@settings(max_examples=300, deadline=None)
@given(st.lists(alphabet, max_size=20).map("".join))
def test_form_is_stable_and_spliced_form_is_whole_form(text):
    form = vf.visual_form(text)
    assert vf.visual_form(form) == form
    assert form == vf._segment(text) or ("‍" in text or "‌" in text)
    spliced, spans = vf.visual_form_spans(text)
    assert spliced == form
    for a, b, c, d in spans:
        assert vf.original_offset(spans, a) <= vf.original_offset(spans, b, True) and text[c:d]


def pairs(spark, rows):
    return {(r.doc_id_a, r.doc_id_b) for r in vf.lookalike_pairs(spark.createDataFrame(rows, "doc_id bigint, text string, f string")).collect()}


def test_lookalike_pairs(spark):
    rows = [(1, "paypal", "x"), (2, "раураl", None), (3, "paypal", ""), (4, "PayPal", ""), (5, None, ""), (6, "", ""), (7, "​", ""), (8, " ", ""), (None, "paypаl", ""), (9, " ", ""), (10, "pay​pal", "")]
    assert pairs(spark, rows) == {(1, 2), (2, 3), (1, 10), (2, 10), (3, 10)}
    assert pairs(spark, []) == set()


def test_hot_group(spark):
    rows = [(i, "thanks" if i else "thаnks", "") for i in range(500)]
    assert pairs(spark, rows) == {(0, i) for i in range(1, 500)}


def test_long_text():
    long = "слово Ｗ́ " * 100_000
    assert vf.visual_form(long) == vf._segment(long)


ITEM = "Before the flood, Lofaia kept 242 floating ledgers inside the old brewery."


def found(spark, docs, items, words=8):
    d = spark.createDataFrame(docs, "doc_id bigint, text string, item_id int")
    i = spark.createDataFrame(items, "item_id bigint, text string, doc_id string")
    return {(r.doc_id, r.item_id): (r.start, r.stop, r.runs) for r in leaks.find_leaks(d, i, words=words).collect()}


def test_leaks(spark):
    docs = [
        (1, "x " + ITEM + " y", 0),
        (2, "the <b>flood</b>,\n> LOFAIA kept [i]242[/i] floating&nbsp;lеdgers inside&amp;the", 0),
        (3, "before the flood Lofaia kept 242 floating, inside the old brewery", 0),
        (4, None, 0), (5, "", 0), (6, "flood Lofaia kept 242 ﻿ｆｌｏａｔｉｎｇ ledgers inside the end", 0), (None, ITEM, 0),
        (7, "before the flood Lofaia kept 242 very floating ledgers inside the old brewery", 0),
    ]
    items = [(10, ITEM, ""), (11, "too short", ""), (12, None, ""), (13, "And then: flood, Lofaia kept 242 floating ledgers inside the", "")]
    got = found(spark, docs, items)
    assert set(got) == {(1, 10), (1, 13), (2, 10), (2, 13), (6, 10), (6, 13)}
    text = docs[1][1]
    start, stop, runs = got[2, 10]
    assert text[start:stop] == "the <b>flood</b>,\n> LOFAIA kept [i]242[/i] floating&nbsp;lеdgers inside&amp;the" and runs == 2
    assert docs[0][1][got[1, 10][0] : got[1, 10][1]] == ITEM[:-1]
    assert found(spark, [], items) == {} and found(spark, docs, []) == {}


def test_several_automata_find_the_same(spark, monkeypatch):
    docs = [(i, f"a b {ITEM if i % 3 else ITEM[:50]} c <i>{ITEM}</i>", 0) for i in range(20)]
    items = [(i, ITEM[i:], "") for i in range(12)]
    whole = found(spark, docs, items)
    assert len(whole) > 100
    monkeypatch.setattr(leaks, "MAX_ITEM_CHARS", 150)
    assert found(spark, docs, items) == whole


@pytest.fixture(scope="module")
def reference():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{bpe.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def mine():
    return bpe.Tokenizer(bpe.read_vocabulary())


def test_tokens_against_library(reference, mine):
    rng = random.Random(4)
    parts = ["a", "e", "th", "ing", " ", "  ", "\n", "é", "中", "\U0001f642", "ACGT", "0", "77", "--", "<|endoftext|>", "'s", "а", "​", "!!", "﻿", "zz", "qu", "\t", "ञ्"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 60))) for _ in range(3000)] + ["A" * 3000, "ab" * 2000, " " * 2000, "".join(rng.choices("ACGT", k=5000))]
    for x in texts:
        assert mine.encode(x) == reference(x)
        assert mine.decode(mine.encode(x)) == x


def test_forgotten_states_change_nothing(reference, mine):
    words = ["".join(random.Random(i).choices("abcdefghijklmnopqrstuvwxyz", k=30)) for i in range(200)]
    before = [mine.transducer.encode_piece(w.encode()) for w in words]
    t = mine.transducer
    t.states, t.numbers, t.steps = t.states[:1], {t.states[0]: 0}, [{}]
    assert [t.encode_piece(w.encode()) for w in words] == before == [reference(w) for w in words]


def test_stream_of_characters(mine):
    ids = mine.encode("ñ中🙂")
    assert "".join(mine.decode_stream(iter(ids))) == "ñ中🙂" and all("�" not in c for c in mine.decode_stream(ids))
    assert mine.decode(mine.encode("🙂")[:1]) == "�"


def test_encode_table(spark, reference):
    rows = [(1, "Hello wörld", 5), (2, "", 6), (3, None, 7), (None, "x", 8), (1, "Hello wörld", 5), (4, "  \n", 9)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    got = sorted((r.doc_id or 0, list(r.ids)) for r in bpe.encode_texts(df).collect())
    assert got == sorted((k or 0, reference(t) if t else []) for k, t, _ in rows)
    back = bpe.decode_ids(bpe.encode_texts(df)).select("doc_id", F.col("text")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in back) == sorted((k or 0, t or "") for k, t, _ in rows)
    assert bpe.encode_texts(df.limit(0)).collect() == []


def test_bounds_of_what_is_kept_change_nothing(reference, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_STATES", 50)
    monkeypatch.setattr(bpe, "KEPT_PAIRS", 20)
    monkeypatch.setattr(bpe, "KEPT_PIECES", 5)
    t = bpe.Tokenizer(bpe.read_vocabulary())
    rng = random.Random(8)
    for _ in range(300):
        x = "".join(rng.choices("abcdefgh éß中 019", k=60))
        assert t.encode(x) == reference(x)
