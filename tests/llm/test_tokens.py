import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shapelake.llm import tokens
from shapelake.llm.queries import p6_ids, p6_stats

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.DEFAULT_FILE), reason="no vocabulary file")


@pytest.fixture(scope="module")
def own():
    with open(tokens.DEFAULT_FILE, "rb") as f:
        return tokens.Transducer(f.read())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.DEFAULT_FILE)
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


def test_every_code_point_in_context(own, library):
    for c in [*range(0xD800), *range(0xE000, 0x10000, 7), *range(0x10000, 0x110000, 997)]:
        s = f"a{chr(c)}b {chr(c)}1 {chr(c)}{chr(c)} "
        assert own.encode(s) == library(s), hex(c)


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=300))
def test_any_text(own, library, text):
    assert own.encode(text) == library(text)
    assert own.decode(own.encode(text)) == text


def test_long_pieces_stream_in_a_bounded_window(own, library):
    rnd = random.Random(3)
    for alphabet in ("a", "ab", "abcdefghijklmnopqrstuvwxyz", "=-", "ÃÂ", "日本語", "0123456789"):
        text = "".join(rnd.choice(alphabet) for _ in range(20_000))
        assert own.encode(text) == library(text)
    data = "".join(rnd.choice("etaoin") for _ in range(100_000))
    parts = list(own.stream(data[i : i + 512] for i in range(0, len(data), 512)))
    assert [t for p in parts for t in p] == library(data)
    assert len(parts) > 50 and max(map(len, parts)) < 10 * own.lookahead  # what waits doesn't grow with the text


def test_transducer_agrees_with_the_definition(own):
    rnd = random.Random(9)
    for _ in range(300):
        data = bytes(rnd.choice(b"abcdehilnorst ,") for _ in range(rnd.randint(1, 60)))
        assert [t for p in own.stream((data.decode("latin-1"),)) for t in p] == own.merged(data)


def test_special_strings_and_unknown_ids(own, library):
    s = "x <|endoftext|> y"
    assert own.encode(s) == library(s) and 50256 not in own.encode(s)
    assert own.decode([999_999]) == "�" and own.decode([]) == ""


def test_nulls_empties_repeats_and_clashing_columns(spark, library):
    rows = [(1, None, "q"), (2, "", "q"), (3, "  ", "q"), (3, "  ", "q"), (None, "a b", "q"), (4, "long " * 40_000, "q")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = sorted(((r.doc_id or 0), r.ids) for r in tokens.encode_corpus(df, split_ids=1000).collect())
    assert got == sorted(((i or 0), library(t) if t else []) for i, t, _ in rows)
    assert tokens.encode_corpus(df.filter("false")).count() == 0
    counts = {(r.doc_id or 0): r.n_tokens for r in tokens.count_tokens(df).collect()}
    assert counts == {i: len(x) for i, x in got}
    back = {(r.doc_id or 0): r.text for r in tokens.decode_corpus(tokens.encode_corpus(df)).collect()}
    assert back == {(i or 0): t or "" for i, t, _ in rows}


def test_whole_table(spark, data, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = {r.doc_id: r.ids for r in p6_ids(spark, data).collect()}
    assert got == {i: library(t) if t else [] for i, t in docs.items()}
    assert sum(r.not_restored for r in p6_stats(spark, data).collect()) == 0
