from __future__ import annotations

import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from framewright.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")
PARTS = ["a", "b", "aa", " ", "  ", "\n", "\t", "é", "'s", "'", "ab", "1", "23", "_", "!!", "\x1c", "\x85", "\xa0", "日本", "<|endoftext|>", "ll", "́", "½", "the", "ing", ",", "."]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=30))
def test_like_the_library(library, parts):
    own, text = bpe.codec(PATH, P.PATTERN), "".join(parts)
    assert own.encode(text) == library.encode_ordinary(text)
    assert own.decode(own.encode(text)) == text.encode()


@pytest.mark.parametrize("text", ["a" * 30_000, "ab" * 5000, "é" * 3000, "".join(random.Random(1).choices("abcde", k=20_000)), " " * 500, "x\n" * 300])
def test_very_long_pre_tokens(library, text):
    assert bpe.codec(PATH, P.PATTERN).encode(text) == library.encode_ordinary(text)


def test_rank_that_falls_after_a_merge():
    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 300, b"abc": 290, b"cd": 310}
    assert bpe.merge(b"abcd", ranks) == [290, ord("d")]
    assert bpe.merge(b"aaa", {b"a": 0, b"aa": 5}) == [5, 0]


def test_query_rows(spark):
    rows = [(1, "Hello  world's\n", "x"), (2, "", "x"), (3, None, "x"), (1, "Hello  world's\n", "x"), (None, "z", None)]
    found = bpe.round_trip(spark.createDataFrame(rows, "doc_id long, text string, ids_sha256 string"), PATH)
    got = [tuple(r) for r in found.collect()]
    empty = hashlib.sha256(b"").hexdigest()
    assert len(got) == 5 and (2, 0, empty, empty) in got and (3, 0, empty, empty) in got and len(set(got)) == 4
    assert {r[3] for r in got if r[0] == 1} == {hashlib.sha256(rows[0][1].encode()).hexdigest()}
    assert bpe.round_trip(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_encode_and_decode_columns(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string")
    back = {r.doc_id: bytes(r.bytes) for r in bpe.decode(bpe.encode(docs, PATH), PATH).collect()}
    assert back == {1: b"one two", 2: b""}
