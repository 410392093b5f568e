"""Encoding against the public library and a merge by the book; term counts against plain counting."""

from __future__ import annotations

import os
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import rows
from trackloom.llm import frequency, tokens

TEXTS = [None, "", " ", "  \n\n ", "Hello world", "it's we'll THEY'D 3.14159", "Été à Lumbre — ñandú", "naïve​ x﻿", "🌊🌊 tide 👨‍👩‍👧", "<|endoftext|> text", "日本語のテキスト", "a" * 5000, "xyz" * 20_000, "word " * 30_000, "\t\ttab\r\nline", "é é", "0123456789" * 30]


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    path = os.path.join(tokens.TOKENIZERS, tokens.VOCABULARY + ".json")
    if not os.path.exists(path):
        pytest.skip("no vocabulary files here")
    t = tokenizers.Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def test_ids_are_those_of_the_library(spark, library):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    got = {r["doc_id"]: list(r["ids"]) for r in tokens.encoded(docs).collect()}
    want = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(TEXTS)}
    assert got == want
    assert got[0] == got[1] == []


def test_unseen_words_are_merged_the_same_without_a_lexicon(spark, library, monkeypatch):
    monkeypatch.setattr(tokens, "WORDS", 1)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    name = tokens.frequent_words(docs, 1)
    assert name.count() <= 1
    counts = {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(docs).collect()}
    assert counts == {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(TEXTS)}


def test_no_documents(spark):
    assert rows(tokens.encoded(spark.createDataFrame([], "doc_id bigint, text string"))) == []


@settings(max_examples=50, deadline=None)
@given(st.dictionaries(st.binary(min_size=1, max_size=8), st.lists(st.integers(0, 60_000), min_size=1, max_size=4), max_size=40), st.binary(max_size=8))
def test_automaton_holds_its_words_and_no_other(words, other):
    import tempfile

    a = tokens.Automaton.compile(words)
    with tempfile.TemporaryDirectory() as d:
        a.save(f"{d}/a")
        b = tokens.Automaton.open(f"{d}/a")
        for w, ids in words.items():
            assert a.find(w) == b.find(w) == ids
        assert b.find(other) == words.get(other)


def test_automaton_shares_suffixes():
    words = {p + b"ing": [1] for p in (b"walk", b"talk", b"jump", b"sing")}
    assert len(tokens.Automaton.compile(words).final) < sum(map(len, words)) - 6


def by_book(word, rank):
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        r, i = min((rank.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
        if r == 1 << 60:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [rank[p] for p in parts]


@settings(max_examples=150, deadline=None)
@given(st.text("abc", min_size=1, max_size=14))
def test_merge_by_the_book(word):
    rank = {bytes([c]): i for i, c in enumerate(b"abc")} | {x: 3 + i for i, x in enumerate([b"ab", b"bc", b"abc", b"aa", b"ca", b"cab", b"aaa", b"abab"])}
    assert tokens.merge(word.encode(), rank) == by_book(word.encode(), rank)


def test_term_counts_match_plain(spark):
    r = random.Random(3)
    data = [("f", [r.choice("abcdefghij") for _ in range(r.randrange(5))]) for _ in range(300)] + [("g", ["hot"]) for _ in range(200)] + [("g", None), ("g", []), ("f", ["a", None, "a"]), ("f", [f"only{i}" for i in range(30)])]
    got = frequency.term_frequencies(spark.createDataFrame(data, "field string, terms array<string>"), 2, 0.5)
    occurrences, records, whole = Counter(), Counter(), Counter()
    for f, t in data:
        t = [x for x in t or [] if x is not None]
        whole[f] += 1
        occurrences.update((f, x) for x in t)
        records.update((f, x) for x in set(t))
    mark = lambda k: "rare" if records[k] < 2 else "common" if records[k] > 0.5 * whole[k[0]] else None
    assert rows(got.select("field", "term", "occurrences", "records", "mark")) == sorted([(*k, n, records[k], mark(k)) for k, n in occurrences.items()], key=repr)
    ids = [r["id"] for r in got.collect()]
    assert sorted(ids) == list(range(len(ids)))


def test_compared_values(spark):
    data = [(None, "<null_val>"), ("", "<null_val>"), (" \t ", "<null_val>"), ("Eating  \tOut ", "eating out"), ("ÉTÉ", "été"), ("a\nb", "a\nb")]
    got = spark.createDataFrame(data, "x string, want string").select(frequency.compared(__import__("pyspark.sql.functions", fromlist=["col"]).col("x")).alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in got)


def test_no_terms(spark):
    assert rows(frequency.term_frequencies(spark.createDataFrame([], "field string, terms array<string>"))) == []
