import hashlib
import json
import sys

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lexfold.llm import bpe
from lexfold.llm.queries import op5_bpe_roundtrip

PATH = public_tokenizers.path("byte_bpe_50k.json")
OWN = bpe.PairIndexBpe(json.load(open(PATH, encoding="utf-8")))
LIBRARY = Tokenizer.from_file(str(PATH))


def library(texts):
    return [e.ids for e in LIBRARY.encode_batch(list(texts), add_special_tokens=False)]


def check(texts):
    ids = library(texts)
    assert list(OWN.encode_batch(texts)) == ids
    assert [OWN.decode(i) for i in ids] == [LIBRARY.decode(i, skip_special_tokens=False) for i in ids]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_any_text(texts):
    check(texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "a", "aaaa", " ", "\n", "\t", "\xa0", "\x1c", "\x85", "'s", "’s", "'LL", "12", "½", "É", "漢字", "!!", "the", "<|", "　"]), max_size=15).map("".join))
def test_odd_pieces(text):
    check([text])


def test_every_character():
    step = 1 if sys.flags.dev_mode else 7
    check([f"a{chr(c)}b {chr(c)}{chr(c)}" for c in range(0, 0x30000, step) if not 0xD800 <= c < 0xE000])
    check([f"a{chr(c)}b {chr(c)}{chr(c)}" for c in range(0x3100) if not 0xD800 <= c < 0xE000])


def test_long_texts():
    check(["a" * 50_000, " " * 20_000 + "x", "ab" * 30_000, "word " * 30_000, "\n" * 9999])


def test_forgetting(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED_WORDS", 3)
    check(["one two three four five", "two three", "six seven eight one"])


def test_messy_rows(messy, empty):
    rows = messy.collect()
    ids = library([r.text or "" for r in rows])
    want = sorted(((r.doc_id, i) for r, i in zip(rows, ids)), key=str)
    coded = bpe.encode(messy, PATH)
    assert sorted(((r.doc_id, r.ids) for r in coded.collect()), key=str) == want
    assert sorted((str(r.text) for r in bpe.decode(coded, PATH).collect())) == sorted(r.text or "" for r in rows)
    assert bpe.round_trip(empty, PATH).collect() == [] and bpe.encode(empty, PATH).collect() == []


@pytest.mark.parametrize("name", ["documents"])
def test_query_on_whole_table(spark, sf, name):
    rows = spark.read.parquet(f"{sf}/{name}.parquet").collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [(r.doc_id, len(i), sha(",".join(map(str, i))), sha(LIBRARY.decode(i, skip_special_tokens=False))) for r, i in zip(rows, library([r.text or "" for r in rows]))]
    got = op5_bpe_roundtrip(spark, sf).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want)
