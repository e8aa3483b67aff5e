"""Each stage against a plain computation on its own input."""

import hashlib
import re
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline as p
from tests.llm.test_op6_simhash import slow_similar, stay
from tests.llm.test_op7_mixing import slow_targets, words

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows(df):
    return df.select(COLUMNS).collect()


def test_every_stage_on_its_own_input(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = {"documents": rows(docs)}
    for k, (name, stage) in enumerate(p.STAGES):
        out = stage(spark, docs, sf)
        if k < len(p.STAGES) - 1:
            assert out.columns == COLUMNS
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        held[name] = docs.collect()

    # documents with letters are of a language that was learned; all of them stay
    lettered = [r for r in held["documents"] if any(c.isalpha() for c in r.text or "")]
    assert Counter(held["language_id"]) <= Counter(lettered) and len(held["language_id"]) >= 0.99 * len(lettered)

    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    first = {}
    for r in sorted(held["language_id"], key=lambda r: r.doc_id):
        first.setdefault(norm(r.text), r)
    assert Counter(held["exact_dedup"]) == Counter(first.values()) and len(first) < len(held["language_id"])

    texts = [(r.doc_id, r.text) for r in held["exact_dedup"]]
    assert sorted((r.doc_id for r in held["simhash_neardup"]), key=str) == stay(texts, slow_similar(texts))
    assert Counter(held["simhash_neardup"]) <= Counter(held["exact_dedup"])

    sizes, largest = {}, {}
    for r in held["simhash_neardup"]:
        sizes[r.source] = sizes.get(r.source, 0) + words(r.text)
        largest[r.source] = max(largest.get(r.source, 0), words(r.text))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    copies, taken = Counter(held["source_mixing"]), Counter()
    for r, n in copies.items():
        assert n <= 3
        taken[r.source] += n * words(r.text)
    assert set(copies) <= set(held["simhash_neardup"])
    for s, t in zip(names, slow_targets([sizes[s] for s in names])):
        assert abs(taken[s] - t) <= 0.01 * t + largest[s] / 2  # a handful of documents to a source here

    library = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = Counter()
    for r, n in copies.items():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(r.text or "")] += n
    assert Counter(map(tuple, held["bpe"])) == want


def test_run_is_registered(spark, sf):
    got = __spark_entry__.queries()["pipeline"](spark, sf)
    assert got.count() > 0 and "pipeline" not in __spark_entry__.oracle_sql()


def test_messy_and_empty_documents(spark, messy, empty, as_documents, tmp_path):
    for df in (messy, empty):
        for name, stage in p.STAGES[:-1]:
            df = stage(spark, df, "")
        p.STAGES[-1][1](spark, df, "").collect()
