import zlib

import numpy as np

from lexfold.llm import language_id as li
from lexfold.llm.queries import op3_language_id


def slow_features(text, buckets=li.BUCKETS):
    """Buckets of the 1- to 3-grams, character by character."""
    if not any(c.isalpha() for c in text.lower()):
        return None
    body = " "
    for c in text.lower():
        if c.isalpha():
            body += c
        elif body[-1] != " ":
            body += " "
    out = []
    for n in li.ORDERS:
        for i in range(len(body) - n + 1):
            h = n * 0x9E3779B1 & 0xFFFFFFFF
            for c in body[i : i + n]:
                h = (h ^ ord(c)) * 0x01000193 & 0xFFFFFFFF
                h ^= h >> 15
            out.append(((h * 0x85EBCA6B & 0xFFFFFFFF) >> 16) % buckets)
    return sorted(out)


def test_features_equal_slow_ones(monkeypatch):
    for text in ("Été à l'heure", "a", " a1b ", "x,y  z", "ß😀É", "12"):
        points = li.characters(text)
        got = None if points is None else sorted(li.features(points).tolist())
        assert got == slow_features(text)
    text = "lorem ipsum dolor " * 50
    want = li.bucket_counts(text)
    monkeypatch.setattr(li, "PIECE", 7)
    assert (li.bucket_counts(text) == want).all()
    model = li.Classifier(["a", "b"], np.random.default_rng(0).normal(size=(li.BUCKETS, 2)), np.log([0.5, 0.5]))
    pieces = list(model.scores([text]))
    monkeypatch.setattr(li, "PIECE", 1 << 17)
    whole = list(model.scores([text]))
    assert pieces[0][0] == whole[0][0] and abs(pieces[0][1] - whole[0][1]) < 1e-9


def test_scores_equal_brute_force_bayes(spark):
    train = [(1, "the cat sat on the mat", "en"), (2, "le chat est sur le lit", "fr"), (3, None, "fr"), (4, "the dog", "en"), (5, "nobody knows", None)]
    df = spark.createDataFrame(train, "doc_id bigint, text string, lang string")
    model = li.train(df)
    assert model.languages == ["en", "fr"]
    counts = {k: np.zeros(li.BUCKETS) for k in model.languages}
    for _, t, lang in train:
        if t and lang:
            for f in slow_features(t):
                counts[lang][f] += 1
    prior = {"en": 2 / 3, "fr": 1 / 3}
    for text in ("the mat", "sur le chat", "xyz"):
        logs = [np.log(prior[k]) + sum(np.log((counts[k][f] + li.SMOOTHING) / (counts[k].sum() + li.SMOOTHING * li.BUCKETS)) for f in slow_features(text)) for k in model.languages]
        (lang, p), = model.scores([text])
        best = int(np.argmax(logs))
        assert lang == model.languages[best] and abs(p - 1 / np.exp(np.array(logs) - logs[best]).sum()) < 1e-3


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op3_language_id(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    judged = [r for r in got if r.held_out and truth[r.doc_id].lang is not None and r.lang_pred != "und"]
    assert len(judged) > 100 and np.mean([r.lang_pred == truth[r.doc_id].lang for r in judged]) > 0.97


def test_messy_rows(spark, messy, empty):
    model = li.train(messy)
    rows = {(r.doc_id, r.lang_pred, r.score) for r in li.predict(messy, model).collect()}
    assert len(li.predict(messy, model).collect()) == messy.count()
    assert {i for i, lang, s in rows if lang == "und"} == {3, 4, 5, 6, 12, None} and all(s == 0 for _, lang, s in rows if lang == "und")
    assert li.predict(empty, model).collect() == [] and li.train(empty).languages == []
    assert {r.lang_pred for r in li.predict(messy, li.train(empty)).collect()} == {"und"}
    kept = li.keep_identified(messy, model, 0.5)
    assert kept.schema == messy.schema and {r.doc_id for r in kept.collect()} >= {1, 2, 7, 9}


def test_foreign_texts_go_and_clean_ones_stay(spark):
    """Planted texts of no learned language, against every document of the table."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = li.train(docs.where("crc32(cast(doc_id as string)) % 4 <> 2"))
    rng = np.random.default_rng(3)
    noise = lambda letters, n: " ".join("".join(rng.choice(list(letters), rng.integers(3, 9))) for _ in range(n))
    planted = [noise("abcdefghijklmnopqrstuvwxyz", n) for n in (12, 40, 400) for _ in range(10)]
    planted += [noise("абвгдежзийклмноп", 5), noise("αβγδεζηθικλ", 5), "素早い茶色の狐がのろまな犬を飛び越える", "12 34", "", None]
    assert all(foreign for _, _, foreign in model.judged(planted))
    df = spark.createDataFrame([(-k - 1, t) for k, t in enumerate(planted)], "doc_id bigint, text string").union(docs.select("doc_id", "text"))
    kept = {r.doc_id for r in li.keep_identified(df, model, 0.5).collect()}
    lettered = {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")}
    assert kept == lettered
    # what is too short to tell stays
    assert [foreign for _, _, foreign in model.judged(["Qxz", "The cat sat on the mat", "Ok", "the"])] == [False] * 4
