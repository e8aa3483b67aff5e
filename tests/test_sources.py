from lexfold.functions.sql import register
from lexfold.operators.detect import analyze
from lexfold.operators.reports import counts
from lexfold.sources.corpus import corpus, single_text, write_texts
from lexfold.streaming.analyze import for_each_batch, stream_matches


def test_single_texts(spark):
    assert single_text(spark, " \n\xa0").collect() == [] and single_text(spark, None).collect() == []
    assert single_text(spark, "Some text").first().text == "Some text" and single_text(spark, " \n Some text\xa0").first().text == "Some text"


def test_corpus_of_excerpts_and_files(spark, tmp_path):
    (tmp_path / "b.txt").write_text("We sell your personal data.\nTwo\n")
    (tmp_path / "a.txt").write_text("é")
    (tmp_path / "c.md").write_text("no")
    (tmp_path / "a-b.txt").write_text("w")
    assert [r.doc for r in corpus(spark, [("one", "x")], str(tmp_path)).collect()] == ["excerpt:one", "local:a-b", "local:a", "local:b"]
    got = corpus(spark, [("one", "x")], str(tmp_path)).where("text <> 'w'").orderBy("doc").collect()
    assert [tuple(r) for r in got] == [("excerpt:one", "x"), ("local:a", "é"), ("local:b", "We sell your personal data.\nTwo\n")]
    assert corpus(spark, [("one", "x")], f"{tmp_path}/none").count() == 1
    write_texts(spark.createDataFrame([("one", "x"), ("two", "é\ny"), ("three", None)], "doc string, text string"), f"{tmp_path}/out")
    assert {p.name: p.read_text() for p in (tmp_path / "out").glob("*.txt")} == {"one.txt": "x\n", "two.txt": "é\ny\n", "three.txt": "\n"}
    assert not list((tmp_path / "out").glob("name=*"))


def test_streams(spark, tmp_path):
    docs = spark.createDataFrame([(1, "We sell your personal data."), (2, "Nothing.")], "doc_id bigint, text string")
    docs.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(docs.schema).parquet(f"{tmp_path}/in")
    q = stream_matches(stream).writeStream.format("memory").queryName("found").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [r.category for r in spark.table("found").collect()] == ["data_sale"]
    seen = []
    q = for_each_batch(stream, counts, lambda df, n: seen.extend(df.where("matches > 0").collect()), f"{tmp_path}/cp")
    q.awaitTermination(60)
    assert [(r.doc_id, r.category) for r in seen] == [(1, "data_sale")]
    assert analyze(docs).count() == 2


def test_sql_functions(spark):
    register(spark)
    r = spark.sql("SELECT looks_like_policy('https://x/privacy', NULL) a, looks_like_policy(NULL, 'Cookie  Notice') b, toolbar_hint('x/gdpr') c, severity_rank('warning') d, clip_text('abcdef', 4) e").first()
    assert tuple(r) == (True, True, False, 2, "abc…")
