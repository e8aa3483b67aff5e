import random

import pytest
from pyspark.sql import functions as F

from lexfold.operators import pages as pg
from lexfold.sources import dom


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("o")).first().o


@pytest.mark.parametrize("html,text", [
    ("<p>One</p><p>Two</p>", "One\n\nTwo"),
    ("<script>x<b>y</b></script><nav>menu</nav>keep<footer>f</footer>", "keep"),
    ("<header>h</header><main>in<br>side</main>out", "in\nside"),
    ("x<article>art</article>", "art"),
    ("x<div role='main'>m<p>n", "m\nn"),
    ("<!-- c -->a<span>b</span>c", "a b c"),
    ("a&nbsp;&nbsp;b &AMP; &amp;lt; &lt;i&gt; &#65;&#x42; &bogus; &#x26;#67; &#1114112; &mdash;", "a b & &lt; <i> AB &bogus; C &#1114112; —"),
    ("a\n\n\n\n\nb", "a\n\nb"),
    (None, ""),
    ("", ""),
])
def test_visible_text(spark, html, text):
    assert one(spark, pg.visible_text, html) == text


def test_repeated_paragraphs_go(spark):
    long = "A paragraph that is long enough to be noticed twice."
    df = spark.createDataFrame([(1, f"<p>{long}</p><p>short</p><p>{long}</p><p>short</p>"), (2, None), (3, f"<p>{long}</p>")], "page_id bigint, html string")
    assert {r.page_id: r.text for r in pg.page_text(df).collect()} == {1: f"{long}\n\nshort\n\nshort", 2: "", 3: long}


def cleaned(spark, clean, texts):
    df = spark.createDataFrame([(list(enumerate(texts)),)], f"v {pg.LINES}")
    found = df.select(clean(F.col("v")).alias("o")).first().o
    assert [x.pos for x in found] == sorted(x.pos for x in found)
    return [x.line for x in found]


def test_line_cleaning(spark):
    assert cleaned(spark, pg.drop_headings, ["Info", "Text one.", "Info", "Once", "End.", "End.", "h" * 59, "h" * 59, "g" * 60, "g" * 60]) == ["Text one.", "Once", "End.", "End.", "g" * 60, "g" * 60]
    assert cleaned(spark, pg.rejoin, ["We may record", "your activity", "here.", "on", "List:", "item", "Next", "1 x", "and y"]) == ["We may record your activity here.", "on", "List:", "item", "Next", "1 x and y"]
    long = "z" * 40
    assert cleaned(spark, lambda x: pg.drop_repeats(x, 3), [long, "a", "b", "a", long, "b", "a"]) == [long, "a", "b", "b"]
    assert cleaned(spark, pg.drop_repeats, [long, "a", "a", f" {long} ", "a"]) == [long, "a", "a", "a"]
    assert cleaned(spark, pg.rejoin, ["opens low", "and on"]) == ["opens low and on"] and cleaned(spark, pg.clean_lines, []) == []


def test_repeated_labels_of_any_number(spark):
    rng = random.Random(4)
    texts = [[rng.choice("abcde") for _ in range(rng.randrange(0, 14))] for _ in range(60)]
    df = spark.createDataFrame([(k, list(enumerate(t))) for k, t in enumerate(texts)], f"k int, v {pg.LINES}")
    for repeats in (2, 3, 5):
        got = {r.k: [x.line for x in r.o] for r in df.select("k", pg.drop_repeats(F.col("v"), repeats).alias("o")).collect()}
        assert got == {n: [x for k, x in enumerate(t) if t.count(x) < repeats or x not in t[:k]] for n, t in enumerate(texts)}


def test_lines_stay_in_their_row(spark):
    df = spark.createDataFrame([(1, "u", "<p>a</p>"), (1, "u", "<p>b</p>"), (None, "u", "<p>c</p>"), (None, None, None)], "page_id bigint, url string, html string")
    for plan in (pg.page_text(df), pg.page_document(df), pg.page_lines(df)):
        assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
    want = [(1, "a"), (1, "b"), (None, ""), (None, "c")]
    assert sorted(((r.page_id, r.text) for r in pg.page_text(df).collect()), key=str) == want
    assert sorted(((r.page_id, r.text) for r in pg.page_document(df).collect()), key=str) == want


def test_status(spark):
    status = lambda t: tuple(spark.createDataFrame([(t,)], "v string").select(*pg.fetch_status(F.col("v")), pg.usable_status(F.col("v"))).first())
    assert status("short") == ("short", None, "thin")
    assert status("x" * 3000 + " Captcha") == ("blocked", "captcha", "results")
    assert status("Access Denied captcha" + "x" * 3000) == ("blocked", "access denied", "results")
    assert status("😀" * 1997 + "captcha" + "x" * 100)[1] is None and status("😀" * 1996 + "captcha" + "x" * 100)[:2] == ("blocked", "captcha")
    assert status("captcha" + "x" * 9000)[0] == "ok" and status("x" * 4000 + "captcha")[0] == "ok" and status("x" * 2000)[0] == "ok"


@pytest.mark.parametrize("url,name", [("https://www.Big-Shop.co.uk/p", "big-shop"), ("http://a_b.com:80/x", "a-b"), ("ftp://x.org", None), (None, None), ("https://___/", None), ("HTTPS://User@Host.example?q", "host")])
def test_page_name(spark, url, name):
    assert one(spark, pg.page_name, url) == name


def test_given_name_wins(spark):
    assert one(spark, lambda c: pg.page_name(c, F.lit("My Name!")), "https://x.org") == "my-name"


@pytest.mark.parametrize("url,title,hint,toolbar", [
    ("https://x.org/privacy-policy", None, True, True), ("https://x.org/DataProtection", None, True, False), ("https://x.org/gdpr", "", True, False), (None, "Our Privacy\xa0Notice", True, False),
    ("https://x.org/", "Privacy", False, False), (None, None, False, False), ("https://x.org/PRIVACY", None, True, False), ("https://x.org", "cookie  policy", True, False),
])
def test_hints(spark, url, title, hint, toolbar):
    df = spark.createDataFrame([(url, title)], "u string, t string")
    assert tuple(df.select(pg.looks_like_policy(F.col("u"), F.col("t")), pg.toolbar_hint(F.col("u"))).first()) == (hint, toolbar)


def test_document_tree():
    contents = "<ul>" + "".join(f"<li><a href='#s{k}'>Section {k}</a>" for k in range(4)) + "</ul>"
    prose = "<ul>" + "".join(f"<li><a href='#s{k}'>x</a> and a lot of prose around the link" for k in range(4)) + "</ul>"
    title, text = dom.extract(f"<title> T </title><nav>menu</nav><main>{contents}<h2>Head</h2><div role=heading>Also</div><p>Body <b>text</b><p>More{prose}<script>no</script></main>", "https://x.org/p")
    kept = [x.strip() for x in text.split("\n") if x.strip()]
    assert title == "T" and kept == ["Body text", "More"] + ["x and a lot of prose around the link"] * 4
    a = lambda href: dom.Element("a", {"href": href}, None)
    assert [dom.in_page(a(h), "https://x.org/p") for h in ("#x", "/p?q=1#y", "https://x.org:443/p", "/other", "https://y.org/p", "", "http://[bad")] == [True, True, True, False, False, False, False]
    assert dom.extract(None, None) == ("", "")
    assert dom.extract("<div>" * 5000 + "deep", None)[1].strip() == "deep"


def test_page_document(spark):
    body = "<p>This is a sentence that has quite some length to it, really.</p>"
    df = spark.createDataFrame([(1, "u", f"<main>{body}{body}<p>Label<p>x<p>Label<p>{'word ' * 60}</main>"), (2, None, None), (3, "u", "<p>thin</p>")], "page_id bigint, url string, html string")
    rows = {r.page_id: r for r in pg.page_document(df).collect()}
    assert rows[1].status == "results" and rows[1].text.count("quite some length") == 1 and "Label" not in rows[1].text
    assert rows[2].text == "" and rows[2].status == rows[3].status == "thin"
    assert pg.page_document(df.limit(0)).collect() == []


def test_a_page_that_cannot_be_read(spark, monkeypatch):
    def fails(html, url):
        raise AssertionError("no parser takes it")

    monkeypatch.setattr(dom, "extract", fails)
    assert dom.extracted("<p>x", None) == ("", "", True)
    flat = spark.createDataFrame([(1, "T", "", True), (2, "T", "", False)], "page_id bigint, title string, text string, failed boolean")
    monkeypatch.setattr(dom, "flatten", lambda *_: flat)
    assert [r.status for r in pg.page_document(flat).orderBy("page_id").collect()] == ["error", "thin"]


def test_malformed_marked_sections_lose_only_themselves():
    for broken in ("<![ x>", "<![foo[ x>", "<![foo[ x ]]>", "<![1>"):
        title, text = dom.extract(f"<title>T</title><body><p>before{broken}<p>after", None)
        assert title == "T" and text.split()[0] == "before" and text.split()[-1] == "after", broken
    assert dom.extract("<title>T</title><body><p>before<![ x", None)[1].split() == ["before"]
    assert dom.extract("<body><p>a<![if !IE]>c<![endif]><p>b", None)[1].split() == ["ac", "b"]
