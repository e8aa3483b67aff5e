from lexfold.operators.detect import analyze
from lexfold.operators.reports import miss_lines, report_lines
from lexfold.plans.scan import fetched, scan_corpus, scan_pages, scan_text


def test_texts(spark):
    found = scan_text(spark, "We sell your personal data.")
    assert [r.category for r in found.quotes.collect()] == ["data_sale"] and found.cards.count() == 6
    assert scan_text(spark, " \n").cards.collect() == []


def test_pages(spark):
    body = "We sell your personal data. " * 10
    pages = spark.createDataFrame([(1, "https://www.shop.example/p", f"<title>Shop</title><main><p>{body}</main>"), (2, None, "<p>thin</p>"), (None, "u", None)], "page_id bigint, url string, html string")
    seen, readout = scan_pages(pages)
    rows = {r.page_id: r for r in seen.collect()}
    assert rows[1].message == "Scanned “Shop” — 279 characters of text." and rows[2].status == rows[None].status == "thin" and "Too little" in rows[2].message
    assert readout.quotes.count() == 10 and readout.cards.count() == 6
    got = {r.page_id: (r.name, r.status) for r in fetched(pages).collect()}
    assert got == {1: ("shop", "short"), 2: (None, "short"), None: (None, "short")}


def test_reports_as_text(spark):
    corpus = spark.createDataFrame([("a", "We sell your personal data. We like to share."), ("b", "Ads sell. We share.")], "doc string, text string")
    lines = [r.line for r in scan_corpus(corpus).report.where("doc = 'a'").orderBy("pos").collect()]
    assert lines[0] == "=== a ===" and lines[2] == '  data_sale              1  e.g. "We sell your personal data."' and lines[1] == "  data_collection        0"
    missed = [r.line for r in scan_corpus(corpus).miss_report.orderBy("doc", "pos").collect()]
    assert missed == ["=== a — 1 candidate miss ===", '  [sharing] "We like to share."', "=== b — 2 candidate misses ===", '  [sale] "Ads sell."', '  [sharing] "We share."']
    none = analyze(corpus, keep=("doc",)).limit(0)
    assert report_lines(none, "doc").collect() == [] and miss_lines(none, "doc").collect() == []
