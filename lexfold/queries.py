"""The registered queries of the engine: each takes (spark, folder of tables) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexfold.functions import vocabulary as v
from lexfold.functions.text import trim_blank, units
from lexfold.operators import pages as pg
from lexfold.operators import reports as rp
from lexfold.operators.detect import RULES, analyze, flat_matches, results
from lexfold.operators.segment import segment
from lexfold.oracles import PAGE_VARIANTS
from lexfold.plans.scan import fetched, scan_pages
from lexfold.sources.corpus import spread
from lexfold.sources.policy_corpus import EXCERPTS, PINS, policy_documents

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def _policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy_documents(_table(spark, sf_dir, "documents"))


def _analyzed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyze(_policy(spark, sf_dir))


def _long(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(c).cast("bigint").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes))


def segment_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(segment(_table(spark, sf_dir, "documents")))


def segment_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(segment(_table(spark, sf_dir, "conversations"), keep=("conv_id", "turn")))


def segment_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(segment(_policy(spark, sf_dir)))


def _detect(category: str) -> Query:
    rules = tuple(r for r in RULES if r.category == category)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _long(flat_matches(analyze(_policy(spark, sf_dir), rules=rules)).select("doc_id", "sentence", "index", "severity"))

    return run


def results_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = results(_analyzed(spark, sf_dir))
    return found.select("doc_id", F.col("ord").cast("bigint"), "category", "label", "base_severity", "found", F.size("matches").cast("bigint").alias("n_matches"))


def readout_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.cards(_analyzed(spark, sf_dir)).drop("ord")


def readout_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(rp.quotes(_analyzed(spark, sf_dir)).drop("ord"))


def eval_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.counts(_analyzed(spark, sf_dir)).drop("ord")


def eval_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.pivot(_analyzed(spark, sf_dir))


def eval_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.totals(_analyzed(spark, sf_dir))


def misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(rp.misses(_analyzed(spark, sf_dir)))


def miss_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.miss_counts(_analyzed(spark, sf_dir))


def misses_by_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.misses(_analyzed(spark, sf_dir)).groupBy("family").agg(F.count("*").alias("misses"), F.count_distinct("doc_id").alias("documents"))


def category_found_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.found_rate(_analyzed(spark, sf_dir), _table(spark, sf_dir, "labels"), "toxic")


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pg.page_text(_table(spark, sf_dir, "pages"))


def page_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = pg.page_text(_table(spark, sf_dir, "pages"))
    status, marker = pg.fetch_status(F.col("text"))
    return texts.select("page_id", units(F.col("text")).cast("bigint").alias("n_units"), pg.usable_status(F.col("text")).alias("usable"), status.alias("status"), marker.alias("marker"))


def _variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PAGE_VARIANTS.replace("FROM pages", "FROM {pages}"), pages=_table(spark, sf_dir, "pages"))


def page_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _variants(spark, sf_dir).select("page_id", pg.page_name(F.col("url")).alias("name"))


def policy_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _variants(spark, sf_dir).select("page_id", pg.looks_like_policy(F.col("url"), F.col("title")).alias("hint"), pg.toolbar_hint(F.col("url")).alias("toolbar"))


def _lines(spark: SparkSession, sf_dir: str, clean: Callable[[Column], Column]) -> DataFrame:
    """(doc_id, pos, line): what cleaning leaves of each document's lines."""
    docs = _table(spark, sf_dir, "documents")
    return _long(docs.select("doc_id", clean(pg.lines_in(F.col("text"))).alias("lines")).select("doc_id", F.inline("lines")))


def lines_without_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir, lambda x: pg.drop_headings(pg.collapse(x)))


def lines_rejoined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir, lambda x: pg.rejoin(pg.drop_headings(pg.collapse(x))))


def lines_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir, pg.clean_lines)


def corpus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = units(F.col("text"))
    return _policy(spark, sf_dir).agg(F.count("*").alias("documents"), F.count_if(trim_blank(F.col("text")) != "").alias("usable"), F.sum(n.cast("bigint")).alias("n_units"), F.count_if(n < v.THIN_LENGTH).alias("thin"))


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(rp.report_lines(_analyzed(spark, sf_dir)))


def miss_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(rp.miss_lines(_analyzed(spark, sf_dir)))


def report_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(rp.total_lines(_analyzed(spark, sf_dir)))


def miss_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.miss_total(_analyzed(spark, sf_dir))


def corpus_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third document counts as a committed excerpt, the others as local files."""
    prefix = F.when(F.col("doc_id") % 3 == 0, v.EXCERPT_PREFIX).otherwise(v.LOCAL_PREFIX)
    return rp.corpus_counts(_table(spark, sf_dir, "documents").select(F.concat(prefix, F.col("doc_id").cast("string")).alias("doc")))


def corpus_pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each pinned assertion about the committed excerpts holds: what must, and must not, be found."""
    found = flat_matches(analyze(spark.createDataFrame(list(EXCERPTS), "name string, text string"), keep=("name",)), ("name",)).select("name", "category", "sentence")
    pins = spark.createDataFrame(list(PINS), "name string, category string, must boolean, needle string")
    hits = found.join(F.broadcast(pins), ["name", "category"]).where(F.contains("sentence", "needle")).select("name", "category", "must", "needle").distinct().withColumn("hit", F.lit(True))
    return pins.join(hits, ["name", "category", "must", "needle"], "left").select("name", "category", "must", "needle", (F.coalesce("hit", F.lit(False)) == F.col("must")).alias("holds"))


def page_fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fetched(_table(spark, sf_dir, "pages")).drop("text")


def page_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status and message of every page, by the document tree."""
    return scan_pages(_table(spark, sf_dir, "pages"))[0].select("page_id", "status", "message")


def page_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document tree's text of every page."""
    return pg.page_document(_table(spark, sf_dir, "pages"))


QUERIES: dict[str, Query] = {
    "segment_documents": segment_documents,
    "segment_conversations": segment_conversations,
    "segment_policy": segment_policy,
    **{f"detect_{c}": _detect(c) for c, _, _ in v.CATEGORIES},
    **{f.__name__: f for f in (results_by_category, readout_cards, readout_quotes, eval_counts, eval_pivot, eval_totals, misses, miss_counts, misses_by_family, category_found_rate,
                               page_text, page_gate, page_name, policy_hint, lines_without_headings, lines_rejoined, lines_cleaned, corpus_summary, report_lines, miss_lines, report_totals, miss_total, corpus_counts, corpus_pins, page_fetched, page_scan, page_document)},
}
