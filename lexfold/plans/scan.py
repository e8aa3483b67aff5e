"""Whole plans: what a user runs from a text, a page or a corpus to its readout."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexfold.functions import vocabulary as v
from lexfold.functions.text import units
from lexfold.operators import pages as pg
from lexfold.operators import reports as rp
from lexfold.operators.detect import RULES, Rule, analyze
from lexfold.sources.corpus import single_text


@dataclass
class Readout:
    """An analyzed collection and its presentations, all lazy."""

    analyzed: DataFrame
    keep: tuple[str, ...]

    @property
    def cards(self) -> DataFrame:
        return rp.cards(self.analyzed, self.keep)

    @property
    def quotes(self) -> DataFrame:
        return rp.quotes(self.analyzed, self.keep)

    @property
    def report(self) -> DataFrame:
        return rp.report_lines(self.analyzed, self.keep[0])

    @property
    def miss_report(self) -> DataFrame:
        return rp.miss_lines(self.analyzed, self.keep[0])

    @property
    def totals_report(self) -> DataFrame:
        return rp.total_lines(self.analyzed)

    @property
    def miss_total(self) -> DataFrame:
        return rp.miss_total(self.analyzed)


def scan_text(spark: SparkSession, text: str | None, rules: tuple[Rule, ...] = RULES) -> Readout:
    """A pasted or selected text; a blank one gives an empty readout."""
    return Readout(analyze(single_text(spark, text), keep=("doc",), rules=rules), ("doc",))


def scan_corpus(corpus: DataFrame, rules: tuple[Rule, ...] = RULES) -> Readout:
    """(doc, text) rows."""
    return Readout(analyze(corpus, keep=("doc",), rules=rules), ("doc",))


def scan_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, Readout]:
    """The pages with title, text, status and message, and the readout of those with enough text."""
    found = pg.page_document(pages, key, url, html).withColumn("message", scanned(F.col("status"), F.col("title"), F.col("text")))
    return found, Readout(analyze(found.where("status = 'results'"), keep=(key,), rules=rules), (key,))


def fetched(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, name, status, marker, n_units, text): pages as a corpus would take them; only those with status ``ok`` and a name are fit to be written."""
    status, marker = pg.fetch_status(F.col("text"))
    named = pg.page_text(pages, key, html, (pg.page_name(F.col(url)).alias("name"),))
    return named.select(key, "name", status.alias("status"), marker.alias("marker"), units(F.col("text")).cast("bigint").alias("n_units"), "text")


def scanned(status, title, text):
    """What a reader is told about a scanned page."""
    named = F.coalesce(F.nullif(title, F.lit("")), F.lit(v.NO_TITLE))
    said = F.replace(F.replace(F.lit(v.SCANNED), F.lit("{title}"), named), F.lit("{count}"), F.format_number(units(text), 0))
    return F.when(status == "thin", v.THIN_NOTE).when(status == "error", v.ERROR_NOTE).otherwise(said)
