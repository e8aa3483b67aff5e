"""Reports over analyzed texts: per-category counts, samples, totals, candidate misses, readout cards.

All but the totals are computed inside a text's row, so that texts without a
match keep their rows without a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexfold.functions import vocabulary as v
from lexfold.functions.text import clip, has_any, let, prefixes
from lexfold.operators.detect import results


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, v.SEVERITIES)), severity).cast("int") - 1


def counts(analyzed: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(*keep, ord, category, matches, sample): zeros kept; the sample is the category's first match, clipped."""
    return results(analyzed, keep).select(*keep, "ord", "category", F.size("matches").cast("bigint").alias("matches"), clip(F.try_element_at("matches", F.lit(1))["sentence"], v.SAMPLE_CLIP).alias("sample"))


def _count(category: str) -> Column:
    return F.size(F.filter("matches", lambda m: m["category"] == category)).cast("bigint")


def pivot(analyzed: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(*keep, a column for each category): match counts side by side."""
    return analyzed.select(*keep, *(_count(c).alias(c) for c, _, _ in v.CATEGORIES))


def _summed(analyzed: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(*by, documents, m0, f0, m1, f1, ...): sums of six counters a text, so that one row a partition and group is shuffled."""
    counted = analyzed.select(*by, *(_count(c).alias(f"m{k}") for k, (c, _, _) in enumerate(v.CATEGORIES)))
    sums = [x for k in range(len(v.CATEGORIES)) for x in (F.sum(f"m{k}").alias(f"m{k}"), F.sum((F.col(f"m{k}") > 0).cast("bigint")).alias(f"f{k}"))]
    return counted.groupBy(*by).agg(F.count("*").alias("documents"), *sums).where("documents > 0")


def _of_category(k: int) -> Column:
    return F.struct(F.lit(v.CATEGORIES[k][0]).alias("category"), F.col(f"m{k}").alias("matches"), F.col(f"f{k}").alias("documents_found"))


def totals(analyzed: DataFrame) -> DataFrame:
    """(category, matches, documents_found, documents): over all texts; the row with a null category is the grand total."""
    every = range(len(v.CATEGORIES))
    add = lambda letter: sum((F.col(f"{letter}{k}") for k in every[1:]), F.col(f"{letter}0"))
    grand = F.struct(F.lit(None).cast("string").alias("category"), add("m").alias("matches"), add("f").alias("documents_found"))
    return _summed(analyzed, ()).select(F.inline(F.array(*map(_of_category, every), grand)), "documents")


def _missed() -> Column:
    """Of an analyzed text: array<struct<index, family_ord, family, sentence>>."""

    def flagged(x: Column, categories: tuple[str, ...]) -> Column:
        return F.exists("matches", lambda m: (m["index"] == x["index"]) & m["category"].isin(*categories))

    def of(x: Column) -> Column:
        def families(low: Column) -> Column:
            each = [F.when(has_any(low, words) & ~flagged(x, categories), F.struct(x["index"].alias("index"), F.lit(k).alias("family_ord"), F.lit(name).alias("family"), clip(x["sentence"], v.MISS_CLIP).alias("sentence")))
                    for k, (name, words, categories) in enumerate(v.MISS_FAMILIES)]
            return F.filter(F.array(*each), lambda y: y.isNotNull())

        return let(F.lower(x["sentence"]), families)

    words = prefixes([w for _, some, _ in v.MISS_FAMILIES for w in some])
    return F.flatten(F.transform(F.filter("spans", lambda x: F.lower(x["sentence"]).rlike(words)), of))


def misses(analyzed: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(*keep, index, family_ord, family, sentence): sentences with a family's keyword that no detector of the family's categories flagged."""
    return analyzed.select(*keep, _missed().alias("__missed")).select(*keep, F.inline_outer("__missed")).where(F.col("family").isNotNull())


def miss_counts(analyzed: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(*keep, misses): zeros kept."""
    return analyzed.select(*keep, F.size(_missed()).cast("bigint").alias("misses"))


def cards(analyzed: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(*keep, ord, category, label, found_label, card_severity, match_count_text): the card's severity is the highest among its matches, at least the base, and null if nothing was found."""
    base = severity_rank(F.col("base_severity"))
    top = F.greatest(base, F.array_max(F.transform("matches", lambda m: F.coalesce(severity_rank(m["severity"]), base))))
    labels = F.array(*(F.lit(v.SEVERITY_LABELS[s]) for s in v.SEVERITIES))
    return results(analyzed, keep).select(
        *keep, "ord", "category", "label", F.when(F.col("found"), v.FOUND_LABEL).otherwise(v.NOT_FOUND_LABEL).alias("found_label"),
        F.when(F.col("found"), F.element_at(labels, top + 1)).alias("card_severity"), F.when(F.col("found"), F.replace(F.lit(v.COUNT_LABEL), F.lit("{count}"), F.size("matches").cast("string"))).alias("match_count_text"))


def quotes(analyzed: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(*keep, ord, category, nth, sentence, badge): the card's quotations in order; a badge only for a severity of the match's own."""
    badge = F.create_map(*[x for s, label in v.SEVERITY_LABELS.items() for x in (F.lit(s), F.lit(label))])
    flat = results(analyzed, keep).select(*keep, "ord", "category", F.posexplode_outer("matches").alias("nth", "m")).where(F.col("nth").isNotNull())
    return flat.select(*keep, "ord", "category", F.col("nth"), F.col("m.sentence").alias("sentence"), F.when(F.col("m.severity").isNotNull(), F.try_element_at(badge, F.col("m.severity"))).alias("badge"))


def found_rate(analyzed: DataFrame, labels: DataFrame, label: str, key: str = "doc_id") -> DataFrame:
    """(label, category, documents, documents_found): how often each category is found among labelled texts."""
    held = analyzed.select(F.col(key).alias("__id"), "matches").join(labels.select(F.col(key).alias("__key"), label), F.col("__id") == F.col("__key"))
    per = _summed(held, (label,)).select(label, "documents", F.inline(F.array(*map(_of_category, range(len(v.CATEGORIES))))))
    return per.select(label, "category", "documents", "documents_found")


#: Width of a category's name in a report.
_NAME_WIDTH = max(len(c) for c, _, _ in v.CATEGORIES) + 2


def report_lines(analyzed: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, pos, line): the corpus report as text, a heading and a line for each category, with its count and first match."""
    sample = F.when(F.col("sample").isNotNull(), F.concat(F.lit('  e.g. "'), F.col("sample"), F.lit('"'))).otherwise("")
    line = F.concat(F.lit("  "), F.rpad("category", _NAME_WIDTH, " "), F.when(F.col("matches") > 999, F.col("matches").cast("string")).otherwise(F.lpad(F.col("matches").cast("string"), 3, " ")), sample)
    head = analyzed.select(key, F.lit(0).alias("pos"), F.concat(F.lit("=== "), F.col(key).cast("string"), F.lit(" ===")).alias("line"))
    return head.union(counts(analyzed, (key,)).select(key, F.col("ord") + 1, line))


def miss_lines(analyzed: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, pos, line): the candidate misses as text, a heading with their number and a line for each."""

    def lines(found: Column) -> Column:
        n = F.size(found)
        head = F.concat(F.lit("=== "), F.col(key).cast("string"), F.lit(" — "), n.cast("string"), F.when(n == 1, " candidate miss ===").otherwise(" candidate misses ==="))
        return F.concat(F.array(head), F.transform(found, lambda m: F.concat(F.lit("  ["), m["family"], F.lit('] "'), m["sentence"], F.lit('"'))))

    return analyzed.select(key, F.posexplode(let(_missed(), lines)).alias("pos", "line"))


def total_lines(analyzed: DataFrame) -> DataFrame:
    """(pos, line): the totals that close the corpus report; those of no text are zero."""
    ords = F.create_map(*[x for k, (c, _, _) in enumerate(v.CATEGORIES) for x in (F.lit(c), F.lit(k + 1))])
    found = totals(analyzed).where("category IS NOT NULL").select(F.col("category").alias("__c"), "matches")
    named = analyzed.sparkSession.createDataFrame([(c,) for c, _, _ in v.CATEGORIES], "category string").join(F.broadcast(found), F.col("category") == F.col("__c"), "left")
    n = F.coalesce("matches", F.lit(0)).cast("string")
    line = F.concat(F.lit("  "), F.rpad("category", _NAME_WIDTH, " "), F.when(F.length(n) > 4, n).otherwise(F.lpad(n, 4, " ")))
    head = analyzed.sparkSession.createDataFrame([(0, v.TOTALS_HEAD)], "pos int, line string")
    return head.union(named.select(ords[F.col("category")].alias("pos"), line.alias("line")))


def miss_total(analyzed: DataFrame) -> DataFrame:
    """(misses, documents, line): the line that closes the report of candidate misses."""
    sums = analyzed.agg(F.coalesce(F.sum(F.size(_missed())), F.lit(0)).alias("misses"), F.count("*").alias("documents"))
    return sums.withColumn("line", F.concat(F.col("misses").cast("string"), F.lit(" candidate misses across "), F.col("documents").cast("string"), F.lit(" documents.")))


def corpus_counts(corpus: DataFrame, doc: str = "doc") -> DataFrame:
    """(excerpts, local, line): committed excerpts and local files of a corpus, by the beginnings of their names, and the report's first line."""
    starts = lambda p: F.count_if(F.startswith(F.col(doc), F.lit(p)))
    n = corpus.agg(starts(v.EXCERPT_PREFIX).alias("excerpts"), starts(v.LOCAL_PREFIX).alias("local"))
    line = F.concat(F.lit("eval — "), F.col("excerpts").cast("string"), F.lit(" committed excerpt(s), "), F.col("local").cast("string"), F.when(F.col("local") == 1, " local policy").otherwise(" local policies"))
    return n.withColumn("line", line)
