"""Sentence segmentation: text to spans with offsets and list lead-ins.

A line feed is a hard boundary.  Within a line a sentence ends at a run of
terminators and closers; a point that belongs to a decimal, an initial or an
abbreviation, or that a lower-case letter follows, ends nothing.  List markers are
skipped.  An item of a list that a line ending in a colon has opened carries that
line's last sentence as its lead-in.

Everything happens inside the row: one regex pass cuts after boundaries and list
markers, and a running fold over the pieces gives offsets and lead-ins.
There is no shuffle and no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexfold.functions.text import BLANK_IN_LINE, let, scan, trim_end, trim_start, units
from lexfold.functions.vocabulary import ABBREVIATIONS, BULLETS, CLOSERS, DASHES

_MARKER = rf"{BLANK_IN_LINE}*(?:[{BULLETS}]|[{DASHES[1:]}{DASHES[0]}]|\(?[0-9]{{1,3}}[.)]){BLANK_IN_LINE}+"
_SHORT_WORD = rf"(?<![A-Za-z.])(?:[A-Za-z]|(?i:{'|'.join(a.replace('.', chr(92) + '.') for a in ABBREVIATIONS)}))"
#: A point that ends a sentence; the cheap conditions come first.  Only the first of several points can, as those after it are of its run or end as little.
_POINT = rf"\.(?<!\.\.)(?!{BLANK_IN_LINE}*[a-z])(?!(?<=[0-9]\.)[0-9])(?<!{_SHORT_WORD}\.)"
_END = rf"(?:[!?]|{_POINT})[.!?{CLOSERS}]*|\n|(?<![^\n]){_MARKER}"

SPAN = "struct<sentence:string,index:int,lead_in:string>"


def _cut(text: Column) -> Column:
    """What stands between pieces, and nowhere in the text: more of one character than the text has in a row, between two others."""
    runs = F.transform(F.split(F.regexp_replace(text, "[^\x02]+", " "), " "), F.length)
    return F.when(F.contains(text, F.lit("\x02")), F.concat(F.lit("\x01"), F.repeat(F.lit("\x02"), F.array_max(runs) + 1), F.lit("\x01"))).otherwise("\x01\x02\x01")


def spans(text: Column) -> Column:
    """array<struct<sentence, index, lead_in>> of a text; null and blank texts have none.

    ``index`` is the offset of the sentence in UTF-16 units, ``lead_in`` null unless carried.
    """
    whole = F.coalesce(text, F.lit(""))
    pieces = F.split(F.regexp_replace(whole, F.lit(_END), F.concat(F.lit("$0"), _cut(whole))), _cut(whole), -1)

    def described(raw: Column) -> Column:
        # a blank is one unit, so that characters count what leads
        return let(trim_start(raw), lambda start: F.struct(
            units(raw).alias("size"), trim_end(start).alias("body"), (F.length(raw) - F.length(start)).alias("lead"),
            F.endswith(raw, F.lit("\n")).alias("ends"), raw.rlike(rf"\A{_MARKER}\z").alias("marker")))

    null = F.lit(None).cast("string")
    zero = F.struct(F.lit(0).alias("at"), null.alias("open"), F.lit(True).alias("fresh"), F.lit(False).alias("item"), null.alias("last"))

    def marks(s: Column, p: Column) -> Column:
        return s["fresh"] & p["marker"]

    def said(s: Column, p: Column) -> Column:
        return F.when((p["body"] != "") & ~marks(s, p), p["body"])

    def step(s: Column, p: Column) -> Column:
        last, item = F.coalesce(said(s, p), s["last"]), s["item"] | marks(s, p)
        keeps = last.isNull() | (item & s["open"].isNotNull())
        after = F.when(keeps, s["open"]).when(F.endswith(last, F.lit(":")), last)
        return F.struct((s["at"] + p["size"]).alias("at"), F.when(p["ends"], after).otherwise(s["open"]).alias("open"), p["ends"].alias("fresh"),
                        (~p["ends"] & item).alias("item"), F.when(~p["ends"], last).alias("last"))

    def emit(s: Column, p: Column) -> Column:
        return F.struct(said(s, p).alias("sentence"), (s["at"] + p["lead"]).alias("index"), F.when(s["item"], s["open"]).alias("lead_in"))

    found = scan(F.transform(pieces, described), zero, step, emit, SPAN)
    return F.filter(found, lambda x: x["sentence"].isNotNull())


def segment(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(*keep, sentence, index, lead_in): one row for each sentence."""
    held = df.select(*keep, spans(F.col(text)).alias("__spans"))
    # the outer form keeps the optimizer from computing the spans twice for a filter on their size
    return held.select(*keep, F.inline_outer("__spans")).where(F.col("sentence").isNotNull())
