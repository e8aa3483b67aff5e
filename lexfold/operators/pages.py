"""Pages: HTML to text and lines, line cleaning, gates, names and hints.

``page_text`` is native.  ``page_lines`` needs a document tree for navigation and
jump-link lists and takes it from ``sources.dom``, in Arrow batches; what follows
it is native again.  Lines are an array inside the page's row, so that cleaning
sorts and compares them without a shuffle, and rows of equal id stay apart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexfold.functions import vocabulary as v
from lexfold.functions.text import collapse_blank, first_units, let, trim_blank, units


def _numeric(s: Column, pattern: str, base: int) -> Column:
    """Character references by number; those beyond Unicode stay as they are."""
    parts = F.split(F.regexp_replace(s, f"(?i)&#{'x' if base == 16 else ''}({pattern}+);", "\x01$1\x02"), "\x01", -1)

    def decoded(p: Column, k: Column) -> Column:
        digits = F.substring_index(p, "\x02", 1)
        written = F.concat(F.lit("&#x" if base == 16 else "&#"), digits, F.lit(";"))
        value = F.conv(F.when(F.length(F.ltrim(digits, F.lit("0"))) <= 7, digits).otherwise(F.lit("0")), base, 10).cast("bigint")
        valid = (value > 0) & (value <= 0x10FFFF) & ~value.between(0xD800, 0xDFFF)
        char = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(value), 8, "0")), "UTF-32")).otherwise(written)
        return F.when((k == 0) | ~F.contains(p, F.lit("\x02")), p).otherwise(F.concat(char, F.substring(p, F.length(digits) + 2, 1 << 30)))

    return F.array_join(F.transform(parts, decoded), "")


def decode_entities(s: Column) -> Column:
    """Hexadecimal, then decimal references, then the known names once (the ampersand's last, so that nothing is decoded twice)."""
    out = _numeric(_numeric(F.translate(s, "\x01\x02", ""), "[0-9a-f]", 16), "[0-9]", 10)
    for name, char in sorted(v.ENTITIES.items(), key=lambda x: x[0] == "amp"):
        out = F.regexp_replace(out, f"(?i)&{name};", char.replace("\\", "\\\\").replace("$", "\\$"))
    return out


def visible_text(html: Column) -> Column:
    """The text of a page by patterns: the main region if one is declared, without page furniture, blocks on their own lines."""
    s = F.regexp_replace(F.coalesce(html, F.lit("")), r"<!--[\s\S]*?-->", " ")
    s = F.regexp_replace(s, rf"(?i)<({'|'.join(v.DROPPED_ELEMENTS)})\b[\s\S]*?</\1\s*>", " ")
    regions = [r"(?i)<main\b[\s\S]*?</main\s*>", r"(?i)<article\b[\s\S]*?</article\s*>", r"""(?i)<[a-z]+\b[^>]*\brole=["']?main["']?[^>]*>[\s\S]*"""]
    s = F.coalesce(*(F.nullif(F.regexp_extract(s, r, 0), F.lit("")) for r in regions), s)
    s = F.regexp_replace(s, rf"(?i)<({'|'.join(v.CHROME_ELEMENTS)})\b[\s\S]*?</\1\s*>", " ")
    s = F.regexp_replace(s, rf"(?i)<(?:{'|'.join(v.BREAK_ELEMENTS)})\s*/?>", "\n")
    s = F.regexp_replace(s, rf"(?i)</?(?:{v.LINE_ELEMENTS})\b[^>]*>", "\n")
    s = decode_entities(F.regexp_replace(s, "<[^>]+>", " "))
    lines = F.transform(F.split(s, "\n", -1), lambda x: trim_blank(F.regexp_replace(x, r"[ \t\xa0]+", " ")))
    return trim_blank(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"))


LINES = "array<struct<pos:int,line:string>>"


def lines_in(text: Column) -> Column:
    """array<struct<pos, line>> of a text; a null text has none."""
    return F.coalesce(F.transform(F.split(text, "\n", -1), lambda x, k: F.struct(k.alias("pos"), x.alias("line"))), F.expr(f"cast(array() as {LINES})"))


def _sorted(lines: Column, key: Callable[[Column], Column], body: Callable[[Column], Column]) -> Column:
    """Lines chosen among equals: ``body`` sees structs (key, pos, line), equal keys side by side, and what it leaves comes back in order."""
    beside = F.array_sort(F.transform(lines, lambda x: F.struct(key(x["line"]).alias("key"), x["pos"].alias("pos"), x["line"].alias("line"))))
    return F.array_sort(F.transform(let(beside, body), lambda x: F.struct(x["pos"].alias("pos"), x["line"].alias("line"))))


def _same(s: Column, x: Column, k: Column) -> Column:
    return F.coalesce(F.get(s, k)["key"] == x["key"], F.lit(False))


def drop_repeats(lines: Column, repeats: int | None = None) -> Column:
    """Lines without later copies of long ones, and, if ``repeats`` is given, of any that occur so often."""

    def left(s: Column) -> Column:
        def stays(x: Column, k: Column) -> Column:
            collapses = units(x["key"]) >= v.PARAGRAPH_LENGTH
            for a in range(repeats or 0):  # so many equal lines in a row around this one
                collapses = collapses | (_same(s, x, k - a) & _same(s, x, k - a + (repeats - 1)))
            return ~(_same(s, x, k - 1) & collapses)

        return F.filter(s, stays)

    return _sorted(lines, trim_blank, left)


def collapse(lines: Column) -> Column:
    """Blanks collapsed, empty lines gone."""
    return F.filter(F.transform(lines, lambda x: F.struct(x["pos"].alias("pos"), collapse_blank(x["line"]).alias("line"))), lambda x: x["line"] != "")


def drop_headings(lines: Column) -> Column:
    """Without short lines that end in no sentence mark and recur on the page."""

    def left(s: Column) -> Column:
        return F.filter(s, lambda x, k: ~((_same(s, x, k - 1) | _same(s, x, k + 1)) & (units(x["key"]) < v.HEADING_LENGTH) & ~x["key"].rlike(r"[.?!]\z")))

    return _sorted(lines, lambda line: line, left)


def rejoin(lines: Column) -> Column:
    """A line that opens in lower case continues the one before, unless that closes a clause; such runs become one line."""

    def joined(s: Column) -> Column:
        def opens(x: Column, k: Column) -> Column:
            return ~((k > 0) & ~F.coalesce(F.get(s, k - 1)["line"].rlike(r"[.?!:]\z"), F.lit(True)) & x["line"].rlike("^[a-z]"))

        def runs(b: Column) -> Column:
            end = lambda k: F.coalesce(F.get(b, k + 1), F.size(s))
            run = lambda begin, k: F.slice(s, begin + 1, end(k) - begin)
            return F.transform(b, lambda begin, k: F.struct(F.get(s, begin)["pos"].alias("pos"), F.array_join(F.transform(run(begin, k), lambda x: x["line"]), " ").alias("line")))

        return let(F.filter(F.transform(s, lambda x, k: F.when(opens(x, k), k)), lambda k: k.isNotNull()), runs)

    return let(lines, joined)


def clean_lines(lines: Column) -> Column:
    """Blanks collapsed, empty lines gone, recurring headings gone, severed sentences joined, repeats collapsed."""
    return drop_repeats(rejoin(drop_headings(collapse(lines))), v.LABEL_REPEATS)


def joined(lines: Column) -> Column:
    return F.array_join(F.transform(lines, lambda x: x["line"]), "\n")


def page_text(pages: DataFrame, key: str = "page_id", html: str = "html", keep: tuple[Column, ...] = ()) -> DataFrame:
    """(key, *keep, text): the visible text without repeated paragraphs; every page keeps its row."""
    once = joined(drop_repeats(lines_in(visible_text(F.col(html)))))
    return pages.select(key, *keep, trim_blank(F.regexp_replace(once, r"\n{3,}", "\n\n")).alias("text"))


def page_lines(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, pos, line): the cleaned lines of a page's main content, by its document tree."""
    from lexfold.sources.dom import flatten

    return flatten(pages, key, url, html).select(key, F.inline(clean_lines(lines_in(F.col("text")))))


def page_document(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, title, text, status): text by the document tree; ``thin`` where it is too short to be analyzed, ``error`` where the page cannot be read."""
    from lexfold.sources.dom import flatten

    whole = flatten(pages, key, url, html).select(key, "title", joined(clean_lines(lines_in(F.col("text")))).alias("text"), "failed")
    return whole.select(key, "title", "text", F.when(F.col("failed"), "error").otherwise(usable_status(F.col("text"))).alias("status"))


def usable_status(text: Column) -> Column:
    return F.when(units(F.coalesce(text, F.lit(""))) < v.THIN_LENGTH, "thin").otherwise("results")


def fetch_status(text: Column) -> tuple[Column, Column]:
    """Status of a fetched text (short, blocked, ok), and the first block marker in it."""
    low = F.lower(first_units(text, v.MARKER_WINDOW))
    marker = F.coalesce(*(F.when(F.contains(low, F.lit(m)), F.lit(m)) for m in v.BLOCK_MARKERS))
    size = units(text)
    return F.when(size < v.FETCH_LENGTH, "short").when(marker.isNotNull() & (size < v.MARKER_LENGTH), "blocked").otherwise("ok"), marker


def page_name(url: Column, given: Column | None = None) -> Column:
    """A file name from a page's address, or the given one; null where there is none or the address is no http(s) one."""
    host = F.lower(F.regexp_extract(url, r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    raw = F.split(F.regexp_replace(host, r"^www\.", ""), r"\.")[0]
    if given is not None:
        raw = F.coalesce(given, raw)
    name = F.regexp_replace(F.regexp_replace(F.lower(raw), "[^a-z0-9-]+", "-"), "^-+|-+$", "")
    return F.when(url.rlike("(?i)^https?://"), F.nullif(name, F.lit("")))


def looks_like_policy(url: Column, title: Column) -> Column:
    return F.coalesce(url, F.lit("")).rlike(f"(?i){v.POLICY_URL}") | collapse_blank(F.coalesce(title, F.lit(""))).rlike(f"(?i){v.POLICY_TITLE}")


def toolbar_hint(url: Column) -> Column:
    """Narrower than ``looks_like_policy``: an address with one of a few signals, in the case given."""
    out = F.lit(False)
    for signal in v.TOOLBAR_SIGNALS:
        out = out | F.contains(F.coalesce(url, F.lit("")), F.lit(signal))
    return out
