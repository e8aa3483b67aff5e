"""Text primitives as native column expressions.

Offsets and lengths count UTF-16 code units.  White space is the class below,
which is wider than what Java's and RE2's ``\\s`` know.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space (fixed value): the code points that count as blank in a source text.
BLANKS = r"\x{9}-\x{d}\x{20}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
BLANK = f"[{BLANKS}]"
#: The same without the line feed.
BLANK_IN_LINE = f"[{BLANKS.replace(chr(92) + 'x{9}-' + chr(92) + 'x{d}', chr(92) + 'x{9}' + chr(92) + 'x{b}-' + chr(92) + 'x{d}')}]"
BLANK_CHARACTERS = "".join(map(chr, (*range(0x9, 0xE), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))
ASTRAL = r"[\x{10000}-\x{10ffff}]"
#: Curly quotes, which patterns name.
QUOTES = "“”‘’"


def _is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


def trim_start(c: Column) -> Column:
    return F.ltrim(c, F.lit(BLANK_CHARACTERS))


def trim_end(c: Column) -> Column:
    return F.rtrim(c, F.lit(BLANK_CHARACTERS))


def trim_blank(c: Column) -> Column:
    """Without blanks at either end."""
    return F.trim(c, F.lit(BLANK_CHARACTERS))


def units(c: Column) -> Column:
    """Length in UTF-16 units."""
    return F.when(_is_ascii(c), F.length(c)).otherwise((F.octet_length(F.encode(c, "UTF-16LE")) / 2).cast("int"))


def collapse_blank(c: Column) -> Column:
    """Each run of blanks one space, ends trimmed."""
    return F.trim(F.regexp_replace(c, f"{BLANK}+", " "))


def match_copy(c: Column) -> Column:
    """The copy on which patterns run: as long as the text in UTF-16 units, but
    with blanks as spaces and all that is neither ASCII nor a curly quote as a
    tilde.  On it word boundaries, case and gap lengths mean the same to every
    regex engine."""
    # translate goes character by character, so that texts without such blanks are spared it
    plain = F.when(c.rlike("[\\x09-\\x0d]"), F.translate(c, "\t\n\v\f\r", "     ")).otherwise(c)
    spaced = F.regexp_replace(F.regexp_replace(plain, f"[{BLANKS.replace(chr(92) + 'x{9}-' + chr(92) + 'x{d}' + chr(92) + 'x{20}', '')}]", " "), ASTRAL, "~~")
    return F.when(_is_ascii(c), plain).otherwise(F.regexp_replace(spaced, f"[^\\x{{0}}-\\x{{7f}}{QUOTES}]", "~"))


def any_of(patterns: list[str] | tuple[str, ...], ignore_case: bool = True) -> str:
    """One pattern that matches where any of these does."""
    return ("(?i)" if ignore_case else "") + "|".join(f"(?:{p})" for p in patterns)


def matches(c: Column, patterns: list[str] | tuple[str, ...] | str, ignore_case: bool = True) -> Column:
    return c.rlike(any_of([patterns] if isinstance(patterns, str) else patterns, ignore_case))


def has_any(low: Column, words: list[str] | tuple[str, ...]) -> Column:
    """Whether a text, in lower case already, contains any of the words."""
    out = F.lit(False)
    for w in words:
        out = out | F.contains(low, F.lit(w))
    return out


def prefixes(words: list[str] | tuple[str, ...]) -> str:
    """One pattern for any of some plain words, those of the same first letter together, which spares a regex engine most of its attempts."""
    short = [w for w in dict.fromkeys(words) if not any(o != w and w.startswith(o) for o in words)]
    by: dict[str, list[str]] = {}
    for w in short:
        by.setdefault(w[0], []).append(re.escape(w[1:]))
    return "|".join(re.escape(first) + (f"(?:{'|'.join(rest)})" if len(rest) > 1 else rest[0]) for first, rest in by.items())


def first_units(c: Column, n: int) -> Column:
    """The first ``n`` UTF-16 units; half of a character that is cut in two reads U+FFFD."""
    coded = F.encode(c, "UTF-16LE")
    halved = F.substring(F.hex(F.substring(coded, 2 * n, 1)), 1, 2).between("D8", "DB")
    exact = F.concat(F.decode(F.when(halved, F.substring(coded, 1, 2 * n - 2)).otherwise(F.substring(coded, 1, 2 * n)), "UTF-16LE"), F.when(halved, F.lit("\ufffd")).otherwise(""))
    return F.when(F.length(c) * 2 <= n, c).when(units(c) == F.length(c), F.substring(c, 1, n)).otherwise(exact)


def clip(c: Column, most: int) -> Column:
    """At most this many UTF-16 units, the last of them an ellipsis where something was cut."""
    return F.when(units(c) > most, F.concat(first_units(c, most - 1), F.lit("…"))).otherwise(c)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of the value, which is computed once however often the body names it."""
    return F.transform(F.array(value), body)[0]


#: Elements that one inner aggregate of ``scan`` appends, so that copying stays near-linear on long arrays.
SCAN_BLOCK = 32


def scan(items: Column, zero: Column, step: Callable[[Column, Column], Column], emit: Callable[[Column, Column], Column], emitted: str) -> Column:
    """A running fold over an array: what ``emit(state, item)`` gives for each item, with the state before it.

    ``emitted`` is the emitted type.  A row's array is folded in place, so no row leaves its partition.
    """
    none, nones = F.expr(f"cast(array() as array<{emitted}>)"), F.expr(f"cast(array() as array<array<{emitted}>>)")

    def folded(xs: Column) -> Column:
        blocks = F.when(F.size(xs) > 0, F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / SCAN_BLOCK).cast("int"))).otherwise(F.expr("cast(array() as array<int>)"))

        def inner(state: Column, block: Column) -> Column:
            return F.aggregate(F.slice(xs, block * SCAN_BLOCK + 1, SCAN_BLOCK), F.struct(state.alias("state"), none.alias("out")),
                               lambda a, x: F.struct(step(a["state"], x).alias("state"), F.concat(a["out"], F.array(emit(a["state"], x))).alias("out")))

        def outer(a: Column, block: Column) -> Column:
            return let(inner(a["state"], block), lambda r: F.struct(r["state"].alias("state"), F.concat(a["out"], F.array(r["out"])).alias("out")))

        return F.flatten(F.aggregate(blocks, F.struct(zero.alias("state"), nones.alias("out")), outer)["out"])

    return let(items, folded)
