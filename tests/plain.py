"""Slow plain-Python readings of the engine's rules, to hold the columns against."""

import re

from lexfold.functions import vocabulary as v

BLANKS = "".join(map(chr, [*range(9, 14), 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))
B = f"[{re.escape(BLANKS)}]"


def units(s):
    return len(s.encode("utf-16-le")) // 2


def ends_sentence(line, at):
    """Whether the terminator at this place of a line ends a sentence."""
    if line[at] != ".":
        return True
    before, after = line[:at], line[at + 1 :]
    if re.search(r"[0-9]\Z", before) and re.match("[0-9]", after):
        return False
    word = re.search(r"[A-Za-z.]*\Z", before)[0].rstrip(".")
    return len(word) != 1 and word.lower() not in v.ABBREVIATIONS and not re.match(f"{B}*[a-z]", after)


def sentences(text):
    """(sentence, index, lead_in) of a text."""
    out, at, stem = [], 0, None
    for line in (text or "").split("\n"):
        item = re.match(rf"{B}*(?:[{v.BULLETS}]|[-–—*]|\(?[0-9]{{1,3}}[.)]){B}+", line)
        skip = item.end() if item else 0
        body, cuts, look = line[skip:], [0], 0
        while m := re.compile("[.!?]").search(body, look):
            look = m.end()
            if ends_sentence(body, m.start()):
                look = re.compile(f"[.!?{v.CLOSERS}]*").match(body, look).end()
                cuts.append(look)
        cuts = sorted({*cuts, len(body)})
        found = []
        for i, j in zip(cuts, cuts[1:]):
            piece = body[i:j]
            if kept := piece.strip(BLANKS):
                lead = len(piece) - len(piece.lstrip(BLANKS))
                found.append((kept, units(line[: skip + i + lead]) + at))
        carried = stem if item else None
        out += [(s, i, carried) for s, i in found]
        if found and not (item and stem):
            stem = found[-1][0] if found[-1][0].endswith(":") else None
        at += units(line) + 1
    return out
