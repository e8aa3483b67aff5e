"""Secret scans with one deterministic automaton for all rules.

The rules' regexes are parsed, joined into one nondeterministic automaton,
made deterministic by subset construction and minimised into a transition
array over byte classes.  One pass over the bytes of a batch finds which rules
match where: bytes that bring every state back to the start cut the batch into
lanes, and numpy moves all lanes one byte at a time.  Lanes in which a rule
accepts are then walked by that rule's own small automaton, which gives the
leftmost longest spans.

Edge cases: a null text counts as empty; texts are scanned whole, in UTF-8, and
spans count code points, end exclusive; rows without a finding have empty spans;
repeated rows repeat; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexfold.llm.common import over_batches, small_batches, text_bytes

#: Bytes after which a lane ends at the next byte that resets the automaton.
LANE_BYTES = 256
#: With fewer lanes than this left, their rest is walked one by one.
FEW_LANES = 12


@dataclass(frozen=True)
class Rule:
    """``keep`` judges a match (bytes); without it every match stays."""

    kind: str
    pattern: str
    keep: Callable[[bytes], bool] | None = None
    #: A stricter pattern for the combined automaton; it must accept in every text with a match that stays.
    sieve: str | None = None


def _value_of_six(match: bytes) -> bool:
    sign = min(i for i in (match.find(b":"), match.find(b"=")) if i >= 0)
    value = match[sign + 1 :].lstrip(b" ")
    return len(value) - value.startswith((b'"', b"'")) >= 6


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in word)


_KEYS = "|".join([*map(_either_case, ("password", "passwd", "secret", "token")), _either_case("api") + "_?" + _either_case("key")])

BASE_RULES = (
    Rule("assign", f"({_KEYS})[\"']?\\x20*[:=]\\x20*[\"']?[A-Za-z0-9+/_.=\\-]+", _value_of_six),
    Rule("access", "AKIA[A-Z0-9]+", lambda m: len(m) >= 20),
    Rule("hex", "[0-9a-f]+", lambda m: len(m) >= 24, "[0-9a-f]{24}"),
)
#: What the scan adds to the base rules.
MORE_RULES = (
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge_token", "gh[pousr]_[A-Za-z0-9]+", lambda m: len(m) >= 40),
    Rule("jwt", r"eyJ[A-Za-z0-9_\-]+\.eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+"),
)
RULES = BASE_RULES + MORE_RULES


class _Nfa:
    """States are numbers; ``moves`` has (byte set, target), ``free`` the moves without a byte."""

    def __init__(self) -> None:
        self.moves: list[list[tuple[frozenset[int], int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def add(self, pattern: str) -> tuple[int, int]:
        """Begin and end of the pattern's part: literals, classes, groups, alternatives, ? * + {n} {n,}."""
        start, end, at = self._either(pattern, 0)
        if at != len(pattern):
            raise ValueError(f"unexpected {pattern[at]!r} at {at} in {pattern!r}")
        return start, end

    def _either(self, p: str, i: int) -> tuple[int, int, int]:
        start, end = self.state(), self.state()
        while True:
            a, b, i = self._sequence(p, i)
            self.free[start].append(a)
            self.free[b].append(end)
            if i >= len(p) or p[i] != "|":
                return start, end, i
            i += 1

    def _sequence(self, p: str, i: int) -> tuple[int, int, int]:
        start = last = self.state()
        while i < len(p) and p[i] not in "|)":
            begin = i
            a, b, i = self._atom(p, i)
            low, high, j = _repeat(p, i)
            for k in range(max(low, 1)):
                if k:
                    a, b, _ = self._atom(p, begin)
                self.free[last].append(a)
                if low == 0:
                    self.free[a].append(b)
                tail, last = a, b
            if high is None:
                self.free[b].append(tail)
            i = j
        return start, last, i

    def _atom(self, p: str, i: int) -> tuple[int, int, int]:
        if p[i] == "(":
            a, b, i = self._either(p, i + 1)
            # a state of its own on either side, as repeats add free moves
            x, y = self.state(), self.state()
            self.free[x].append(a)
            self.free[b].append(y)
            return x, y, i + 1
        chars, i = _class(p, i) if p[i] == "[" else _char(p, i)
        a, b = self.state(), self.state()
        self.moves[a].append((frozenset(chars), b))
        return a, b, i


def _char(p: str, i: int) -> tuple[set[int], int]:
    if p[i] == "\\":
        if p[i + 1] == "x":
            return {int(p[i + 2 : i + 4], 16)}, i + 4
        return {ord(p[i + 1])}, i + 2
    return {ord(p[i])}, i + 1


def _class(p: str, i: int) -> tuple[set[int], int]:
    chars: set[int] = set()
    i += 1
    while p[i] != "]":
        low, i = _char(p, i)
        if p[i] == "-" and p[i + 1] != "]":
            high, i = _char(p, i + 1)
            chars |= set(range(min(low), max(high) + 1))
        else:
            chars |= low
    return chars, i + 1


def _repeat(p: str, i: int) -> tuple[int, int | None, int]:
    """At least, at most (None: any number), where the pattern goes on."""
    if i < len(p) and p[i] in "?*+":
        return {"?": (0, 1), "*": (0, None), "+": (1, None)}[p[i]] + (i + 1,)
    if i < len(p) and p[i] == "{":
        j = p.index("}", i)
        low, _, open_end = p[i + 1 : j].partition(",")
        return int(low), (None if p[i + 1 : j].endswith(",") else int(open_end or low)), j + 1
    return 1, 1, i


@dataclass
class Dfa:
    """Transition array [state * classes + class] of next states; state ``start``; ``accepts`` has a bit for each rule."""

    classes: np.ndarray
    n_classes: int
    step: np.ndarray
    accepts: np.ndarray
    start: int


def compile_dfa(patterns: list[str], anywhere: bool) -> Dfa:
    """Subset construction and minimisation of the patterns' union; ``anywhere``: matches may begin at any byte."""
    nfa = _Nfa()
    ends: dict[int, int] = {}
    begin = nfa.state()
    for bit, p in enumerate(patterns):
        a, b = nfa.add(p)
        nfa.free[begin].append(a)
        ends[b] = 1 << bit
    closures: dict[int, frozenset[int]] = {}

    def closure(s: int) -> frozenset[int]:
        if s not in closures:
            seen, todo = {s}, [s]
            while todo:
                for t in nfa.free[todo.pop()]:
                    if t not in seen:
                        seen.add(t)
                        todo.append(t)
            closures[s] = frozenset(x for x in seen if nfa.moves[x] or x in ends)
        return closures[s]

    # bytes that no pattern tells apart share a class
    kinds: dict[tuple[bool, ...], int] = {}
    sets = sorted({c for moves in nfa.moves for c, _ in moves}, key=sorted)
    classes = np.array([kinds.setdefault(tuple(b in c for c in sets), len(kinds)) for b in range(256)], np.uint8)
    sample = [int(np.argmax(classes == k)) for k in range(len(kinds))]
    first = closure(begin)
    subsets, todo, step = {first: 0}, [first], []
    for subset in todo:
        for byte in sample:
            out = set(first) if anywhere else set()
            for s in subset:
                for chars, t in nfa.moves[s]:
                    if byte in chars:
                        out |= closure(t)
            key = frozenset(out)
            if key not in subsets:
                subsets[key] = len(todo)
                todo.append(key)
            step.append(subsets[key])
    step = np.array(step, np.int64).reshape(len(todo), len(sample))
    accepts = np.array([sum(ends[s] for s in subset if s in ends) for subset in todo], np.uint64 if len(patterns) > 8 else np.uint8)
    # minimisation: split groups until their members agree on the groups they move to
    group = np.unique(accepts, return_inverse=True)[1]
    while True:
        finer = np.unique(np.column_stack([group, group[step]]), axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() == group.max():
            break
        group = finer
    member = np.zeros(group.max() + 1, np.int64)
    member[group] = np.arange(len(group))
    return Dfa(classes, len(sample), group[step[member]].astype(np.int32).reshape(-1), accepts[member], int(group[0]))


class Scanner:
    """The combined automaton and each rule's own, ready to scan."""

    def __init__(self, rules: tuple[Rule, ...] = RULES) -> None:
        if len(rules) > 64:
            raise ValueError("a scan takes 64 rules at most, a bit for each; scan others by a second scanner")
        self.rules = rules
        self.all = compile_dfa([r.sieve or r.pattern for r in rules], anywhere=True)
        self.own = [self._listed(compile_dfa([r.pattern], anywhere=False)) for r in rules]
        table = self.all.step.reshape(-1, self.all.n_classes)
        self.resets = (table == self.all.start).all(axis=0)[self.all.classes]
        if not self.resets[10]:
            raise ValueError("no rule may match a line break")

    @staticmethod
    def _listed(dfa: Dfa) -> tuple[list[int], list[int], list[bool], int, int]:
        """Lists for walking byte by byte, and the state that nothing leaves."""
        table = dfa.step.reshape(-1, dfa.n_classes)
        dead = [s for s in range(len(table)) if not dfa.accepts[s] and (table[s] == s).all()]
        wide = table[:, dfa.classes].reshape(-1).tolist()
        return wide, dfa.accepts.astype(bool).tolist(), dfa.start, dead[0] if dead else -1

    def marked(self, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One pass over the bytes: begin, end and accepted rules of each lane with any."""
        dfa = self.all
        resets = np.nonzero(self.resets[row])[0] + 1
        grid = np.searchsorted(resets, np.arange(LANE_BYTES, len(row), LANE_BYTES))
        cuts = np.unique(np.concatenate([[0], resets[grid[grid < len(resets)]], [len(row)]]))
        begin, end = cuts[:-1], cuts[1:]
        order = np.argsort(begin - end, kind="stable")
        begin, end = begin[order], end[order]
        size = end - begin
        coded = dfa.classes[row].astype(np.int32)
        state = np.full(len(begin), dfa.start * dfa.n_classes, np.int32)
        step = dfa.step * dfa.n_classes
        accepts = np.repeat(dfa.accepts, dfa.n_classes)
        hits = np.zeros(len(begin), accepts.dtype)
        longest = int(size[0]) if len(size) else 0
        left = np.searchsorted(-size, -np.arange(longest), side="left")  # lanes longer than t
        for t in range(longest):
            n = left[t]
            if n < FEW_LANES:
                self._rest(coded, begin, end, state, hits, n, t)
                break
            s = step[state[:n] + coded[begin[:n] + t]]
            state[:n] = s
            hits[:n] |= accepts[s]
        found = np.nonzero(hits)[0]
        found = found[np.argsort(begin[found])]
        return begin[found], end[found], hits[found]

    def _rest(self, coded, begin, end, state, hits, n: int, t: int) -> None:
        if not hasattr(self, "walk"):
            self.walk = (self.all.step * self.all.n_classes).tolist(), np.repeat(self.all.accepts, self.all.n_classes).tolist()
        step, accepts = self.walk
        for k in range(n):
            s, hit = int(state[k]), int(hits[k])
            for c in coded[begin[k] + t : end[k]].tolist():
                s = step[s + c]
                hit |= accepts[s]
            hits[k] = hit

    def spans(self, rule: int, lane: bytes) -> list[tuple[int, int]]:
        """Leftmost longest matches of one rule, without overlap, in bytes of the lane; those it drops still take their bytes."""
        wide, accepts, start, dead = self.own[rule]
        keep, out, i, n = self.rules[rule].keep, [], 0, len(lane)
        while i < n:
            s, last, j = start, -1, i
            while j < n:
                s = wide[s << 8 | lane[j]]
                if s == dead:
                    break
                j += 1
                if accepts[s]:
                    last = j
            if last > i:
                if keep is None or keep(lane[i:last]):
                    out.append((i, last))
                i = last
            else:
                i += 1
        return out

    def scan(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """(start, rule, end) of each text's findings in code points, sorted."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        whole = b"\n".join(texts)
        if not whole:
            return out
        row = np.frombuffer(whole, np.uint8)
        ends = np.cumsum([len(t) + 1 for t in texts])
        for b, e, hit in zip(*(x.tolist() for x in self.marked(row))):
            lane = whole[b:e]
            for rule in range(len(self.rules)):
                if hit >> rule & 1:
                    for i, j in self.spans(rule, lane):
                        k = int(np.searchsorted(ends, b + i, side="right"))
                        base = int(ends[k - 1]) if k else 0
                        out[k].append((b + i - base, rule, b + j - base))
        for k, found in enumerate(out):
            if found:
                found.sort()
                text, ascii_only = texts[k], texts[k].isascii()
                if not ascii_only:
                    lead = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
                    out[k] = [(int(lead[i]) - 1, r, int(lead[j - 1])) for i, r, j in found]
        return out


def scan(df: DataFrame, id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id, spans array<struct<kind, start, end>>) of every row, by start, then by the rules' order."""
    small_batches(df.sparkSession)
    scanner = Scanner(rules)  # transition arrays, whose size depends on the rules alone
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [r.kind for r in scanner.rules]
        for b in batches:
            found = scanner.scan(text_bytes(b.column(1)))
            spans = [[{"kind": kinds[r], "start": i, "end": j} for i, r, j in x] for x in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, pa.list_(span))], names=[id, "spans"])

    picked = df.select(id, text)
    return over_batches(picked, run, f"`{id}` {picked.schema[0].dataType.simpleString()}, spans array<struct<kind:string,start:bigint,end:bigint>>")
