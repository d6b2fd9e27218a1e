"""Secret scan: all rules in one deterministic automaton, one pass over the bytes.

Rules become position automata, subset construction makes one automaton of all of them
and refinement makes it minimal. Texts are scanned side by side: one numpy step moves
thousands of lanes on by a byte. Lanes are cut only behind bytes that lead every state
back to the start, so no match crosses a cut.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from re import _constants as op
from re import _parser
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forumlake.llm.common import ship_package


class Rule(NamedTuple):
    """``head`` and then at least ``least`` characters of the class ``body``."""

    kind: str
    head: str
    body: str
    least: int


BASE_KINDS = ("assign", "access", "hex")
RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""",
         r"[A-Za-z0-9+/_.=-]", 12),
    Rule("access", "AKIA", "[A-Z0-9]", 14),
    Rule("hex", "", "[0-9a-f]", 16),
    Rule("hub", "gh[opsu]_", "[A-Za-z0-9]", 20),
    Rule("chat", "xox[abps]-", "[A-Za-z0-9-]", 20),
)


class Nfa:
    """States with steps on sets of bytes and steps without a byte."""

    def __init__(self):
        self.steps: list[list[tuple[frozenset, int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.steps.append([])
        self.free.append([])
        return len(self.steps) - 1

    def add(self, parsed, start: int, folded: bool = False) -> int:
        """Append what the expression parser made of a pattern; the state behind it."""
        for kind, value in parsed:
            if kind in (op.LITERAL, op.IN):
                end = self.state()
                items = [(kind, value)] if kind is op.LITERAL else value
                self.steps[start].append((byte_set(items, folded), end))
            elif kind is op.SUBPATTERN:
                end = self.add(value[3], start, folded or bool(value[1] & 2))
            elif kind is op.BRANCH:
                end = self.state()
                for branch in value[1]:
                    self.free[self.add(branch, start, folded)].append(end)
            elif kind is op.MAX_REPEAT:
                low, high, inner = value
                end = start
                for _ in range(low):
                    end = self.add(inner, end, folded)
                if high is op.MAXREPEAT:
                    back = self.state()
                    self.free[end].append(back)
                    self.free[self.add(inner, back, folded)].append(back)
                    end = back
                else:
                    ends = [end]
                    for _ in range(high - low):
                        ends.append(self.add(inner, ends[-1], folded))
                    end = self.state()
                    for e in ends:
                        self.free[e].append(end)
            else:
                raise ValueError(f"{kind} is not supported in a rule")
            start = end
        return start


def byte_set(items, folded: bool) -> frozenset:
    found: set[int] = set()
    for kind, value in items:
        if kind is op.LITERAL:
            found.add(value)
        elif kind is op.RANGE:
            found.update(range(value[0], value[1] + 1))
        else:
            raise ValueError(f"{kind} is not supported in a class")
    if folded:
        found |= {ord(c) for b in found for c in (chr(b).lower(), chr(b).upper())}
    return frozenset(found)


class Dfa(NamedTuple):
    """``move[state * 256 + byte]`` is the next state; ``accepts`` has a bit per rule. State 0
    is the start; ``dead`` is the state nothing leaves and nothing is found in, or -1."""

    move: np.ndarray
    accepts: np.ndarray
    dead: int


def compile_rules(patterns: list[str], anywhere: bool) -> Dfa:
    """One minimal automaton of all patterns; ``anywhere``: a match may start at any byte."""
    nfa = Nfa()
    start = nfa.state()
    final = {}
    for bit, pattern in enumerate(patterns):
        first = nfa.state()
        nfa.free[start].append(first)
        final[nfa.add(_parser.parse(pattern), first)] = 1 << bit

    def closed(states) -> frozenset:
        found, todo = set(states), list(states)
        while todo:
            for s in nfa.free[todo.pop()]:
                if s not in found:
                    found.add(s)
                    todo.append(s)
        return frozenset(found)

    used = {bytes_ for steps in nfa.steps for bytes_, _ in steps}
    kinds: dict[tuple, int] = {}
    kind_of = [kinds.setdefault(tuple(b in x for x in used), len(kinds)) for b in range(256)]
    example = {k: b for b, k in enumerate(kind_of)}
    to = [{k: closed([t for bytes_, t in steps if b in bytes_]) for k, b in example.items()
           if any(b in bytes_ for bytes_, _ in steps)} for steps in nfa.steps]
    begin = closed([start])
    again = begin if anywhere else frozenset()
    number, todo, rows = {begin: 0}, [begin], []
    for subset in todo:
        row = []
        for k in range(len(kinds)):
            target = again.union(*[to[s][k] for s in subset if k in to[s]])
            if target not in number:
                number[target] = len(number)
                todo.append(target)
            row.append(number[target])
        rows.append(row)
    table = np.array(rows)
    accepts = np.array([sum({final[s] for s in subset if s in final}) for subset in todo])
    group = np.unique(accepts, return_inverse=True)[1]
    while True:  # split groups of states until the members of each go to the same groups
        marks = np.column_stack([group, group[table]])
        finer = np.unique(marks, axis=0, return_inverse=True)[1].ravel()
        if finer.max() == group.max():
            break
        group = finer
    order = {g: i for i, g in enumerate(dict.fromkeys(group.tolist()))}  # the start comes first
    group = np.array([order[g] for g in group.tolist()])
    first = np.unique(group, return_index=True)[1]
    small = group[table[first]]
    move = small[:, kind_of]
    loops = (move == np.arange(len(first))[:, None]).all(1) & (accepts[first] == 0)
    dead = int(np.flatnonzero(loops)[0]) if loops.any() and not anywhere else -1
    return Dfa(move.astype("int32").ravel(), accepts[first].astype("uint8"), dead)


class Scanner:
    """Finds the spans of all rules in many texts at once."""

    LANE = 256

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        # A rule with a head is found by its head and one character: counting the lengths of
        # all rules at once would multiply the states. Lengths are measured on what is found.
        self.all = compile_rules(
            [r.head + r.body + (f"{{{r.least},}}" if not r.head else "") for r in rules], anywhere=True)
        #: The rules as they match without a least length, and their heads, from a given byte on.
        self.whole = [compile_rules([f"{r.head}{r.body}+"], anywhere=False) for r in rules]
        self.heads = [compile_rules([r.head], anywhere=False) if r.head else None for r in rules]
        self.plain = [(d.move.tolist(), d.accepts.tolist(), d.dead) if d else None
                      for d in (*self.whole, *self.heads)]
        table = self.all.move.reshape(-1, 256)
        self.resets = (table == 0).all(0)
        assert self.resets[10], "a rule goes over line ends"

    def longest(self, which: int, data: bytes, at: int) -> int:
        """End of the longest match from ``at`` on, or -1."""
        move, accepts, dead = self.plain[which]
        state, end = 0, -1
        for i in range(at, len(data)):
            state = move[state * 256 + data[i]]
            if state == dead:
                break
            if accepts[state]:
                end = i + 1
        return end

    def spans(self, rule: int, data: bytes) -> Iterator[tuple[int, int]]:
        """Leftmost matches that do not overlap; too short ones are passed over whole."""
        at, n = 0, len(data)
        while at < n:
            end = self.longest(rule, data, at)
            if end < 0:
                at += 1
                continue
            body = self.longest(len(self.rules) + rule, data, at) if self.rules[rule].head else at
            if end - body >= self.rules[rule].least:
                yield at, end
            at = end

    def flagged(self, data: np.ndarray) -> list[tuple[int, int, int]]:
        """Start, end and rule bits of the lanes in which a rule is found."""
        n = len(data)
        cuts = np.flatnonzero(self.resets[data]) + 1
        wanted = np.searchsorted(cuts, np.arange(self.LANE, n, self.LANE))
        inner = np.unique(cuts[wanted[wanted < len(cuts)]])
        starts = np.concatenate([[0], inner[inner < n]])
        lengths = np.diff(np.concatenate([starts, [n]]))
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        active = np.searchsorted(-lengths, -np.arange(lengths[0] if n else 0), side="left")
        state = np.zeros(len(starts), "int32")
        found = np.zeros(len(starts), "uint8")
        for i, m in enumerate(active):
            state[:m] = self.all.move[(state[:m] << 8) + data[starts[:m] + i]]
            found[:m] |= self.all.accepts[state[:m]]
        hit = np.flatnonzero(found)
        return [(int(starts[h]), int(starts[h] + lengths[h]), int(found[h])) for h in hit]

    def scan(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        """Kind, start and end (code points) of the spans of each text, by start and kind."""
        coded = [t.encode("utf-8", "surrogatepass") for t in texts]
        data = b"\n".join(coded)
        ends = np.cumsum([len(c) + 1 for c in coded])
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for start, end, bits in self.flagged(np.frombuffer(data, "uint8")) if data else []:
            lane = data[start:end]
            for rule in range(len(self.rules)):
                if bits >> rule & 1:
                    for a, b in self.spans(rule, lane):
                        text = int(np.searchsorted(ends, start + a, side="right"))
                        base = int(ends[text]) - len(coded[text]) - 1
                        out[text].append((start + a - base, rule, start + b - base))
        return [[(self.rules[r].kind, chars(t, c, a), chars(t, c, b)) for a, r, b in sorted(own)]
                for t, c, own in zip(texts, coded, out, strict=True)]


def chars(text: str, coded: bytes, at: int) -> int:
    return at if len(text) == len(coded) else len(coded[:at].decode("utf-8", "surrogatepass"))


@functools.lru_cache(maxsize=2)
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def find_secrets(
    df: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id and ``found``, an array of kind, start and end, of each row's whole text.

    Spans are sorted by start and then by the order of the rules; spans of different kinds may
    overlap. A null or empty text has none. Repeated rows each get their own result, an
    empty table none; columns other than the two named are not read.
    """
    ship_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(scanner(tuple(rules)))

    @F.pandas_udf("array<struct<kind:string,start:long,end:long>>")
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scan = shared.value.scan
        for batch in batches:
            out = []
            for lot in lots(batch):
                out.extend([[{"kind": k, "start": a, "end": b} for k, a, b in own] for own in scan(lot)])
            yield pd.Series(out, dtype=object)

    return df.select(F.col(id_col).alias("doc_id"),
                     spans(F.coalesce(F.col(text_col), F.lit(""))).alias("found"))


def lots(batch: pd.Series, most: int = 2_000_000) -> Iterator[list[str]]:
    lot, size = [], 0
    for text in batch:
        lot.append(text)
        size += len(text)
        if size >= most:
            yield lot
            lot, size = [], 0
    if lot:
        yield lot
