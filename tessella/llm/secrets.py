"""Operator 6: secrets, found by one minimised deterministic automaton for all rules.

Every rule is a small regular expression over bytes. The reversed rules, each behind any bytes, are combined
by subset construction and minimised into one transition array: a single pass over a text's bytes, from its
end, marks for all rules where matches can start. From each marked start the rule's own automaton (made
the same way, forwards) runs to the longest end. Matches of a rule are leftmost and don't overlap;
for these rules the longest match is the one that a backtracking matcher finds.

Null and empty texts have no spans. Repeated rows each give a row; a null doc_id stays null. Columns other
than doc_id and text are ignored. Time is linear in the text but for the matches themselves."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from tessella.llm.common import id_and_text, per_row


@dataclass(frozen=True)
class Rule:
    """``least`` is the fewest characters of the match, or of what follows ``value_after``, the expression of its head."""

    kind: str
    pattern: str
    least: int = 1
    value_after: str = ""
    any_case: bool = False


_HEAD = r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
#: The first three are the base. A hex run that is too short holds no match of its own, so its least length can be part of the automaton;
#: more such counts would multiply the states.
RULES = (
    Rule("assign", _HEAD + r"[A-Za-z0-9+/_.=-]+", 6, _HEAD, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24}[0-9a-f]*", 24),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge", r"gh(p|o|u|s|r)_[A-Za-z0-9]+", 40),
    Rule("chat", r"xox(a|b|p|r|s)-[A-Za-z0-9-]+", 15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 30),
)
BASE = ("assign", "access", "hex")


# --- expressions: ("set", bytes), ("cat", parts), ("alt", parts), ("star", part)


def parse(pattern: str, any_case: bool = False) -> tuple:
    """The subset that rules need: literals, \\xHH, classes, groups, |, ?, *, + and {n}."""
    at = 0

    def one() -> int:
        nonlocal at
        c = pattern[at]
        at += 1
        if c != "\\":
            return ord(c)
        c = pattern[at]
        at += 1
        if c == "x":
            at += 2
            return int(pattern[at - 2 : at], 16)
        return ord(c)

    def letters(codes: set[int]) -> tuple:
        if any_case:
            codes = codes | {ord(chr(c).swapcase()) for c in codes if c < 128 and chr(c).isalpha()}
        return "set", frozenset(codes)

    def atom() -> tuple:
        nonlocal at
        if pattern[at] == "(":
            at += 1
            got = alternatives()
            at += 1
            return got
        if pattern[at] != "[":
            return letters({one()})
        at += 1
        codes: set[int] = set()
        while pattern[at] != "]":
            first = one()
            if pattern[at] == "-" and pattern[at + 1] != "]":
                at += 1
                codes |= set(range(first, one() + 1))
            else:
                codes.add(first)
        at += 1
        return letters(codes)

    def sequence() -> tuple:
        nonlocal at
        parts = []
        while at < len(pattern) and pattern[at] not in "|)":
            got = atom()
            if at < len(pattern) and pattern[at] in "?*+{":
                mark = pattern[at]
                at += 1
                if mark == "{":
                    end = pattern.index("}", at)
                    got, at = ("cat", (got,) * int(pattern[at:end])), end + 1
                else:
                    got = {"?": ("alt", (got, ("cat", ()))), "*": ("star", got), "+": ("cat", (got, ("star", got)))}[mark]
            parts.append(got)
        return "cat", tuple(parts)

    def alternatives() -> tuple:
        nonlocal at
        parts = [sequence()]
        while at < len(pattern) and pattern[at] == "|":
            at += 1
            parts.append(sequence())
        return parts[0] if len(parts) == 1 else ("alt", tuple(parts))

    return alternatives()


def backwards(x: tuple) -> tuple:
    if x[0] == "set":
        return x
    if x[0] == "star":
        return "star", backwards(x[1])
    return x[0], tuple(backwards(p) for p in (reversed(x[1]) if x[0] == "cat" else x[1]))


@dataclass
class Automaton:
    """``to[state + column[byte]]`` is the next state, already times the number of columns; ``accepts[state]`` are the rules as bits. State 0 is dead or, unanchored, the start."""

    column: bytes
    width: int
    to: list[int]
    accepts: list[int]
    start: int


def compile_rules(trees: list[tuple], anchored: bool) -> Automaton:
    edges: list[list[tuple[frozenset, int]]] = [[]]
    empty: list[list[int]] = [[]]

    def state() -> int:
        edges.append([])
        empty.append([])
        return len(edges) - 1

    def build(x: tuple, a: int) -> int:
        if x[0] == "set":
            edges[a].append((x[1], b := state()))
            return b
        if x[0] == "cat":
            for part in x[1]:
                a = build(part, a)
            return a
        b = state()
        if x[0] == "alt":
            for part in x[1]:
                empty[a].append(first := state())
                empty[build(part, first)].append(b)
            return b
        empty[a].append(b)
        empty[build(x[1], b)].append(b)
        return b

    final: dict[int, int] = {}
    for bit, tree in enumerate(trees):
        empty[0].append(first := state())
        final[build(tree, first)] = 1 << bit
    if not anchored:
        edges[0].append((frozenset(range(256)), 0))

    def closure(states: set[int]) -> frozenset:
        todo, seen = list(states), set(states)
        while todo:
            for b in empty[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        return frozenset(s for s in seen if edges[s] or s in final)

    sets = {codes for e in edges for codes, _ in e}
    kinds: dict[tuple, int] = {}
    column = bytes(kinds.setdefault(tuple(byte in s for s in sets), len(kinds)) for byte in range(256))
    sample = [column.index(k) for k in range(len(kinds))]
    start = closure({0})
    number, order, table = {start: 0}, [start], []
    for own in order:  # grows meanwhile
        row = []
        for byte in sample:
            nxt = closure({b for s in own for codes, b in edges[s] if byte in codes})
            if nxt not in number:
                number[nxt] = len(order)
                order.append(nxt)
            row.append(number[nxt])
        table.append(row)
    bits = [sum(final.get(s, 0) for s in own) for own in order]
    bits = [0 if not own else b for own, b in zip(order, bits, strict=True)]
    # minimisation: blocks of states that accept alike are split until their members move alike
    block, n = bits, len(set(bits))
    while True:
        names: dict[tuple, int] = {}
        block = [names.setdefault((block[i], *(block[j] for j in row)), len(names)) for i, row in enumerate(table)]
        if len(names) == n:
            break
        n = len(names)
    dead = next((block[i] for i, own in enumerate(order) if not own), None)
    rename = {block[0] if dead is None else dead: 0}
    for x in block:
        rename.setdefault(x, len(rename))
    width, to, accepts = len(kinds), [0] * (n * len(kinds)), [0] * (n * len(kinds))
    for i, row in enumerate(table):
        at = rename[block[i]] * width
        accepts[at] = bits[i]
        for k, j in enumerate(row):
            to[at + k] = rename[block[j]] * width
    return Automaton(column, width, to, accepts, rename[block[0]] * width)


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        trees = [parse(r.pattern, r.any_case) for r in rules]
        self.starts = compile_rules([backwards(t) for t in trees], anchored=False)
        self.ends = [compile_rules([t], anchored=True) for t in trees]
        self.heads = [re.compile(r.value_after.encode(), re.I if r.any_case else 0) if r.value_after else None for r in rules]

    def marks(self, text: bytes) -> list[tuple[int, int]]:
        """(position, rules that can start there) in one pass, the last position first."""
        dfa, found, s, at = self.starts, [], self.starts.start, len(text)
        to, accepts = dfa.to, dfa.accepts
        for c in reversed(text.translate(dfa.column)):
            at -= 1
            s = to[s + c]
            if accepts[s]:
                found.append((at, accepts[s]))
        return found

    def end(self, rule: int, text: bytes, at: int) -> int:
        dfa, last = self.ends[rule], at
        s = dfa.start
        for i in range(at, len(text)):
            s = dfa.to[s + dfa.column[text[i]]]
            if not s:
                break
            if dfa.accepts[s]:
                last = i + 1
        return last

    def spans(self, text: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes, in order; matches that are too short are dropped without another try."""
        free, out = [0] * len(self.rules), []
        for at, bits in reversed(self.marks(text)):
            for rule in range(len(self.rules)):
                if bits >> rule & 1 and at >= free[rule]:
                    end = free[rule] = self.end(rule, text, at)
                    head = self.heads[rule]
                    if end - (head.match(text, at).end() if head else at) >= self.rules[rule].least:
                        out.append((at, rule, end))
        return sorted(out)


@lru_cache
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[str, ...] = BASE) -> DataFrame:
    """doc_id, n_<kind> of the base kinds, base_sha256 and spans (kind:start:end in code points) of each whole text."""

    def fn(ids: list, texts: list) -> dict:
        machine, out = scanner(rules), {"doc_id": ids, "base_sha256": [], "spans": []} | {f"n_{k}": [] for k in base}
        for text in texts:
            found = machine.spans(text) if text else []
            plain = not found or text.isascii()
            told = [(rules[r].kind, f"{rules[r].kind}:{a if plain else len(text[:a].decode())}:{b if plain else len(text[:b].decode())}") for a, r, b in found]
            for k in base:
                out[f"n_{k}"].append(sum(x[0] == k for x in told))
            out["base_sha256"].append(hashlib.sha256(",".join(x[1] for x in told if x[0] in base).encode()).hexdigest())
            out["spans"].append(",".join(x[1] for x in told))
        return out

    counts = [f"n_{k}" for k in base]
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in counts), ("base_sha256", pa.string()), ("spans", pa.string())])
    return id_and_text(docs).mapInArrow(per_row(fn, schema), f"doc_id long, {', '.join(f'{c} long' for c in counts)}, base_sha256 string, spans string")
