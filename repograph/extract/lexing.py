"""Tokens of source text, with their places, lines and matching brackets."""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field
from itertools import accumulate
from operator import add, sub

OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
_BRACKETS = {*OPEN, *CLOSE}
#: Empty texts behind the last token of Tokens.shown, so that loops look a few tokens ahead (or one back from the first) without a test.
PAD = 4


#: What a caller may want of a file.
FACTS = frozenset(("symbol", "import", "supertype", "reference"))


@dataclass
class Facts:
    """What a file says. symbols: (name, full name, kind, start, end, visibility, exported); supertypes: (child, base, hint); references: (from, to)."""

    symbols: list[tuple[str, str, str, int, int, str, bool]] = field(default_factory=list)
    imports: set[str] = field(default_factory=set)
    supertypes: set[tuple[str, str, str]] = field(default_factory=set)
    references: set[tuple[str, str]] = field(default_factory=set)

    def symbol(self, name: str, kind: str, start: int, end: int, visibility: str = "", exported: bool = False, full: str | None = None) -> None:
        self.symbols.append((name, name if full is None else full, kind, start, end, visibility, exported))


def line_starts(text: str) -> list[int]:
    return list(accumulate(map((1).__add__, map(len, text.split("\n"))), initial=0))[:-1]


def bare(raw: str) -> str:
    """A type's own name: without generic arguments, call arguments and qualifiers."""
    return re.split("[.:]", re.split("[<(]", raw, maxsplit=1)[0])[-1].strip()


class Tokens:
    """text, kind (i identifier, s literal, n number, p other), start and end offset of each token; partner of each bracket.

    shown has the texts without literals, padded, and count the tokens, once they are closed.
    """

    def __init__(self, source: str) -> None:
        self.source, self.starts = source, line_starts(source)
        self.text: list[str] = []
        self.kind: list[str] = []
        self.begin: list[int] = []
        self.stop: list[int] = []
        self.partner: list[int] = []
        self.shown: list[str] = []
        self.count = 0

    def add(self, text: str, kind: str, begin: int, stop: int) -> None:
        self.text.append(text)
        self.kind.append(kind)
        self.begin.append(begin)
        self.stop.append(stop)

    def read(self, pattern: re.Pattern) -> None:
        """All tokens of the source by a token_pattern, without a call per token: each match begins where the last one ended."""
        at = [pattern.groupindex[g] - 1 for g in ("skip", "i", "p", "s", "n")]
        columns = list(zip(*pattern.findall(self.source)))
        skipped, i, p, s, n = (columns[k] for k in at)
        self.text = [a or b or c or d for a, b, c, d in zip(i, p, s, n)]
        self.kind = ["i" if a else "p" if b else "s" if c else "n" for a, b, c in zip(i, p, s)]
        while self.text and not self.text[-1]:
            self.text.pop(), self.kind.pop()
        sizes = list(map(len, self.text))
        self.stop = list(accumulate(map(add, map(len, skipped), sizes)))
        self.begin = list(map(sub, self.stop, sizes))

    def read_pairs(self, pattern: re.Pattern, kinds: dict[str, str]) -> None:
        """As read, by a pattern of what is skipped and the token; kinds tells a token's kind by its text."""
        skipped, text = zip(*pattern.findall(self.source))
        sizes = list(map(len, text))
        self.text = list(text)
        while self.text and not self.text[-1]:
            self.text.pop()
        self.kind = list(map(kinds.__getitem__, self.text))
        self.stop = list(accumulate(map(add, map(len, skipped), sizes)))
        self.begin = list(map(sub, self.stop, sizes))

    def close(self) -> Tokens:
        """Pairs the brackets; one without a partner ends where the text does (an opening one) or pairs with itself."""
        n, held = len(self.text), []
        self.partner = list(range(n))
        self.count, self.shown = n, ["" if k == "s" else x for x, k in zip(self.text, self.kind)] + [""] * PAD
        for i in [i for i, x in enumerate(self.shown) if x in _BRACKETS]:
            x = self.shown[i]
            if x in OPEN:
                held.append(i)
            elif held and OPEN[self.text[held[-1]]] == x:
                self.partner[i] = j = held.pop()
                self.partner[j] = i
            else:
                for j in range(len(held) - 1, -1, -1):
                    if OPEN[self.text[held[j]]] == x:
                        for lost in held[j + 1 :]:
                            self.partner[lost] = i
                        self.partner[held[j]], self.partner[i] = i, held[j]
                        del held[j:]
                        break
        for lost in held:
            self.partner[lost] = n - 1
        return self

    def __len__(self) -> int:
        return len(self.text)

    def at(self, i: int) -> str:
        return self.shown[i] if 0 <= i < self.count else ""

    def name(self, i: int) -> bool:
        return 0 <= i < self.count and self.kind[i] == "i"

    def line(self, i: int) -> int:
        return bisect_right(self.starts, self.begin[i])

    def last_line(self, i: int) -> int:
        return bisect_right(self.starts, max(self.begin[i], self.stop[i] - 1))

    def slice(self, a: int, b: int) -> str:
        """The source of tokens a to b - 1."""
        return self.source[self.begin[a] : self.stop[b - 1]] if b > a else ""

    def after(self, i: int) -> int:
        """What follows token i, or the group that it opens."""
        return self.partner[i] + 1 if 0 <= i < self.count and self.shown[i] in OPEN and self.partner[i] > i else i + 1

    def find(self, i: int, stop: int, wanted: set[str]) -> int:
        """The first token from i of those wanted, outside groups that open on the way (an opening bracket may be wanted); stop if none."""
        shown, partner, end = self.shown, self.partner, min(stop, self.count)
        while 0 <= i < end:
            x = shown[i]
            if x in wanted:
                return i
            i = partner[i] + 1 if x in OPEN and partner[i] > i else i + 1
        while i < stop:
            if self.at(i) in wanted:
                return i
            i = self.after(i)
        return stop

    def angles(self, i: int, stop: int) -> int:
        """What follows the angle brackets that open at i, or i if they don't close before something that isn't of a type."""
        depth, j = 0, i
        while j < stop:
            x = self.at(j)
            if x == "<":
                depth += 1
            elif x in (">", ">>", ">>>"):
                depth -= len(x)
                if depth <= 0:
                    return j + 1
            elif x in (";", "{", "}", "&&", "||", "==", "!=") or x in CLOSE:
                return i
            elif x in ("(", "["):
                j = self.partner[j]
            j += 1
        return i

    def pieces(self, a: int, b: int, separator: str = ",") -> list[tuple[int, int]]:
        """The parts of tokens a to b - 1 between separators outside groups and angle brackets."""
        out, begin, i = [], a, a
        while i < b:
            if self.at(i) == separator:
                out.append((begin, i))
                begin = i + 1
            elif self.at(i) == "<":
                j = self.angles(i, b)
                if j > i:
                    i = j
                    continue
            i = self.after(i)
        if begin < b:
            out.append((begin, b))
        return [p for p in out if p[1] > p[0]]


class Spans:
    """Declarations by the tokens they cover; the innermost one around a token."""

    def __init__(self) -> None:
        self.held: list[tuple[int, int, str]] = []

    def add(self, first: int, last: int, name: str) -> None:
        self.held.append((first, last, name))

    def sweep(self, places: list[int]) -> dict[int, str]:
        """The name of the innermost span around each place, '' where there is none."""
        spans, out, stack, k = sorted(self.held, key=lambda s: (s[0], -s[1])), {}, [], 0
        for p in sorted(set(places)):
            while k < len(spans) and spans[k][0] <= p:
                stack.append(spans[k])
                k += 1
            while stack and stack[-1][1] < p:
                stack.pop()
            out[p] = next((s[2] for s in reversed(stack) if s[1] >= p), "")
        return out


def token_pattern(skip: str, s: str, i: str, n: str, p: str, flags: int = 0) -> re.Pattern:
    """What is skipped and the token after it, or the text's end; of skip, s, i, n and p the first that matches counts, and some matches everywhere."""
    return re.compile(rf"(?P<skip>(?:{skip})*+)(?:(?P<s>{s})|(?P<i>{i})|(?P<n>{n})|(?P<p>{p})|\Z)", flags)


def lex(source: str, pattern: re.Pattern) -> Tokens:
    """Tokens by a token_pattern, closed."""
    out = Tokens(source)
    out.read(pattern)
    return out.close()
