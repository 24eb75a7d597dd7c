"""Go: functions, methods, struct and interface types, what they embed."""

from __future__ import annotations

from .lexing import Facts, Tokens, bare, lex, token_pattern

_TOKEN = token_pattern(
    r"\s+|//[^\n]*|/\*(?:.|\n)*?\*/",
    r"""`[^`]*`|"(?:\\.|[^"\\\n])*"|'(?:\\[^'\n]+|[^'\\\n])'""",
    r"[^\W\d]\w*",
    r"\d[\w.]*",
    r":=|<-|&&|\|\||[=!<>]=|\.\.\.|.",
)
_TOP = {"func", "type", "var", "const", "import", "package"}


def _body(t: Tokens, i: int) -> int:
    """The brace of a function's body from what follows its name; len(t) if there is none."""
    while i < len(t):
        x = t.at(i)
        if x == "{" and t.at(i - 1) not in ("interface", "struct"):
            return i
        if x in (";", "}") or (x in _TOP and x != "func" and t.line(i) > t.line(i - 1)) or (x == "func" and t.line(i) > t.line(i - 1)):
            return len(t)
        i = t.after(i)
    return i


def _parts(t: Tokens, a: int, b: int) -> list[tuple[int, int]]:
    """What newlines and semicolons part between tokens a and b - 1."""
    out, begin, i = [], a, a
    while i < b:
        nxt = t.after(i)
        if t.at(i) == ";":
            out.append((begin, i))
            begin = nxt
        elif nxt < b and t.line(nxt) > t.last_line(nxt - 1) and t.at(nxt - 1) not in (",", "|", ".", "~", "("):
            out.append((begin, nxt))
            begin = nxt
        i = nxt
    out.append((begin, b))
    return [p for p in out if p[1] > p[0]]


def _embedded(t: Tokens, brace: int, kind: str, name: str, facts: Facts) -> None:
    for a, b in _parts(t, brace + 1, t.partner[brace]):
        for k in range(a, b):
            if t.at(k) == "{" and t.at(k - 1) == kind:
                _embedded(t, k, kind, name, facts)
        if kind == "struct":
            if t.kind[b - 1] == "s":
                b -= 1
            a += t.at(a) == "*"
            end = a + 1
            while t.at(end) == "." and t.name(end + 1):
                end += 2
            whole = end == b or (t.at(end) == "[" and t.partner[end] + 1 == b and end > a and t.partner[end] > end + 1 and t.line(a) == t.line(b - 1) and t.at(a - 1) == "*")
            if not (t.name(a) and whole):
                continue
        elif t.name(a) and t.at(a + 1) == "(":
            continue
        if base := bare(t.slice(a, b)):
            facts.supertypes.add((name, base, "inherits"))


def _specs(t: Tokens, i: int) -> tuple[int, list[tuple[int, int]]]:
    """(last token, [(name, type)]) of a type declaration at token i; aliases are left out."""
    parts = [(i + 1, len(t))]
    last = -1
    if t.at(i + 1) == "(":
        last = t.partner[i + 1]
        parts = _parts(t, i + 2, last)
    out = []
    for a, b in parts:
        k = a + 1
        if t.at(k) == "[" and t.partner[k] > k + 1 and t.at(t.partner[k] + 1) not in (";", "") and t.line(t.partner[k] + 1) == t.line(t.partner[k]) and t.name(k + 1) and t.partner[k] > k + 2:
            k = t.after(k)
        if not t.name(a) or t.at(k) == "=":
            continue
        out.append((a, k))
        if last < 0:
            last = t.partner[k + 1] if t.at(k) in ("struct", "interface") and t.at(k + 1) == "{" else k
    return max(last, i), out


def go(source: str) -> Facts:
    t, facts = lex(source, _TOKEN), Facts()
    i = 0
    while i < len(t):
        x = t.at(i)
        if x == "func":
            name = i + 1
            if t.at(name) == "(" and t.name(t.after(name)) and t.at(t.after(name) + 1) in ("(", "["):
                name, kind = t.after(name), "method"
            else:
                kind = "function"
            if t.name(name) and t.at(name + 1) in ("(", "["):
                brace = _body(t, name + 1)
                end = t.partner[brace] if brace < len(t) else t.after(t.find(name + 1, len(t), {"("})) - 1
                facts.symbol(t.at(name), kind, t.line(i), t.last_line(min(end, len(t) - 1)), "", t.at(name)[:1].isupper())
                i = name
        elif x == "type" and t.at(i - 1) not in (".", "(") and (t.name(i + 1) or t.at(i + 1) == "("):
            last, specs = _specs(t, i)
            kind = next((t.at(k) for _, k in specs), "")
            for a, k in specs:
                if t.at(k) in ("struct", "interface") and t.at(k + 1) == "{":
                    if kind in ("struct", "interface"):
                        facts.symbol(t.at(a), kind, t.line(i), t.last_line(last), "", t.at(a)[:1].isupper())
                    _embedded(t, k + 1, t.at(k), t.at(a), facts)
        i += 1
    return facts
