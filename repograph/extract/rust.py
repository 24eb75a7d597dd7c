"""Rust: items, trait implementations and bounds, calls and struct literals."""

from __future__ import annotations

from .lexing import FACTS, Facts, Spans, Tokens, bare, lex, token_pattern

_NESTED = r"/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*(?:[^*]|\*(?!/))*\*/)*\*/)*\*/"
_TOKEN = token_pattern(
    rf"\s+|//[^\n]*|{_NESTED}",
    r"""(?=[bcr"'])(?:b?r(?P<h>\#*)"(?:.|\n)*?"(?P=h)|[bc]?"(?:\\(?:.|\n)|[^"\\])*"|b?'(?:\\(?:u\{[^}]*\}|x..|.)|[^'\\\n])'|'\w+)""",
    r"r\#\w+|[^\W\d]\w*",
    r"\d[\w]*(?:\.\d\w*)?",
    r"::|->|=>|==|!=|<=|>=|&&|\|\||\.\.=?|.",
)
_MODIFIERS = {"pub", "async", "unsafe", "const", "extern", "default", "auto", "safe"}
_KINDS = {"struct": "struct", "enum": "enum", "trait": "trait", "mod": "module", "fn": "function"}
_KEYWORDS = set("as async await break const continue crate dyn else enum extern fn for if impl in let loop match mod move mut pub ref return static struct trait type unsafe use where while yield".split())
_ITEMS = {*_KINDS, "impl"}
_OPENERS = set("if while for let match loop unsafe else async move try const struct enum trait mod union impl fn".split())
_TRAITS_OF_FUNCTIONS = {"Fn", "FnMut", "FnOnce"}


def _first(t: Tokens, i: int) -> int:
    """Where an item begins whose keyword is token i."""
    while i > 0:
        j = i - 1
        if t.at(j) in _MODIFIERS or (t.kind[j] == "s" and t.at(j - 1) == "extern"):
            i = j
        elif t.at(j) == ")" and t.at(t.partner[j] - 1) == "pub":
            i = t.partner[j] - 1
        else:
            break
    return i


def _opaque(t: Tokens) -> list[bool]:
    """Tokens of macro bodies and attributes, which say nothing of the program's own items."""
    out, i, n, shown, kind = [False] * len(t), 0, len(t), t.shown, t.kind
    while i < n:
        x, group = shown[i], -1
        if x == "#":
            group = i + 1 if shown[i + 1] == "[" else i + 2 if shown[i + 1] == "!" and shown[i + 2] == "[" else -1
        elif shown[i + 1] == "!" and kind[i] == "i" and x not in _KEYWORDS:
            group = i + 3 if t.name(i + 2) else i + 2
        if group > 0 and group < n and shown[group] in ("(", "[", "{"):
            for j in range(group, t.partner[group] + 1):
                out[j] = True
            i = t.partner[group] + 1
        else:
            i += 1
    return out


def _patterns(t: Tokens) -> tuple[list[bool], set[int]]:
    """Tokens of patterns, and braces that open a block and no literal."""
    pattern, block = [False] * len(t), set()

    def head(i: int) -> int:
        """The block's brace of an if, while, for or match whose keyword is before i; len(t) if there is none."""
        while i < len(t):
            x = t.at(i)
            if x == "{":
                block.add(i)
                return i
            if x in (";", "}", ")", "]", "=>", ","):
                return len(t)
            if x == "let":
                end = t.find(i + 1, len(t), {"=", ";"})
                for k in range(i + 1, min(end, len(t))):
                    pattern[k] = True
                i = end
            i = t.after(i) if i < len(t) else i
        return i

    for i, x in enumerate(t.shown):
        if x not in _OPENERS:
            continue
        if x in ("if", "while"):
            head(i + 1)
        elif x == "for" and t.at(i + 1) != "<":
            end = t.find(i + 1, len(t), {"in", "{", ";"})
            for k in range(i + 1, min(end, len(t)) if t.at(end) == "in" else i + 1):
                pattern[k] = True
            head(end)
        elif x == "let" and not pattern[i]:
            end = t.find(i + 1, len(t), {"=", ";", ":", "{"} if t.name(i + 1) and t.at(i + 2) in (":", "=", ";") else {"=", ";"})
            for k in range(i + 1, min(end, len(t))):
                pattern[k] = True
        elif x == "match":
            body = head(i + 1)
            if body >= len(t):
                continue
            k, end = body + 1, t.partner[body]
            while k < end:
                arrow = t.find(k, end, {"=>"})
                guard = t.find(k, arrow, {"if"})
                for j in range(k, guard):
                    pattern[j] = True
                k = arrow + 1
                if t.at(k) == "{":
                    block.add(k)
                    k = t.after(k)
                    k += t.at(k) == ","
                else:
                    k = t.find(k, end, {","}) + 1
        elif x in ("loop", "unsafe", "else", "async", "move", "try", "const") and t.at(i + 1) == "{":
            block.add(i + 1)
        elif x in ("struct", "enum", "trait", "mod", "union", "impl", "fn"):
            if x == "impl" and not _item_impl(t, i):
                continue
            end = t.find(i + 1, len(t), {"{", ";"})
            if t.at(end) == "{":
                block.add(end)
    return pattern, block


def _item_impl(t: Tokens, i: int) -> bool:
    return i == 0 or t.at(i - 1) in ("}", ";", "{", "]", "unsafe", "default")


def _generics(t: Tokens, i: int) -> int:
    return t.angles(i, len(t)) if t.at(i) == "<" else i


def rust(source: str, wanted: frozenset[str] = FACTS) -> Facts:
    t, facts, spans = lex(source, _TOKEN), Facts(), Spans()
    opaque = _opaque(t)
    skip_calls: set[int] = set()
    for i, x in enumerate(t.shown):
        if x not in _ITEMS or opaque[i]:
            continue
        if x in _KINDS and t.name(i + 1) and t.at(i + 1) not in _KEYWORDS:
            name, first = t.at(i + 1), _first(t, i)
            body = t.find(i + 2, len(t), {"{", ";"})
            if body >= len(t) or (x == "fn" and t.at(body) != "{"):
                continue
            last = t.partner[body] if t.at(body) == "{" else body
            exported = "pub" in (t.at(k) for k in range(first, i))
            facts.symbol(name, _KINDS[x], t.line(first), t.last_line(last), "pub" if exported else "", exported)
            if x in ("fn", "struct", "enum"):
                spans.add(first, last, name)
            if x in ("struct", "enum"):
                skip_calls.update(range(i + 1, last + 1))
            if x == "trait":
                k = _generics(t, i + 2)
                if t.at(k) == ":":
                    for a, b in t.pieces(k + 1, t.find(k + 1, body, {"where"}), "+"):
                        if all(t.name(j) if (j - a) % 2 == 0 else t.at(j) == "::" for j in range(a, b)) and (b - a) % 2:
                            facts.supertypes.add((name, bare(t.slice(a, b)), "inherits"))
        elif x == "impl" and _item_impl(t, i):
            a = _generics(t, i + 1)
            body = t.find(a, len(t), {"{", ";"})
            depth, split = 0, -1
            for k in range(a, body):
                y = t.at(k)
                depth += (y == "<") - (y == ">") - 2 * (y == ">>")
                if y == "for" and depth == 0 and t.at(k + 1) != "<":
                    split = k
                    break
            if split > 0:
                end = t.find(split + 1, body, {"where"})
                child, base = bare(t.slice(split + 1, end)), bare(t.slice(a, split).lstrip("!"))
                if child and base:
                    facts.supertypes.add((child, base, "implements"))
    if "reference" not in wanted:
        return facts
    pattern, block = _patterns(t)
    found: list[tuple[int, str]] = []
    for i in [k - 1 for k, x in enumerate(t.shown) if k and (x == "(" or x == "{")]:
        if opaque[i] or pattern[i] or t.kind[i] != "i" or (t.at(i) in _KEYWORDS and t.at(i) not in ("crate",)):
            continue
        path = i
        while t.at(path - 1) == "::" and t.name(path - 2):
            path -= 2
        if t.at(i + 1) == "(" and i not in skip_calls and t.at(i - 1) not in ("fn", "struct") and t.at(i) not in _TRAITS_OF_FUNCTIONS:
            found.append((i, t.at(i)))
            if path < i:
                found.append((i, bare(t.slice(path, i - 1))))
            elif t.at(i - 1) == "::" and t.at(i - 2) in (">", ">>"):
                k = i - 2
                depth = 0
                while k >= 0:
                    depth += (t.at(k) == ">") + 2 * (t.at(k) == ">>") - (t.at(k) == "<")
                    if depth <= 0:
                        break
                    k -= 1
                k -= 1 + (t.at(k - 1) == "::")
                if t.name(k):
                    found.append((i, t.at(k)))
        elif t.at(i + 1) == "{" and t.at(i - 2) != "macro_rules" and i + 1 not in block and i not in skip_calls and t.at(path - 1) not in ("->", "for", "impl", "dyn", "&", "+", "struct", "enum", "trait", "mod", "union"):
            found.append((i, t.at(i)))
    around = spans.sweep([p for p, _ in found])
    facts.references = {(around[p], to) for p, to in found if to}
    return facts
