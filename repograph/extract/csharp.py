"""C#: types and their members, base lists, using directives, uses of types and methods."""

from __future__ import annotations

import re

from .lexing import FACTS, Facts, Spans, Tokens, bare, lex, token_pattern

_SPACE = r"\s+|//[^\n]*|/\*(?:.|\n)*?\*/|^[ \t]*\#[^\n]*"
_TOKEN = token_pattern(
    _SPACE,
    r'''(?=[$@"'])(?:\$*"""(?:.|\n)*?"""|(?:\$@|@\$|@)"(?:[^"]|"")*"|\$?"(?:\\.|[^"\\\n])*"(?:u8)?|'(?:\\[^'\n]+|[^'\\\n])')''',
    r"@?[^\W\d]\w*",
    r"\d[\w.]*",
    r"::|=>|==|!=|<=|>=|&&|\|\||\?\?=?|\?\.|\+\+|--|.",
    re.M,
)
_ACCESS = ("public", "private", "internal", "protected")
_MODIFIERS = {*_ACCESS, "static", "abstract", "sealed", "partial", "readonly", "virtual", "override", "async", "extern", "unsafe", "new", "const", "volatile", "required", "file", "ref", "fixed"}
_TYPES = {"class": "class", "struct": "struct", "interface": "interface", "enum": "enum", "record": "record"}
_NO_CALLS = set("if while for foreach switch using lock catch fixed return typeof sizeof default checked unchecked when new base this nameof stackalloc and or not is in await throw yield out ref delegate where operator get set init else case".split()) - {"nameof"}
_BEFORE_CALLS = set("return await throw in is as else case when and or not yield out ref new do => select from where orderby equals on let join into by".split())
_USES = {"new", "<", "("}
_PARAMETER_WORDS = {"ref", "out", "in", "params", "this", "scoped", "readonly"}
_NAME = re.compile(r"^[^\W\d]\w*(?:\s*<.*>)?(?:\s*(?:\.|::)\s*[^\W\d]\w*(?:\s*<.*>)?)*$", re.S)
#: A using directive of a name, and what stands before it.
_USING = re.compile(rf"(?:{_SPACE})*+using\s++(?!(?:static|unsafe)\b)([^\W\d]\w*+(?:\s*\.\s*[^\W\d]\w*+)*+)\s*+;", re.M)


def _imports(source: str) -> set[str] | None:
    """The namespaces of the directives that a source begins with, if no other can follow; else None."""
    found, i = set(), 0
    while m := _USING.match(source, i):
        found.add(m[1])
        i = m.end()
    return found if source.find("using", i) < 0 else None


class _Reader:
    def __init__(self, source: str, wanted: frozenset[str] = FACTS) -> None:
        self.t, self.facts, self.spans, self.wanted = lex(source, _TOKEN), Facts(), Spans(), wanted
        self.heads: set[int] = set()
        self.found: list[tuple[int, str]] = []
        self.declared: set[int] = set()
        self.attributes: set[int] = set()

    def run(self) -> Facts:
        t = self.t
        self.body(0, len(t), None)
        if "reference" not in self.wanted:
            return self.facts
        self.uses()
        around = self.spans.sweep([p for p, _ in self.found])
        self.facts.references = {(around[p], to) for p, to in self.found if to}
        return self.facts

    def body(self, i: int, stop: int, owner: str | None) -> None:
        """The members between tokens i and stop; owner is the type they belong to, None outside types."""
        t = self.t
        while i < stop:
            first = i
            access, seen = "", False
            while i < stop:
                x = t.at(i)
                if x == "[" and not seen:
                    self.attributes.update(range(i, t.partner[i] + 1))
                    i = t.after(i)
                elif x in _MODIFIERS and not (x == "ref" and t.at(i + 1) == "struct" and False):
                    if x in _ACCESS and not access:
                        access = x
                    i, seen = i + 1, True
                else:
                    break
            i = max(self.member(first, i, stop, owner, access), i, first + 1)

    def member(self, first: int, i: int, stop: int, owner: str | None, access: str) -> int:
        t = self.t
        x = t.at(i)
        if x == "namespace":
            k = t.find(i, stop, {"{", ";"})
            if t.at(k) == "{":
                self.body(k + 1, t.partner[k], None)
            return t.after(k)
        if x == "using" and owner is None:
            return self.using(i, stop)
        if x in _TYPES and (t.name(i + 1) or (x == "record" and t.at(i + 1) in ("struct", "class"))):
            k = i + 1 + (x == "record" and t.at(i + 1) in ("struct", "class"))
            if t.name(k) and not (x == "record" and t.at(k + 1) not in ("(", "{", ":", ";", "<", "where")):
                return self.type(first, k, stop, _TYPES[x], access)
        if x in ("event", "delegate") or owner is None:
            return self.other(i, stop, x == "delegate")
        return self.method_or_field(first, i, stop, owner, access)

    def using(self, i: int, stop: int) -> int:
        t = self.t
        end = t.find(i, stop, {";", "{"})
        if t.at(end) != ";":
            return self.other(i, stop, False)
        k = i + 1
        if t.at(k) in ("static", "unsafe"):
            k += 1
        if t.at(k + 1) == "=":
            # the alias's own name is an identifier of the directive as well
            k += 2
        name = t.slice(k, end)
        if re.fullmatch(r"[^\W\d]\w*(\s*\.\s*[^\W\d]\w*)*", name) and "(" not in t.slice(i, end):
            self.facts.imports.add(name)
        return end + 1

    def type(self, first: int, k: int, stop: int, kind: str, access: str) -> int:
        t, name = self.t, self.t.at(k)
        body = t.find(k + 1, stop, {"{", ";"})
        last = t.partner[body] if t.at(body) == "{" else min(body, len(t) - 1)
        if self.wanted == {"import"}:
            # directives stand outside types
            return last + 1
        self.facts.symbol(name, kind, t.line(first), t.last_line(last), access, access == "public")
        if kind in ("class", "record", "struct"):
            self.spans.add(first, last, name)
        i = k + 1
        if t.at(i) == "<":
            i = self.declares(i, body)
        if t.at(i) == "(":
            self.heads.add(i)
            self.parameters(i)
            i = t.after(i)
        if t.at(i) == ":" and kind != "enum":
            for a, b in t.pieces(i + 1, t.find(i + 1, body, {"where"})):
                if kind != "interface" and "(" not in t.slice(a, b) and _NAME.match(t.slice(a, b)) and "::" not in t.slice(a, b):
                    self.facts.supertypes.add((name, bare(t.slice(a, b)), "unknown"))
                if t.at(b - 1) == ")":
                    self.heads.add(t.partner[b - 1])
        if t.at(body) == "{" and kind != "enum":
            self.body(body + 1, last, name)
        return last + 1

    def declares(self, i: int, stop: int) -> int:
        """Type parameters are no uses of types."""
        end = self.t.angles(i, stop)
        self.declared.update(range(i, end))
        return max(end, i + 1)

    def other(self, i: int, stop: int, delegate: bool) -> int:
        t = self.t
        k = t.find(i, stop, {"{", ";"})
        if delegate:
            paren = t.find(i, k, {"("})
            while paren < k and not (t.name(paren - 1) or t.at(paren - 1) == ">"):
                paren = t.find(t.after(paren), k, {"("})
            if paren < k:
                self.heads.add(paren)
                self.parameters(paren)
        return t.after(k) if k < stop else stop

    def method_or_field(self, first: int, i: int, stop: int, owner: str, access: str) -> int:
        t = self.t
        k = i
        while k < stop:
            x = t.at(k)
            if x in ("{", ";", "=", "=>"):
                break
            if x == "<":
                k = max(t.angles(k, stop), k + 1)
                continue
            if x == "(" and (t.name(k - 1) and t.at(k - 1) not in _MODIFIERS or t.at(k - 1) == ">") and k > i:
                return self.method(first, i, k, stop, owner, access)
            k = t.after(k)
        if "operator" in (t.at(j) for j in range(i, k)) or t.at(i) == "~":
            return self.end(k, stop)
        # a property or a field: its type is what stands before its name
        name = k - 1
        if t.at(k) in ("{", "=>", "=", ";") and name > i:
            a, b = i, name
            if t.at(k) in ("=", ";"):
                comma = t.find(i, k, {","})
                if comma < k and not any(t.at(j) == "<" for j in range(i, comma)):
                    b = comma - 1
            if t.at(name) == "]" and t.at(t.partner[name] - 1) == "this":
                self.heads.add(t.partner[name])
                self.parameters(t.partner[name])
            elif t.name(name):
                while t.at(b - 1) == "." and t.at(k) in ("{", "=>"):
                    b -= 2
                if b > a:
                    self.found.append((first, bare(t.slice(a, b))))
        if t.at(k) == "{":
            k = t.after(k)
            return self.end(k, stop) if t.at(k) == "=" else k
        return self.end(k, stop)

    def end(self, k: int, stop: int) -> int:
        k = self.t.find(k, stop, {";"})
        return min(k + 1, stop)

    def method(self, first: int, i: int, paren: int, stop: int, owner: str, access: str) -> int:
        t = self.t
        name = paren - 1
        if t.at(name) == ">":
            depth = 0
            while name > i:
                depth += (t.at(name) == ">") - (t.at(name) == "<")
                if depth == 0:
                    break
                name -= 1
            self.declared.update(range(name, paren))
            name -= 1
        self.heads.add(paren)
        k = t.find(t.after(paren), stop, {"{", ";", "=>"})
        for j in range(t.after(paren), k):
            if t.at(j) == "(":
                self.heads.add(j)
        last = t.partner[k] if t.at(k) == "{" else min(t.find(k, stop, {";"}), len(t) - 1)
        if "operator" not in (t.at(j) for j in range(i, paren)) and t.at(i) != "~" and t.name(name):
            kind = "constructor" if name == i and t.at(name) == owner else "method"
            if kind == "constructor" or name > i:
                self.facts.symbol(t.at(name), kind, t.line(first), t.last_line(last), access, access == "public")
                self.spans.add(first, last, t.at(name))
        self.parameters(paren)
        return last + 1

    def parameters(self, paren: int) -> None:
        t = self.t
        for a, b in t.pieces(paren + 1, t.partner[paren]):
            while t.at(a) == "[" and a < b:
                self.attributes.update(range(a, t.partner[a] + 1))
                a = t.after(a)
            while t.at(a) in _PARAMETER_WORDS:
                a += 1
            b = t.find(a, b, {"="})
            if b - a >= 2 and t.name(b - 1):
                self.found.append((paren, bare(t.slice(a, b - 1))))

    def uses(self) -> None:
        t = self.t
        for i in [i for i, x in enumerate(t.shown) if x in _USES]:
            if i in self.attributes:
                continue
            x = t.shown[i]
            if x == "new" and t.name(i + 1):
                k = i + 2
                while t.at(k) in (".", "::") and t.name(k + 1) or t.at(k) == "<":
                    k = max(t.angles(k, len(t)), k + 1) if t.at(k) == "<" else k + 2
                if t.at(k) in ("(", "{"):
                    self.found.append((i, bare(t.slice(i + 1, k))))
                    self.heads.add(k)
            elif x == "<" and t.name(i - 1) and i not in self.declared:
                end = t.angles(i, len(t))
                if end > i and (t.at(end) in ("(", ")", "]", "}", ":", ";", ",", ".", "?", "==", "!=", "|", "&", "{", ">", "=", "=>", "[", "?.", "") or t.name(end)):
                    for a, b in t.pieces(i + 1, end - 1 if t.at(end - 1) == ">" else end):
                        if _NAME.match(t.slice(a, b)) and "::" not in t.slice(a, b):
                            self.found.append((i, bare(t.slice(a, b))))
            elif x == "(" and i not in self.heads:
                if t.at(t.after(i)) == "=>" and not t.name(i - 1):
                    self.parameters(i)
                self.call(i)

    def call(self, paren: int) -> None:
        t, end = self.t, paren - 1
        if t.at(end) == ">":
            depth, k = 0, end
            while k > 0:
                depth += (t.at(k) == ">") - (t.at(k) == "<")
                if depth == 0:
                    break
                k -= 1
            if t.angles(k, paren) != paren:
                return
            end = k - 1
        if not t.name(end) or t.at(end) in _NO_CALLS:
            return
        name, k = t.at(end), end
        if k == 0 or t.at(k - 1) not in (".", "?.", "::"):
            before = t.at(k - 1)
            local = (t.name(k - 1) and before not in _BEFORE_CALLS) or (before in (">", "]", "?") and t.at(t.after(paren)) in ("{", "=>") and k > 0)
            if local:
                self.heads.add(paren)
                self.parameters(paren)
                return
            self.found.append((paren, name))
            return
        # what the function's text says up to its first bracket
        while k > 0 and t.at(k - 1) in (".", "?.", "::"):
            if t.at(k - 1) == "?.":
                break
            k -= 2
            if t.at(k) in (")", "]"):
                if t.at(k) == ")":
                    return
                k = t.partner[k]
                k -= 1 if t.name(k - 1) else 0
            elif t.at(k) in (">", "!", "?"):
                if t.at(k) == ">":
                    depth = 0
                    while k > 0:
                        depth += (t.at(k) == ">") - (t.at(k) == "<")
                        if depth == 0:
                            break
                        k -= 1
                    k -= 1
                    name = t.at(k)
                else:
                    k -= 1
        self.found.append((paren, name))


def csharp(source: str, wanted: frozenset[str] = FACTS) -> Facts:
    if wanted == {"import"} and (imports := _imports(source)) is not None:
        return Facts(imports=imports)
    return _Reader(source, wanted).run()
