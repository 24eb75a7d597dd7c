"""JavaScript and TypeScript: declarations, imports, heritage, calls and types."""

from __future__ import annotations

import re

from .lexing import FACTS, Facts, Spans, Tokens

_SPACE = re.compile(r"\s+|//[^\n]*|/\*(?:.|\n)*?\*/|^\#![^\n]*")
_KINDS = (
    r""""(?:\\(?:.|\n)|[^"\\\n])*"|'(?:\\(?:.|\n)|[^'\\\n])*'""",
    r"[#@]?[^\W\d][\w$]*|[#@]?\$[\w$]*",
    r"\d[\w.]*|\.\d\w*",
    r"=>|===?|!==?|\?\.(?!\d)|\?\?=?|&&=?|\|\|=?|\.\.\.|\+\+|--|[-+*/%&|^]=|\*\*=?|<=|>=|(?:.|\n)",
)
_PLAIN = re.compile("(?P<s>{})|(?P<i>{})|(?P<n>{})|(?P<p>{})".format(*_KINDS))
#: What is skipped and a token, as _PLAIN has them; names come first, as no two kinds begin alike (numbers stay before other dots).
_TOKEN = re.compile(rf"(\s*+(?:/(?:/[^\n]*+|\*(?:.|\n)*?\*/)\s*+)*+)([^\W\d][\w$]*+|[(){{}};,:\[\]]|{_KINDS[0]}|{_KINDS[1]}|{_KINDS[2]}|{_KINDS[3]}|\Z)")
#: Tokens that may begin a template or a regular expression, which what stands before them tells.
_UNSURE = {"`", "/", "/="}
#: Words that token() looks at.
_BEGINNINGS = {"export", "import", "function", "class", "const", "let", "var", "interface", "type", "enum", "as", "satisfies"}
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
_TAG = re.compile(r"[\w$.:-]*")
#: What a search for imports passes over: comments, literals, numbers and other words, each as the tokens have them.
_PASSED = re.compile(rf"""(?:[^\w$#@"'`/<.]++|{_KINDS[0]}|//[^\n]*+|/\*(?:.|\n)*?\*/|\d[\w.]*+|\.\d\w*+|(?!(?:import|require)(?![\w$]))(?:[#@]?[^\W\d][\w$]*+|[#@]?\$[\w$]*+)|["'#@$.])*+""")
_IMPORT = re.compile(rf"import(?P<clause>(?:\s*+(?:[\w$]++|[,*]|\{{[\w$\s,]*+\}}))*+)\s*+(?P<end>{_KINDS[0]}|=(?![=>])|\.(?![\d.])|[;(])")
_REQUIRE = re.compile(rf"require\s*+\(\s*+({_KINDS[0]})\s*+\)")
_VALUE_WORDS = set("return typeof case in of delete void throw new instanceof else do yield await default export extends as satisfies".split())
_WORDS = set("break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with yield let static await async of enum implements interface".split())
_NO_CALLS = set("if for while switch catch with return typeof delete void throw in of instanceof new case do else yield await function".split())
_GOES_ON = {".", "?.", "(", "[", "+", "-", "*", "/", "%", ",", "?", ":", "&&", "||", "??", "|", "&", "^", "=", "==", "===", "!=", "!==", "=>", "<", ">", "<=", ">=", "in", "instanceof", "as", "satisfies", "extends", "**", "+=", "-=", "*=", "/="}
_WANTS_MORE = {".", "?.", "+", "-", "*", "/", "%", ",", "?", ":", "&&", "||", "??", "|", "&", "^", "=", "==", "===", "!=", "!==", "=>", "<", "<=", ">=", "(", "[", "{", "!", "~", "return", "typeof", "new", "extends", "keyof", "in", "of", "instanceof", "await", "as", "is", "readonly", "infer", "satisfies", "async", "**", "+=", "-=", "*=", "/=", "implements", "void", "delete"}
_BUILT_IN = set("any unknown never void string number boolean object symbol bigint null undefined true false this unique asserts is keyof typeof readonly infer".split())
_MEMBER_WORDS = {"public", "private", "protected", "static", "readonly", "abstract", "override", "async", "declare", "accessor", "get", "set"}


class _Kinds(dict):
    """The kind of a token by its text; of texts seen before without looking at them."""

    MOST = 20_000

    def __missing__(self, x: str) -> str:
        kind = _PLAIN.fullmatch(x).lastgroup
        if len(self) < self.MOST and len(x) < 40:
            self[x] = kind
        return kind


_KIND_OF = _Kinds()


class _Lexer:
    def __init__(self, source: str, markup: bool) -> None:
        self.source, self.markup, self.t = source, markup, Tokens(source)

    def read(self) -> Tokens:
        """All tokens: in one go where none depends on those before it, else one by one."""
        self.t.read_pairs(_TOKEN, _KIND_OF)
        if self.source.startswith("#!") or not _UNSURE.isdisjoint(self.t.text) or self.markup and "<" in self.t.text:
            self.t = Tokens(self.source)
            self.run()
        return self.t

    def value_before(self) -> bool:
        """Whether the last token ends a value, so that a slash divides and an angle bracket compares."""
        t = self.t
        if not t.text:
            return False
        if t.kind[-1] in "sn":
            return True
        return t.text[-1] not in _VALUE_WORDS if t.kind[-1] == "i" else t.text[-1] in (")", "]", "}", "++", "--")

    def run(self, i: int = 0, embedded: bool = False) -> int:
        """Reads tokens from offset i to the end, or to the brace that closes an embedded expression; what follows it."""
        s, t, depth = self.source, self.t, 0
        while i < len(s):
            if m := _SPACE.match(s, i):
                i = m.end()
                continue
            c = s[i]
            if c == "`":
                i = self.template(i)
                continue
            if c == "/" and not self.value_before() and (m := _REGEX.match(s, i)):
                t.add("//", "s", i, m.end())
                i = m.end()
                continue
            if c == "<" and self.markup and not self.value_before() and (s[i + 1 : i + 2] == ">" or s[i + 1 : i + 2].isalpha()) and not re.match(r"<\w+\s*(,|extends\b)", s[i : i + 80]):
                t.add("(", "p", i, i + 1)
                i = self.element(i)
                t.add(")", "p", i - 1, i)
                continue
            m = _PLAIN.match(s, i)
            x = m[0]
            if embedded and m.lastgroup == "p":
                depth += (x == "{") - (x == "}")
                if depth < 0:
                    return m.end()
            t.add(x, m.lastgroup, i, m.end())
            i = m.end()
        return i

    def inner(self, i: int) -> int:
        self.t.add("(", "p", i, i + 1)
        i = self.run(i + 1, True)
        self.t.add(")", "p", i - 1, i)
        return i

    def template(self, i: int) -> int:
        s, begin = self.source, i
        i += 1
        while i < len(s) and s[i] != "`":
            if s[i] == "\\":
                i += 2
            elif s.startswith("${", i):
                self.t.add("``", "s", begin, i)
                i = begin = self.inner(i + 1)
            else:
                i += 1
        self.t.add("``", "s", begin, min(i + 1, len(s)))
        return i + 1

    def element(self, i: int) -> int:
        """A markup element from its opening bracket; only the expressions in it give tokens."""
        s = self.source
        m = _TAG.match(s, i + 1)
        i = m.end()
        while i < len(s) and s[i] != ">":
            if s[i] == "{":
                i = self.inner(i)
            elif s[i] in "\"'":
                i = (s.find(s[i], i + 1) + 1) or len(s)
            elif s.startswith("/>", i):
                return i + 2
            elif s[i] == "<" and (s[i + 1 : i + 2].isalpha()):
                i = self.element(i)
            else:
                i += 1
        i += 1
        while i < len(s):
            if s[i] == "{":
                i = self.inner(i)
            elif s.startswith("</", i):
                return (s.find(">", i) + 1) or len(s)
            elif s[i] == "<" and (s[i + 1 : i + 2] == ">" or s[i + 1 : i + 2].isalpha()):
                i = self.element(i)
            else:
                i += 1
        return i


def _root(literal: str) -> str:
    """The package that a module's name in quotes is of; '' for a relative, absolute or empty one."""
    spec = literal.strip("\"'`")
    if not spec or spec[0] in "./":
        return ""
    parts = spec.split("/")
    return "/".join(parts[:2]) if spec[0] == "@" else parts[0]


def _before(source: str, i: int) -> str:
    """The last character before offset i that isn't space or of a line of comment; a slash where another comment may end."""
    while i > 0:
        start = source.rfind("\n", 0, i) + 1
        line = source[start:i].strip()
        if line and (not line.startswith("//") or "*/" in line):
            return "/" if "//" in line or line.endswith("*/") else line[-1]
        i = start - 1
    return ""


def _imports(source: str, typed: bool, markup: bool) -> set[str] | None:
    """The packages that a source imports, without its tokens; None where only they tell (templates, divisions, elements, unusual clauses)."""
    found, i = set(), 0
    if "import" not in source and "require" not in source:
        return found
    while (i := _PASSED.match(source, i).end()) < len(source):
        before = _before(source, i)
        if source[i] == "<" and not markup:
            i += 1
        elif source.startswith("import", i) and before not in (".", "/"):
            m = _IMPORT.match(source, i)
            clause = m["clause"].strip() if m else "import"
            if "import" in clause or "require" in clause:
                return None
            if m["end"][0] in "\"'":
                if not clause or re.search(r"(?<![\w$])from$", clause):
                    found.add(_root(m["end"]))
            elif m["end"] in "(." and clause:
                return None
            i = m.end("clause") if m["end"] in "(." else m.end()
        elif source.startswith("require", i) and not typed and before in ("=", "("):
            if not (m := _REQUIRE.match(source, i)):
                return None
            found.add(_root(m[1]))
            i = m.end()
        else:
            return None
    return found - {""}


class _Reader:
    def __init__(self, source: str, typed: bool, markup: bool, wanted: frozenset[str] = FACTS) -> None:
        self.t, self.typed, self.wanted = _Lexer(source, markup).read().close(), typed, wanted
        self.facts, self.spans, self.found = Facts(), Spans(), []
        self.heads: set[int] = set()
        self.exports: list[tuple[int, int]] = []
        self.named: set[str] = set()
        self.declared: list[tuple[str, str, int, int]] = []
        self.typed_at: dict[int, int] = {}

    # --- statements -----------------------------------------------------------------------------

    def begins(self, i: int) -> bool:
        """Whether a declaration may begin at token i."""
        t, j = self.t, i - 1
        if j < 0:
            return True
        x = t.at(j)
        if x in (";", "}", "{", "export", "default", "declare", "else", "abstract"):
            return not (x == "}" and t.line(i) == t.last_line(j) and self.value_brace(j))
        if t.at(j) == ")" and t.at(t.partner[j] - 1) in ("if", "for", "while"):
            return True
        return t.line(i) > t.last_line(j) and (t.kind[j] in "sn" or x in (")", "]") or (t.name(j) and x not in _WANTS_MORE))

    def value_brace(self, j: int) -> bool:
        return self.t.at(self.t.partner[j] - 1) in ("=", "(", ",", ":", "[", "return")

    def ends(self, i: int, commas: bool = False) -> int:
        """The token after the expression or type at i, which a semicolon, a bracket or a line's end closes (or a comma)."""
        t = self.t
        while i < len(t):
            x = t.at(i)
            if x == ";" or x in (")", "]", "}") or (commas and x == ","):
                return i
            nxt = t.after(i)
            if nxt < len(t) and t.line(nxt) > t.last_line(nxt - 1) and not (t.at(nxt) in _GOES_ON and t.kind[nxt] != "s") and t.at(nxt - 1) not in _WANTS_MORE:
                return nxt
            i = nxt
        return len(t)

    def run(self) -> Facts:
        t, wanted = self.t, self.wanted
        # exports and import clauses tell of nothing else
        beginnings = _BEGINNINGS - ({"export"} if "symbol" not in wanted else set()) - ({"import"} if "import" not in wanted else set())
        for i in [i for i, x in enumerate(t.shown) if x in beginnings]:
            self.token(i)
        # calls also name modules: require()
        if wanted & {"import", "reference"}:
            self.calls()
        if "reference" in wanted:
            around = self.spans.sweep([p for p, _ in self.found])
            self.facts.references = {(around[p], to) for p, to in self.found if to}
        for name, kind, first, last in self.declared if "symbol" in wanted else ():
            exported = name in self.named or any(a <= first <= b for a, b in self.exports)
            self.facts.symbol(name, kind, t.line(first), t.last_line(last), "export" if exported else "", exported)
        return self.facts

    def token(self, i: int) -> None:
        t, x = self.t, self.t.at(i)
        if not t.name(i) or t.at(i - 1) in (".", "?."):
            return
        if x == "export" and self.begins(i):
            self.export(i)
        elif x == "import":
            self.imports(i)
        elif x == "function":
            self.function(i)
        elif x == "class":
            self.klass(i)
        elif x in ("const", "let", "var"):
            if not (x == "const" and t.at(i + 1) == "enum") and (t.name(i + 1) or t.at(i + 1) in ("{", "[")):
                self.variables(i)
        elif self.typed and x in ("interface", "type", "enum") and t.name(i + 1) and (self.begins(i) or t.at(i - 1) == "const" and x == "enum"):
            self.typed_declaration(i)
        elif self.typed and x in ("as", "satisfies") and i > 0 and (t.name(i - 1) or t.at(i - 1) in (")", "]", "}") or t.kind[i - 1] in "sn") and t.at(i + 1) != "const" and (t.name(i + 1) or t.at(i + 1) in ("{", "(", "[")) and not self.in_clause(i):
            self.type(i + 1)

    def in_clause(self, i: int) -> bool:
        """Whether `as` renames in an import or export clause."""
        t = self.t
        k = i
        while k > 0 and t.at(k) not in ("{", ";", "}"):
            if t.at(k) == "*" and t.at(k - 1) in ("import", "export", ","):
                return True
            k -= 1
        return t.at(k) == "{" and t.at(k - 1) in ("import", "export", "type", ",")

    def export(self, i: int) -> None:
        t, k = self.t, i + 1
        if t.at(k) == "type" and t.at(k + 1) == "{":
            k += 1
        if t.at(k) == "{":
            for a, b in t.pieces(k + 1, t.partner[k]):
                a += t.at(a) == "type" and b - a > 1 and t.at(a + 1) != "as"
                if t.name(a):
                    self.named.add(t.at(a))
            return
        while t.at(k) in ("default", "declare", "abstract", "async") or (t.at(k)[:1] == "@" and t.name(k)):
            k = t.after(k + 1) if t.at(k)[:1] == "@" and t.at(k + 1) == "(" else k + 1
        if t.at(k) in ("function", "class", "interface", "enum", "namespace", "module") or t.at(k) == "const" and t.at(k + 1) == "enum":
            brace = t.find(k, len(t), {"{", ";"})
            while t.at(brace) == "{" and t.at(brace - 1) in (":", "|", "&", "<", ","):
                brace = t.find(t.after(brace), len(t), {"{", ";"})
            end = t.partner[brace] if t.at(brace) == "{" else brace
        else:
            end = self.ends(k)
        self.exports.append((i, end))

    def imports(self, i: int) -> None:
        t = self.t
        if t.at(i + 1) in ("(", "."):
            return
        k = i + 1
        while k < len(t) and t.kind[k] != "s" and t.at(k) not in (";", "="):
            k = t.after(k)
        if k < len(t) and t.kind[k] == "s" and (k == i + 1 or t.at(k - 1) == "from"):
            self.specifier(k)

    def specifier(self, k: int) -> None:
        if root := _root(self.t.text[k]):
            self.facts.imports.add(root)

    def function(self, i: int) -> None:
        t, k = self.t, i + 1
        star = t.at(k) == "*"
        k += star
        name = t.at(k) if t.name(k) else ""
        paren = k + bool(name)
        if t.at(paren) == "<":
            paren = self.type_parameters(paren)
        if t.at(paren) != "(":
            return
        self.heads.add(paren)
        body = self.signature(paren)
        first = i - (t.at(i - 1) == "async")
        if name and not star and t.at(body) == "{" and self.begins(first):
            self.declared.append((name, "function", first, t.partner[body]))
            self.spans.add(first, t.partner[body], name)

    def klass(self, i: int) -> None:
        t = self.t
        name = t.at(i + 1) if t.name(i + 1) and t.at(i + 1) not in ("extends", "implements") else ""
        k = i + 1 + bool(name)
        if t.at(k) == "<":
            k = self.type_parameters(k)
        brace = t.find(k, len(t), {"{"})
        declaration = bool(name) and t.at(i - 1) != "abstract" and self.begins(self.decorated(i))
        if brace >= len(t):
            return
        first = self.decorated(i) if t.at(i - 1) not in ("export", "default") else i
        if declaration:
            self.declared.append((name, "class", first, t.partner[brace]))
            self.spans.add(first, t.partner[brace], name)
            if self.typed:
                self.found.append((i, name))
        elif self.typed and name:
            self.found.append((i, name))
        at = {t.at(j): j for j in self.outside(k, brace) if t.at(j) in ("extends", "implements")}
        up, does = at.get("extends", brace), at.get("implements", brace)
        if self.typed and up < brace:
            end = does if does > up else brace
            angle = next((j for j in range(up + 1, end) if t.at(j) == "<"), end)
            if angle < end:
                self.arguments(angle)
            if declaration and angle > up + 1 and all(t.name(j) if (j - up) % 2 else t.at(j) == "." for j in range(up + 1, angle)) and (t.at(end - 1) in (">", ">>") or angle == end):
                self.facts.supertypes.add((name, t.at(angle - 1), "inherits"))
        if self.typed and does < brace:
            for a, b in t.pieces(does + 1, brace):
                self.type(a)
                if declaration:
                    self.heritage(name, a, b, "implements")
        self.members(brace)

    def outside(self, a: int, b: int):
        """Tokens from a to b - 1 that lie in no group or angle brackets."""
        t = self.t
        while a < b:
            yield a
            end = t.angles(a, b) if t.at(a) == "<" else a
            a = end if end > a else t.after(a)

    def heritage(self, child: str, a: int, b: int, hint: str) -> None:
        if "supertype" not in self.wanted:
            return
        t = self.t
        angle = next((j for j in range(a, b) if t.at(j) == "<"), b)
        if all(t.name(j) if (j - a) % 2 == 0 else t.at(j) == "." for j in range(a, angle)) and angle > a:
            self.facts.supertypes.add((child, t.at(angle - 1), hint))

    def decorated(self, i: int) -> int:
        t = self.t
        while i > 0:
            if t.name(i - 1) and t.at(i - 1)[:1] == "@":
                i -= 1
            elif t.at(i - 1) == ")":
                k = t.partner[i - 1] - 1
                while t.name(k) and t.at(k - 1) == ".":
                    k -= 2
                if not (t.name(k) and t.at(k)[:1] == "@"):
                    break
                i = k
            else:
                break
        return i

    def members(self, brace: int) -> None:
        """Methods and fields of a class: their names, heads and types."""
        t, i, stop = self.t, brace + 1, self.t.partner[brace]
        while i < stop:
            first = i
            while i < stop and ((t.name(i) and t.at(i)[:1] == "@") or (t.at(i) in _MEMBER_WORDS and (t.name(i + 1) or t.at(i + 1) in ("[", "*") or t.kind[i + 1] in "sn")) or t.at(i) == "*"):
                i = t.after(i + 1) if t.at(i)[:1] == "@" and t.at(i + 1) == "(" else i + 1
            if i >= stop:
                return
            name = t.at(i) if t.name(i) else ""
            if t.at(i) == "{" or t.at(i) == ";":
                i = t.after(i)
                continue
            k = t.after(i)
            k += t.at(k) in ("?", "!")
            if t.at(k) == "<":
                k = self.type_parameters(k)
            if t.at(k) == "(":
                self.heads.add(k)
                body = self.signature(k)
                if t.at(body) == "{":
                    if name:
                        self.spans.add(first, t.partner[body], name)
                    i = t.after(body)
                else:
                    i = body + (t.at(body) == ";")
                i = max(i, k + 1)
                continue
            if t.at(k) == ":" and self.typed:
                k = self.type(k + 1)
            k = self.ends(k)
            i = max(k + (t.at(k) == ";"), first + 1)

    def variables(self, i: int) -> None:
        t = self.t
        loop = t.at(i - 1) == "(" and t.at(i - 2) in ("for", "await")
        end, functions, k = i + 1, [], i + 1
        while k < len(t):
            name = t.at(k) if t.name(k) else ""
            j = t.after(k)
            j += t.at(j) == "!"
            if t.at(j) == ":" and self.typed:
                j = self.type(j + 1)
            if loop and t.at(j) in ("of", "in"):
                end = t.find(j, len(t), {")"})
                break
            stop = j
            if t.at(j) == "=":
                stop = self.ends(j + 1, True)
                if name and self.is_function(j + 1, stop):
                    functions.append(name)
                if name:
                    self.spans.add(k, max(stop - 1, k), name)
            end = stop
            if t.at(stop) != ",":
                break
            k = stop + 1
        last = end if t.at(end) == ";" and not loop else end - 1
        for name in functions:
            self.declared.append((name, "function", i, max(i, min(last, len(t) - 1))))

    def is_function(self, i: int, stop: int) -> bool:
        """Whether the value at i is an arrow function or a function expression, whole."""
        t = self.t
        i += t.at(i) == "async" and t.at(i + 1) != "=>"
        if t.at(i) == "function":
            if t.at(i + 1) == "*":
                return False
            paren = t.find(i + 1, stop, {"("})
            body = t.find(t.after(paren), stop, {"{"}) if paren < stop else stop
            while body < stop and t.at(body - 1) in (":", "|", "&", "<", ","):
                body = t.find(t.after(body), stop, {"{"})
            return body < stop and t.after(body) >= stop
        if t.at(i) == "<":
            i = t.angles(i, stop)
        if t.name(i) and t.at(i + 1) == "=>":
            return True
        if t.at(i) != "(":
            return False
        k = t.after(i)
        if t.at(k) == ":":
            k = self.type(k + 1) if self.typed else k
        return t.at(k) == "=>"

    # --- types ----------------------------------------------------------------------------------

    def signature(self, paren: int) -> int:
        """Reads parameters and a return type; the token after them."""
        t = self.t
        if self.typed:
            for a, b in t.pieces(paren + 1, t.partner[paren]):
                while (t.name(a) and (t.at(a)[:1] == "@" or t.at(a) in _MEMBER_WORDS and (t.name(a + 1) or t.at(a + 1) in ("{", "[")))) or t.at(a) == "...":
                    a = t.after(a + 1) if t.at(a)[:1] == "@" and t.at(a + 1) == "(" else a + 1
                k = t.after(a)
                k += t.at(k) == "?"
                if t.at(k) == ":":
                    self.type(k + 1)
        k = t.after(paren)
        if t.at(k) == ":" and self.typed:
            k = self.type(k + 1)
        return k

    def type_parameters(self, i: int) -> int:
        t, end = self.t, self.t.angles(i, len(self.t))
        if end <= i:
            return i + 1
        if self.typed:
            for a, b in t.pieces(i + 1, end - 1):
                a += t.at(a) in ("const", "in", "out") and t.name(a + 1)
                self.see(a)
                for k in range(a + 1, b):
                    if t.at(k) in ("extends", "="):
                        self.type(k + 1)
        return end

    def arguments(self, i: int) -> int:
        t, end = self.t, self.t.angles(i, len(self.t))
        if end <= i:
            return i + 1
        for a, _ in t.pieces(i + 1, end - 1):
            self.type(a)
        return end

    def see(self, i: int) -> None:
        if self.t.name(i):
            self.found.append((i, self.t.at(i)))

    def type(self, i: int) -> int:
        """Reads a type at token i, noting the names in it; the token after it. A type read before is only passed over."""
        if i in self.typed_at:
            return self.typed_at[i]
        k = self._union(i)
        t = self.t
        if t.at(k) == "extends" and t.line(k) >= 0 and k > i:
            k = self._union(k + 1)
            if t.at(k) == "?":
                k = self.type(k + 1)
                if t.at(k) == ":":
                    k = self.type(k + 1)
        elif t.at(k) == "is" and k > i and t.line(k) == t.line(k - 1):
            k = self.type(k + 1)
        self.typed_at[i] = k
        return k

    def _union(self, i: int) -> int:
        t = self.t
        i += t.at(i) in ("|", "&")
        i = self._one(i)
        while t.at(i) in ("|", "&"):
            i = self._one(i + 1)
        return i

    def _one(self, i: int) -> int:
        t = self.t
        while t.at(i) in ("readonly", "keyof", "infer", "unique", "asserts", "abstract", "new") and (t.name(i + 1) or t.at(i + 1) in ("(", "[", "{", "<")):
            i += 1
        x = t.at(i)
        if x == "typeof":
            i += 2
            while t.at(i) == "." and t.name(i + 1):
                i += 2
        elif x == "<":
            i = self._one(self.type_parameters(i))
        elif x == "(":
            k = t.after(i)
            if t.at(k) == "=>":
                self.heads.add(i)
                self.signature(i)
                return self.type(k + 1)
            self.heads.add(i)
            self.type(i + 1)
            i = k
        elif x == "{":
            self.object(i)
            i = t.after(i)
        elif x == "[":
            for a, b in t.pieces(i + 1, t.partner[i]):
                a += t.at(a) == "..."
                if t.name(a) and (t.at(a + 1) == ":" or t.at(a + 1) == "?" and t.at(a + 2) == ":"):
                    a += 2 + (t.at(a + 1) == "?")
                self.type(a)
            i = t.after(i)
        elif t.name(i):
            while t.at(i + 1) == "." and t.name(i + 2):
                i += 2
            if t.at(i) not in _BUILT_IN:
                self.see(i)
            i += 1
            if t.at(i) == "<":
                i = self.arguments(i)
        elif i < len(t) and (t.kind[i] in "sn" or x == "-"):
            i += 1 + (x == "-")
            while i < len(t) and t.kind[i] == "s" or (t.at(i) == "(" and t.source[t.begin[i]] == "{"):
                if t.at(i) == "(":
                    self.type(i + 1)
                i = t.after(i)
        else:
            return i
        while t.at(i) == "[" and t.line(i) == t.last_line(i - 1):
            if t.partner[i] > i + 1:
                self.type(i + 1)
            i = t.after(i)
        return i

    def object(self, brace: int) -> None:
        """Members of an object type or interface."""
        t, i, stop = self.t, brace + 1, self.t.partner[brace]
        while i < stop:
            first = i
            while t.at(i) in ("readonly", "get", "set", "-", "+", "new") and (t.name(i + 1) or t.at(i + 1) in ("[", "(", "readonly", "?") or t.kind[i + 1] == "s"):
                i += 1
            if t.at(i) == "<":
                i = self.type_parameters(i)
            if t.at(i) == "[":
                for k in range(i + 1, t.partner[i]):
                    if t.at(k) in (":", "in"):
                        if t.at(k) == "in":
                            self.see(k - 1)
                        self.type(k + 1)
            k = i if t.at(i) == "(" else t.after(i)
            while t.at(k) in ("?", "-", "+"):
                k += 1
            if t.at(k) == "<":
                k = self.type_parameters(k)
            if t.at(k) == "(":
                self.heads.add(k)
                k = self.signature(k)
            elif t.at(k) == ":":
                k = self.type(k + 1)
            i = max(k, first + 1)
            i += t.at(i) in (",", ";")

    def typed_declaration(self, i: int) -> None:
        t, x, name = self.t, self.t.at(i), self.t.at(i + 1)
        first, k = i - (t.at(i - 1) == "const" and x == "enum"), i + 2
        if x == "type":
            if t.at(k) == "<":
                k = self.type_parameters(k)
            if t.at(k) != "=":
                return
            end = max(self.type(k + 1), k + 1)
            last = end if t.at(end) == ";" else end - 1
            self.see(i + 1)
            self.declared.append((name, "type", first, min(last, len(t) - 1)))
            return
        brace = t.find(k, len(t), {"{"})
        if brace >= len(t):
            return
        self.declared.append((name, x, first, t.partner[brace]))
        if x == "interface":
            self.see(i + 1)
            if t.at(k) == "<":
                k = self.type_parameters(k)
            if t.at(k) == "extends":
                for a, b in t.pieces(k + 1, brace):
                    self.type(a)
                    self.heritage(name, a, b, "inherits")
            self.object(brace)

    # --- calls ----------------------------------------------------------------------------------

    def calls(self) -> None:
        t = self.t
        for i in [i for i, x in enumerate(t.shown) if x == "(" or x == "new"]:
            x = t.shown[i]
            if x == "new" and t.name(i) and t.name(i + 1) and t.at(i - 1) != "." and i + 1 not in self.typed_at:
                k = i + 2
                while t.at(k) == "." and t.name(k + 1):
                    k += 2
                self.found.append((i, t.at(k - 1)))
                if t.at(k) == "<" and self.typed:
                    k = self.arguments(k)
                if t.at(k) == "(":
                    self.heads.add(k)
            elif x == "(" and i not in self.heads and t.source[t.begin[i]] == "(":
                arrow = t.after(i)
                if t.at(arrow) == "=>" or (t.at(arrow) == ":" and self.typed and self.arrow_type(arrow)):
                    self.signature(i)
                    if not t.name(i - 1) or t.at(i - 1) == "async":
                        continue
                self.call(i)

    def arrow_type(self, colon: int) -> bool:
        """Whether a return type and an arrow follow, which tells an arrow function from a branch of a conditional."""
        held = len(self.found)
        known = dict(self.typed_at)
        k = self.type(colon + 1)
        if self.t.at(k) == "=>":
            return True
        del self.found[held:]
        self.typed_at = known
        return False

    def call(self, paren: int) -> None:
        t, k = self.t, paren - 1
        k -= t.at(k) == "?."
        if t.at(k) == ">" and self.typed:
            depth, end = 0, k
            while k > 0:
                depth += (t.at(k) == ">") - (t.at(k) == "<")
                if depth == 0:
                    break
                k -= 1
            if not t.name(k - 1) or t.angles(k, paren) != end + 1:
                return
            self.arguments(k)
            k -= 1
        if not t.name(k) or (t.at(k) in _NO_CALLS and t.at(k - 1) not in (".", "?.")) or t.at(k - 1) in ("function", "*") and t.at(k) in _WORDS:
            return
        if self.object_method(k, paren):
            self.signature(paren)
            self.spans.add(k, t.partner[t.find(t.after(paren), len(t), {"{"})] if t.find(t.after(paren), len(t), {"{"}) < len(t) else paren, t.at(k))
            return
        name, only = t.at(k), k
        if name == "require" and "import" in self.wanted and t.at(k - 1) not in (".", "?."):
            for j in range(paren + 1, t.partner[paren]):
                if t.kind[j] == "s" and t.text[j][:1] in "\"'":
                    self.specifier(j)
        if name in ("super", "import"):
            if name == "super":
                self.found.append((paren, name))
            return
        # the name in front of the first bracket of the function's text
        while t.at(k - 1) in (".", "?.") and k > 1:
            k -= 2
            if t.at(k) in ("!",):
                k -= 1
            if t.at(k) == ")":
                return
            while t.at(k) == "]":
                if any(t.at(j) in ("(", "<") for j in range(t.partner[k], k)):
                    return
                k = t.partner[k] - 1
                if t.at(k) == ")":
                    return
        self.found.append((paren, t.at(only)))

    def object_method(self, k: int, paren: int) -> bool:
        """Whether `name(…) {` is a method of an object literal."""
        t = self.t
        end = t.after(paren)
        before = t.at(k - 1)
        if before in ("async", "get", "set", "*"):
            before = t.at(k - 2)
        return t.at(end) == "{" and before in ("{", ",") and t.line(end) == t.last_line(end - 1) and t.at(k - 1) not in (".", "?.")


def script(source: str, typed: bool, markup: bool, components: bool = False, wanted: frozenset[str] = FACTS) -> Facts:
    """markup: elements may stand among expressions; components: capitalised functions and classes are components."""
    if wanted == {"import"} and (imports := _imports(source, typed, markup)) is not None:
        return Facts(imports=imports)
    facts = _Reader(source, typed, markup, wanted).run()
    if components:
        facts.symbols = [(n, f, "component" if k in ("function", "class") and n[:1].isupper() else k, a, b, v, e) for n, f, k, a, b, v, e in facts.symbols]
    return facts
