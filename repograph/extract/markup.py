"""Svelte, shell, YAML, JSON and Markdown."""

from __future__ import annotations

import re

from .lexing import Facts, line_starts
from .script import script

_ROLES = {"+page": "page", "+layout": "layout", "+server": "endpoint", "+error": "error"}
_SCRIPT = re.compile(r"<script\b((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>(.*?)</script\s*>", re.S | re.I)
_LANG = re.compile(r"""(?<![\w-])lang\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_SHELL = re.compile(r"^[ \t]*(?:function[ \t]+([^\s(){};]+)[ \t]*(?:\([ \t]*\))?|([^\s(){};#=\"'$&|<>]+)[ \t]*\([ \t]*\))\s*(?=[{(])", re.M)
_SHELL_TOKEN = re.compile(r"""\\.|'[^']*'|"(?:\\.|[^"\\])*"|\$\{|\$\(|(?<![\w$])\#[^\n]*|<<-?\s*\\?['"]?(\w+)['"]?|[{}()]""", re.S)
_YAML_KEY = re.compile(r"""^((?:"(?:\\.|[^"\\])*"|'(?:''|[^'])*'|[^\s#\[\]{},&*!|>'"%@`\-?:][^#]*?|[-?:][^\s#][^#]*?))\s*:(?=\s|$)""")
_ANCHOR = re.compile(r"(?:^|(?<=[\s:\[{,-]))&([^\s\[\]{},]+)")
_ATX = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?[ \t]*$")
_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})(.*)$")


def route_role(path: str) -> str | None:
    return _ROLES.get(path.rsplit("/", 1)[-1].lower().split(".", 1)[0])


def svelte(path: str, source: str) -> Facts:
    facts = Facts()
    base = path.rsplit("/", 1)[-1]
    name, role = base[: -len(".svelte")] if base.endswith(".svelte") else path, route_role(path)
    if role and (parent := path.rpartition("/")[0].rsplit("/", 1)[-1]):
        name = f"{parent}/{name}"
    facts.symbol(name, "component", 1, source.count("\n") + 1, role or "component", True, f"{name} (sveltekit {role})" if role else name)
    for m in _SCRIPT.finditer(source):
        lang = next((g for found in _LANG.finditer(m[1]) for g in found.groups() if g is not None), "")
        inner = script(m[2], lang.lower() not in ("js", "javascript"), False, True)
        shift = source.count("\n", 0, m.start(2))
        facts.symbols += [(n, f, k, a + shift, b + shift, v, e) for n, f, k, a, b, v, e in inner.symbols]
    return facts


def bash(source: str) -> Facts:
    facts, starts = Facts(), line_starts(source)
    kept = _blank_shell(source)
    for m in _SHELL.finditer(kept):
        name = m[1] or m[2]
        end = _shell_end(kept, m.end())
        at = m.start(1) if m[1] else m.start(2)
        first = kept.rfind("function", m.start(), at) if m[1] else at
        line = lambda i: sum(s <= i for s in starts) if len(starts) < 64 else _line(starts, i)
        facts.symbol(name, "function", line(first), line(max(end - 1, first)), "", True)
    return facts


def _line(starts: list[int], i: int) -> int:
    from bisect import bisect_right

    return bisect_right(starts, i)


def _blank_shell(source: str) -> str:
    """The script with quoted texts, comments and here-documents blanked, lines kept."""
    out, i, waiting = [], 0, []
    for m in _SHELL_TOKEN.finditer(source):
        if m.start() < i:
            continue
        gap = source[i : m.start()]
        if waiting and "\n" in gap:
            cut = source.index("\n", i) + 1
            end = cut
            for word in waiting:
                stop = re.compile(rf"^\t*{re.escape(word)}[ \t]*$", re.M).search(source, end)
                end = stop.end() if stop else len(source)
            waiting = []
            out += [source[i:cut], re.sub(r"[^\n]", " ", source[cut:end])]
            i = end
            if m.start() < i:
                continue
            gap = source[i : m.start()]
        out.append(gap)
        x = m[0]
        if m[1]:
            waiting.append(m[1])
            out.append(x)
        else:
            out.append(x if x in "{}()" else "{ " if x == "${" else " (" if x == "$(" else re.sub(r"[^\n]", "_" if x[0] in "'\"\\" else " ", x))
        i = m.end()
    out.append(re.sub(r"[^\n]", " ", source[i:]) if waiting and "\n" in source[i:] else source[i:])
    return "".join(out)


def _shell_end(text: str, i: int) -> int:
    """What follows the group that opens at i."""
    depth = 0
    close = {"{": "}", "(": ")"}[text[i]]
    while i < len(text):
        depth += (text[i] in "{(") - (text[i] in "})")
        i += 1
        if depth == 0:
            return i
    return len(text) if close else i


def yaml(source: str) -> Facts:
    facts, keys, indent = Facts(), [], None
    block, last, done = -1, 0, False
    for n, line in enumerate(source.split("\n"), 1):
        body = line.rstrip("\r")
        depth = len(body) - len(body.lstrip(" "))
        text = body.strip()
        if block >= 0:
            if not text or depth > block:
                last = n if text else last
                continue
            block = -1
        if not text or text[0] == "#" or text[0] == "%":
            continue
        if text.startswith("---") or text.startswith("..."):
            done = done or bool(keys)
            text = text[3:].strip() if text.startswith("---") else ""
            if not text or text[0] == "#":
                continue
        content = re.sub(r"(^|\s)#.*$", "", text)
        for m in _ANCHOR.finditer(re.sub(r"\"(?:\\.|[^\"\\])*\"|'(?:''|[^'])*'", lambda q: "_" * len(q[0]), content)):
            facts.symbol(m[1], "key", n, n, "anchor", False)
        item = content
        while item.startswith("- ") and indent is None:
            depth += len(item) - len(item[1:].lstrip())
            item = item[1:].lstrip()
        m = _YAML_KEY.match(item)
        if m and not done and (indent is None or depth == indent):
            if keys:
                keys[-1][2] = last
            indent = depth if indent is None else indent
            keys.append([m[1].strip(), n, n])
        elif indent is not None and depth < indent:
            done = True
        if not done:
            last = n
        if re.search(r"(^|[\s:-])[|>][+-]?\d?[+-]?$", content):
            block = depth
    if keys:
        keys[-1][2] = max(last, keys[-1][1])
    for name, first, end in keys:
        facts.symbol(name, "key", first, max(first, end))
    return facts


def json(source: str) -> Facts:
    facts, starts = Facts(), line_starts(source)
    token = re.compile(r'"(?:\\.|[^"\\])*"|//[^\n]*|/\*.*?\*/|[{}\[\]:,]|[^\s{}\[\]:,"]+', re.S)
    depth, inside, key, want, last = 0, False, None, False, 0
    for m in token.finditer(source):
        x = m[0]
        if x.startswith(("//", "/*")):
            continue
        if not inside:
            inside = want = x == "{"
            depth = 1
            continue
        if depth == 1 and x in ",}":
            if key and key[0]:
                facts.symbol(key[0], "key", _line(starts, key[1]), _line(starts, max(last - 1, key[1])))
            key, want = None, True
            if x == "}":
                break
        elif depth == 1 and want and x[0] == '"':
            key, want = (x.strip('"'), m.start()), False
        if x in ("{", "["):
            depth += 1
        elif x in ("}", "]"):
            depth -= 1
        last = m.end()
    return facts


def markdown(source: str) -> Facts:
    facts, fence, paragraph = Facts(), "", []
    lines = source.split("\n")

    def add(level: int, raw: str, first: int, last: int) -> None:
        title = " ".join(raw.strip().rstrip("#").split())
        if title:
            # a heading's node ends at the start of the line after it
            facts.symbol(title, "key", first, min(last + 1, len(lines)), f"h{level}", False, f"h{level} {title}")

    for n, line in enumerate(lines, 1):
        line = line.rstrip("\r")
        if fence:
            m = _FENCE.match(line)
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not m[2].strip():
                fence = ""
            continue
        if (m := _FENCE.match(line)) and not (m[1][0] == "`" and "`" in m[2]):
            fence, paragraph = m[1], []
        elif m := _ATX.match(line):
            add(len(m[1]), m[2] or "", n, n)
            paragraph = []
        elif paragraph and (m := re.match(r"^ {0,3}(=+|-+)[ \t]*$", line)):
            add(1 if m[1][0] == "=" else 2, "\n".join(paragraph), n - len(paragraph), n)
            paragraph = []
        elif not line.strip() or (not paragraph and re.match(r"^(    |\t)", line)) or re.match(r"^ {0,3}(>|[-+*] |\d+[.)] |<\w|(?:[-*_] *){3,}$)", line):
            paragraph = []
        else:
            paragraph.append(line)
    return facts
