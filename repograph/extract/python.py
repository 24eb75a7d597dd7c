"""Python: classes and functions at any depth, base classes."""

from __future__ import annotations

import ast
import re
import warnings

from .lexing import Facts, bare

_BLANK = re.compile(r"""[rRbBuUfF]{0,2}('''(?:\\.|(?!''').)*'''|\"\"\"(?:\\.|(?!\"\"\").)*\"\"\"|'(?:\\.|[^'\\\n])*'|"(?:\\.|[^"\\\n])*")|\#[^\n]*""", re.S)
_HEAD = re.compile(r"^([ \t]*)(?:async[ \t]+)?(class|def)[ \t]+([^\W\d]\w*)[ \t]*(\(([^()]*)\))?", re.M)
_BASE = re.compile(r"[^\W\d]\w*(?:\s*\.\s*[^\W\d]\w*)*")


def python(source: str) -> Facts:
    """By the parser of this Python, or, where that refuses the text, by indentation."""
    facts = Facts()
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return _by_indentation(source)
    for node in _statements(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            kind = "class" if isinstance(node, ast.ClassDef) else "function"
            facts.symbol(node.name, kind, node.lineno, node.end_lineno or node.lineno, "", not node.name.startswith("_"))
            for base in node.bases if kind == "class" else ():
                if isinstance(base, (ast.Name, ast.Attribute)):
                    _base(facts, node.name, ast.unparse(base))
    return facts


def _statements(tree: ast.Module) -> list[ast.AST]:
    """The tree's nodes that hold statements or are some, in the order of ast.walk; expressions hold no declarations."""
    out: list[ast.AST] = [tree]
    for node in out:
        for name in ("body", "handlers", "orelse", "finalbody", "cases"):
            out += getattr(node, name, ())
    return out


def _base(facts: Facts, child: str, text: str) -> None:
    if (name := bare(text)) and name != "object":
        facts.supertypes.add((child, name, "inherits"))


def _by_indentation(source: str) -> Facts:
    facts = Facts()
    text = _BLANK.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), source)
    lines = text.split("\n")
    for m in _HEAD.finditer(text):
        first = text.count("\n", 0, m.start(2)) + 1
        indent, last = len(m[1].expandtabs()), first
        i = text.count("\n", 0, m.end()) + 1
        for k in range(i, len(lines)):
            line = lines[k].expandtabs()
            if line.strip():
                if len(line) - len(line.lstrip()) <= indent and not line.lstrip().startswith(")"):
                    break
                last = k + 1
        facts.symbol(m[3], "class" if m[2] == "class" else "function", first, max(last, first), "", not m[3].startswith("_"))
        for part in (m[5] or "").split(",") if m[2] == "class" else ():
            if _BASE.fullmatch(part.strip()):
                _base(facts, m[3], part.strip())
    return facts
