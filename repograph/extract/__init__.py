"""Facts of source files: symbols, imports, supertypes and references, by scanners of each language."""

from __future__ import annotations

from . import markup
from .csharp import csharp
from .go import go
from .lexing import FACTS, Facts
from .python import python
from .rust import rust
from .script import script


def facts_of(path: str, language: str, source: str, wanted: frozenset[str] = FACTS) -> Facts:
    """What a file says; a file that can't be read gives no facts, never an error. Facts that are not wanted may be left out."""
    low = path.lower()
    elements = low.endswith((".tsx", ".jsx"))
    try:
        if language == "rust":
            return rust(source, wanted)
        if language == "csharp":
            return csharp(source, wanted)
        if language == "python":
            return python(source)
        if language == "go":
            return go(source)
        if language in ("javascript", "typescript"):
            return script(source, language == "typescript", language == "javascript" or elements, elements, wanted)
        if language == "svelte":
            return markup.svelte(path, source)
        plain = {"bash": markup.bash, "yaml": markup.yaml, "json": markup.json, "markdown": markup.markdown}.get(language)
        return plain(source) if plain else Facts()
    except (RecursionError, IndexError, ValueError, KeyError, AttributeError):
        return Facts()
