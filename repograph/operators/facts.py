"""Files to facts: one pass over file contents, then the tables of symbols, imports, supertypes and references."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..extract import FACTS, facts_of
from ..functions import paths as P
from .joins import shuffled

SCHEMA = "path string, fact string, name string, full_name string, kind string, start_line int, end_line int, visibility string, exported boolean, target string, hint string"
_ARROW = pa.schema(
    [("path", pa.string()), ("fact", pa.string()), ("name", pa.string()), ("full_name", pa.string()), ("kind", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("visibility", pa.string()), ("exported", pa.bool_()), ("target", pa.string()), ("hint", pa.string())]
)
#: Rows of facts that one Arrow batch holds, about.
BATCH_ROWS = 20_000
LANGUAGES_WITH_REFERENCES = ("csharp", "rust", "typescript", "javascript")


def _rows(path: str, language: str, text: str, wanted: frozenset[str] = FACTS) -> Iterator[tuple]:
    facts = facts_of(path, language, text, wanted)
    for name, full, kind, first, last, visibility, exported in sorted({(s[0], s[3], s[2]): s for s in reversed(facts.symbols if "symbol" in wanted else [])}.values(), key=lambda s: (s[3], s[0], s[2])):
        yield path, "symbol", name, full, kind, first, last, visibility, exported, None, None
    for name in sorted(facts.imports) if "import" in wanted else ():
        yield path, "import", name, None, None, None, None, None, None, None, None
    for child, base, hint in sorted(facts.supertypes) if "supertype" in wanted else ():
        yield path, "supertype", child, None, None, None, None, None, None, base, hint
    for source, target in sorted(facts.references) if "reference" in wanted else ():
        yield path, "reference", source, None, None, None, None, None, None, target, None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


def extract(files: DataFrame, *wanted: str) -> DataFrame:
    """The facts (SCHEMA) of files (path, language, text), each file read by the scanner of its language.

    A file is one row's work and files are independent, so this is a map without a shuffle. A null path,
    language or text gives no facts; neither does a file that its scanner can't read. Files of any size
    are read whole. Repeated rows give repeated facts. wanted: the facts to give (symbol, import, supertype,
    reference; all if none is named); scanners don't look for others.
    """
    asked = frozenset(wanted) or FACTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for path, language, text in zip(*(c.to_pylist() for c in batch.columns)):
                if path is None or language is None or text is None:
                    continue
                held += _rows(path, language, text, asked)
                if len(held) >= BATCH_ROWS:
                    yield _batch(held)
                    held = []
        if held:
            yield _batch(held)

    return files.filter(F.col("language") != "other").select("path", "language", F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def declared(facts: DataFrame) -> DataFrame:
    """id, name, full_name, kind, file_path, start_line, end_line, visibility, exported."""
    named = P.symbol_id(F.col("path"), F.col("kind"), F.col("name"), F.col("start_line"))
    return facts.filter("fact = 'symbol'").select(named.alias("id"), "name", "full_name", "kind", F.col("path").alias("file_path"), "start_line", "end_line", "visibility", "exported")


def symbols(facts: DataFrame, files: DataFrame) -> DataFrame:
    """id, name, full_name, kind, language, file_path, start_line, end_line, visibility, exported; files: path, language."""
    found = declared(facts).join(shuffled(files.select(F.col("path").alias("file_path"), "language")), "file_path")
    return found.select("id", "name", "full_name", "kind", "language", "file_path", "start_line", "end_line", "visibility", "exported")


def raw_imports(facts: DataFrame) -> DataFrame:
    return facts.filter("fact = 'import'").select(F.col("path").alias("file_path"), F.col("name").alias("package"))


def raw_supertypes(facts: DataFrame) -> DataFrame:
    return facts.filter("fact = 'supertype'").select(F.col("path").alias("file_path"), F.col("name").alias("from"), F.col("target").alias("to"), "hint")


def raw_references(facts: DataFrame) -> DataFrame:
    return facts.filter("fact = 'reference'").select(F.col("path").alias("file_path"), F.col("name").alias("from"), F.col("target").alias("to"))
