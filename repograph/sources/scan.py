"""A repository's files: discovery, globs, listing and reading."""

from __future__ import annotations

import os
import re
import subprocess
from collections.abc import Iterator, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P

#: The folder that holds the graph.
HOME = ".repograph"
_ENDS = "bash cjs cs csproj go js json jsx markdown md mdx mjs props py rs sh sln svelte targets toml ts tsx yaml yml zsh".split()
_NAMES = ("package-lock.json", "package.json", "pnpm-lock.yaml", "yarn.lock")
INCLUDE = tuple(f"**/{n}" for n in (*(f"*.{e}" for e in _ENDS), *_NAMES))
_FOLDERS = (".git", ".next", ".turbo", ".vite", "bin", "build", "coverage", "dist", "node_modules", "obj", "target")
_MADE = ("Designer.cs", "bundle.js", "g.cs", "generated.cs", "map", "min.js")
EXCLUDE = (*(f"**/{d}/**" for d in _FOLDERS), *(f"**/*.{e}" for e in _MADE))


def discover(start: str) -> str:
    """The nearest folder at or above start that holds a graph, else the nearest that is a git work tree, else start."""
    here = Path(start).resolve()
    chain = [here, *here.parents]
    for mark in (HOME, ".git"):
        for p in chain:
            if (p / mark).exists():
                return str(p)
    return str(here)


def glob_regex(glob: str) -> str:
    """An anchored regular expression: ** and * cross folders, ? is any character, {a,b} and [..] as usual."""
    out, i, depth = [], 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out.append("(?:.*/)?")
            i += 3
            continue
        if c == "*":
            out.append(".*")
            i += 2 if glob.startswith("**", i) else 1
            continue
        if c == "?":
            out.append(".")
        elif c == "{":
            out.append("(?:")
            depth += 1
        elif c == "}" and depth:
            out.append(")")
            depth -= 1
        elif c == "," and depth:
            out.append("|")
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            inside = glob[i + 1 : end]
            out.append("[" + ("^" + inside[1:] if inside[0] in "!^" else inside).replace("\\", "\\\\") + "]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return "^(?s:" + "".join(out) + ")$"


def path_matches(path: Column, include: Sequence[str] = INCLUDE, exclude: Sequence[str] = EXCLUDE) -> Column:
    """Whether one of the include globs matches and no exclude glob does; without include globs nothing matches."""
    any_of = lambda globs: path.rlike("|".join(f"(?:{glob_regex(g)})" for g in globs)) if globs else F.lit(False)
    return any_of(include) & ~any_of(exclude)


def _ignored_by_git(root: str) -> list[str] | None:
    try:
        got = subprocess.run(["git", "-C", root, "ls-files", "-co", "--exclude-standard", "-z"], capture_output=True, check=True)
    except (OSError, subprocess.CalledProcessError):
        return None
    return [os.fsdecode(p) for p in got.stdout.split(b"\0") if p]


def list_files(root: str) -> list[str]:
    """Regular files below root that git doesn't ignore (all of them outside a work tree), relative, hidden ones too."""
    found = _ignored_by_git(root)
    found = _walk(root) if found is None else found
    found = [p for p in found if not p.startswith(f"{HOME}/")]
    return sorted({p.replace("\\", "/") for p in found if os.path.isfile(os.path.join(root, p)) and not os.path.islink(os.path.join(root, p))})


def _walk(root: str) -> list[str]:
    out = []
    for folder, folders, files in os.walk(root):
        folders[:] = [d for d in folders if d not in (".git", HOME)]
        out += [os.path.relpath(os.path.join(folder, f), root) for f in files]
    return out


def candidate_files(spark: SparkSession, root: str, include: Sequence[str] = INCLUDE, exclude: Sequence[str] = EXCLUDE) -> DataFrame:
    """path of the files to index, distinct. The listing is the driver's, as git's is; the globs are evaluated by Spark."""
    rows = spark.createDataFrame([(p,) for p in list_files(root)], "path string")
    return rows.filter(path_matches(F.col("path"), include, exclude))


def decoded(content: Column) -> Column:
    """Bytes as text, each malformed part as a replacement character."""
    return F.make_valid_utf8(content.cast("string"))


def described(raw: DataFrame) -> DataFrame:
    """path, language, text, hash, size_bytes of raw (path, content)."""
    return raw.select("path", P.language(F.col("path")).alias("language"), decoded(F.col("content")).alias("text"), F.sha2("content", 256).alias("hash"), F.length("content").cast("long").alias("size_bytes"))


def read_files(paths: DataFrame, root: str) -> DataFrame:
    """path, content of paths below root, a folder that all executors see. A file that is gone by now gives no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                try:
                    content = Path(root, path).read_bytes()
                except OSError:
                    continue
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([content], pa.binary())], names=["path", "content"])

    return paths.select("path").mapInArrow(run, "path string, content binary")
