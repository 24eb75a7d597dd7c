"""Searches, one-hop traversals, table maintenance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import ci_contains, ci_equals
from .joins import shuffled


def symbols_matching(symbols: DataFrame, name: str | None = None, kind: str | None = None, language: str | None = None, file: str | None = None) -> DataFrame:
    tests = [ci_contains(F.col("name"), name)] if name else []
    tests += [F.col(c) == v for c, v in (("kind", kind), ("language", language), ("file_path", file)) if v is not None]
    return reduce(lambda d, t: d.filter(t), tests, symbols).orderBy("name", "file_path", "id")


def files_matching(files: DataFrame, path: str | None = None, language: str | None = None) -> DataFrame:
    tests = ([ci_contains(F.col("path"), path)] if path else []) + ([F.col("language") == language] if language is not None else [])
    return reduce(lambda d, t: d.filter(t), tests, files).orderBy("path")


def packages_matching(packages: DataFrame, name: str = "", ecosystem: str | None = None) -> DataFrame:
    found = packages.filter(ci_contains(F.col("name"), name))
    found = found.filter(ci_equals(F.col("ecosystem"), ecosystem)) if ecosystem else found
    return found.withColumn("shown", F.when(F.col("version") == "", "(unversioned)").otherwise(F.col("version"))).orderBy("name", "version")


def projects_matching(projects: DataFrame, text: str = "") -> DataFrame:
    return projects.filter(ci_contains(F.col("name"), text) | ci_contains(F.col("path"), text)).orderBy("path")


def symbol_references(references: DataFrame, symbols: DataFrame, name: str) -> DataFrame:
    """path, reason, depth of files that refer to a symbol of that name."""
    target = symbols.filter(ci_equals(F.col("name"), name)).select(F.col("id").alias("dst"))
    source = symbols.select(F.col("id").alias("src"), F.col("file_path").alias("path"))
    met = references.join(shuffled(target), "dst", "left_semi").select("src").distinct().join(shuffled(source), "src")
    return met.select("path", F.lit(f"references {name}").alias("reason"), F.lit(1).alias("depth")).distinct()


def type_relations(edges: DataFrame, symbols: DataFrame, name: str) -> DataFrame:
    """path, reason, depth over inheritance and implementation edges (src, dst, kind), both ways."""
    named = symbols.filter(ci_equals(F.col("name"), name)).select(F.col("id").alias("node"))
    where = symbols.select(F.col("id").alias("other"), F.col("file_path").alias("path"))
    inherits = F.col("kind") == "inherits"
    up = F.struct(F.col("src").alias("node"), F.col("dst").alias("other"), F.when(inherits, "base type (inherits)").otherwise("implemented interface/trait").alias("reason"))
    down = F.struct(F.col("dst").alias("node"), F.col("src").alias("other"), F.when(inherits, "subtype (inherits)").otherwise("implementor").alias("reason"))
    both = edges.select(F.explode(F.array(up, down)).alias("rg")).select("rg.*")
    return both.join(shuffled(named), "node", "left_semi").join(shuffled(where), "other").select("path", "reason", F.lit(1).alias("depth")).distinct()


def files_importing(imports: DataFrame, packages: DataFrame, name: str) -> DataFrame:
    return imports.join(shuffled(packages.filter(F.col("name") == name).select(F.col("id").alias("package_id"))), "package_id", "left_semi").select(F.col("file_path").alias("path")).distinct()


def siblings(contains: DataFrame, projects: DataFrame, path: str) -> DataFrame:
    """path, reason, depth of the files that share a project (contains: project_id, path) with path."""
    own = contains.filter(F.col("path") == path).select("project_id").join(projects.select(F.col("id").alias("project_id"), "name"), "project_id")
    reason = F.concat(F.lit("same project ("), F.col("name"), F.lit(")"))
    return contains.join(own, "project_id").filter(F.col("path") != path).select("path", reason.alias("reason"), F.lit(1).alias("depth")).distinct()


def related_to_symbol(symbols: DataFrame, references: DataFrame, name: str) -> DataFrame:
    here = symbols.filter(ci_equals(F.col("name"), name)).select(F.col("file_path").alias("path"), F.lit("exact symbol declaration").alias("reason"), F.lit(0).alias("depth")).distinct()
    there = symbol_references(references, symbols, name).join(shuffled(here.select("path")), "path", "left_anti")
    return here.unionByName(there)


def stats(files: DataFrame, symbols: DataFrame, projects: DataFrame, packages: DataFrame, project_edges: DataFrame, package_edges: DataFrame, references: DataFrame) -> DataFrame:
    named = {"files": files, "symbols": symbols, "projects": projects, "packages": packages, "project_edges": project_edges, "package_edges": package_edges, "reference_edges": references}
    counts = reduce(lambda a, b: a.crossJoin(b), [d.agg(F.count("*").alias(n)) for n, d in named.items()])
    return counts.select("files", "symbols", "projects", "packages", (F.col("project_edges") + F.col("package_edges")).alias("edges"), "reference_edges")


def last_writer(rows: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """Of each key, the values of the row that is last by order."""
    return rows.groupBy(key).agg(F.max(F.struct(F.struct(*order).alias("o"), F.struct(*values).alias("v"))).alias("rg")).select(key, *[f"rg.v.{v}" for v in values])


def distinct_symbols(symbols: DataFrame) -> DataFrame:
    """One symbol of each file, name, line and kind: the one of least end, then id."""
    least = F.min(F.struct("end_line", "id")).alias("rg")
    return symbols.groupBy("file_path", "name", "start_line", "kind").agg(least).select("file_path", "name", "start_line", "kind", "rg.end_line", "rg.id")


def classify(candidates: DataFrame, indexed: DataFrame) -> DataFrame:
    """path, change of every path: new, changed, same (by hash) or deleted."""
    both = candidates.select("path", F.col("hash").alias("now")).join(indexed.select("path", F.col("hash").alias("was")), "path", "full")
    change = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "deleted").when(F.col("now") == F.col("was"), "same").otherwise("changed")
    return both.select("path", change.alias("change"))


def replace_files(old: DataFrame, batch: DataFrame, key: str = "path") -> DataFrame:
    """old with the rows of the batch's files replaced by the batch."""
    return old.join(batch.select(key).distinct(), key, "left_anti").unionByName(batch)
