"""The ranked selections: by change, path, symbol, text, and what relates to a symbol or file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators import graph as G
from ..operators import ranking as R
from ..operators.joins import shuffled


def _neighbours(found: DataFrame, files: DataFrame) -> DataFrame:
    dirs = found.select(P.parent_dir(F.col("path")).alias("dir")).distinct()
    near = files.withColumn("dir", P.parent_dir(F.col("path"))).join(shuffled(dirs), "dir", "left_semi").select("path")
    return found.unionByName(R.candidates(near, 99, 2, "same directory as a selected file", False))


def _chosen(found: DataFrame, files: DataFrame, **flags) -> DataFrame:
    return R.select_best(R.keep(_neighbours(found, files), **flags), files)


def pack_changed(files: DataFrame, changed: DataFrame, **flags) -> DataFrame:
    return _chosen(R.candidates(changed, 0, 0, "changed file", False), files, **flags)


def pack_path(files: DataFrame, prefix: str, **flags) -> DataFrame:
    p = prefix.rstrip("/")
    exact = R.candidates(files.filter(F.col("path") == p), 0, 0, "exact path match", True)
    below = R.candidates(files.filter(P.under_prefix(F.col("path"), p)), 1, 1, f"under path `{p}`", True)
    return _chosen(exact.unionByName(below), files, **flags)


def pack_symbol(files: DataFrame, symbols: DataFrame, references: DataFrame, name: str, **flags) -> DataFrame:
    here = symbols.filter(P.ci_equals(F.col("name"), name)).select(F.col("file_path").alias("path")).distinct()
    declares = R.candidates(here, 0, 0, f"declares `{name}`", True)
    related = G.related_to_symbol(symbols, references, name)
    own = R.candidates(related.filter("depth = 0"), 1, 0, F.col("reason"), True)
    other = R.candidates(related.filter("depth > 0"), 2, 1, F.col("reason"), False)
    return _chosen(declares.unionByName(own).unionByName(other), files, **flags)


def pack_query(files: DataFrame, symbols: DataFrame, text: str, **flags) -> DataFrame:
    by_path = R.candidates(files.filter(P.ci_contains(F.col("path"), text)), 0, 1, f"path matches `{text}`", True)
    named = symbols.filter(P.ci_contains(F.col("name"), text)).select(F.col("file_path").alias("path")).distinct()
    return _chosen(by_path.unionByName(R.candidates(named, 1, 1, f"declares symbol matching `{text}`", True)), files, **flags)


def _items(df: DataFrame, order: int, reason, depth: int = 1) -> DataFrame:
    reason = F.lit(reason) if isinstance(reason, str) else reason
    return df.select("path", reason.alias("reason"), F.lit(depth).alias("depth"), F.lit(order).alias("seq"))


def related_symbol(files: DataFrame, symbols: DataFrame, contains: DataFrame, projects: DataFrame, supers: DataFrame, references: DataFrame, name: str, ceiling: int = 1) -> DataFrame:
    seeds = symbols.filter(P.ci_equals(F.col("name"), name)).select(F.col("file_path").alias("path")).distinct()
    own = contains.join(shuffled(seeds), "path").join(shuffled(projects.select(F.col("id").alias("project_id"), "name")), "project_id").select("project_id", F.col("path").alias("seed"), "name")
    same = contains.join(shuffled(own), "project_id").filter("path != seed").select("path", F.concat(F.lit("same project ("), F.col("name"), F.lit(")")).alias("reason")).distinct()
    dirs = seeds.select(P.parent_dir(F.col("path")).alias("dir")).distinct()
    near = files.withColumn("dir", P.parent_dir(F.col("path"))).join(shuffled(dirs), "dir", "left_semi")
    path = F.col("path")
    beside = F.when(P.is_test_file(path), "test file in the same directory").when(P.is_config_file(path), "config/registration file in the area").otherwise("same directory as a declaring file")
    matching = files.filter(P.ci_contains(path, name))
    named = F.when(P.is_test_file(path), f"likely test for `{name}`").otherwise(f"path contains `{name}`")
    parts = [
        _items(seeds, 0, f"declares `{name}`", 0), _items(same, 1, F.col("reason")), _items(G.type_relations(supers, symbols, name), 2, F.col("reason")),
        _items(G.symbol_references(references, symbols, name), 3, F.col("reason")), _items(near, 4, beside), _items(matching, 5, named),
    ]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return R.finalize(found, files, ceiling)


def related_file(files: DataFrame, contains: DataFrame, projects: DataFrame, path: str, ceiling: int = 1) -> DataFrame:
    p, stem = F.col("path"), F.lit(path.rsplit("/", 1)[-1].split(".", 1)[0].lower())
    folder = path.rsplit("/", 1)[0] if "/" in path else ""
    seed = _items(files.filter(p == path), 0, "seed file", 0)
    same = _items(G.siblings(contains, projects, path), 1, F.col("reason"))
    others = files.filter(p != path)
    here = P.parent_dir(p) == folder
    reason = F.when(here & P.is_test_file(p), "test file in the same directory").when(here, "same directory as the seed file").otherwise("likely test for the seed file")
    near = others.filter(here | (P.is_test_file(p) & F.contains(F.lower(p), stem)))
    return R.finalize(seed.unionByName(same).unionByName(_items(near, 2, reason)), files, ceiling)


def build_pack(chosen: DataFrame, contents: DataFrame, budget: int = R.BUDGET) -> DataFrame:
    """path, tier, tokens, included; contents: path, text."""
    sized = contents.select("path", P.estimate_tokens(F.col("text")).alias("tokens"))
    return R.budget_fit(chosen.select("path", "tier").join(shuffled(sized), "path"), budget)
