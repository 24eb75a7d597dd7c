"""Name resolution: the ambiguity cascade and the prefix joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import ancestors, ci_equals, parent_dir
from .joins import shuffled

INTERFACES = ("interface", "trait")


def first_declarations(symbols: DataFrame) -> DataFrame:
    """The first symbol of each name in each file, by start, end, id."""
    w = Window.partitionBy("file_path", "name").orderBy("start_line", "end_line", "id")
    return symbols.withColumn("rg_nth", F.row_number().over(w)).filter("rg_nth = 1").drop("rg_nth")


def named_in(symbols: DataFrame, raw: DataFrame) -> DataFrame:
    """The symbols whose name raw (..., to, ...) refers to."""
    return symbols.join(shuffled(raw.select(F.col("to").alias("name")).distinct()), "name", "left_semi")


def _in_file(path: Column) -> Column:
    return F.concat(F.lit("="), path)


def _below(dir: Column) -> Column:
    return F.concat(F.lit("/"), dir)


def cascade(raw: DataFrame, symbols: DataFrame, targets: DataFrame | None = None, alive: DataFrame | None = None) -> DataFrame:
    """src, dst and raw's other columns: raw (file_path, from, to, ...) against symbols by name.

    Targets in the referrer's file win; else those strictly below its directory; else all of that name.
    Where targets are is counted first (least and greatest id in each file and below each directory), so that
    each (src, to) gets the one scope it resolves in, and one join finds its targets; raw is read once. Each
    (src, to) is resolved by itself, so a condition on raw restricts the result without changing it; targets
    restricts the symbols referred to likewise, if it has all symbols of a name or none. alive (id) keeps the
    edges whose both ends it has; what others resolve to stays as it is. Rows are distinct if those of raw's
    other columns are, for each (file_path, from, to).
    """
    extra = [c for c in raw.columns if c not in ("file_path", "from", "to")]
    decl = first_declarations(symbols).select("file_path", F.col("name").alias("from"), F.col("id").alias("src"))
    ends = (symbols if targets is None else targets).select(F.col("name").alias("to"), F.col("id").alias("dst"), F.col("file_path").alias("t_file"), F.col("kind").alias("t_kind"))
    found = ends.distinct()
    if alive is not None:
        decl = decl.join(shuffled(alive.select(F.col("id").alias("src"))), "src", "left_semi")
        found = found.join(shuffled(alive.select(F.col("id").alias("dst"))), "dst", "left_semi")
    # distinct while still partitioned by file and from
    base = raw.filter(F.col("from") != "").join(shuffled(decl), ["file_path", "from"]).distinct()
    base = base.join(shuffled(ends.select("to").distinct()), "to", "left_semi").select("src", "to", "file_path", *extra)
    dirs = F.transform(F.filter(ancestors(F.col("t_file")), lambda d: d != ""), _below)

    # least and greatest ids of each file first: directories are made of files, not of each symbol's path
    in_files = ends.groupBy("to", "t_file").agg(F.min("dst").alias("rg_lo"), F.max("dst").alias("rg_hi"))
    in_dirs = in_files.select("to", F.explode(dirs).alias("scope"), "rg_lo", "rg_hi").groupBy("to", "scope").agg(F.min("rg_lo").alias("rg_lo"), F.max("rg_hi").alias("rg_hi"))
    in_files = in_files.select("to", _in_file(F.col("t_file")).alias("scope"), "rg_lo", "rg_hi")

    other = F.coalesce((F.col("rg_lo") != F.col("src")) | (F.col("rg_hi") != F.col("src")), F.lit(False))
    dir, scope = parent_dir(F.col("file_path")), F.col("scope")
    near = base.withColumn("scope", _in_file(F.col("file_path"))).join(shuffled(in_files), ["to", "scope"], "left")
    near = near.withColumn("scope", F.when(other, scope).when(dir != "", _below(dir)).otherwise("")).drop("rg_lo", "rg_hi")
    near = near.join(shuffled(in_dirs), ["to", "scope"], "left")
    near = near.withColumn("scope", F.when(scope.startswith("=") | other, scope).otherwise("")).drop("rg_lo", "rg_hi")
    everywhere = F.explode(F.concat(F.array(F.lit(""), _in_file(F.col("t_file"))), dirs))
    met = near.join(shuffled(found.select("to", "dst", "t_kind", everywhere.alias("scope"))), ["to", "scope"])
    return met.filter("src != dst").select("src", "to", *extra, "dst", "t_kind")


def resolve_references(raw: DataFrame, symbols: DataFrame, name: str | None = None, targets: DataFrame | None = None, alive: DataFrame | None = None) -> DataFrame:
    """src, dst, each once; with a name, only the edges to symbols of that name, for which no other name is resolved."""
    raw = raw.select("file_path", "from", "to")
    if name is not None:
        raw, targets = raw.filter(ci_equals(F.col("to"), name)), symbols.filter(ci_equals(F.col("name"), name))
    return cascade(raw, symbols, targets, alive).select("src", "dst")


def resolve_supertypes(raw: DataFrame, symbols: DataFrame, name: str | None = None, targets: DataFrame | None = None) -> DataFrame:
    """src, dst, kind, each once; an unknown hint implements interfaces and traits and inherits the rest.

    With a name, only the edges from or to symbols of that name. The hints of one (file_path, from, to) go
    through the cascade as one row, so that what they make of a target is told apart without a shuffle of edges.
    """
    if name is not None:
        raw = raw.filter(ci_equals(F.col("from"), name) | ci_equals(F.col("to"), name))
    hints = F.sort_array(F.collect_set(F.coalesce("hint", F.lit("unknown")))).alias("hints")
    met = cascade(raw.groupBy("file_path", "from", "to").agg(hints), symbols, targets)
    unknown = F.when(F.col("t_kind").isin(*INTERFACES), F.lit("implements")).otherwise(F.lit("inherits"))
    kinds = F.array_distinct(F.transform("hints", lambda h: F.when(h != "unknown", h).otherwise(unknown)))
    return met.select("src", "dst", F.explode(kinds).alias("kind"))


def resolve_imports(imports: DataFrame, packages: DataFrame) -> DataFrame:
    """file_path, package_id of imports (file_path, language, package).

    A JavaScript or TypeScript import is an npm package of that name; a C# namespace is the nuget package
    whose name is its longest dotted prefix; other languages' imports name no package. Each name is resolved
    once, however many files import it, so that packages meet names and not files.
    """
    ecosystem = F.when(F.col("language").isin("javascript", "typescript"), "npm").when(F.col("language") == "csharp", "nuget")
    asked = imports.select("file_path", ecosystem.alias("ecosystem"), "package").filter("ecosystem IS NOT NULL")
    begins = F.when(F.col("ecosystem") == "npm", F.array("package")).otherwise(_prefixes("package"))
    named = asked.select("ecosystem", "package").distinct().select("ecosystem", "package", F.explode(begins).alias("name"))
    offered = packages.groupBy("ecosystem", "name").agg(F.collect_set("id").alias("ids"))
    found = named.join(shuffled(offered), ["ecosystem", "name"]).groupBy("ecosystem", "package").agg(F.max_by("ids", F.length("name")).alias("ids"))
    return asked.join(shuffled(found), ["ecosystem", "package"]).select("file_path", F.explode("ids").alias("package_id")).distinct()


def _prefixes(name: str) -> Column:
    """What begins a dotted name at a dot, and the name itself."""
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))


def longest_prefix(names: DataFrame, packages: DataFrame, key: str) -> DataFrame:
    """key, package: the longest package name that equals a dotted name (column name) or begins it at a dot."""
    met = names.select(key, F.explode(_prefixes("name")).alias("package")).join(shuffled(packages.select(F.col("name").alias("package")).distinct()), "package")
    return met.groupBy(key).agg(F.max_by("package", F.length("package")).alias("package"))


def nearest_owner(files: DataFrame, manifests: DataFrame) -> DataFrame:
    """path, manifest: the manifest of the deepest directory at or above each file; the greatest path of several."""
    m = manifests.select("manifest", parent_dir(F.col("manifest")).alias("dir"))
    met = files.select("path", F.explode(ancestors(F.col("path"))).alias("dir")).join(m, "dir").filter("path != manifest")
    depth = F.when(F.col("dir") == "", 0).otherwise(F.size(F.split("dir", "/")))
    return met.groupBy("path").agg(F.max_by("manifest", F.struct(depth, F.col("manifest"))).alias("manifest"))


def central_value(wanted: DataFrame, pins: DataFrame, inline: Column) -> DataFrame:
    """path, name, value: the inline value, else that pinned nearest above (pins: props, name, value), else ''."""
    p = pins.select("props", "name", F.col("value").alias("pinned"), parent_dir(F.col("props")).alias("dir"))
    above = wanted.select("path", "name", F.explode(ancestors(F.col("path"))).alias("dir")).join(p, ["dir", "name"])
    depth = F.when(F.col("dir") == "", 0).otherwise(F.size(F.split("dir", "/")))
    nearest = above.groupBy("path", "name").agg(F.max_by("pinned", F.struct(depth, F.col("props"))).alias("pinned"))
    return wanted.join(nearest, ["path", "name"], "left").select("path", "name", F.coalesce(inline, F.col("pinned"), F.lit("")).alias("value"))
