"""Project manifests: MSBuild files and package.json."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators.resolve import central_value

_TAG = re.compile(r"<!--.*?-->|<!\[CDATA\[(.*?)\]\]>|<\?.*?\?>|<(/?)([\w.:-]+)((?:\s+[\w.:-]+\s*=\s*(?:\"[^\"]*\"|'[^']*'))*)\s*(/?)>", re.S)
_ATTRIBUTE = re.compile(r"([\w.:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", re.S)
MSBUILD_SCHEMA = "path string, item string, name string, version string, position int"
NODE_SCHEMA = "path string, item string, name string, version string, kind string"
#: Kinds of dependencies by their key.
_NODE_KINDS = {"dependencies": "dependency", "devDependencies": "devDependency", "peerDependencies": "peerDependency"}


def parse_msbuild(text: str) -> list[tuple[str, str, str | None]]:
    """(item, name, version): project, package (PackageReference), pin (PackageVersion), central (true or false).

    A child <Version> wins over the attribute. End tags need not match; an item that is still open where
    another one opens is lost, one that is open at the end counts.
    """
    out: list[tuple[str, str, str | None]] = []
    pending: list | None = None
    inside, last = "", 0

    def said(raw: str) -> None:
        value = unescape(raw).strip()
        if value and inside == "Version" and pending is not None:
            pending[2] = value
        elif value and inside == "ManagedPackageVersionsCentrally":
            out.append(("central", "true" if value.lower() == "true" else "false", None))

    for m in _TAG.finditer(text):
        said(text[last : m.start()])
        last = m.end()
        name = m[3]
        if not name:
            continue
        if m[2]:
            if name in ("PackageReference", "PackageVersion") and pending is not None:
                out.append(tuple(pending))
                pending = None
            if name in ("Version", "ManagedPackageVersionsCentrally", "PackageReference", "PackageVersion"):
                inside = ""
            continue
        found = {k: unescape(a or b) for k, a, b in _ATTRIBUTE.findall(m[4] or "")}
        if name == "ProjectReference" and "Include" in found:
            out.append(("project", found["Include"], None))
        elif name in ("PackageReference", "PackageVersion") and "Include" in found:
            item = ["package" if name == "PackageReference" else "pin", found["Include"], found.get("Version")]
            if m[5]:
                out.append(tuple(item))
            else:
                pending = item
        elif not m[5] and (name == "ManagedPackageVersionsCentrally" or (name == "Version" and pending is not None)):
            inside = name
    if pending is not None:
        out.append(tuple(pending))
    return out


def msbuild_items(files: DataFrame) -> DataFrame:
    """MSBUILD_SCHEMA of files (path, text); position is the item's place in its file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, *x, i) for p, t in zip(*(c.to_pylist() for c in batch.columns)) for i, x in enumerate(parse_msbuild(t or ""))]
            types = [pa.string()] * 4 + [pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["path", "item", "name", "version", "position"])

    return files.select("path", "text").mapInArrow(run, MSBUILD_SCHEMA)


def node_items(files: DataFrame) -> DataFrame:
    """NODE_SCHEMA of package.json files (path, text); only entries whose value is a string.

    A file that is no JSON fails the query, as a broken manifest fails an index run.
    """
    whole = files.select("path", F.expr("coalesce(try_parse_json(text), IF(text IS NULL, NULL, raise_error(concat(path, ' is no JSON'))))").alias("v"))
    text = lambda v: F.expr(f"CASE WHEN schema_of_variant({v}) = 'STRING' THEN CAST({v} AS STRING) END")
    at = lambda key: f"try_variant_get(v, '$.{key}', 'variant')"
    out = whole.select("path", F.lit("name").alias("item"), text(at("name")).alias("name"), F.lit(None).cast("string").alias("version"), F.lit("").alias("kind")).filter("name IS NOT NULL")
    for key, kind in (*_NODE_KINDS.items(), ("scripts", "script")):
        entries = whole.select("path", F.explode(F.expr(f"CASE WHEN schema_of_variant({at(key)}) LIKE 'OBJECT%' THEN CAST({at(key)} AS map<string, variant>) END")).alias("k", "e"))
        found = entries.select("path", F.lit("script" if kind == "script" else "package").alias("item"), F.col("k").alias("name"), text("e").alias("version"), F.lit(kind).alias("kind"))
        out = out.unionByName(found.filter("version IS NOT NULL"))
    return out


def _is(end: str):
    return F.col("path").endswith(end)


def manifests(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(projects, packages, project references, used packages) of files (path, text).

    projects: id, name, path, language, kind; packages: id, name, version, ecosystem, dependency_kind, of
    several versions the last by manifest path and place; edges: src, dst. Versions that a project leaves
    to central management come from the nearest Directory.Packages.props above it.
    """
    text = files.select("path", "text")
    dotnet = msbuild_items(text.filter(_is(".csproj")))
    base = P.basename(F.col("path"))
    props = msbuild_items(text.filter(F.lower(base).isin("directory.packages.props", "directory.build.props")))
    pins = props.filter("item = 'pin' AND version IS NOT NULL").groupBy(F.col("path").alias("props"), "name").agg(F.max_by("version", "position").alias("value"))
    flags = props.filter("item = 'central'").groupBy(F.col("path").alias("props")).agg(F.max_by("name", "position").alias("value")).select("props", F.lit("central").alias("name"), "value")
    csproj = text.filter(_is(".csproj")).select("path")
    # centrally managed if the nearest props file with a flag says so, or if the project has pins itself
    told = central_value(csproj.withColumn("name", F.lit("central")), flags, F.lit(None).cast("string")).filter("value = 'true'").select("path")
    central = told.unionByName(dotnet.filter("item = 'pin'").select("path")).distinct().withColumn("cpm", F.lit(True))
    stem = F.regexp_replace(base, r"\.[^.]*$", "")
    net = csproj.join(central, "path", "left").select(P.project_id(F.col("path")).alias("id"), stem.alias("name"), "path", F.lit("csharp").alias("language"), F.when(F.col("cpm"), "dotnet (cpm)").otherwise("dotnet").alias("kind"))
    wanted = dotnet.filter("item = 'package'").groupBy("path", "name").agg(F.max_by("version", "position").alias("inline"), F.max("position").alias("position"))
    versions = central_value(wanted.select("path", "name", "inline"), pins, F.col("inline")).join(wanted.select("path", "name", "position"), ["path", "name"])
    net_packages = versions.select("path", "name", F.col("value").alias("version"), F.lit("nuget").alias("ecosystem"), F.lit("package").alias("dependency_kind"), F.col("position").cast("string").alias("place"))
    target = P.normal_path(F.concat_ws("/", P.parent_dir(F.col("path")), F.col("name")))
    references = dotnet.filter("item = 'project'").select(P.project_id(F.col("path")).alias("src"), P.project_id(target).alias("dst")).distinct()

    packs = text.filter(_is("package.json"))
    node = node_items(packs)
    names = node.filter("item = 'name'").select("path", "name")
    folder = P.basename(P.parent_dir(F.col("path")))
    shown = F.coalesce("name", F.when(folder != "", folder), F.lit("package"))
    js = packs.select("path").join(names, "path", "left").select(P.project_id(F.col("path")).alias("id"), shown.alias("name"), "path", F.lit("javascript").alias("language"), F.lit("node").alias("kind"))
    js_packages = node.filter("item = 'package'").select("path", "name", "version", F.lit("npm").alias("ecosystem"), F.col("kind").alias("dependency_kind"), F.concat_ws("\u0001", "kind", "name").alias("place"))

    uses = net_packages.unionByName(js_packages).withColumn("id", P.package_id(F.col("ecosystem"), F.col("name")))
    last = F.max_by(F.struct("name", "version", "ecosystem", "dependency_kind"), F.struct("path", "place")).alias("p")
    packages = uses.groupBy("id").agg(last).select("id", "p.*")
    return net.unionByName(js), packages, references, uses.select(P.project_id(F.col("path")).alias("src"), F.col("id").alias("dst")).distinct()
