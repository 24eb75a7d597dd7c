"""Indexing: files to facts to a resolved graph, whole or for what changed."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators import facts as X
from ..operators import graph as G
from ..operators import resolve as J
from ..sources import git, scan
from ..sources.manifests import manifests
from .store import Store

_MANIFESTS = r"(\.csproj|package\.json|(^|/)Directory\.(Packages|Build)\.props)$"


def resolved(files: DataFrame, facts: DataFrame, manifest_texts: DataFrame) -> dict[str, DataFrame]:
    """Every other table of the store from files (path, language, ...), their facts and manifests (path, text).

    Edges whose ends don't exist are left out, but a project that is referred to exists as a stub.
    """
    symbols = X.symbols(facts, files)
    named, packages, references, uses = manifests(manifest_texts)
    stubs = references.join(named.select(F.col("id").alias("dst")), "dst", "left_anti").select(F.col("dst").alias("id")).distinct()
    empty = {c: F.lit("") for c in ("name", "path", "language", "kind")}
    projects = named.unionByName(stubs.withColumns(empty))
    owners = J.nearest_owner(files.select("path"), named.select(F.col("path").alias("manifest")))
    imports = X.raw_imports(facts).join(files.select(F.col("path").alias("file_path"), "language"), "file_path")
    refs, supers = X.raw_references(facts), X.raw_supertypes(facts)
    edges = J.cascade(refs, symbols, J.named_in(symbols, refs)).select("src", "dst", F.col("to").alias("name"))
    return {
        "symbols": symbols,
        "projects": projects,
        "packages": packages,
        "contains_file": owners.select(P.project_id(F.col("manifest")).alias("project_id"), "path"),
        "references_project": references,
        "uses_package": uses,
        "imports_package": J.resolve_imports(imports, packages),
        # by name, so that a query for one symbol's referrers reads few row groups
        "references": edges.repartitionByRange("name").sortWithinPartitions("name"),
        "supertypes": J.resolve_supertypes(supers, symbols, targets=J.named_in(symbols, supers)),
    }


def index(spark: SparkSession, root: str, store: Store, force: bool = False, only_changed: bool = False, include=scan.INCLUDE, exclude=scan.EXCLUDE, enabled: tuple[str, ...] = tuple(P.LANGUAGES)) -> dict[str, int]:
    """Brings the store up to the files below root; counts of what was done.

    Only files whose hash changed are read for facts (all with force; with only_changed none but those that
    git calls changed, and files that are gone stay). Facts are kept, so names resolve as a whole run would
    resolve them, whatever changed. The new version replaces the old one when all its tables are written.
    """
    now = datetime.now(timezone.utc).isoformat(timespec="seconds")
    version = store.begin()
    paths = scan.candidate_files(spark, root, include, exclude)
    if only_changed:
        paths = paths.join(spark.createDataFrame([(p,) for p in git.changed_files(root)], "path string"), "path", "left_semi")
    tracked = spark.createDataFrame([(p, True) for p in sorted(git.tracked_files(root))], "path string, tracked boolean")
    found = scan.read_files(paths, root).select("path", P.language(F.col("path")).alias("language"), F.sha2("content", 256).alias("hash"), F.length("content").cast("long").alias("size_bytes"))
    seen = found.join(tracked, "path", "left").select(P.file_id(F.col("path")).alias("id"), "path", "language", "hash", "size_bytes", F.coalesce("tracked", F.lit(False)).alias("tracked"), F.lit(now).alias("last_indexed_at"))
    seen = store.write(version, "seen", seen)
    old = store.read("files").limit(0) if force else store.read("files")
    change = G.classify(seen, old)
    gone = change.filter("change = 'deleted'").select("path")
    batch = change.filter("change IN ('new', 'changed')").select("path")
    kept = old.join(batch, "path", "left_anti")
    kept = kept if only_changed else kept.join(gone, "path", "left_anti")
    files = store.write(version, "files", kept.unionByName(seen.join(batch, "path", "left_semi").select(*kept.columns)))
    todo = files.filter(F.col("last_indexed_at") == now).select("path")
    texts = scan.described(scan.read_files(todo, root)).filter(P.language_enabled(F.col("language"), enabled))
    before = store.read("facts").limit(0) if force else store.read("facts")
    facts = store.write(version, "facts", before.join(files.select("path"), "path", "left_semi").join(todo, "path", "left_anti").unionByName(X.extract(texts)))
    holders = files.filter(F.col("path").rlike(_MANIFESTS)).select("path")
    texts_of = scan.described(scan.read_files(holders, root)).select("path", "text")
    counts = {"files": files.count(), "indexed": todo.count()}
    for name, df in resolved(files, facts, texts_of).items():
        counts[name] = store.write(version, name, df).count()
    store.commit(version)
    return counts


def remove_files(store: Store, gone: DataFrame) -> None:
    """A version without the files of gone (path): their symbols and facts go, and every edge at them, in both directions."""
    version = store.begin()
    for name in ("projects", "packages", "references_project", "uses_package"):
        store.write(version, name, store.read(name))
    gone = gone.select("path").distinct()
    for name, column in (("files", "path"), ("facts", "path"), ("contains_file", "path"), ("imports_package", "file_path"), ("symbols", "file_path")):
        left = store.write(version, name, store.read(name).join(gone.withColumnRenamed("path", column), column, "left_anti"))
    for name in ("references", "supertypes"):
        edges = store.read(name)
        for end in ("src", "dst"):
            edges = edges.join(left.select(F.col("id").alias(end)), end, "left_semi")
        store.write(version, name, edges)
    store.commit(version)


def merge_edges(edges: DataFrame, batch: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """edges with a batch (same columns) merged in: each once, none without both its ends (sources, targets: id)."""
    ends = batch.join(sources.select(F.col("id").alias(batch.columns[0])), batch.columns[0], "left_semi").join(targets.select(F.col("id").alias(batch.columns[1])), batch.columns[1], "left_semi")
    return edges.unionByName(ends.select(*edges.columns)).distinct()


def freshness(spark: SparkSession, root: str, store: Store, include=scan.INCLUDE, exclude=scan.EXCLUDE) -> DataFrame:
    """path, stale, untracked of every file to index: stale if its bytes are not those indexed, untracked if git doesn't know it."""
    now = scan.read_files(scan.candidate_files(spark, root, include, exclude), root).select("path", F.sha2("content", 256).alias("now"))
    tracked = spark.createDataFrame([(p, True) for p in sorted(git.tracked_files(root))], "path string, tracked boolean")
    met = now.join(store.read("files").select("path", "hash"), "path", "left").join(tracked, "path", "left")
    return met.select("path", (~F.col("now").eqNullSafe(F.col("hash"))).alias("stale"), F.col("tracked").isNull().alias("untracked"))


def stats(store: Store) -> dict[str, int | str]:
    """Counts of the graph's parts, and the greatest time of indexing ('' if nothing is indexed)."""
    t = store.read
    row = G.stats(t("files"), t("symbols"), t("projects"), t("packages"), t("references_project"), t("uses_package"), t("references")).first().asDict()
    return row | {"last_index": t("files").agg(F.max("last_indexed_at")).first()[0] or ""}
