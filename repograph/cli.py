"""Commands: init, index, status, symbols, related, packages, pack, push, pull, clean. Data goes to stdout, all else to stderr."""

from __future__ import annotations

import argparse
import json
import shutil
import sys
import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import paths as P
from .operators import facts as X
from .operators import graph as G
from .operators import ranking as R
from .plans import index as I
from .plans import render, selection
from .plans.store import Store
from .sources import git, scan, share

CONFIG = f"""[repo]
name = {{name}}

[index]
include = {json.dumps(scan.INCLUDE, indent=2)}
exclude = {json.dumps(scan.EXCLUDE, indent=2)}

[pack]
budget = {R.BUDGET}
format = "markdown"

[share]
enabled = false
target = ""
"""
FOLDERS = ("graph", "cache", "packs")


class CommandError(Exception):
    """What is told to the user instead of a trace."""


class Repo:
    def __init__(self, start: str, spark: SparkSession | None = None) -> None:
        self.root = scan.discover(start)
        self.home = Path(self.root, scan.HOME)
        self._spark = spark

    @property
    def spark(self) -> SparkSession:
        if self._spark is None:
            self._spark = SparkSession.builder.appName("repograph").getOrCreate()
        return self._spark

    def ready(self) -> Repo:
        if not (self.home / "config.toml").is_file():
            raise CommandError("no graph here; run `init` first")
        return self

    @property
    def config(self) -> dict:
        at = self.home / "config.toml"
        return tomllib.loads(at.read_text()) if at.is_file() else {}

    @property
    def globs(self) -> dict[str, list[str]]:
        own = self.config.get("index", {})
        return {"include": own.get("include", list(scan.INCLUDE)), "exclude": own.get("exclude", list(scan.EXCLUDE))}

    @property
    def enabled(self) -> tuple[str, ...]:
        own = self.config.get("index", {}).get("languages", {})
        return tuple(x for x in P.LANGUAGES if own.get(x, True))

    @property
    def store(self) -> Store:
        return Store(self.spark, f"file://{self.home}/graph")

    def origin(self) -> dict | None:
        at = self.home / "origin.json"
        return json.loads(at.read_text()) if at.is_file() else None


def _dicts(df: DataFrame) -> list[dict]:
    return [r.asDict() for r in df.toLocalIterator()]


def init(repo: Repo, args) -> str:
    at = repo.home / "config.toml"
    if at.exists() and not args.force:
        raise CommandError("there is a graph already; --force replaces its configuration")
    for d in FOLDERS:
        (repo.home / d).mkdir(parents=True, exist_ok=True)
    at.write_text(CONFIG.format(name=json.dumps(args.name or Path(repo.root).name)))
    ignore = Path(repo.root, ".gitignore")
    if ignore.is_file() and f"{scan.HOME}/" not in ignore.read_text().splitlines():
        text = ignore.read_text()
        ignore.write_text(text + "\n" * (bool(text) and not text.endswith("\n")) + f"{scan.HOME}/\n")
    return f"Initialised {scan.HOME}\n"


def index(repo: Repo, args) -> str:
    counts = I.index(repo.ready().spark, repo.root, repo.store, args.force, args.changed, **repo.globs, enabled=repo.enabled)
    if args.quiet:
        return ""
    if not args.stats:
        return f"Indexed {render.number(counts['indexed'])} of {render.number(counts['files'])} files\n"
    return "".join(f"{k}: {render.number(v)}\n" for k, v in counts.items())


def status_values(repo: Repo) -> tuple[dict, list[str]]:
    """The values of a status report, and the stale paths."""
    told = I.stats(repo.store)
    fresh = I.freshness(repo.spark, repo.root, repo.store, **repo.globs)
    stale = [r.path for r in fresh.filter("stale").select("path").orderBy("path").toLocalIterator()]
    here, origin = git.info(repo.root), repo.origin()
    commit = (origin or {}).get("commit")
    compared = git.same_commit(commit, here["full_commit"])
    values = {
        "repo": repo.config.get("repo", {}).get("name") or None, "index": "ready" if told["files"] else "empty", "graphBackend": "parquet", "graphPath": f"{scan.HOME}/graph",
        "filesIndexed": told["files"], "symbolsIndexed": told["symbols"], "projects": told["projects"], "packages": told["packages"], "referenceEdges": told["reference_edges"],
        "referenceLanguages": list(X.LANGUAGES_WITH_REFERENCES), "staleFiles": len(stale), "untrackedFiles": fresh.filter("untracked").count(), "branch": here["branch"], "commit": here["commit"],
        "lastIndex": told["last_index"], "origin": origin, "originStale": None if compared == "unknown" else compared == "mismatch",
    }
    return values, stale


def status(repo: Repo, args) -> str:
    values, stale = status_values(repo.ready())
    if args.stale:
        return "".join(f"{p}\n" for p in stale)
    if args.json:
        return render.pretty(values) + "\n"
    if values["originStale"]:
        print(f"warning: the graph that was pulled is of commit {values['origin'].get('commit')}, not of this one; run `index`", file=sys.stderr)
    return render.status(values)


def _named(values: tuple[str, ...], aliases: dict[str, str], word: str | None) -> str | None:
    """What a word names; None if it names nothing, which then filters nothing."""
    low = (word or "").lower()
    return low if low in values else aliases.get(low)


def symbols(repo: Repo, args) -> str:
    kind, language = _named(P.KINDS, P.KIND_ALIASES, args.kind), _named((*P.LANGUAGES, "other"), P.ALIASES, args.language)
    found = _dicts(G.symbols_matching(repo.ready().store.read("symbols"), args.query, kind, language, args.file))
    if args.json:
        return render.pretty([s | {"kind": "typealias" if s["kind"] == "type" else s["kind"]} for s in found]) + "\n"
    return render.table(["Symbol", "Kind", "Language", "File"], [(s["name"], s["kind"], s["language"], s["file_path"]) for s in found])


def related(repo: Repo, args) -> str:
    t = repo.ready().store.read
    if args.symbol:
        items = selection.related_symbol(t("files"), t("symbols"), t("contains_file"), t("projects"), t("supertypes"), t("references"), args.symbol, args.depth)
    elif args.file:
        items = selection.related_file(t("files"), t("contains_file"), t("projects"), args.file, args.depth)
    else:
        raise CommandError("provide --symbol <name> or --file <path>")
    found = _dicts(items)
    return render.pretty(found) + "\n" if args.json else render.related(args.symbol or args.file, found)


def packages(repo: Repo, args) -> str:
    t = repo.ready().store.read
    if args.importers:
        files = [r.path for r in G.files_importing(t("imports_package"), t("packages"), args.importers).orderBy("path").toLocalIterator()]
        if args.json:
            return render.pretty(files) + "\n"
        return f"Files importing `{args.importers}`:\n" + "".join(f"  {f}\n" for f in files) if files else f"No indexed files import `{args.importers}`.\n"
    if args.projects:
        rows = _dicts(G.projects_matching(t("projects"), args.query or ""))
        return render.pretty(rows) + "\n" if args.json else render.table(["Project", "Language", "Kind", "Path"], [(r["name"], r["language"], r["kind"], r["path"]) for r in rows])
    found = G.packages_matching(t("packages"), args.query or "", args.ecosystem)
    if args.json:
        return render.pretty(_dicts(found.drop("shown"))) + "\n"
    return render.table(["Package", "Version", "Ecosystem", "Kind"], [(r["name"], r["shown"], r["ecosystem"], r["dependency_kind"]) for r in _dicts(found)])


def pack(repo: Repo, args) -> str:
    t = repo.ready().store.read
    files, flags = t("files").select("path", "language"), {"include_tests": args.include_tests, "include_config": args.include_config}
    if args.changed:
        mode, query = "changed", "(changed files)"
        chosen = selection.pack_changed(files, repo.spark.createDataFrame([(p,) for p in git.changed_files(repo.root)], "path string"), **flags)
    elif args.path is not None:
        mode, query = "path", args.path
        chosen = selection.pack_path(files, args.path.replace("\\", "/"), **flags)
    elif args.symbol:
        mode, query = "symbol", args.symbol
        chosen = selection.pack_symbol(files, t("symbols"), t("references"), args.symbol, **flags)
    elif args.query:
        mode, query = "query", args.query
        chosen = selection.pack_query(files, t("symbols"), args.query, **flags)
    else:
        raise CommandError("provide one of --changed, --path, --symbol or --query")
    own = repo.config.get("pack", {})
    form = args.format or own.get("format", "markdown")
    if form not in ("markdown", "md", "json"):
        raise CommandError(f"unknown format: {form}")
    budget = args.budget or own.get("budget", R.BUDGET)
    texts = scan.described(scan.read_files(chosen.select("path"), repo.root)).select("path", "language", "text")
    sized = chosen.join(texts.select("path", "language", P.estimate_tokens(F.col("text")).alias("tokens")), "path", "left").withColumns({"tokens": F.coalesce("tokens", F.lit(0).cast("long")), "language": F.coalesce("language", P.language(F.col("path")))})
    fitted = R.budget_fit(sized.select("path", "tier", "tokens"), budget).join(sized.select("path", "reason", "language"), "path")
    rows = _dicts(fitted.orderBy("tier", "path"))
    inside = repo.spark.createDataFrame([(r["path"],) for r in rows if r["included"]], "path string")
    contents = {} if args.dry_run else {r.path: r.text for r in texts.join(inside, "path", "left_semi").toLocalIterator()}
    declared = _dicts(t("symbols").join(inside.withColumnRenamed("path", "file_path"), "file_path", "left_semi"))
    here = git.info(repo.root) | {"name": repo.config.get("repo", {}).get("name")}
    write = render.pack_json if form == "json" else render.pack_markdown
    text = write({"mode": mode, "query": query, "budget": budget}, here, rows, declared, contents, git.diff(repo.root) if args.include_diff else None, args.dry_run)
    if args.explain:
        print(render.table(["File", "Tier", "Reason", "Tokens", "Included"], [(r["path"], r["tier"], r["reason"], r["tokens"], "yes" if r["included"] else "no") for r in rows]), end="", file=sys.stderr)
    if args.output:
        Path(args.output).write_text(text)
        return ""
    return text if text.endswith("\n") else text + "\n"


def push(repo: Repo, args) -> str:
    """Copies the graph to the target folder under its tags; refuses in the order of the checks below."""
    own = repo.ready().config.get("share", {})
    target = args.target or own.get("target")
    here = git.info(repo.root)
    for bad, why in (
        (not own.get("enabled"), "sharing is off in the configuration"), (not target, "no target is configured"), (repo.store.version() is None, "there is no graph; run `index`"),
        (git.changed_files(repo.root) and not args.force, "the work tree has changes"), (not here["full_commit"], "there is no commit"), (not args.yes, "give --yes to confirm"),
    ):
        if bad:
            raise CommandError(why)
    told = I.stats(repo.store)
    out = []
    for tag in share.push_tags(args.tag, here["commit"]):
        got = share.copy(str(repo.home / "graph"), f"{target}/{tag}")
        meta = share.annotations({"commit": here["full_commit"], "branch": here["branch"], "files": str(told["files"]), "symbols": str(told["symbols"]), "created": told["last_index"], "digest": got})
        Path(target, f"{tag}.json").write_text(render.pretty(meta))
        out.append(f"Pushed {tag}\n")
    return "".join(out)


def pull(repo: Repo, args) -> str:
    target = args.target or repo.ready().config.get("share", {}).get("target")
    if not target:
        raise CommandError("no target is configured")
    tag = share.pull_tag(args.tag)
    meta = share.metadata(json.loads(Path(target, f"{tag}.json").read_text()))
    share.copy(f"{target}/{tag}", str(repo.home / "graph"), meta.get("digest"))
    (repo.home / "origin.json").write_text(render.pretty({"registry": "file", "repository": target, "tag": tag, "commit": meta.get("commit")}))
    return f"Pulled {tag}\n"


def clean(repo: Repo, args) -> str:
    wanted = {"graph": args.index, "cache": args.cache, "packs": args.packs}
    chosen = [d for d in FOLDERS if args.all or wanted[d]]
    if not chosen:
        raise CommandError("provide --cache, --index, --packs or --all")
    for d in chosen:
        shutil.rmtree(repo.ready().home / d, ignore_errors=True)
        (repo.home / d).mkdir(parents=True)
    return "".join(f"Cleaned {d}\n" for d in chosen)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="repograph")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, /, *flags: str, **values: dict) -> None:
        c = sub.add_parser(name)
        c.set_defaults(run=globals()[name])
        for f in flags:
            c.add_argument(f"--{f}", action="store_true")
        for v, options in values.items():
            c.add_argument(v if options.get("nargs") else f"--{v}", **options)

    query = {"nargs": "?", "default": None}
    command("init", "force", name={})
    command("index", "force", "changed", "stats", "quiet")
    command("status", "json", "stale")
    command("symbols", "json", query=query, kind={}, file={}, language={})
    command("related", "json", symbol={}, file={}, depth={"type": int, "default": 1})
    command("packages", "json", "projects", query=query, ecosystem={}, importers={})
    command("pack", "changed", "include-tests", "include-config", "include-diff", "dry-run", "explain", path={}, symbol={}, query={}, budget={"type": int}, depth={"type": int, "default": 1}, output={}, format={})
    command("push", "force", "yes", tag={}, target={})
    command("pull", tag={}, target={})
    command("clean", "cache", "index", "packs", "all")
    return p


def main(argv: list[str] | None = None, start: str = ".", spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        sys.stdout.write(args.run(Repo(start, spark), args))
        return 0
    except CommandError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
