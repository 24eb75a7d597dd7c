"""A repository on disk through the command line: index, change, ask, pack."""

import json
import subprocess

import pytest

from repograph import cli
from repograph.operators import graph as G
from repograph.operators import ranking as R
from repograph.plans import index as I
from repograph.plans import render
from repograph.plans.store import Store
from repograph.sources import git, scan, share
from repograph.sources.manifests import manifests, parse_msbuild
from repograph.streaming.follow import follow

FILES = {
    "src/widget.rs": "pub struct Widget {}\npub fn make() -> Widget { Widget {} }\n",
    "src/use.rs": "fn run() { make(); helper(); }\n",
    "src2/widget.rs": "fn helper() { Gone::new(); }\n",
    "app/Impl.cs": "using Acme.Text.Deep;\nclass Impl : Base, IFoo { void Go(Widget w) { } }\n",
    "app/Base.cs": "public class Base { }\ninterface IFoo { }\n",
    "app/App.csproj": '<Project><ItemGroup><ProjectReference Include="..\\lib\\Lib.csproj"/><PackageReference Include="Acme.Text" Version="1.0"/></ItemGroup></Project>',
    "web/package.json": '{"name": "site", "dependencies": {"lodash": "1"}}',
    "web/a.ts": "import x from 'lodash/fp';\nexport function a() {}\n",
    "web/tests/a.test.ts": "function t() {}\n",
    "docs/guide.md": "# Widget guide\n\n```\n| x\n```\n",
    "bin/skipped.rs": "fn skipped() {}\n",
    "secret.py": "def no(): pass\n",
}


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    for p, text in FILES.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(text)
    (root / ".gitignore").write_text("secret.py\n")
    run = lambda *a: subprocess.run(["git", "-C", str(root), *a], check=True, capture_output=True)
    run("init", "-q")
    run("add", "-A")
    run("-c", "user.name=x", "-c", "user.email=x@x", "commit", "-qm", "x")
    return root


def test_a_repository_from_init_to_pack(spark, repo, capsys):
    def ask(*args):
        code = cli.main(list(args), str(repo / "src"), spark)
        out = capsys.readouterr()
        return code, out.out, out.err

    assert ask("symbols")[0] == 1
    assert ask("init", "--name", "shop")[0] == 0 and ask("init")[0] == 1
    assert (repo / ".gitignore").read_text() == "secret.py\n.repograph/\n"
    assert "references: " in ask("index", "--stats")[1]
    assert ask("symbols", "widget", "--kind", "struct")[1] == "Symbol  Kind    Language  File\nWidget  struct  rust      src/widget.rs\n"
    names = {s["name"] for s in json.loads(ask("symbols", "--json", "--kind", "no such kind")[1])}
    assert {"Widget", "make", "Impl", "a", "Widget guide"} <= names and not names & {"skipped", "no"}
    related = json.loads(ask("related", "--symbol", "WIDGET", "--json")[1])
    assert {(r["path"], r["depth"], r["reason"]) for r in related} >= {("src/widget.rs", 0, "declares `WIDGET`"), ("app/Impl.cs", 1, "references WIDGET")}
    assert "Direct:" in ask("related", "--symbol", "Base")[1] and "implementor" in ask("related", "--symbol", "IFoo")[1]
    assert ask("related", "--file", "app/Base.cs", "--json")[1].count("same project (App)") >= 1
    assert ask("packages", "--importers", "lodash")[1] == "Files importing `lodash`:\n  web/a.ts\n" and "app/Impl.cs" in ask("packages", "--importers", "Acme.Text")[1]
    assert "Acme.Text" in ask("packages", "acme", "--ecosystem", "NUGET")[1] and "(no results)" in ask("packages", "nothing")[1]
    assert "site" in ask("packages", "--projects")[1]
    code, text, err = ask("pack", "--symbol", "Widget", "--explain")
    assert "## Files" in text and "### src/widget.rs" in text and "pub struct Widget {}" in text and "Included" in err and text.endswith("\n")
    doc = json.loads(ask("pack", "--path", "src", "--format", "json", "--dry-run")[1])
    assert doc["files"] == [] and [s["path"] for s in doc["selection"]] == ["src/use.rs", "src/widget.rs"] and doc["repository"]["name"] == "shop"
    assert ask("pack", "--query", "x", "--format", "odd")[0] == 1
    status = json.loads(ask("status", "--json")[1])
    assert status["index"] == "ready" and status["staleFiles"] == 0 and status["projects"] == 3 and len(status) == 17

    # a changed file moves its own facts only; names of others resolve again
    store = Store(spark, f"file://{repo}/.repograph/graph")
    before = store.read("references").count()
    (repo / "src/widget.rs").write_text("\npub struct Widget {}\npub fn make() -> Widget { Widget {} }\npub fn helper() {}\n")
    assert ask("status", "--stale")[1] == "src/widget.rs\n" and "src/widget.rs" in ask("pack", "--changed", "--dry-run")[1]
    assert "Indexed 1 of " in ask("index")[1]
    kept = {(r.src, r.dst) for r in store.read("references").collect()}
    assert ("sym:src/use.rs#function#run#1", "sym:src/widget.rs#function#helper#4") in kept and ("sym:src/use.rs#function#run#1", "sym:src/widget.rs#function#make#3") in kept and before
    I.index(spark, str(repo), store, force=True)
    assert {(r.src, r.dst) for r in store.read("references").collect()} == kept
    I.remove_files(store, spark.createDataFrame([("src/widget.rs",)], "path string"))
    assert not [r for r in store.read("references").collect() if "src/widget.rs" in r.src + r.dst] and store.read("files").filter("path = 'src/widget.rs'").count() == 0
    assert ask("push", "--yes")[0] == 1 and ask("clean")[0] == 1 and ask("clean", "--index")[1] == "Cleaned graph\n"
    assert json.loads(ask("status", "--json")[1])["index"] == "empty"


def test_merging_edges_twice_is_merging_them_once(spark):
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    batch = spark.createDataFrame([("a", "b"), ("a", "gone")], "src string, dst string")
    once = I.merge_edges(batch.limit(0), batch, nodes, nodes)
    assert [tuple(r) for r in I.merge_edges(once, batch, nodes, nodes).collect()] == [("a", "b")]


def test_a_graph_is_copied_whole_or_not_at_all(tmp_path):
    (tmp_path / "g").mkdir()
    (tmp_path / "g/x").write_text("1")
    got = share.copy(str(tmp_path / "g"), str(tmp_path / "to"))
    with pytest.raises(ValueError):
        share.copy(str(tmp_path / "g"), str(tmp_path / "to"), "wrong")
    assert (tmp_path / "to/x").read_text() == "1" and share.digest(str(tmp_path / "to")) == got
    meta = {"commit": "abc", "files": "3"}
    assert share.metadata(share.annotations(meta)) == meta and share.metadata({"org.opencontainers.image.revision": "r"}) == {"commit": "r"}
    assert share.push_tags(None, "ab1") == ["ab1", "latest"] and share.push_tags("latest", "x") == ["latest"] and share.pull_tag(None) == "latest"
    assert [git.same_commit(*x) for x in (("ABC", "abcd"), ("abd", "abcd"), (None, "a"), ("", "a"))] == ["match", "mismatch", "unknown", "unknown"]


def test_project_files_that_are_not_well_formed(spark):
    text = '<Project>\n<PackageReference Include="Lost" Version="1">\n<PackageReference Include="Kept" Version="1"><Version>2</Version>\n</ItemGroup><PackageVersion Include="P&amp;Q" Version="3"/>'
    assert parse_msbuild(text) == [("pin", "P&Q", "3"), ("package", "Kept", "2")]
    files = spark.createDataFrame([("a/x-package.json", "[]"), ("package.json", '{"name": null, "dependencies": null}'), ("deep/package.json", '{"dependencies": {"z": "1"}}'), ("package-lock.json.md", "no json")], "path string, text string")
    projects, packages, references, uses = manifests(files)
    assert {(r.path, r.name) for r in projects.collect()} == {("a/x-package.json", "a"), ("package.json", "package"), ("deep/package.json", "deep")}
    assert packages.count() == 1 and references.count() == 0 and uses.count() == 1


def test_globs():
    import re

    match = lambda g, p: bool(re.match(scan.glob_regex(g), p))
    assert match("**/*.cs", "a.cs") and match("**/*.cs", "a/b/c.cs") and not match("**/*.cs", "a.css") and match("src/*.rs", "src/a/b.rs")
    assert match("**/bin/**", "bin/x") and match("**/bin/**", "a/bin/x/y") and not match("**/bin/**", "cabin/x") and match("a.{ts,js}", "a.js") and match("[!a]b?", "cbd") and not match("a.b", "axb")


def test_budget_takes_what_fits_in_order(spark):
    import random

    g = random.Random(1)
    rows = [(f"p{i:04}", g.randint(0, 2), g.choice((0, 1, 5, 5, 5, 40, 90, 400))) for i in range(3000)]
    d = spark.createDataFrame(rows, "path string, tier int, tokens long")
    left, want = 900, {}
    for p, tier, tokens in sorted(rows, key=lambda r: (r[1], r[0])):
        cost = tokens + 8 if tokens else 0
        want[p] = cost <= left
        left -= cost if want[p] else 0
    assert {r.path: r.included for r in R.budget_fit(d, 900).collect()} == want and 20 < sum(want.values()) < len(want)


def test_texts():
    assert render.table(["A", "Bé"], [["x", "y"], ["long"]]) == "A     Bé\nx     y\nlong\n"
    assert render.number(1234567) == "1,234,567" and render.fence_for("a ```` b") == "`````" and render.escape_cell("a|b") == "a\\|b"
    item = {"path": "a|b.md", "tier": 0, "reason": "r", "tokens": 3, "included": True, "language": "other"}
    text = render.pack_markdown({"mode": "path", "query": "q", "budget": 5}, {}, [item], [], {"a|b.md": "x"}, "+d\n")
    assert "| a\\|b.md | r | 3 |" in text and "```text\nx\n```\n" in text and "```diff\n+d\n```" in text and "_No symbols" in text and "- Repo: (unnamed)" in text
    assert G.stats is not None and json.loads(render.pack_json({"mode": "changed", "query": "", "budget": 1}, {}, [item], [], {}))["repository"]["changedFilesIncluded"]


def test_facts_of_files_that_arrive(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    for name, text in (("a.rs", "fn one() {}"), ("sub/b.go", "package b\nfunc Two() {}")):
        (tmp_path / "in" / name).write_text(text)
        assert follow(spark, f"file://{tmp_path}/in", f"{tmp_path}/facts", f"{tmp_path}/check").awaitTermination(60)
    got = spark.read.parquet(f"{tmp_path}/facts").select("path", "name").collect()
    assert sorted(map(tuple, got)) == [("a.rs", "one"), ("sub/b.go", "Two")]
