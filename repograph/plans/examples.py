"""Source files of every language, made from the driver's tables, with the facts that SQL expects of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators import facts as X
from ..operators import resolve as J
from ..operators.joins import shuffled
from ..operators.work import read_once
from ..sources.manifests import manifests, msbuild_items, node_items
from .corpus import Graph, cascade_sql

#: language: (file name, text); {n} stands for the part's key, {m} for that of another.
FILES = {
    "rust": ("w{n}.rs", 'pub struct Widget{n} {\n    id: u32,\n}\n/* struct Not{n} {} */\npub trait Draw{n}: Base{n} {\n    fn area(&self);\n}\nimpl Draw{n} for Widget{n} {\n    fn area(&self) {\n        println!("{}", hidden());\n        grow{m}(Widget{m} { id: 1 });\n    }\n}\nfn grow{n}(w: Widget{n}) -> u32 {\n    Widget{n}::make()\n}\n'),
    "csharp": ("O{n}.cs", "using Acme.Part{m}.Sub;\nusing System;\npublic class Order{n} : Base{n}, IOrder{n}\n{\n    public Order{n}(Order{m} other) { }\n    internal Line{n} Sum() { return new Line{m}(); }\n}\npublic interface IOrder{n}\n{\n    void Close();\n}\n"),
    "python": ("s{n}.py", "class Stock{n}(base.Model{n}):\n    def _level(self):\n        return 1\n\nasync def fetch{n}():\n    pass\n"),
    "go": ("l{n}.go", "package l\n\ntype Box{n} struct {\n\tio.Reader{n}\n\tname string\n}\n\nfunc (b *Box{n}) open() {}\n\nfunc New{n}() *Box{n} {\n\treturn nil\n}\n"),
    "typescript": ("b{n}.ts", "import { a } from '@acme/part{m}/deep';\nimport './local';\nexport interface Bill{n} extends Doc{n} {\n  id: string;\n}\nexport class Engine{n} extends Motor{n} implements Bill{n} {\n  last: Bill{m};\n}\nconst run{n} = (b: Bill{n}) => {\n  return new Engine{m}();\n};\n"),
    "javascript": ("c{n}.js", "const x = require('part{m}');\nfunction sum{n}() {\n  return add{m}(1);\n}\nclass Cart{n} {}\nexport { sum{n} };\n"),
    "svelte": ("r{n}/+page.svelte", "<script lang=\"ts\">\n  function pick{n}() {}\n</script>\n<p>Don't {pick{n}()}</p>\n"),
    "bash": ("d{n}.sh", "# no{n}() {\nbuild{n}() {\n  echo \"}\"\n}\nfunction ship{n} {\n  true\n}\n"),
    "yaml": ("y{n}.yaml", "version{n}: 1\nbase: &anchor{n}\n  inner: 2\nend{n}: |\n  text: 3\n"),
    "markdown": ("g{n}.md", "# Title {n} ##\n\n```\n# no {n}\n```\nSet {n}\n---\n"),
}
#: language: (name, full name, kind, first line, last line, visibility, exported).
SYMBOLS = {
    "rust": [("Widget{n}", "", "struct", 1, 3, "pub", True), ("Draw{n}", "", "trait", 5, 7, "pub", True), ("area", "", "function", 9, 12, "", False), ("grow{n}", "", "function", 14, 16, "", False)],
    "csharp": [("Order{n}", "", "class", 3, 7, "public", True), ("Order{n}", "", "constructor", 5, 5, "public", True), ("Sum", "", "method", 6, 6, "internal", False), ("IOrder{n}", "", "interface", 8, 11, "public", True), ("Close", "", "method", 10, 10, "", False)],
    "python": [("Stock{n}", "", "class", 1, 3, "", True), ("_level", "", "function", 2, 3, "", False), ("fetch{n}", "", "function", 5, 6, "", True)],
    "go": [("Box{n}", "", "struct", 3, 6, "", True), ("open", "", "method", 8, 8, "", False), ("New{n}", "", "function", 10, 12, "", True)],
    "typescript": [("Bill{n}", "", "interface", 3, 5, "export", True), ("Engine{n}", "", "class", 6, 8, "export", True), ("run{n}", "", "function", 9, 11, "", False)],
    "javascript": [("sum{n}", "", "function", 2, 4, "export", True), ("Cart{n}", "", "class", 5, 5, "", False)],
    "svelte": [("r{n}/+page", "r{n}/+page (sveltekit page)", "component", 1, 5, "page", True), ("pick{n}", "", "function", 2, 2, "", False)],
    "bash": [("build{n}", "", "function", 2, 4, "", True), ("ship{n}", "", "function", 5, 7, "", True)],
    "yaml": [("version{n}", "", "key", 1, 1, "", False), ("base", "", "key", 2, 3, "", False), ("anchor{n}", "", "key", 2, 2, "anchor", False), ("end{n}", "", "key", 4, 5, "", False)],
    "markdown": [("Title {n}", "h1 Title {n}", "key", 1, 2, "h1", False), ("Set {n}", "h2 Set {n}", "key", 6, 8, "h2", False)],
}
IMPORTS = {"csharp": ["Acme.Part{m}.Sub", "System"], "typescript": ["@acme/part{m}"], "javascript": ["part{m}"]}
SUPERTYPES = {
    "rust": [("Widget{n}", "Draw{n}", "implements"), ("Draw{n}", "Base{n}", "inherits")],
    "csharp": [("Order{n}", "Base{n}", "unknown"), ("Order{n}", "IOrder{n}", "unknown")],
    "python": [("Stock{n}", "Model{n}", "inherits")],
    "go": [("Box{n}", "Reader{n}", "inherits")],
    "typescript": [("Bill{n}", "Doc{n}", "inherits"), ("Engine{n}", "Motor{n}", "inherits"), ("Engine{n}", "Bill{n}", "implements")],
}
REFERENCES = {
    "rust": [("area", "grow{m}"), ("area", "Widget{m}"), ("grow{n}", "Widget{n}"), ("grow{n}", "make")],
    "csharp": [("Order{n}", "Order{m}"), ("Sum", "Line{m}")],
    "typescript": [("", "Bill{n}"), ("", "Doc{n}"), ("Engine{n}", "Engine{n}"), ("Engine{n}", "Bill{n}"), ("Engine{n}", "Bill{m}"), ("run{n}", "Bill{n}"), ("run{n}", "Engine{m}")],
    "javascript": [("sum{n}", "add{m}"), ("x", "require")],
}
_OTHER = "(p_partkey * 7 + 3) % 200"
#: Tasks at least that scan the files of each language.
TASKS = 24


def _filled(text: str):
    return F.replace(F.replace(F.lit(text), F.lit("{n}"), F.col("n")), F.lit("{m}"), F.col("m"))


def files(g: Graph, *languages: str) -> DataFrame:
    """path, language, text of a file of each language for each part, in folders of one to three levels.

    Parts are few bytes and many rows: read as the table's files are split, all of them could be one task's,
    so their keys are spread over the cores before texts are made of them.
    """
    tasks = max(TASKS, 4 * g.spark.sparkContext.defaultParallelism)
    part = g.table("part").select("p_partkey", "p_size").repartition(tasks, "p_partkey").select(F.col("p_partkey").cast("string").alias("n"), F.expr(_OTHER).cast("string").alias("m"), F.concat(F.lit("d"), (F.col("p_partkey") % 5).cast("string")).alias("a"), (F.col("p_size") % 3).alias("deep"))
    folder = F.when(F.col("deep") == 0, F.col("a")).when(F.col("deep") == 1, F.concat("a", F.lit("/b"))).otherwise(F.concat("a", F.lit("/b/c")))
    out = None
    for lang in languages or FILES:
        name, text = FILES[lang]
        one = part.select(F.concat(folder, F.lit("/"), _filled(name)).alias("path"), F.lit(lang).alias("language"), _filled(text).alias("text"))
        out = one if out is None else out.unionByName(one)
    return out


def _sql_text(x: str) -> str:
    return "replace(replace('" + x.replace("'", "''") + "', '{n}', n), '{m}', m)"


_PARTS = f"parts AS (SELECT CAST(p_partkey AS VARCHAR) AS n, CAST({_OTHER} AS VARCHAR) AS m, 'd' || (p_partkey % 5) || CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN '/b' ELSE '/b/c' END AS dir FROM part)"


def _rows(table: dict[str, list], columns: list[str], languages: tuple[str, ...] = ()) -> str:
    """SELECT of path, language and a table's columns for every part."""
    selects = []
    for lang in languages or table:
        for row in table.get(lang, ()):
            values = [row] if isinstance(row, str) else list(row)
            cells = [_sql_text(v) if isinstance(v, str) else ("true" if v is True else "false" if v is False else f"CAST({v} AS INTEGER)") for v in values]
            selects.append(f"SELECT dir || '/' || {_sql_text(FILES[lang][0])} AS path, '{lang}' AS language, " + ", ".join(f"{c} AS \"{k}\"" for c, k in zip(cells, columns)) + " FROM parts")
    return " UNION ALL ".join(selects)


_SYMBOL_COLUMNS = ["name", "full_name", "kind", "start_line", "end_line", "visibility", "exported"]


def _symbols(*languages: str):
    def plan(g: Graph) -> DataFrame:
        return X.extract(files(g, *languages), "symbol").select("path", *_SYMBOL_COLUMNS)

    named = {k: [(r[0], r[1] or r[0], *r[2:]) for r in v] for k, v in SYMBOLS.items()}
    return plan, f"WITH {_PARTS} SELECT path, {', '.join(_SYMBOL_COLUMNS)} FROM ({_rows(named, _SYMBOL_COLUMNS, languages)})"


def _raw(fact: str, table: dict, columns: list[str], *languages: str):
    reader = {"import": X.raw_imports, "supertype": X.raw_supertypes, "reference": X.raw_references}[fact]
    shown = [f'"{c}"' for c in columns]
    return (lambda g: reader(X.extract(files(g, *languages), fact))), f"WITH {_PARTS} SELECT path AS file_path, {', '.join(shown)} FROM ({_rows(table, columns, languages)})"


def _packages(g: Graph) -> DataFrame:
    """Packages that the imports of files() name, of both ecosystems; some names are in both."""
    k = F.col("p_partkey")
    rows = [("npm", F.concat(F.lit("@acme/part"), k), 3), ("npm", F.concat(F.lit("part"), k), 2), ("nuget", F.concat(F.lit("Acme.Part"), k), 2), ("nuget", F.lit("Acme"), 1), ("npm", F.lit("System"), 1), ("nuget", F.concat(F.lit("part"), k), 1)]
    each = [F.when(k % step == 0, F.struct(F.lit(eco).alias("ecosystem"), name.alias("name"))) for eco, name, step in rows]
    out = g.table("part").select(F.inline(F.array_compact(F.array(*each)))).distinct()
    return out.withColumn("id", P.package_id(F.col("ecosystem"), F.col("name")))


_PACKAGES = """packages AS (SELECT *, 'pkg:' || ecosystem || ':' || name AS id FROM (
    SELECT 'npm' AS ecosystem, '@acme/part' || p_partkey AS name FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT 'npm', 'part' || p_partkey FROM part WHERE p_partkey % 2 = 0
    UNION ALL SELECT 'nuget', 'Acme.Part' || p_partkey FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT 'nuget', 'Acme' UNION ALL SELECT 'npm', 'System' UNION ALL SELECT 'nuget', 'part' || p_partkey FROM part))"""


def _imports(g: Graph) -> DataFrame:
    # a file's language is what its path says
    raw = X.raw_imports(X.extract(files(g, *IMPORTS), "import")).withColumn("language", P.language(F.col("file_path")))
    return J.resolve_imports(read_once(raw, "imports"), _packages(g))


def _edges(g: Graph) -> DataFrame:
    """References of all files, as an index run resolves them."""
    facts = read_once(X.extract(files(g, *REFERENCES), "symbol", "reference"), "facts")
    raw, symbols = X.raw_references(facts), X.declared(facts)
    return J.resolve_references(raw, symbols, targets=read_once(J.named_in(symbols, raw), "targets"))


def _type_edges(g: Graph) -> DataFrame:
    facts = read_once(X.extract(files(g, *SUPERTYPES), "symbol", "supertype"), "facts")
    raw, symbols = X.raw_supertypes(facts), X.declared(facts)
    return J.resolve_supertypes(raw, symbols, targets=read_once(J.named_in(symbols, raw), "targets"))


def _index_sql(table: dict, columns: list[str], raw: str, extra: str, tail: str) -> str:
    symbols = f"symbols AS (SELECT *, path AS file_path, 'sym:' || path || '#' || kind || '#' || name || '#' || start_line AS id FROM ({_rows(SYMBOLS, _SYMBOL_COLUMNS, tuple(table))}))"
    return f"WITH {_PARTS}, {symbols}, {raw} AS (SELECT DISTINCT path AS file_path, {', '.join(f'\"{c}\"' for c in columns)} FROM ({_rows(table, columns)})), {cascade_sql(raw, extra)} {tail}"


# --- manifests -----------------------------------------------------------------------------------


def _manifest_files(g: Graph) -> DataFrame:
    """A project file of each supplier, a props file of each nation, a package.json of each customer."""
    s = g.table("supplier").select(F.col("s_suppkey").cast("string").alias("k"), F.col("s_nationkey").cast("string").alias("n"), (F.col("s_suppkey") + 1).cast("string").alias("next"))
    at = F.concat(F.lit("n"), "n", F.lit("/s"), "k")
    net = s.select(F.concat(at, F.lit("/S"), "k", F.lit(".csproj")).alias("path"), F.concat(
        F.lit('<Project Sdk="x">\n <!-- <PackageReference Include="No" /> -->\n <ItemGroup>\n  <ProjectReference Include="..\\s'), "next", F.lit("\\S"), "next", F.lit('.csproj" />\n  <PackageReference Include="Shared" Version="'), "k",
        F.lit('.0">\n   <PrivateAssets>all</PrivateAssets></PackageReference>\n  <PackageReference Include="Child" Version="0"><Version> '), "k", F.lit('.1 </Version></PackageReference>\n  <PackageReference Include="Central"></PackageReference>\n </ItemGroup>\n</Project>\n')).alias("text"))
    props = g.table("nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string"), F.lit("/Directory.Packages.props")).alias("path"), F.concat(
        F.lit("<Project><PropertyGroup><ManagedPackageVersionsCentrally>"), F.when(F.col("n_nationkey") % 2 == 0, "true").otherwise("false"), F.lit('</ManagedPackageVersionsCentrally></PropertyGroup><ItemGroup><PackageVersion Include="Central" Version="c'), F.col("n_nationkey").cast("string"), F.lit('" /></ItemGroup></Project>')).alias("text"))
    root = g.table("region").filter("r_regionkey = 0").select(F.lit("Directory.Packages.props").alias("path"), F.lit('<Project><ItemGroup><PackageVersion Include="Central" Version="far" /></ItemGroup></Project>').alias("text"))
    c = F.col("c_custkey").cast("string")
    node = g.table("customer").select(F.concat(F.lit("web/c"), c, F.lit("/package.json")).alias("path"), F.concat(
        F.when(F.col("c_custkey") % 3 == 0, '{"name": 7, ').otherwise(F.concat(F.lit('{"name": "app'), c, F.lit('", '))), F.lit('"scripts": {"build": "x", "n": 1}, "dependencies": {"left": "'), c, F.lit('", "odd": null, "num": 3}, "devDependencies": ["a"], "peerDependencies": {"right": "^1"}}')).alias("text"))
    return net.unionByName(props).unionByName(root).unionByName(node)


_NET = "net AS (SELECT 'n' || s_nationkey || '/s' || s_suppkey || '/S' || s_suppkey || '.csproj' AS path, s_suppkey AS k, s_nationkey AS n FROM supplier), node AS (SELECT 'web/c' || c_custkey || '/package.json' AS path, c_custkey AS c FROM customer)"
_USES = "uses AS (SELECT path, 'pkg:nuget:' || name AS dst, version FROM (SELECT path, 'Shared' AS name, k || '.0' AS version FROM net UNION ALL SELECT path, 'Child', k || '.1' FROM net UNION ALL SELECT path, 'Central', 'c' || n FROM net) UNION ALL SELECT path, 'pkg:npm:left', CAST(c AS VARCHAR) FROM node UNION ALL SELECT path, 'pkg:npm:right', '^1' FROM node)"

#: name: (plan over a Graph, SQL)
CATALOG = {
    "x1_rust_symbols": _symbols("rust"),
    "x2_csharp_symbols": _symbols("csharp"),
    "x3_python_symbols": _symbols("python"),
    "x4_go_symbols": _symbols("go"),
    "x5_script_symbols": _symbols("typescript", "javascript"),
    "x6_svelte_symbols": _symbols("svelte"),
    "x7_bash_symbols": _symbols("bash"),
    "x8_yaml_symbols": _symbols("yaml"),
    "x9_json_symbols": (
        lambda g: X.extract(g.table("events").select(F.concat(F.lit("e"), F.col("event_id").cast("string"), F.lit(".json")).alias("path"), F.lit("json").alias("language"), F.col("props").alias("text"))).select("path", "name", "kind", "start_line"),
        "SELECT 'e' || event_id || '.json' AS path, unnest(json_keys(props)) AS name, 'key' AS kind, CAST(1 AS INTEGER) AS start_line FROM events",
    ),
    "x10_markdown_symbols": _symbols("markdown"),
    "x11_script_imports": _raw("import", IMPORTS, ["package"], "typescript", "javascript"),
    "x12_csharp_imports": _raw("import", IMPORTS, ["package"], "csharp"),
    "x13_supertypes": _raw("supertype", SUPERTYPES, ["from", "to", "hint"], *SUPERTYPES),
    "x14_csharp_references": _raw("reference", REFERENCES, ["from", "to"], "csharp"),
    "x15_rust_references": _raw("reference", REFERENCES, ["from", "to"], "rust"),
    "x16_script_references": _raw("reference", REFERENCES, ["from", "to"], "typescript", "javascript"),
    "j6_resolve_imports": (
        _imports,
        f"WITH {_PARTS}, {_PACKAGES}, imp AS ({_rows(IMPORTS, ['package'])}), hit AS (SELECT i.path, i.package, p.id, length(p.name) AS size FROM imp i JOIN packages p ON p.ecosystem = 'nuget' AND (i.package = p.name OR starts_with(i.package, p.name || '.')) WHERE language = 'csharp')"
        " SELECT DISTINCT i.path AS file_path, p.id AS package_id FROM imp i JOIN packages p ON p.name = i.package AND p.ecosystem = 'npm' WHERE i.language IN ('javascript', 'typescript') UNION SELECT path, id FROM hit h WHERE size = (SELECT max(size) FROM hit x WHERE x.path = h.path AND x.package = h.package)",
    ),
    "q9_index_references": (_edges, _index_sql(REFERENCES, ["from", "to"], "raw_refs", "", "SELECT DISTINCT src, dst FROM met")),
    "q9_index_supertypes": (
        _type_edges,
        _index_sql(SUPERTYPES, ["from", "to", "hint"], "raw_supers", "hint", "SELECT DISTINCT src, dst, CASE WHEN hint <> 'unknown' THEN hint WHEN t_kind IN ('interface', 'trait') THEN 'implements' ELSE 'inherits' END AS kind FROM met"),
    ),
    "s9_msbuild_items": (
        lambda g: msbuild_items(_manifest_files(g).filter(F.col("path").endswith(".csproj"))).select("path", "item", "name", "version"),
        f"WITH {_NET} SELECT path, 'project' AS item, '..\\s' || (k + 1) || '\\S' || (k + 1) || '.csproj' AS name, NULL AS version FROM net UNION ALL SELECT path, 'package', 'Shared', k || '.0' FROM net UNION ALL SELECT path, 'package', 'Child', k || '.1' FROM net UNION ALL SELECT path, 'package', 'Central', NULL FROM net",
    ),
    "s10_node_items": (
        lambda g: node_items(_manifest_files(g).filter(F.col("path").endswith("package.json"))),
        f"WITH {_NET} SELECT path, 'name' AS item, 'app' || c AS name, NULL AS version, '' AS kind FROM node WHERE c % 3 <> 0 UNION ALL SELECT path, 'script', 'build', 'x', 'script' FROM node UNION ALL SELECT path, 'package', 'left', CAST(c AS VARCHAR), 'dependency' FROM node UNION ALL SELECT path, 'package', 'right', '^1', 'peerDependency' FROM node",
    ),
    "m1_m2_projects": (
        lambda g: manifests(_manifest_files(g))[0],
        f"WITH {_NET} SELECT 'proj:' || path AS id, 'S' || k AS name, path, 'csharp' AS language, CASE WHEN n % 2 = 0 THEN 'dotnet (cpm)' ELSE 'dotnet' END AS kind FROM net UNION ALL SELECT 'proj:' || path, CASE WHEN c % 3 = 0 THEN 'c' || c ELSE 'app' || c END, path, 'javascript', 'node' FROM node",
    ),
    "m1_project_references": (lambda g: manifests(_manifest_files(g))[2], f"WITH {_NET} SELECT 'proj:' || path AS src, 'proj:n' || n || '/s' || (k + 1) || '/S' || (k + 1) || '.csproj' AS dst FROM net"),
    "m1_m2_used_packages": (lambda g: manifests(_manifest_files(g))[3], f"WITH {_NET}, {_USES} SELECT 'proj:' || path AS src, dst FROM uses"),
    "m1_m2_packages": (lambda g: manifests(_manifest_files(g))[1].select("id", "version"), f"WITH {_NET}, {_USES} SELECT dst AS id, arg_max(version, path) AS version FROM uses GROUP BY dst"),
}
