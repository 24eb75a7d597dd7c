"""Every query by name, with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators import graph as G
from ..operators import ranking as R
from ..operators import resolve as J
from ..sources.scan import described, path_matches
from . import selection as S
from .corpus import GRAPH_SQL, Graph, _list, language_sql, low, parent_sql, pick
from .examples import CATALOG as EXAMPLES

PREFIX, NAME, TEXT, IMPORTED = "src0/en", "small widget", "src1/", "Supplier#000000002"
ROUTES = ("+page.svelte", "+layout.ts", "+Server.js", "+error.svelte", "page.tsx", "+pages.jsx", "x.TSX")
WORDS = ("Rust", "rs", "C#", "ctor", "class", "Éa", "other", "rust")
RELATIVE = ("..\\.\\x", "../../../x", "a/../b//c", "./d", "../../../../y/./z")


def _routes(g: Graph) -> DataFrame:
    return g.table("nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string"), F.lit("/"), pick(ROUTES, F.col("n_nationkey"))).alias("path"))


def _refs(g: Graph, name: str | None = None) -> DataFrame:
    return J.resolve_references(g.raw_references(), g.symbols(), name)


def _supers(g: Graph, name: str | None = None) -> DataFrame:
    return J.resolve_supertypes(g.raw_supertypes(), g.symbols(), name)


def _doc_index(g: Graph) -> DataFrame:
    """What an earlier run indexed: a seventh of the files since changed, an eleventh since added."""
    d = g.doc_files().filter("doc_id % 11 != 0")
    return d.select("path", F.when(F.col("doc_id") % 7 == 0, F.lit("old")).otherwise(F.sha2("text", 256)).alias("hash"))


def _doc_contains(g: Graph) -> DataFrame:
    return g.doc_files().select(P.project_id(F.concat(F.split_part("path", F.lit("/"), F.lit(1)), F.lit("/package.json"))).alias("project_id"), "path")


def _doc_projects(g: Graph) -> DataFrame:
    s = g.table("documents").select("source").distinct()
    return s.select(P.project_id(F.concat("source", F.lit("/package.json"))).alias("id"), F.col("source").alias("name"))


def _hrefs(g: Graph) -> DataFrame:
    return g.table("pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))


def _hosts(g: Graph) -> DataFrame:
    return g.table("pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"))


def _host_packages(g: Graph) -> DataFrame:
    h = _hosts(g)
    return h.select(F.regexp_extract("host", r"^([^.]+\.[^.]+)", 1).alias("name")).union(h.select(F.split_part("host", F.lit("."), F.lit(1)))).distinct()


def _customer_files(g: Graph) -> DataFrame:
    n = g.table("nation").select("n_nationkey", "n_regionkey")
    c = g.table("customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select(F.concat_ws("/", F.concat(F.lit("r"), F.col("n_regionkey").cast("string")), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")), F.concat(F.lit("c"), F.col("c_custkey").cast("string"))).alias("path"), "c_custkey", "c_mktsegment")


def _manifests(g: Graph) -> DataFrame:
    r = g.table("region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string"), F.lit("/p.csproj")).alias("manifest"))
    n = g.table("nation").filter("n_nationkey % 3 = 0").select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string"), F.lit("/n"), F.col("n_nationkey").cast("string"), F.lit("/p.csproj")).alias("manifest"))
    return r.union(n)


def _pins(g: Graph) -> DataFrame:
    m = _manifests(g).select(F.replace("manifest", F.lit("p.csproj"), F.lit("Directory.Packages.props")).alias("props"))
    return m.crossJoin(g.table("customer").select(F.col("c_mktsegment").alias("name")).distinct()).withColumn("value", F.concat(F.col("props"), F.lit("@"), F.col("name")))


def _build(g: Graph) -> DataFrame:
    files = g.doc_files()
    return S.build_pack(S.pack_path(files, PREFIX), files)


def _flags(g: Graph) -> DataFrame:
    p = F.col("path")
    return g.doc_files().select("path", "language", P.is_test_file(p).alias("test"), P.is_config_file(p).alias("config"), P.is_generated(p).alias("generated"), P.is_lockfile(p).alias("lockfile"))


def _stats(g: Graph) -> DataFrame:
    none = g.projects().limit(0)
    return G.stats(g.files(), g.symbols(), g.projects(), g.packages(), none, g.uses_package(), _refs(g))


def _heading_lines(g: Graph) -> DataFrame:
    return g.table("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).select("doc_id", (F.col("i") + 1).alias("line_no"), P.heading_text(F.col("line")).alias("title"))


def _status(g: Graph) -> DataFrame:
    now = g.doc_files().select("path", F.sha2("text", 256).alias("hash"))
    return G.classify(now, _doc_index(g)).filter("change != 'same'")


def _incremental(g: Graph) -> DataFrame:
    now = g.doc_files().select("path", F.sha2("text", 256).alias("hash"))
    batch = G.classify(now, _doc_index(g)).filter("change IN ('new', 'changed')").select("path").join(now, "path")
    return G.replace_files(_doc_index(g), batch)


def _deleted(g: Graph) -> DataFrame:
    alive = g.symbols().filter("start_line % 5 != 0")
    return J.resolve_references(g.raw_references(), g.symbols(), alive=alive)


def _last_version(g: Graph) -> DataFrame:
    rows = g.lines().join(g.packages().select(F.col("key").alias("l_suppkey"), "id"), "l_suppkey")
    return G.last_writer(rows.select("id", "p_brand", "l_orderkey", "l_linenumber", "l_partkey"), "id", ["p_brand", "l_orderkey", "l_linenumber", "l_partkey"], ["p_brand", "l_orderkey"])


def _order(name: str, extra: str = "") -> str:
    return f"WITH {GRAPH_SQL}{extra} {name}"


def _test_sql(path: str) -> str:
    base = f"regexp_extract(lower({path}), '([^/]*)$', 1)"
    ends = " OR ".join(f"ends_with({base}, '{e}')" for e in P.TEST_ENDS)
    return f"(contains(lower({path}), '/tests/') OR contains(lower({path}), '/test/') OR contains(lower({path}), '__tests__/') OR starts_with({base}, 'test_') OR {ends} OR (contains({base}, 'test') AND ends_with({base}, '.rs')))"


def _ends_sql(path: str, ends: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"ends_with(lower({path}), '{e}')" for e in ends) + ")"


def _lock_sql(path: str) -> str:
    return f"regexp_extract(lower({path}), '([^/]*)$', 1) IN ({', '.join(repr(x) for x in P.LOCKFILES)})"


def _select_sql(files: str, found: str) -> str:
    """CTEs from `found` (path, tier, explicit, reason, g, k) to `chosen` (path, tier, reason)."""
    return f""", found0 AS ({found}),
    dirs AS (SELECT DISTINCT {parent_sql("path")} AS dir FROM found0),
    found AS (SELECT * FROM found0 UNION ALL SELECT f.path, 2, false, 'same directory as a selected file', 99, f.path FROM {files} f WHERE {parent_sql("f.path")} IN (SELECT dir FROM dirs)),
    kept AS (SELECT * FROM found WHERE NOT {_ends_sql("path", P.GENERATED_ENDS)} AND (explicit OR NOT ({_lock_sql("path")})) AND (explicit OR NOT {_test_sql("path")}) AND (explicit OR NOT {_ends_sql("path", P.CONFIG_ENDS)})),
    chosen AS (SELECT path, tier, reason FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY tier, g, k) AS nth FROM kept WHERE path IN (SELECT path FROM {files})) WHERE nth = 1)"""


def _final_sql(files: str, items: str) -> str:
    return f""", items AS ({items}),
    scored AS (SELECT *, CASE WHEN starts_with(reason, 'declares') THEN 4 WHEN starts_with(reason, 'references') OR contains(reason, 'inherits') OR contains(reason, 'implement') OR contains(reason, 'base type') OR contains(reason, 'subtype') THEN 3 WHEN contains(reason, 'test') OR starts_with(reason, 'path contains') THEN 2 ELSE 1 END AS s FROM items WHERE path IN (SELECT path FROM {files}))
    SELECT path, reason, depth FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY depth, s DESC, seq, reason) AS nth FROM scored) WHERE nth = 1"""


_NAMED = f"{low('name')} = '{NAME}'"
_SYMBOL_REFS = f"SELECT DISTINCT s.file_path AS path, 'references {NAME}' AS reason, 1 AS depth FROM refs r JOIN symbols t ON t.id = r.dst JOIN symbols s ON s.id = r.src WHERE {low('t.name')} = '{NAME}'"
_TYPE_RELATIONS = f"""SELECT DISTINCT o.file_path AS path, CASE WHEN e.kind = 'inherits' THEN 'base type (inherits)' ELSE 'implemented interface/trait' END AS reason, 1 AS depth FROM supers e JOIN symbols n ON n.id = e.src JOIN symbols o ON o.id = e.dst WHERE {low('n.name')} = '{NAME}'
UNION SELECT DISTINCT o.file_path, CASE WHEN e.kind = 'inherits' THEN 'subtype (inherits)' ELSE 'implementor' END, 1 FROM supers e JOIN symbols n ON n.id = e.dst JOIN symbols o ON o.id = e.src WHERE {low('n.name')} = '{NAME}'"""
_CHOSEN_PATH = _select_sql("doc_files", f"SELECT path, 0 AS tier, true AS explicit, 'exact path match' AS reason, 0 AS g, path AS k FROM doc_files WHERE path = '{PREFIX}' UNION ALL SELECT path, 1, true, 'under path `{PREFIX}`', 1, path FROM doc_files WHERE starts_with(path, '{PREFIX}/')")
_RELATED = f"SELECT DISTINCT file_path AS path, 'exact symbol declaration' AS reason, 0 AS depth FROM symbols WHERE {_NAMED}"
_ONE_FILE = "src1/en/doc_"


def _seed_path(g: Graph) -> str:
    """The first file of a source that has several; the SQL finds it the same way."""
    return g.doc_files().filter(F.col("path").startswith(_ONE_FILE)).agg(F.min("path")).first()[0] or ""


_ANC = "SELECT path, array_to_string(parts[1:i], '/') AS dir, i AS depth FROM (SELECT path, string_split(path, '/') AS parts, unnest(range(0, len(string_split(path, '/')))) AS i FROM cf)"
_CUSTOMERS = """, cf AS (SELECT 'r' || n_regionkey || '/n' || c_nationkey || '/c' || c_custkey AS path, c_custkey, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey),
manifests AS (SELECT 'r' || r_regionkey || '/p.csproj' AS manifest FROM region UNION ALL SELECT 'r' || n_regionkey || '/n' || n_nationkey || '/p.csproj' FROM nation WHERE n_nationkey % 3 = 0)"""
_DOC_OLD = ", old AS (SELECT path, CASE WHEN doc_id % 7 = 0 THEN 'old' ELSE sha256(text) END AS hash FROM doc_files WHERE doc_id % 11 <> 0), now AS (SELECT path, sha256(text) AS hash FROM doc_files)"
_SEED = f"(SELECT min(path) FROM doc_files WHERE starts_with(path, '{_ONE_FILE}'))"

#: name: (plan over a Graph, SQL or None)
_CATALOG: dict[str, tuple[Callable[[Graph], DataFrame], str | None]] = {
    "p1_ids": (lambda g: g.doc_files().select(P.file_id(F.col("path")).alias("id"), "path"), _order("SELECT 'file:' || path AS id, path FROM doc_files")),
    "p2_language": (lambda g: g.doc_files().select("path", "language"), _order("SELECT path, language FROM doc_files")),
    "p5_file_flags": (_flags, _order(f"SELECT path, language, {_test_sql('path')} AS test, {_ends_sql('path', P.CONFIG_ENDS)} AS config, {_ends_sql('path', P.GENERATED_ENDS)} AS generated, {_lock_sql('path')} AS lockfile FROM doc_files")),
    "p11_path_parts": (lambda g: g.doc_files().select("path", P.parent_dir(F.col("path")).alias("dir"), P.file_stem(F.col("path")).alias("stem"), P.under_prefix(F.col("path"), PREFIX).alias("below")), _order(f"SELECT path, {parent_sql('path')} AS dir, lower(split_part(regexp_extract(path, '([^/]*)$', 1), '.', 1)) AS stem, starts_with(path, '{PREFIX}/') AS below FROM doc_files")),
    "p17_import_roots": (lambda g: _hrefs(g).select("page_id", P.npm_root(F.ltrim(F.regexp_replace("href", "^/", ""))).alias("root")).distinct(), """SELECT DISTINCT page_id, CASE WHEN h = '' OR starts_with(h, '.') OR starts_with(h, '/') THEN NULL WHEN starts_with(h, '@') AND regexp_extract(h, '^(@[^/]*/[^/]*)', 1) <> '' THEN regexp_extract(h, '^(@[^/]*/[^/]*)', 1) ELSE split_part(h, '/', 1) END AS root FROM (SELECT page_id, ltrim(regexp_replace(unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)), '^/', '')) AS h FROM pages)"""),
    "p18_bare_type_name": (lambda g: g.table("part").select("p_partkey", P.bare_type_name(F.concat("p_brand", F.lit("."), "p_type", F.lit("<"), "p_name", F.lit(">"))).alias("bare")), "SELECT p_partkey, trim(regexp_extract(regexp_extract(p_brand || '.' || p_type || '<' || p_name || '>', '^[^<(]*', 0), '[^.:]*$', 0)) AS bare FROM part"),
    "p19_heading_text": (_heading_lines, r"SELECT doc_id, CAST(i AS INTEGER) AS line_no, regexp_replace(trim(regexp_replace(trim(line), '#+$', '')), '\s+', ' ', 'g') AS title FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)"),
    "p21_token_cost": (lambda g: g.doc_files().select("path", P.estimate_tokens(F.col("text")).alias("tokens"), P.file_cost(P.estimate_tokens(F.col("text"))).alias("cost")), _order("SELECT path, t AS tokens, CASE WHEN t = 0 THEN CAST(0 AS BIGINT) ELSE t + 8 END AS cost FROM (SELECT path, CASE WHEN length(text) = 0 THEN CAST(0 AS BIGINT) ELSE greatest(1, length(text) // 4) END AS t FROM doc_files)")),
    "p25_fence_length": (lambda g: g.doc_files().select("path", P.fence_length(F.col("text")).alias("fence")), _order("SELECT path, CAST(greatest(2, coalesce(list_max([length(x) for x in regexp_extract_all(text, '`+')]), 0)) + 1 AS INTEGER) AS fence FROM doc_files")),
    "p16_resolve_rel": (lambda g: g.doc_files().select("path", P.normal_path(F.concat(P.parent_dir(F.col("path")), F.lit("/"), pick(RELATIVE, F.col("doc_id")))).alias("resolved")), _order(f"SELECT path, CASE doc_id % 5 WHEN 0 THEN split_part(path, '/', 1) || '/x' WHEN 1 THEN 'x' WHEN 2 THEN {parent_sql('path')} || '/b/c' WHEN 3 THEN {parent_sql('path')} || '/d' ELSE 'y/z' END AS resolved FROM doc_files")),
    "p3_route_roles": (lambda g: _routes(g).select("path", P.route_role(F.col("path")).alias("role"), P.is_jsx(F.col("path")).alias("jsx")), "SELECT path, CASE split_part(lower(regexp_extract(path, '([^/]*)$', 1)), '.', 1) WHEN '+page' THEN 'page' WHEN '+layout' THEN 'layout' WHEN '+server' THEN 'endpoint' WHEN '+error' THEN 'error' END AS role, ends_with(lower(path), '.tsx') OR ends_with(lower(path), '.jsx') AS jsx FROM (SELECT 'n' || n_nationkey || '/' || " + _list(ROUTES) + "[n_nationkey % 7 + 1] AS path FROM nation)"),
    "p20_p30_names": (lambda g: g.table("part").select("p_partkey", P.starts_upper(pick(WORDS, F.col("p_partkey"))).alias("upper"), P.language_named(pick(WORDS, F.col("p_partkey"))).alias("language"), P.kind_named(pick(WORDS, F.col("p_partkey"))).alias("kind"), P.language_enabled(pick(WORDS, F.col("p_partkey")), ("rust", "other")).alias("enabled")), f"SELECT p_partkey, regexp_matches(w, '^\\p{{Lu}}') AS upper, CASE lower(w) WHEN 'rs' THEN 'rust' WHEN 'c#' THEN 'csharp' WHEN 'rust' THEN 'rust' WHEN 'other' THEN 'other' END AS language, CASE lower(w) WHEN 'ctor' THEN 'constructor' WHEN 'class' THEN 'class' WHEN 'fn' THEN 'function' END AS kind, w = 'rust' AS enabled FROM (SELECT p_partkey, {_list(WORDS)}[p_partkey % 8 + 1] AS w FROM part)"),
    "p24_p28_texts": (lambda g: g.table("documents").select("doc_id", P.escape_cell(F.concat("source", F.lit("|"), "lang")).alias("cell"), P.fence(F.col("text")).alias("fence"), P.grouped(F.col("n_chars") * 1000).alias("shown"), P.slashes(F.concat("source", F.lit("\\"), "lang")).alias("path")), "SELECT doc_id, source || '\\|' || lang AS cell, repeat('`', CAST(greatest(2, coalesce(list_max([length(x) for x in regexp_extract_all(text, '`+')]), 0)) + 1 AS INTEGER)) AS fence, format('{:,}', n_chars * 1000) AS shown, source || '/' || lang AS path FROM documents"),
    "s3_globs": (lambda g: g.doc_files().filter(path_matches(F.col("path"), ("**/*.ts", "src[12]/*.rs", "**/doc_?.{md,go}"), ("src2/**", "**/*5.ts"))).select("path"), _order("SELECT path FROM doc_files WHERE regexp_matches(path, '(\\.ts$)|(^src[12]/.*\\.rs$)|((^|/)doc_.\\.(md|go)$)') AND NOT starts_with(path, 'src2/') AND NOT ends_with(path, '5.ts')")),
    "s4_s5_read": (lambda g: described(g.table("documents").select(F.col("doc_id").cast("string").alias("path"), F.concat(F.encode("text", "UTF-8"), F.when(F.col("doc_id") % 2 == 0, F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit("")))).alias("content"))).select("path", F.sha2("text", 256).alias("text_hash"), "hash", "size_bytes"), "SELECT CAST(doc_id AS VARCHAR) AS path, sha256(text || CASE WHEN doc_id % 2 = 0 THEN chr(65533) ELSE '' END) AS text_hash, sha256(CASE WHEN doc_id % 2 = 0 THEN encode(text) || unhex('FF') ELSE encode(text) END) AS hash, CAST(octet_length(encode(text)) + CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS size_bytes FROM documents"),
    "s6_s7_lookup": (lambda g: G.files_matching(g.doc_files()).filter(F.col("path") == _seed_path(g)).select("path", "language"), _order(f"SELECT path, language FROM doc_files WHERE path = {_SEED}")),
    "f1_symbols_matching": (lambda g: G.symbols_matching(g.symbols(), "WIDGET", kind="class").select("id", "name", "file_path"), _order(f"SELECT id, name, file_path FROM symbols WHERE contains({low('name')}, 'widget') AND kind = 'class'")),
    "f2_files_matching": (lambda g: G.files_matching(g.doc_files(), "SRC1", "rust").select("path"), _order(f"SELECT path FROM doc_files WHERE contains({low('path')}, 'src1') AND language = 'rust'")),
    "f3_packages": (lambda g: G.packages_matching(g.packages(), "SUPP", "NPM").select("id", "name", "shown"), _order(f"SELECT id, name, CASE WHEN version = '' THEN '(unversioned)' ELSE version END AS shown FROM packages WHERE contains({low('name')}, 'supp') AND ecosystem = 'npm'")),
    "f4_projects": (lambda g: G.projects_matching(g.projects(), "brand#1"), _order(f"SELECT id, name, path FROM projects WHERE contains({low('name')}, 'brand#1') OR contains({low('path')}, 'brand#1')")),
    "f6_status": (_status, _order("SELECT coalesce(n.path, o.path) AS path, CASE WHEN o.hash IS NULL THEN 'new' WHEN n.hash IS NULL THEN 'deleted' ELSE 'changed' END AS change FROM now n FULL JOIN old o ON n.path = o.path WHERE n.hash IS DISTINCT FROM o.hash", _DOC_OLD)),
    "j2_first_declarations": (lambda g: J.first_declarations(g.symbols()).select("file_path", "name", "id"), _order("SELECT file_path, name, id FROM (SELECT *, row_number() OVER (PARTITION BY file_path, name ORDER BY start_line, end_line, id) AS nth FROM symbols) WHERE nth = 1")),
    "j4_resolve_supertypes": (_supers, _order("SELECT * FROM supers")),
    "j5_resolve_references": (_refs, _order("SELECT * FROM refs")),
    "j7_longest_prefix": (lambda g: J.longest_prefix(_hosts(g).withColumnRenamed("host", "name"), _host_packages(g), "page_id"), r"""WITH h AS (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages), p AS (SELECT regexp_extract(host, '^([^.]+\.[^.]+)', 1) AS name FROM h UNION SELECT split_part(host, '.', 1) FROM h)
        SELECT page_id, name AS package FROM (SELECT page_id, name, row_number() OVER (PARTITION BY page_id ORDER BY length(name) DESC) AS nth FROM h JOIN p ON host = name OR starts_with(host, name || '.')) WHERE nth = 1"""),
    "j8_nearest_owner": (lambda g: J.nearest_owner(_customer_files(g), _manifests(g)), _order(f"SELECT path, manifest FROM (SELECT a.path, m.manifest, row_number() OVER (PARTITION BY a.path ORDER BY a.depth DESC, m.manifest DESC) AS nth FROM ({_ANC}) a JOIN manifests m ON {parent_sql('m.manifest')} = a.dir) WHERE nth = 1", _CUSTOMERS)),
    "j9_central_versions": (lambda g: J.central_value(_customer_files(g).select("path", F.col("c_mktsegment").alias("name"), F.when(F.col("c_custkey") % 4 == 0, "inline").alias("v")), _pins(g), F.col("v")), _order(f"SELECT cf.path, cf.c_mktsegment AS name, CASE WHEN cf.c_custkey % 4 = 0 THEN 'inline' ELSE coalesce(replace(o.manifest, 'p.csproj', 'Directory.Packages.props') || '@' || cf.c_mktsegment, '') END AS value FROM cf LEFT JOIN (SELECT path, manifest FROM (SELECT a.path, m.manifest, row_number() OVER (PARTITION BY a.path ORDER BY a.depth DESC) AS nth FROM ({_ANC}) a JOIN manifests m ON {parent_sql('m.manifest')} = a.dir) WHERE nth = 1) o ON o.path = cf.path", _CUSTOMERS)),
    "j11_symbol_references": (lambda g: G.symbol_references(_refs(g, NAME), g.symbols(), NAME), _order(_SYMBOL_REFS)),
    "j12_type_relations": (lambda g: G.type_relations(_supers(g, NAME), g.symbols(), NAME), _order(_TYPE_RELATIONS)),
    "j13_files_importing": (lambda g: G.files_importing(J.resolve_imports(g.raw_imports(), g.packages()), g.packages(), IMPORTED), _order(f"SELECT DISTINCT file_path AS path FROM raw_imports i JOIN packages p ON p.name = i.package AND p.ecosystem = CASE i.language WHEN 'typescript' THEN 'npm' WHEN 'csharp' THEN 'nuget' END WHERE i.package = '{IMPORTED}'")),
    "j14_siblings": (lambda g: G.siblings(_doc_contains(g), _doc_projects(g), _seed_path(g)), _order(f"SELECT path, 'same project (' || split_part(path, '/', 1) || ')' AS reason, 1 AS depth FROM doc_files WHERE split_part(path, '/', 1) = split_part({_SEED}, '/', 1) AND path <> {_SEED}")),
    "j15_related_to_symbol": (lambda g: G.related_to_symbol(g.symbols(), _refs(g, NAME), NAME), _order(f"{_RELATED} UNION ALL SELECT * FROM ({_SYMBOL_REFS}) WHERE path NOT IN (SELECT file_path FROM symbols WHERE {_NAMED})")),
    "a1_stats": (_stats, _order("SELECT (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM symbols) AS symbols, (SELECT count(*) FROM projects) AS projects, (SELECT count(*) FROM packages) AS packages, (SELECT count(*) FROM uses_package) AS edges, (SELECT count(*) FROM refs) AS reference_edges")),
    "a3_last_writer": (_last_version, _order("SELECT id, p_brand, l_orderkey FROM (SELECT k.id, p_brand, l_orderkey, row_number() OVER (PARTITION BY k.id ORDER BY p_brand DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC) AS nth FROM lines JOIN packages k ON k.key = l_suppkey) WHERE nth = 1")),
    "a4_distinct_symbols": (lambda g: G.distinct_symbols(g.symbols()), _order("SELECT file_path, name, start_line, kind, end_line, id FROM (SELECT *, row_number() OVER (PARTITION BY file_path, name, start_line, kind ORDER BY end_line, id) AS nth FROM symbols) WHERE nth = 1")),
    "a8_budget_fit": (lambda g: R.budget_fit(g.doc_files().select("path", F.lit(1).alias("tier"), P.estimate_tokens(F.col("text")).alias("tokens"))), None),
    "q1_pack_changed": (lambda g: S.pack_changed(g.doc_files(), _status(g)), _order("SELECT path, tier, reason FROM chosen", _DOC_OLD + _select_sql("doc_files", "SELECT coalesce(n.path, o.path) AS path, 0 AS tier, false AS explicit, 'changed file' AS reason, 0 AS g, coalesce(n.path, o.path) AS k FROM now n FULL JOIN old o ON n.path = o.path WHERE n.hash IS DISTINCT FROM o.hash"))),
    "q2_pack_path": (lambda g: S.pack_path(g.doc_files(), PREFIX), _order("SELECT path, tier, reason FROM chosen", _CHOSEN_PATH)),
    "q3_pack_symbol": (lambda g: S.pack_symbol(g.files(), g.symbols(), _refs(g, NAME), NAME), _order("SELECT path, tier, reason FROM chosen", _select_sql("files", f"SELECT DISTINCT file_path AS path, 0 AS tier, true AS explicit, 'declares `{NAME}`' AS reason, 0 AS g, file_path AS k FROM symbols WHERE {_NAMED} UNION ALL SELECT path, 1, false, reason, 2, path FROM ({_SYMBOL_REFS}) WHERE path NOT IN (SELECT file_path FROM symbols WHERE {_NAMED})"))),
    "q4_pack_query": (lambda g: S.pack_query(g.doc_files(), g.symbols(), TEXT), _order("SELECT path, tier, reason FROM chosen", _select_sql("doc_files", f"SELECT path, 1 AS tier, true AS explicit, 'path matches `{TEXT}`' AS reason, 0 AS g, path AS k FROM doc_files WHERE contains({low('path')}, '{TEXT}') UNION ALL SELECT DISTINCT file_path, 1, true, 'declares symbol matching `{TEXT}`', 1, file_path FROM symbols WHERE contains({low('name')}, '{TEXT}')"))),
    "q6_related_symbol": (lambda g: S.related_symbol(g.files(), g.symbols(), g.contains(), g.projects(), _supers(g, NAME), _refs(g, NAME), NAME), _order("", ", seeds AS (SELECT DISTINCT file_path AS path FROM symbols WHERE " + _NAMED + ")" + _final_sql("files", f"""SELECT path, 'declares `{NAME}`' AS reason, 0 AS depth, 0 AS seq FROM seeds
        UNION ALL SELECT DISTINCT c.path, 'same project (' || p.name || ')', 1, 1 FROM contains_file c JOIN contains_file s ON s.project_id = c.project_id JOIN seeds ON seeds.path = s.path JOIN projects p ON p.id = c.project_id WHERE c.path <> s.path
        UNION ALL SELECT path, reason, depth, 2 FROM ({_TYPE_RELATIONS}) UNION ALL SELECT path, reason, depth, 3 FROM ({_SYMBOL_REFS})
        UNION ALL SELECT path, CASE WHEN {_test_sql('path')} THEN 'test file in the same directory' WHEN {_ends_sql('path', P.CONFIG_ENDS)} THEN 'config/registration file in the area' ELSE 'same directory as a declaring file' END, 1, 4 FROM files WHERE {parent_sql('path')} IN (SELECT {parent_sql('path')} FROM seeds)
        UNION ALL SELECT path, CASE WHEN {_test_sql('path')} THEN 'likely test for `{NAME}`' ELSE 'path contains `{NAME}`' END, 1, 5 FROM files WHERE contains({low('path')}, '{NAME}')"""))),
    "q7_related_file": (lambda g: S.related_file(g.doc_files(), _doc_contains(g), _doc_projects(g), _seed_path(g)), _order("", f", seed AS (SELECT {_SEED} AS p)" + _final_sql("doc_files", f"""SELECT p AS path, 'seed file' AS reason, 0 AS depth, 0 AS seq FROM seed
        UNION ALL SELECT path, 'same project (' || split_part(path, '/', 1) || ')', 1, 1 FROM doc_files, seed WHERE split_part(path, '/', 1) = split_part(p, '/', 1) AND path <> p
        UNION ALL SELECT path, CASE WHEN {parent_sql('path')} = {parent_sql('p')} AND {_test_sql('path')} THEN 'test file in the same directory' WHEN {parent_sql('path')} = {parent_sql('p')} THEN 'same directory as the seed file' ELSE 'likely test for the seed file' END, 1, 2 FROM doc_files, seed WHERE path <> p AND ({parent_sql('path')} = {parent_sql('p')} OR ({_test_sql('path')} AND contains(lower(path), lower(split_part(regexp_extract(p, '([^/]*)$', 1), '.', 1)))))"""))),
    "q8_build_pack": (_build, None),
    "s11_replace_files": (_incremental, _order("SELECT path, hash FROM now", _DOC_OLD)),
    "s12_live_edges": (_deleted, _order("SELECT DISTINCT r.src, r.dst FROM refs r JOIN symbols a ON a.id = r.src JOIN symbols b ON b.id = r.dst WHERE a.start_line % 5 <> 0 AND b.start_line % 5 <> 0")),
}

_CATALOG |= EXAMPLES

_FOLD = f"""sized AS (SELECT path, tier, CASE WHEN length(text) = 0 THEN CAST(0 AS BIGINT) ELSE greatest(1, length(text) // 4) END AS tokens FROM picked),
numbered AS (SELECT *, CASE WHEN tokens = 0 THEN 0 ELSE tokens + 8 END AS cost, row_number() OVER (ORDER BY tier, path) AS rn FROM sized),
fold AS (SELECT rn, path, tier, tokens, cost <= {R.BUDGET} AS included, CASE WHEN cost <= {R.BUDGET} THEN cost ELSE 0 END AS used FROM numbered WHERE rn = 1
 UNION ALL SELECT n.rn, n.path, n.tier, n.tokens, f.used + n.cost <= {R.BUDGET}, CASE WHEN f.used + n.cost <= {R.BUDGET} THEN f.used + n.cost ELSE f.used END FROM fold f JOIN numbered n ON n.rn = f.rn + 1)
SELECT path, tier, tokens, included FROM fold"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, plan=plan: plan(Graph(spark, sf_dir))) for name, (plan, _) in _CATALOG.items()}


def oracle_sql() -> dict[str, str]:
    out = {name: sql for name, (_, sql) in _CATALOG.items() if sql}
    out["a8_budget_fit"] = f"WITH RECURSIVE {GRAPH_SQL}, picked AS (SELECT path, 1 AS tier, text FROM doc_files), {_FOLD}"
    out["q8_build_pack"] = f"WITH RECURSIVE {GRAPH_SQL}{_CHOSEN_PATH}, picked AS (SELECT c.path, c.tier, d.text FROM chosen c JOIN doc_files d ON d.path = c.path), {_FOLD}"
    return out
