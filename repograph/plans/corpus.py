"""Graph tables over the driver's tables, in Spark and (GRAPH_SQL) in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators.joins import shuffled

EXTENSIONS = (".rs", ".ts", "_test.py", ".json", "Tests.cs", ".min.js", ".md", ".yaml", ".tsx", ".go")
KINDS, LANGS = ("class", "interface", "struct", "trait", "function"), ("rust", "csharp", "typescript", "go")
HINTS, ECOSYSTEMS, IMPORTERS = ("inherits", "implements", "unknown"), ("npm", "nuget"), ("typescript", "csharp", "rust")


def pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index % len(values) + 1).cast("int"))


def _file() -> Column:
    """A part's file, one or two folders deep."""
    deep = F.when(F.col("p_size") % 3 == 0, "/").otherwise("/sub/")
    return F.concat("p_brand", deep, "p_type", F.lit(".rs"))


_FILE_SQL = "p_brand || CASE WHEN p_size % 3 = 0 THEN '/' ELSE '/sub/' END || p_type || '.rs'"


class Graph:
    """Each table is a plan over the tables of one directory; nothing is read before it is used."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def doc_files(self) -> DataFrame:
        path = F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), pick(EXTENSIONS, F.col("doc_id")))
        return self.table("documents").select("doc_id", path.alias("path"), "text").select("doc_id", "path", P.language(F.col("path")).alias("language"), "text")

    def symbols(self) -> DataFrame:
        rows = self.table("part").select(
            F.col("p_name").alias("name"), pick(KINDS, F.col("p_size")).alias("kind"), pick(LANGS, F.col("p_size")).alias("language"),
            _file().alias("file_path"), F.col("p_partkey").alias("start_line"), (F.col("p_partkey") + F.col("p_size")).alias("end_line"),
        )
        return rows.withColumn("id", P.symbol_id(F.col("file_path"), F.col("kind"), F.col("name"), F.col("start_line")))

    def files(self) -> DataFrame:
        return self.symbols().select(F.col("file_path").alias("path")).distinct()

    def projects(self) -> DataFrame:
        brand = self.table("part").select("p_brand").distinct()
        manifest = F.concat("p_brand", F.lit("/proj.csproj"))
        return brand.select(P.project_id(manifest).alias("id"), F.col("p_brand").alias("name"), manifest.alias("path"))

    def contains(self) -> DataFrame:
        return self.files().select(P.project_id(F.concat(F.split_part("path", F.lit("/"), F.lit(1)), F.lit("/proj.csproj"))).alias("project_id"), "path")

    def packages(self) -> DataFrame:
        s = self.table("supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), pick(ECOSYSTEMS, F.col("s_nationkey")).alias("ecosystem"))
        version = F.when(F.col("key") % 5 == 0, "").otherwise(F.concat(F.lit("1."), F.col("key").cast("string"), F.lit(".0")))
        return s.select("key", "name", "ecosystem", version.alias("version"), P.package_id(F.col("ecosystem"), F.col("name")).alias("id"))

    def lines(self) -> DataFrame:
        p = self.table("part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand", _file().alias("file_path"))
        return self.table("lineitem").join(shuffled(p), "l_partkey")

    def uses_package(self) -> DataFrame:
        rows = self.lines().select("p_brand", F.col("l_suppkey").alias("key")).distinct().join(shuffled(self.packages()), "key")
        return rows.select(P.project_id(F.concat("p_brand", F.lit("/proj.csproj"))).alias("src"), F.col("id").alias("dst")).distinct()

    def raw_imports(self) -> DataFrame:
        rows = self.lines().filter("l_linenumber = 1").select("file_path", F.col("l_suppkey").alias("key"), pick(IMPORTERS, F.col("l_partkey")).alias("language")).distinct()
        return rows.join(shuffled(self.packages().select("key", F.col("name").alias("package"))), "key").select("file_path", "language", "package").distinct()

    def raw_references(self) -> DataFrame:
        w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
        return self.lines().select("file_path", F.col("p_name").alias("from"), F.lead("p_name").over(w).alias("to")).filter("to IS NOT NULL").distinct()

    def raw_supertypes(self) -> DataFrame:
        part = self.table("part")
        n = part.agg(F.count("*").alias("n"))
        child = part.crossJoin(F.broadcast(n)).select(_file().alias("file_path"), F.col("p_name").alias("from"), ((F.col("p_partkey") * 7 + 3) % F.col("n")).alias("k"), pick(HINTS, F.col("p_size")).alias("hint"))
        return child.join(shuffled(part.select(F.col("p_partkey").alias("k"), F.col("p_name").alias("to"))), "k").select("file_path", "from", "to", "hint").distinct()


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def language_sql(path: str) -> str:
    ext = rf"regexp_extract(lower({path}), '[^/]\.([^./]+)$', 1)"
    return "CASE " + " ".join(f"WHEN {ext} IN ({', '.join(repr(e) for e in ends)}) THEN '{n}'" for n, ends in P.LANGUAGES.items()) + " ELSE 'other' END"


def low(x: str) -> str:
    return f"translate({x}, '{P.UPPER}', '{P.LOWER}')"


def parent_sql(x: str) -> str:
    return f"regexp_extract({x}, '^(.*)/[^/]*$', 1)"


def cascade_sql(raw: str, extra: str = "") -> str:
    """CTEs that end in `met` (src, to, extra, dst, t_kind)."""
    e = f", {extra}" if extra else ""
    same = "AND x.src = y.src AND x.\"to\" = y.\"to\"" + (f" AND x.{extra} = y.{extra}" if extra else "")
    return f"""
    decl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_path, name ORDER BY start_line, end_line, id) AS nth FROM symbols) WHERE nth = 1),
    base AS (SELECT DISTINCT d.id AS src, r."to", r.file_path{e} FROM {raw} r JOIN decl d ON d.file_path = r.file_path AND d.name = r."from" WHERE r."from" <> ''),
    e0 AS (SELECT b.src, b."to", b.file_path{e}, s.id AS dst, s.kind AS t_kind FROM base b JOIN symbols s ON s.name = b."to" AND s.file_path = b.file_path AND s.id <> b.src),
    r1 AS (SELECT * FROM base x WHERE NOT EXISTS (SELECT 1 FROM e0 y WHERE true {same})),
    e1 AS (SELECT b.src, b."to", b.file_path{e}, s.id AS dst, s.kind AS t_kind FROM r1 b JOIN symbols s ON s.name = b."to" AND s.id <> b.src AND {parent_sql("b.file_path")} <> '' AND starts_with(s.file_path, {parent_sql("b.file_path")} || '/')),
    r2 AS (SELECT * FROM r1 x WHERE NOT EXISTS (SELECT 1 FROM e1 y WHERE true {same})),
    e2 AS (SELECT b.src, b."to", b.file_path{e}, s.id AS dst, s.kind AS t_kind FROM r2 b JOIN symbols s ON s.name = b."to" AND s.id <> b.src),
    met AS (SELECT * FROM e0 UNION ALL SELECT * FROM e1 UNION ALL SELECT * FROM e2)"""


GRAPH_SQL = f"""
doc_files AS (SELECT doc_id, path, {language_sql("path")} AS language, text FROM (SELECT doc_id, concat(source, '/', lang, '/doc_', doc_id, {_list(EXTENSIONS)}[doc_id % 10 + 1]) AS path, text FROM documents)),
symbols AS (SELECT name, kind, language, file_path, start_line, end_line, 'sym:' || file_path || '#' || kind || '#' || name || '#' || start_line AS id FROM (
    SELECT p_name AS name, {_list(KINDS)}[p_size % 5 + 1] AS kind, {_list(LANGS)}[p_size % 4 + 1] AS language, {_FILE_SQL} AS file_path, p_partkey AS start_line, p_partkey + p_size AS end_line FROM part)),
files AS (SELECT DISTINCT file_path AS path FROM symbols),
projects AS (SELECT DISTINCT 'proj:' || p_brand || '/proj.csproj' AS id, p_brand AS name, p_brand || '/proj.csproj' AS path FROM part),
contains_file AS (SELECT 'proj:' || split_part(path, '/', 1) || '/proj.csproj' AS project_id, path FROM files),
packages AS (SELECT *, 'pkg:' || ecosystem || ':' || name AS id FROM (SELECT s_suppkey AS key, s_name AS name, {_list(ECOSYSTEMS)}[s_nationkey % 2 + 1] AS ecosystem, CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE '1.' || s_suppkey || '.0' END AS version FROM supplier)),
lines AS (SELECT l.*, p_name, p_brand, {_FILE_SQL} AS file_path FROM lineitem l JOIN part ON p_partkey = l_partkey),
uses_package AS (SELECT DISTINCT 'proj:' || p_brand || '/proj.csproj' AS src, k.id AS dst FROM lines JOIN packages k ON k.key = l_suppkey),
raw_imports AS (SELECT DISTINCT file_path, {_list(IMPORTERS)}[l_partkey % 3 + 1] AS language, k.name AS package FROM lines JOIN packages k ON k.key = l_suppkey WHERE l_linenumber = 1),
raw_references AS (SELECT DISTINCT * FROM (SELECT file_path, p_name AS "from", lead(p_name) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS "to" FROM lines) WHERE "to" IS NOT NULL),
raw_supertypes AS (SELECT DISTINCT {_FILE_SQL.replace('p_', 'c.p_')} AS file_path, c.p_name AS "from", t.p_name AS "to", {_list(HINTS)}[c.p_size % 3 + 1] AS hint FROM part c JOIN part t ON t.p_partkey = (c.p_partkey * 7 + 3) % (SELECT count(*) FROM part)),
refs AS (WITH {cascade_sql("raw_references")} SELECT DISTINCT src, dst FROM met),
supers AS (WITH {cascade_sql("raw_supertypes", "hint")} SELECT DISTINCT src, dst, CASE WHEN hint <> 'unknown' THEN hint WHEN t_kind IN ('interface', 'trait') THEN 'implements' ELSE 'inherits' END AS kind FROM met)
"""
