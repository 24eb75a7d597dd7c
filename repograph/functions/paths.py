"""Path, name and text expressions; all stay inside the JVM."""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase
LANGUAGES = {
    "csharp": ("cs",), "rust": ("rs",), "python": ("py", "pyi"), "go": ("go",), "javascript": ("js", "jsx", "mjs", "cjs"), "typescript": ("ts", "tsx"),
    "svelte": ("svelte",), "bash": ("sh", "bash", "zsh"), "yaml": ("yml", "yaml"), "json": ("json",), "markdown": ("md", "markdown", "mdx"),
}
TEST_ENDS = ("tests.cs", "test.cs", "_test.go", "_test.py", ".test.rs", *(f".{k}.{e}" for e in ("ts", "tsx", "js", "jsx") for k in ("test", "spec")))
CONFIG_ENDS = (".yml", ".yaml", ".json", ".toml", ".csproj", ".props", ".targets", "package.json")
GENERATED_ENDS = (".designer.cs", ".g.cs", ".generated.cs", ".min.js", ".bundle.js", ".map")
LOCKFILES = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "cargo.lock")
PER_FILE_TOKENS = 8
FENCES = {"other": "text"}
ROUTE_ROLES = {"+page": "page", "+layout": "layout", "+server": "endpoint", "+error": "error"}
ALIASES = {"c#": "csharp", "cs": "csharp", "rs": "rust", "py": "python", "js": "javascript", "ts": "typescript", "sh": "bash", "shell": "bash", "yml": "yaml", "md": "markdown"}
KINDS = ("class", "record", "struct", "interface", "enum", "method", "constructor", "function", "trait", "module", "type", "component", "key")
KIND_ALIASES = {"func": "function", "fn": "function", "mod": "module", "typealias": "type", "ctor": "constructor"}


def _any(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts)


def file_id(path: Column) -> Column:
    return F.concat(F.lit("file:"), path)


def symbol_id(path: Column, kind: Column, name: Column, line: Column) -> Column:
    return F.concat(F.lit("sym:"), path, F.lit("#"), kind, F.lit("#"), name, F.lit("#"), line.cast("string"))


def project_id(manifest: Column) -> Column:
    return F.concat(F.lit("proj:"), manifest)


def package_id(ecosystem: Column, name: Column) -> Column:
    return F.concat(F.lit("pkg:"), ecosystem, F.lit(":"), name)


def ascii_lower(x: Column) -> Column:
    return F.translate(x, UPPER, LOWER)


def ci_contains(x: Column, needle: str) -> Column:
    return F.contains(ascii_lower(x), F.lit(needle.translate(str.maketrans(UPPER, LOWER))))


def ci_equals(x: Column, value: str) -> Column:
    return ascii_lower(x) == F.lit(value.translate(str.maketrans(UPPER, LOWER)))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def parent_dir(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def file_stem(path: Column) -> Column:
    return F.lower(F.split_part(basename(path), F.lit("."), F.lit(1)))


def language(path: Column) -> Column:
    ext = F.regexp_extract(F.lower(path), r"[^/]\.([^./]+)$", 1)
    out = F.when(F.lit(False), F.lit(""))
    for name, ends in LANGUAGES.items():
        out = out.when(ext.isin(*ends), F.lit(name))
    return out.otherwise(F.lit("other"))


def is_test_file(path: Column) -> Column:
    low, base = F.lower(path), F.lower(basename(path))
    inside = [F.contains(low, F.lit(d)) for d in ("/tests/", "/test/", "__tests__/")]
    return _any([*inside, base.startswith("test_"), *(base.endswith(e) for e in TEST_ENDS), F.contains(base, F.lit("test")) & base.endswith(".rs")])


def is_config_file(path: Column) -> Column:
    return _any([F.lower(path).endswith(e) for e in CONFIG_ENDS])


def is_generated(path: Column) -> Column:
    return _any([F.lower(path).endswith(e) for e in GENERATED_ENDS])


def is_lockfile(path: Column) -> Column:
    return F.lower(basename(path)).isin(*LOCKFILES)


def under_prefix(path: Column, prefix: str) -> Column:
    return F.lit(True) if prefix == "" else path.startswith(prefix + "/")


def estimate_tokens(text: Column) -> Column:
    n = F.length(text)
    return F.when(n == 0, F.lit(0).cast("long")).otherwise(F.greatest(F.lit(1), F.floor(n / 4)).cast("long"))


def file_cost(tokens: Column) -> Column:
    return F.when(tokens == 0, F.lit(0).cast("long")).otherwise(tokens + PER_FILE_TOKENS)


def npm_root(spec: Column) -> Column:
    """Package of an import; null for relative, absolute and empty ones."""
    scoped = F.regexp_extract(spec, "^(@[^/]*/[^/]*)", 1)
    return F.when((spec == "") | spec.startswith(".") | spec.startswith("/"), F.lit(None)).when(spec.startswith("@") & (scoped != ""), scoped).otherwise(F.split_part(spec, F.lit("/"), F.lit(1)))


def bare_type_name(x: Column) -> Column:
    return F.trim(F.regexp_extract(F.regexp_extract(x, "^[^<(]*", 0), "[^.:]*$", 0))


def heading_text(x: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(F.trim(x), "#+$", "")), r"\s+", " ")


def specificity(reason: Column) -> Column:
    typed = [F.contains(reason, F.lit(w)) for w in ("inherits", "implement", "base type", "subtype")]
    return F.when(reason.startswith("declares"), 4).when(_any([reason.startswith("references"), *typed]), 3).when(F.contains(reason, F.lit("test")) | reason.startswith("path contains"), 2).otherwise(1)


def fence_length(text: Column) -> Column:
    runs = F.transform(F.regexp_extract_all(text, F.lit("(`+)"), F.lit(1)), lambda r: F.length(r))
    return F.greatest(F.lit(2), F.coalesce(F.array_max(runs), F.lit(0))) + 1


def normal_path(path: Column) -> Column:
    """Backslashes as slashes, '.' and '..' worked out ('..' at the root stays there)."""
    step = lambda acc, x: F.when((x == "") | (x == "."), acc).when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))
    return F.array_join(F.aggregate(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), F.array().cast("array<string>"), step), "/")


def ancestors(path: Column) -> Column:
    """All directories above a path, '' first."""
    root, dir = F.array(F.lit("")), parent_dir(path)
    # the lambda is run for each level: it cuts the path, which needs no search of its own
    dirs = F.transform(F.sequence(F.lit(1), F.size(F.split(dir, "/"))), lambda i: F.call_function("substring_index", path, F.lit("/"), i))
    return F.when(dir == "", root).otherwise(F.array_distinct(F.concat(root, dirs)))


def route_role(path: Column) -> Column:
    """page, layout, endpoint or error of a route file; null of others."""
    base = F.split_part(F.lower(basename(path)), F.lit("."), F.lit(1))
    out = F.when(F.lit(False), F.lit(""))
    for name, role in ROUTE_ROLES.items():
        out = out.when(base == name, F.lit(role))
    return out


def is_jsx(path: Column) -> Column:
    return _any([F.lower(path).endswith(e) for e in (".tsx", ".jsx")])


def starts_upper(name: Column) -> Column:
    return name.rlike(r"^\p{Lu}")


def language_enabled(lang: Column, enabled: tuple[str, ...] = tuple(LANGUAGES)) -> Column:
    """Whether a language is switched on; other never is."""
    return lang.isin(*[e for e in enabled if e != "other"])


def language_named(text: Column) -> Column:
    """The language that a word names, by name or alias in any case of letters; null if it names none."""
    word = ascii_lower(text)
    out = F.when(word.isin(*LANGUAGES, "other"), word)
    for alias, name in ALIASES.items():
        out = out.when(word == alias, F.lit(name))
    return out


def kind_named(text: Column) -> Column:
    """The symbol kind that a word names; null if it names none."""
    word = ascii_lower(text)
    out = F.when(word.isin(*KINDS), word)
    for alias, name in KIND_ALIASES.items():
        out = out.when(word == alias, F.lit(name))
    return out


def fence(text: Column) -> Column:
    return F.repeat(F.lit("`"), fence_length(text))


def escape_cell(text: Column) -> Column:
    return F.replace(text, F.lit("|"), F.lit("\\|"))


def grouped(n: Column) -> Column:
    """A whole number with commas between thousands."""
    return F.format_number(n, 0)


def slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))
