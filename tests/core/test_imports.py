"""Imports read without tokens, where only they are wanted, and resolved once a name."""

import importlib
from pathlib import Path

import pytest

from repograph.operators import resolve as J
from repograph.plans import catalog
from repograph.plans.examples import FILES

DATA = Path("/root/testdata/sf0.001")
IMPORT = frozenset(["import"])
READERS = {k: importlib.import_module(f"repograph.extract.{k}") for k in ("script", "csharp")}


def _read(language, source, wanted):
    if language == "csharp":
        return READERS["csharp"].csharp(source, wanted).imports
    return READERS["script"].script(source, language == "typescript", language == "javascript", False, wanted).imports


@pytest.mark.parametrize("language", ["typescript", "javascript", "csharp"])
def test_plain_imports_need_no_tokens(monkeypatch, language):
    text = FILES[language][1].replace("{n}", "7").replace("{m}", "52")
    want = _read(language, text, IMPORT | {"symbol"})
    for module in READERS.values():
        monkeypatch.setattr(module, "_Reader", None)
    assert want and _read(language, text, IMPORT) == want


@pytest.mark.parametrize("language", ["typescript", "javascript"])
@pytest.mark.parametrize("source", [
    "import a, { b as c,\n d } from \"x/y\";import'z';import * as q from '@s/t/u'", "foo.import\n{ a } from 'x'", "// import a from 'x'\n/* import 'y' */ 'import \"z\"';", "a. // b\nimport c from 'x'",
    "import(\"x\"); import.meta.url; import { a, // b\n c } from 'y'", "import type { A } from 'x'; import b = require('y'); import c from './z'", "const a = require('x'), b = f(require(\"y\").z), c = d.require('w')", "function require(a) {}\nclass A { require('x') {} }",
    "`${import('x')}`; import a from 'y'", "const a = b / 2; import c from 'x'; d = e / 3", "const a = <b>import c from 'x'</b>", "import a\nimport b from 'x'", "1.import\n'x'", "#import; @import 'x'; $import; import '' ; it's; import b from 'y'", "const a = require('x' + 'y'); b = require(`z`)",
])
def test_imports_are_those_of_tokens(language, source):
    assert _read(language, source, IMPORT) == _read(language, source, IMPORT | {"reference"})


@pytest.mark.parametrize("source", ["using A;\nusing B . C ;\nclass D { void E() { using (F) { } } }", "// using X;\nusing static A.B;\nusing C = D.E;\nusing F;", "namespace N { using A; class B { } using C; }", "global using A;\nusing B;", "using A;\n#region x\nusing B;\n", "using (var a = b) { }", "record R(int A);\nusing B;"])
def test_directives_are_those_of_tokens(source):
    assert _read("csharp", source, IMPORT) == _read("csharp", source, IMPORT | {"symbol"})


def test_packages_of_imports(spark):
    imports = spark.createDataFrame([("a.ts", "typescript", "x.y"), ("a.ts", "typescript", "x"), ("b.js", "javascript", "x"), ("c.cs", "csharp", "x.y.z"), ("c.cs", "csharp", "x.y.w"), ("c.cs", "csharp", "xy"), ("d.rs", "rust", "x"), ("c.cs", "csharp", "x")], "file_path string, language string, package string")
    packages = spark.createDataFrame([("npm", "x", "1"), ("nuget", "x", "2"), ("nuget", "x.y", "3"), ("nuget", "x.y", "4"), ("npm", "x.y.z", "5")], "ecosystem string, name string, id string")
    got = [tuple(r) for r in J.resolve_imports(imports, packages).collect()]
    assert sorted(got) == [("a.ts", "1"), ("b.js", "1"), ("c.cs", "2"), ("c.cs", "3"), ("c.cs", "4")]


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")
def test_import_files_are_made_once(spark):
    """They were made again for their languages, and packages were read for each ecosystem and pattern."""
    plan = catalog.queries()["j6_resolve_imports"](spark, str(DATA))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [p_partkey") == 1


def test_references_need_no_exports_or_clauses(monkeypatch):
    """Exports tell what is exported, clauses what is imported: nothing of calls and types."""
    reader, text = READERS["script"]._Reader, FILES["typescript"][1] + "export { a as b };\nexport default c;\nconst d = require('e');\n"
    want = READERS["script"].script(text, True, False).references
    for name in ("export", "imports", "specifier"):
        monkeypatch.setattr(reader, name, None)
    assert want and READERS["script"].script(text, True, False, False, frozenset(["reference"])).references == want


@pytest.mark.parametrize("source", ["#!/usr/bin/env node\nclass A {}", "/* a */ // b\nclass A { $b = .5; c = '\\'d'; #e = ...f }", "class A {} ' \" @ # $", "/* class B {}"])
def test_tokens_in_one_go_are_those_one_by_one(source):
    lexer = READERS["script"]._Lexer
    one, t = lexer(source, False), lexer(source, False).read()
    one.run()
    assert (t.text, t.kind) == (one.t.text, one.t.kind) and t.begin[: len(t)] == one.t.begin and t.stop[: len(t)] == one.t.stop
