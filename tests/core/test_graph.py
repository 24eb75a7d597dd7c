from pyspark.sql import functions as F

from repograph.functions import paths as P
from repograph.operators import ranking as R
from repograph.operators import resolve as J

SYMBOLS = "file_path string, name string, kind string, start_line int, end_line int, id string"


def _symbols(spark, *rows):
    return spark.createDataFrame([(p, n, k, a, a + 1, f"sym:{p}#{k}#{n}#{a}") for p, n, k, a in rows], SYMBOLS)


def test_token_estimates(spark):
    df = spark.createDataFrame([("",), ("ab",), ("abcd",), ("x" * 400,)], "t string")
    assert [r[0] for r in df.select(P.estimate_tokens(F.col("t"))).collect()] == [0, 1, 1, 100]


def test_names_below_the_referrers_directory_win_at_a_slash(spark):
    s = _symbols(spark, ("src/a.rs", "use", "function", 1), ("src/b.rs", "Foo", "struct", 1), ("src2/c.rs", "Foo", "struct", 1))
    raw = spark.createDataFrame([("src/a.rs", "use", "Foo")], "file_path string, from string, to string")
    assert [r.dst for r in J.resolve_references(raw, s).collect()] == ["sym:src/b.rs#struct#Foo#1"]


def test_ambiguous_names_link_to_all_and_unknown_ones_to_none(spark):
    s = _symbols(spark, ("c/a.rs", "use", "function", 1), ("a/b.rs", "Foo", "struct", 1), ("b/c.rs", "Foo", "struct", 1))
    raw = spark.createDataFrame([("c/a.rs", "use", "Foo"), ("c/a.rs", "use", "Bar")], "file_path string, from string, to string")
    assert J.resolve_references(raw, s).count() == 2


def test_a_smaller_file_goes_in_after_one_that_did_not_fit(spark):
    df = spark.createDataFrame([("a", 0, 10), ("b", 0, 100), ("c", 0, 5)], "path string, tier int, tokens long")
    got = {r.path: r.included for r in R.budget_fit(df, 40).collect()}
    assert got == {"a": True, "b": False, "c": True}


def test_nearest_owner(spark):
    files = spark.createDataFrame([("a/b/c.cs",), ("x.cs",)], "path string")
    m = spark.createDataFrame([("p.csproj",), ("a/p.csproj",), ("ab/p.csproj",)], "manifest string")
    assert dict(J.nearest_owner(files, m).collect()) == {"a/b/c.cs": "a/p.csproj", "x.cs": "p.csproj"}


def test_cascade_is_the_same_as_trying_each_pair(spark):
    """Scopes chosen by least and greatest ids, against a loop over all symbols; names of one, own and repeated declarations."""
    paths = ("a.rs", "x/a.rs", "x/b.rs", "x/y/c.rs", "xy/d.rs")
    names = ("f", "g", "h", "I")
    rows = [(p, n, "trait" if n == "I" else "struct", line) for i, p in enumerate(paths) for j, n in enumerate(names) for line in range(1, 1 + (i * 3 + j * 5) % 4)]
    s = _symbols(spark, *rows, *rows[:2])
    raw = [(p, a, b, h) for p in paths for a in names for b in (*names, "none") for h in ("unknown", "inherits")[: 1 + len(p) % 2]]
    symbols = [(p, n, k, f"sym:{p}#{k}#{n}#{a}") for p, n, k, a in rows]
    want = set()
    for p, a, b, h in raw:
        src = min(((line, f"sym:{q}#{k}#{n}#{line}") for q, n, k, line in rows if (q, n) == (p, a)), default=(0, None))[1]
        folder = p.rpartition("/")[0]
        all_of = [(q, k, i) for q, n, k, i in symbols if n == b and i != src] if src else []
        near = [x for x in all_of if x[0] == p] or [x for x in all_of if folder and x[0].startswith(folder + "/")] or all_of
        want |= {(src, i, h if h != "unknown" else "implements" if k == "trait" else "inherits") for _, k, i in near}
    df = spark.createDataFrame(raw + raw[:5], "file_path string, from string, to string, hint string")
    got = [tuple(r) for r in J.resolve_supertypes(df, s).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    refs = [tuple(r) for r in J.resolve_references(df, s).collect()]
    assert len(refs) == len(set(refs)) and set(refs) == {x[:2] for x in want}
    alive = s.filter("start_line != 1")
    kept = [tuple(r) for r in J.resolve_references(df, s, alive=alive).collect()]
    ids = {r.id for r in alive.collect()}
    assert len(kept) == len(set(kept)) and set(kept) == {x[:2] for x in want if x[0] in ids and x[1] in ids}
    assert {r.dst for r in J.resolve_references(df, s, "G").collect()} == {x[1] for x in want if "#g#" in x[1]}
