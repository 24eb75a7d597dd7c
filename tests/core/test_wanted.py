"""Scanners that are asked for some facts only, and tokens that are read in one go."""

import pytest

from repograph.extract import FACTS
from repograph.extract.script import script
from repograph.operators import facts as X
from repograph.plans.examples import FILES


def _text(language):
    return tuple(x.replace("{n}", "7").replace("{m}", "52") for x in FILES[language])


@pytest.mark.parametrize("language", sorted(FILES))
@pytest.mark.parametrize("wanted", [*sorted(FACTS)])
def test_wanted_facts_are_those_of_a_whole_scan(language, wanted):
    path, text = _text(language)
    assert list(X._rows(path, language, text, frozenset([wanted]))) == [r for r in X._rows(path, language, text) if r[1] == wanted]


def test_extract_gives_wanted_facts_only(spark):
    files = spark.createDataFrame([(*_text(k), k) for k in FILES], "path string, text string, language string")
    assert {r.fact for r in X.extract(files, "import", "supertype").select("fact").collect()} == {"import", "supertype"}


@pytest.mark.parametrize("source", ["a = b / c / d;\nclass A {}", "f(/[/]'/);\nclass A {}", "`${class B {}}`;\nclass A {}", "const x = <b>it's</b>;\nclass A {}", "a<b;class A {}"])
def test_doubtful_tokens_are_read_one_by_one(source):
    assert "A" in [s[0] for s in script(source, False, True).symbols]
