"""Plans of queries whose tables grow: no side collected by the driver on a guess, no table scanned for facts in one task."""

from pathlib import Path

import pytest

from repograph.plans import catalog, examples
from repograph.plans.corpus import Graph

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")
QUERIES = catalog.queries()


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["q9_index_references", "q9_index_supertypes", "j12_type_relations", "q6_related_symbol", "j6_resolve_imports", "j4_resolve_supertypes", "s12_live_edges", "j5_resolve_references", "q3_pack_symbol"])
def test_no_hash_join_by_broadcast(spark, name):
    assert "BroadcastHashJoin" not in _plan(QUERIES[name](spark, str(DATA)))


def test_counts_are_all_that_stats_broadcasts(spark):
    assert "BroadcastHashJoin" not in _plan(QUERIES["a1_stats"](spark, str(DATA)))


@pytest.mark.parametrize("language", sorted(examples.FILES))
def test_files_are_spread_over_tasks(spark, language):
    files = examples.files(Graph(spark, str(DATA)), language)
    assert files.rdd.getNumPartitions() >= examples.TASKS


@pytest.mark.parametrize("name", ["q9_index_references", "q9_index_supertypes"])
def test_an_index_run_scans_once(spark, name):
    assert "mapInArrow" not in _plan(QUERIES[name](spark, str(DATA))).replace("MapInArrow", "mapInArrow")


@pytest.mark.parametrize("name", ["j4_resolve_supertypes", "j5_resolve_references", "s12_live_edges", "a1_stats"])
def test_directories_are_made_of_grouped_files(spark, name):
    """The paths of all symbols of one scan task were taken apart in that task."""
    lines = QUERIES[name](spark, str(DATA))._jdf.queryExecution().optimizedPlan().toString().split("\n")
    for i in (i for i, line in enumerate(lines) if "Generate explode(" in line):
        table = next(j for j in range(i, len(lines)) if "Relation [" in lines[j])
        assert any("Aggregate [" in line for line in lines[i:table])
