"""Selection: best candidate per file, and the greedy fit to a budget."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from .joins import shuffled

BUDGET = 40_000
#: Parts in which rows of one cost are ranked first.
PARTS = 64


def candidates(df: DataFrame, order: int, tier: int, reason, explicit: bool, within: list[str] | None = None) -> DataFrame:
    """path, tier, explicit, reason, seq: one generator's rows; seq says in what order they were generated."""
    inner = F.concat_ws("\u0001", *[F.col(c).cast("string") for c in (within or ["path"])])
    reason = F.lit(reason) if isinstance(reason, str) else reason
    return df.select("path", F.lit(tier).alias("tier"), F.lit(explicit).alias("explicit"), reason.alias("reason"), F.struct(F.lit(order).alias("g"), inner.alias("k")).alias("seq"))


def keep(found: DataFrame, include_tests: bool = False, include_config: bool = False) -> DataFrame:
    path, explicit = F.col("path"), F.col("explicit")
    out = found.filter(~P.is_generated(path)).filter(~P.is_lockfile(path) | explicit)
    out = out if include_tests else out.filter(~P.is_test_file(path) | explicit)
    return out if include_config else out.filter(~P.is_config_file(path) | explicit)


def select_best(found: DataFrame, files: DataFrame) -> DataFrame:
    """path, tier, reason: of each indexed file the candidate of least tier, the earliest of equals."""
    best = found.groupBy("path").agg(F.min(F.struct("tier", "seq", "reason")).alias("b"))
    return best.join(shuffled(files.select("path")), "path", "left_semi").select("path", "b.tier", "b.reason").orderBy("tier", "path")


def finalize(items: DataFrame, files: DataFrame, ceiling: int = 1) -> DataFrame:
    """path, reason, depth: of each indexed file the item of least depth, then most specific reason, then earliest."""
    w = Window.partitionBy("path").orderBy("depth", F.desc("rg_s"), "seq", "reason")
    near = items.join(shuffled(files.select("path")), "path", "left_semi").filter((F.col("depth") == 0) | (F.col("depth") <= ceiling)).withColumn("rg_s", P.specificity(F.col("reason")))
    return near.withColumn("rg_n", F.row_number().over(w)).filter("rg_n = 1").select("path", "reason", "depth").orderBy("depth", "path")


def _first_of_each_cost(rows: DataFrame, budget: int) -> DataFrame:
    """Of the rows of each cost c the first budget // c by (tier, path).

    What is left of the budget never grows, so the rows of one cost that go in are its first ones, and no
    more of them fit. That leaves about budget * ln(budget) rows, however many there were. Ranked twice, in
    parts of each cost first, so that no task sorts all rows of a hot cost.
    """
    out = rows.withColumn("rg_part", F.pmod(F.xxhash64("path"), F.lit(PARTS)))
    for by in (["cost", "rg_part"], ["cost"]):
        out = out.withColumn("rg_n", F.row_number().over(Window.partitionBy(*by).orderBy("tier", "path"))).filter(F.col("rg_n") * F.col("cost") <= budget)
    return out.select("tier", "path", "cost")


def budget_fit(chosen: DataFrame, budget: int = BUDGET) -> DataFrame:
    """path, tier, tokens, included of chosen (path, tier, tokens): each file in (tier, path) order goes in if it still fits.

    A later smaller file may go in after one that didn't, so this is a fold, over (tier, path, cost) of the
    rows that can go in at all (_first_of_each_cost): one linear pass of one task over a number of rows that
    the budget bounds. Files without tokens cost nothing and go in. Paths are distinct.
    """
    cost = P.file_cost(F.col("tokens"))
    rows = chosen.select("tier", "path", cost.alias("cost")).filter((F.col("cost") > 0) & (F.col("cost") <= budget))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = budget
        for batch in batches:
            keep = []
            for i, c in enumerate(batch.column(2).to_pylist()):
                if c <= left:
                    left -= c
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())).cast(pa.int32()), batch.column(1).take(pa.array(keep, pa.int64()))], names=["rg_tier", "rg_path"])

    ordered = _first_of_each_cost(rows, budget).coalesce(1).sortWithinPartitions("tier", "path")
    fits = ordered.mapInArrow(fold, "rg_tier int, rg_path string").select(F.col("rg_tier").cast(chosen.schema["tier"].dataType), "rg_path", F.lit(True).alias("rg_in"))
    # at most budget / (PER_FILE_TOKENS + 1) rows
    small = F.broadcast(fits) if budget <= 1_000_000 else fits
    met = chosen.join(small, (F.col("tier") == F.col("rg_tier")) & (F.col("path") == F.col("rg_path")), "left")
    return met.select("path", "tier", "tokens", F.coalesce("rg_in", cost == 0, F.lit(False)).alias("included"))
