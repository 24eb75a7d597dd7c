"""Operator 4: mixing sources to target weights by pivotal dependent rounding over a reduction tree."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, mix, staged

#: Shares go as rows ** TEMPERATURE: below 1 the hot source gives way to the small ones.
TEMPERATURE, SEED = 0.7, 29
#: Units that one leaf of the tree rounds, about, and how many residuals a node combines.
LEAF_UNITS, FAN_IN = 4096, 64

_RESULT = "source string, node long, doc_id long, p double, copies int, open boolean"


def _draws(ids: np.ndarray, level: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = mix(ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 1_000_003 + level * 7919 + 1))
    return (h >> np.uint64(11)).astype(np.float64) / 2.0**53


def pivot(p: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, int]:
    """(rounded values, index of the one still fractional or -1).

    Unit after unit meets the survivor: if their sum is under 1, one takes it all and the other gets 0;
    otherwise one gets 1 and the other the rest. Each choice keeps both expectations.
    """
    out = p.astype(np.float64).copy()
    live = -1
    for i, x in enumerate(p.tolist()):
        if x <= 1e-12 or x >= 1 - 1e-12:
            out[i] = round(x)
            continue
        if live < 0:
            live = i
            continue
        a, total, u = out[live], out[live] + x, draws[i]
        if total < 1 - 1e-12:
            if u * total < a:
                out[live], out[i] = total, 0.0
            else:
                out[live], out[i], live = 0.0, total, i
        elif total <= 1 + 1e-12:
            out[live], out[i], live = (1.0, 0.0, -1) if u < a else (0.0, 1.0, -1)
        else:
            rest = total - 1
            if u * (2 - total) < 1 - x:
                out[live], out[i], live = 1.0, rest, i
            else:
                out[live], out[i] = rest, 1.0
    return out, live


def _node(level: int, seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id", kind="stable")
        ids = pdf.doc_id.to_numpy(np.int64)
        out, live = pivot(pdf.p.to_numpy(np.float64), _draws(ids, level, seed))
        still = np.zeros(len(out), bool)
        if live >= 0:
            still[live] = True
        return pd.DataFrame({"source": pdf.source, "node": pdf.node // FAN_IN, "doc_id": ids, "p": out, "copies": np.where(still, 0, np.rint(out)).astype(np.int32), "open": still})

    return run


def copy_counts(docs: DataFrame, weights: dict[str | None, float] | None = None, total: int | None = None, temperature: float = TEMPERATURE, seed: int = SEED) -> DataFrame:
    """doc_id, source, copies: how often each document is to appear in the mixture.

    A source of n documents with share w of `total` (default: as many as there are) gives each of its
    documents total * w / n copies: the whole part for certain, the fraction by pivotal rounding, so a
    source's copies sum to its target within one and every document's expected copies are exact.
    weights: share by source (they need not sum to 1; an unnamed source gets 0); by default
    n ** temperature. Residuals of leaves meet in a tree of FAN_IN until one is left per source.
    Draws depend on doc_id and seed alone, so a recomputed task gives the same rows.

    A null source is a source of its own. Rows that share doc_id and source are one unit, decided once;
    a null doc_id is such a unit too. Empty input gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    units = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source")).distinct()
    sizes = {r.source: r.n for r in units.groupBy("source").agg(F.count("*").alias("n")).toLocalIterator()}
    if not sizes:
        return spark.createDataFrame([], "doc_id long, source string, copies int")
    total = sum(sizes.values()) if total is None else total
    share = {s: (n**temperature if weights is None else max(0.0, float(weights.get(s, 0.0)))) for s, n in sizes.items()}
    whole = sum(share.values()) or 1.0
    plan = pd.DataFrame({"s": list(sizes), "rate": [total * share[s] / whole / n for s, n in sizes.items()], "leaves": [max(1, -(-n // LEAF_UNITS)) for n in sizes.values()]})
    plan_df = spark.createDataFrame(list(plan.itertuples(index=False, name=None)), "s string, rate double, leaves long")
    # the sentinel stands for a null id inside the tree
    null_id = F.lit(-(2**63))
    rated = units.join(F.broadcast(plan_df) if len(plan) <= 100_000 else plan_df, units["source"].eqNullSafe(plan_df["s"])).select(
        "source", F.coalesce("doc_id", null_id).alias("doc_id"), F.floor("rate").cast("int").alias("base"), (F.col("rate") - F.floor("rate")).alias("p"), F.expr("pmod(xxhash64(doc_id), leaves)").alias("node")
    )
    leaves = rated.groupBy("source", "node").applyInPandas(_node_with_base(seed), _RESULT + ", base int")
    leaves = staged(leaves, "mix-leaves")
    done = leaves.filter(~F.col("open")).select("source", "doc_id", (F.col("base") + F.col("copies")).alias("copies"))
    level_df, width, level = leaves.filter("open"), int(plan.leaves.max()), 1
    parts = [done]
    bases = leaves.filter("open").select("source", "doc_id", "base")
    closed = []
    while width > 1:
        step = staged(level_df.select("source", "node", "doc_id", "p").groupBy("source", "node").applyInPandas(_node(level, seed), _RESULT), "mix-node")
        closed.append(step.filter(~F.col("open")).select("source", "doc_id", "copies"))
        level_df, width, level = step.filter("open"), -(-width // FAN_IN), level + 1

    def last(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            u = _draws(pdf.doc_id.to_numpy(np.int64), 999, seed)
            yield pd.DataFrame({"source": pdf.source, "doc_id": pdf.doc_id, "copies": (u < pdf.p).astype("int32")})

    closed.append(level_df.select("source", "doc_id", "p").mapInPandas(last, "source string, doc_id long, copies int"))
    decided = closed[0]
    for c in closed[1:]:
        decided = decided.unionByName(c)
    b = bases.select(F.col("source").alias("bs"), F.col("doc_id").alias("bd"), "base")
    parts.append(decided.join(b, decided["source"].eqNullSafe(b["bs"]) & (decided["doc_id"] == b["bd"])).select("source", "doc_id", (F.col("base") + F.col("copies")).alias("copies")))
    return parts[0].unionByName(parts[1]).select(F.when(F.col("doc_id") != null_id, F.col("doc_id")).alias("doc_id"), "source", F.col("copies").cast("int").alias("copies"))


def _node_with_base(seed: int):
    inner = _node(0, seed)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id", kind="stable")
        return inner(pdf).assign(base=pdf.base.to_numpy())

    return run


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """docs with each row repeated as copy_counts() says (0: it goes); columns as they were, whatever their names.

    Nulls, repeated rows and an empty table are as in copy_counts(); texts move once, unread.
    """
    names = {c: f"rg_{uuid.uuid4().hex}" for c in ("id", "source", "copies", "copy")}
    counts = copy_counts(docs, **options).filter("copies > 0").select(F.col("doc_id").alias(names["id"]), F.col("source").alias(names["source"]), F.col("copies").alias(names["copies"]))
    met = docs.join(counts, docs["doc_id"].cast("long").eqNullSafe(counts[names["id"]]) & docs["source"].cast("string").eqNullSafe(counts[names["source"]]))
    return met.withColumn(names["copy"], F.explode(F.sequence(F.lit(1), F.col(names["copies"])))).select(*[met[c] for c in docs.columns])


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copy_counts(documents(spark, sf_dir))
