"""Operator 10: shards that all match the mixture, by proportional stratified interleaving."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, small

SHARDS, SEED = 64, 17
#: Rows of a range, about: a source (and the line of all rows) is cut by its shuffle hash into ranges that are ranked apart, so no task sorts a whole source.
RANGE_ROWS = 1_000_000


def _offsets(counts: DataFrame, by: list[str], order: str) -> DataFrame:
    """Adds to each range's count how many rows lie in the ranges before it."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("rg_before", F.coalesce(F.sum("rg_n").over(w), F.lit(0)))


def shard_rows(rows: DataFrame, n_shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """doc_id, source, shard, position for every row.

    Within each source rows are ordered by md5(seed:doc_id:occurrence); rank r of n has the fraction
    (2r - 1) / 2n. All rows are ordered by fraction, source, rank; position counts from 0 and shard is
    floor(position * n_shards / rows). So each shard holds each source within one row of its share
    (two where the cuts fall badly), and any prefix of shards is a sample of the mixture.

    Nulls: a null source is a source of its own, sorted first; a null doc_id hashes as 'null'.
    Repeated rows: the occurrences of a doc_id are numbered and placed apart. Fewer rows than shards
    leave shards empty; no rows give no rows. Other columns, whatever their names, are not read.
    """
    digits, n = 2, rows.count()
    while n > RANGE_ROWS * 16**digits:
        digits += 1
    occurrence = Window.partitionBy("doc_id", "source").orderBy("doc_id")
    base = (
        rows.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"))
        .withColumn("rg_occ", F.row_number().over(occurrence))
        .withColumn("rg_key", F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("rg_occ").cast("string"))))
        .withColumn("rg_range", F.substring("rg_key", 1, digits))
        .withColumn("rg_src", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("")))
    )
    per = _offsets(base.groupBy("rg_src", "rg_range").agg(F.count("*").alias("rg_n")), ["rg_src"], "rg_range")
    per = per.withColumn("rg_of", F.sum("rg_n").over(Window.partitionBy("rg_src"))).drop("rg_n")
    inner = Window.partitionBy("rg_src", "rg_range").orderBy("rg_key", "doc_id", "rg_occ")
    ranked = base.join(per, ["rg_src", "rg_range"]).withColumn("rg_rank", F.col("rg_before") + F.row_number().over(inner)).drop("rg_before")
    # the fraction falls in one of many equal ranges of the line; positions are counted range by range
    ranges = 16**digits
    ranked = ranked.withColumn("rg_cell", F.expr(f"cast((2 * rg_rank - 1) * {ranges} div (2 * rg_of) as int)"))
    cells = _offsets(ranked.groupBy("rg_cell").agg(F.count("*").alias("rg_n")).withColumn("rg_all", F.lit(0)), ["rg_all"], "rg_cell")
    cells = cells.withColumn("rg_total", F.sum("rg_n").over(Window.partitionBy("rg_all"))).select("rg_cell", "rg_before", "rg_total")
    line = Window.partitionBy("rg_cell").orderBy(F.expr("(2 * rg_rank - 1) / (2 * rg_of)"), "rg_src", "rg_rank")
    return (
        ranked.join(small(cells, 32, ranges), "rg_cell")
        .withColumn("position", F.col("rg_before") + F.row_number().over(line) - 1)
        .select("doc_id", "source", F.expr(f"cast(position * {n_shards} div rg_total as int)").alias("shard"), "position", F.col("rg_occ").alias("occurrence"))
    )


def shard_documents(docs: DataFrame, n_shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """docs with shard and position, every other column kept (an input column of either name is replaced).

    Texts move once, to meet their position; ranks are worked out over ids and sources alone. Nulls, ties,
    repeated rows and an empty table are as in shard_rows().
    """
    kept = [c for c in docs.columns if c not in ("shard", "position")]
    names = {c: f"rg_{uuid.uuid4().hex}" for c in ("id", "source", "occurrence", "o")}
    occurrence = Window.partitionBy("doc_id", "source").orderBy("doc_id")
    left = docs.select(*kept).withColumn(names["occurrence"], F.row_number().over(occurrence))
    places = shard_rows(docs, n_shards, seed).select(F.col("doc_id").alias(names["id"]), F.col("source").alias(names["source"]), F.col("occurrence").alias(names["o"]), "shard", "position")
    met = left["doc_id"].eqNullSafe(places[names["id"]]) & left["source"].eqNullSafe(places[names["source"]]) & (left[names["occurrence"]] == places[names["o"]])
    return left.join(places, met).select(*kept, "shard", "position")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(documents(spark, sf_dir)).drop("occurrence")


OP10_SQL = f"""
WITH o AS (SELECT doc_id, source, row_number() OVER (PARTITION BY doc_id, source) AS occ FROM documents),
k AS (SELECT *, md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || occ) AS key FROM o),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY key, doc_id, occ) AS rank, count(*) OVER (PARTITION BY source) AS n FROM k),
p AS (SELECT *, row_number() OVER (ORDER BY (2 * rank - 1) / (2 * n), coalesce('s' || source, ''), rank) - 1 AS position, count(*) OVER () AS total FROM r)
SELECT doc_id, source, CAST(position * {SHARDS} // total AS INTEGER) AS shard, CAST(position AS BIGINT) AS position FROM p
"""
