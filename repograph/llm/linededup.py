"""Operator 7: line dedup by probing a sharded minimal perfect hash over all distinct lines."""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, mix, staged, work_path

#: A line that stands in so many documents stays only in the one of least doc_id.
MIN_DOCS = 2
#: Distinct lines of a shard, about; bits a key at each level of its hash.
SHARD_KEYS, GAMMA = 500_000, 2.0
#: Up to so many shards a worker probes them where the documents are; beyond that, lines travel to their shards.
CACHED_SHARDS = 64
_BLANK = " \t\r"
_NULL_ID = -(2**63)


def _slots(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
    salt = np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)
    return (mix(keys + salt) % np.uint64(bits)).astype(np.int64)


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys ^ np.uint64(0x5DEECE66D1234567)) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """A minimal perfect hash in levels of bits (Limasset et al., 2017): a key's place is the rank of the
    bit that it alone hit; keys that met others at one level go on to the next."""

    def __init__(self, sizes: list[int], bits: np.ndarray, ranks: np.ndarray) -> None:
        self.sizes, self.bits, self.ranks = sizes, bits, ranks

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, levels, rest = [], [], keys
        while len(rest):
            size = max(64, int(np.ceil(GAMMA * len(rest) / 64)) * 64)
            at = _slots(rest, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            levels.append(alone)
            rest = rest[~alone[at]]
        flat = np.concatenate(levels) if levels else np.zeros(64, bool)
        words = np.packbits(flat, bitorder="little").view(np.uint64)
        return cls(sizes, words, np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)]).astype(np.uint32))

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, -1 if it is none of the keys (or, rarely, that of another key)."""
        out = np.full(len(keys), -1, np.int64)
        rest, base = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            if not len(rest):
                break
            at = base + _slots(keys[rest], level, size)
            word, bit = self.bits[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[rest[hit]] = (self.ranks[at >> 6] + below)[hit]
            rest, base = rest[~hit], base + size
        return out


class Shard:
    """A perfect hash with the arrays it indexes: fingerprints, counts, owners."""

    def __init__(self, hashing: PerfectHash, prints: np.ndarray, counts: np.ndarray, owners: np.ndarray) -> None:
        self.hashing, self.prints, self.counts, self.owners = hashing, prints, counts, owners

    @classmethod
    def build(cls, keys: np.ndarray, counts: np.ndarray, owners: np.ndarray) -> Shard:
        h = PerfectHash.build(keys)
        at = h.places(keys)
        out = [np.empty(len(keys), t) for t in (np.uint32, np.uint32, np.int64)]
        out[0][at], out[1][at], out[2][at] = fingerprint(keys), np.minimum(counts, 2**32 - 1), owners
        return cls(h, *out)

    def write(self, path: str) -> None:
        arrays = [self.hashing.bits, self.hashing.ranks, self.prints, self.counts, self.owners]
        head = json.dumps({"sizes": self.hashing.sizes, "arrays": [[a.dtype.str, len(a)] for a in arrays]}).encode()
        head += b" " * (-(len(head) + 8) % 8)
        fs, name = pa.fs.FileSystem.from_uri(path)
        fs.create_dir(os.path.dirname(name), recursive=True)
        temporary = f"{name}.{os.getpid()}-{os.urandom(4).hex()}"
        with fs.open_output_stream(temporary) as f:
            f.write(len(head).to_bytes(8, "little") + head)
            for a in arrays:
                f.write(a.tobytes() + b"\0" * (-a.nbytes % 8))
        fs.move(temporary, name)  # a task run twice writes the same bytes

    @classmethod
    def read(cls, path: str) -> Shard:
        fs, name = pa.fs.FileSystem.from_uri(path)
        if isinstance(fs, pa.fs.LocalFileSystem):
            data = np.memmap(name, np.uint8, "r")
        else:
            with fs.open_input_file(name) as f:
                data = np.frombuffer(f.read(), np.uint8)
        n = int(data[:8].view("<u8")[0])
        head, at, arrays = json.loads(bytes(data[8 : 8 + n])), 8 + n, []
        for t, size in head["arrays"]:
            width = size * np.dtype(t).itemsize
            arrays.append(data[at : at + width].view(t))
            at += width + -width % 8
        return cls(PerfectHash(head["sizes"], arrays[0], arrays[1]), *arrays[2:])

    def probe(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(counts, owners); a key that isn't there has the count 0."""
        at = self.hashing.places(keys)
        safe = np.maximum(at, 0)
        known = (at >= 0) & (self.prints[safe] == fingerprint(keys))
        return np.where(known, self.counts[safe], 0), self.owners[safe]


@functools.lru_cache(maxsize=CACHED_SHARDS)
def _shard(path: str) -> Shard:
    return Shard.read(path)


def _keys(text: str | None) -> tuple[list[str], np.ndarray]:
    lines = (text or "").split("\n")
    return lines, np.array([xxhash.xxh3_64_intdigest(s.encode("utf-8", "surrogatepass")) if (s := x.strip(_BLANK)) else 0 for x in lines], np.uint64)


def build_index(docs: DataFrame) -> tuple[str, int]:
    """(folder, shards): files with the document count and least doc_id of every distinct line."""
    spark = docs.sparkSession

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                k = np.unique(_keys(text)[1])
                k = k[k != 0]
                keys.append(k)
                owners.append(np.full(len(k), i, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(owners))], names=["line", "doc"])

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("doc"), F.col("text").alias("text")).mapInArrow(lines, "line long, doc long")
    counted = staged(rows.distinct().groupBy("line").agg(F.count("*").alias("n"), F.min("doc").alias("owner")), "lines-counted")
    shards = max(1, -(-counted.count() // SHARD_KEYS))
    folder = work_path(spark, "lines-index")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        s = int(pdf.shard.iloc[0])
        Shard.build(pdf.line.to_numpy(np.int64).view(np.uint64), pdf.n.to_numpy(np.int64), pdf.owner.to_numpy(np.int64)).write(f"{folder}/{s}")
        return pd.DataFrame({"shard": [s], "keys": [len(pdf)]})

    numbered = counted.withColumn("shard", F.pmod("line", F.lit(shards)).cast("int"))
    numbered.groupBy("shard").applyInPandas(build, "shard int, keys long").agg(F.sum("keys")).collect()
    return folder, shards


def _without(ids: pa.Array, texts: list[str | None], split: list[tuple[list[str], np.ndarray]], drop: list[np.ndarray]) -> pa.RecordBatch:
    out: list[list] = [[], [], []]
    for text, (lines, _), gone in zip(texts, split, drop):
        n = int(gone.sum())
        out[0].append("\n".join([x for x, g in zip(lines, gone.tolist()) if not g]) if n else text)
        out[1].append(0 if text is None else len(lines))
        out[2].append(n)
    return pa.RecordBatch.from_arrays([ids, pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], names=["doc_id", "text", "n_lines", "n_removed"])


def _routed(docs: DataFrame, folder: str, shards: int, min_docs: int) -> DataFrame:
    """Lines go to the task of their shard, which is loaded once, and those to drop come back to their document's row."""
    rows = staged(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")), "lines-rows")

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, i, text in zip(*(c.to_pylist() for c in batch.columns)):
                k = np.unique(_keys(text)[1])
                k = k[k != 0].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.mod(k, shards).astype(np.int32)), pa.array(k), pa.array(np.full(len(k), row)), pa.array(np.full(len(k), _NULL_ID if i is None else i))], names=["shard", "line", "row", "doc"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, shard = -1, None
        for batch in batches:
            which, line, doc = (batch.column(i).to_numpy() for i in (0, 1, 3))
            drop = np.zeros(len(which), bool)
            for s in np.unique(which).tolist():
                if s != at:
                    at, shard = s, Shard.read(f"{folder}/{s}")
                own = np.flatnonzero(which == s)
                counts, owners = shard.probe(line[own].view(np.uint64))
                drop[own] = (counts >= min_docs) & (owners != doc[own])
            yield batch.select(["row", "line"]).filter(pa.array(drop))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            split = [_keys(t) for t in texts]
            drop = [np.isin(k.view(np.int64), np.array(gone or (), np.int64)) for (_, k), gone in zip(split, batch.column(2).to_pylist())]
            yield _without(batch.column(0), texts, split, drop)

    sent = rows.mapInArrow(lines, "shard int, line long, row long, doc long").hint("rebalance", "shard").sortWithinPartitions("shard")
    gone = sent.mapInArrow(probe, "row long, line long").groupBy("row").agg(F.collect_list("line").alias("gone"))
    return rows.join(gone, "row", "left").select("doc_id", "text", "gone").mapInArrow(cut, "doc_id long, text string, n_lines long, n_removed long")


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, text, n_lines, n_removed: documents without the lines that others repeat.

    A line (between newlines, compared without blanks at its ends) that stands in at least min_docs
    documents is removed from all of them but the one of least doc_id. Blank lines stay. Rows with one
    doc_id are one document, null ids together another; a null text stays null with no lines; an empty
    one has one line; a text of any length is read whole. Distinct lines are told apart by 64-bit hashes.
    An empty table gives no rows. Other columns, whatever their names, are not read.
    """
    folder, shards = build_index(docs)
    if shards > CACHED_SHARDS:
        return _routed(docs, folder, shards, min_docs)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids = [_NULL_ID if i is None else i for i in part.column(0).to_pylist()]
                texts = part.column(1).to_pylist()
                split = [_keys(t) for t in texts]
                keys = np.concatenate([k for _, k in split])
                owner_of = np.repeat(np.array(ids, np.int64), [len(k) for _, k in split])
                drop = np.zeros(len(keys), bool)
                # the shard is the line's signed hash modulo, as in build_index
                which = np.mod(keys.view(np.int64), shards)
                for s in np.unique(which[keys != 0]).tolist():
                    rows = np.flatnonzero((which == s) & (keys != 0))
                    counts, owners = _shard(f"{folder}/{s}").probe(keys[rows])
                    drop[rows] = (counts >= min_docs) & (owners != owner_of[rows])
                ends = np.cumsum([len(k) for _, k in split])
                yield _without(part.column(0), texts, split, np.split(drop, ends[:-1]))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(probe, "doc_id long, text string, n_lines long, n_removed long")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(documents(spark, sf_dir))


OP7_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id, {-(2**63) + 1} - 1) AS owner_id, text FROM documents),
s AS (SELECT rid, doc_id, owner_id, string_split(text, chr(10)) AS parts FROM d WHERE text IS NOT NULL),
l AS (SELECT rid, owner_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS i FROM s),
k AS (SELECT *, trim(line, chr(32) || chr(9) || chr(13)) AS key FROM l),
c AS (SELECT key, count(DISTINCT owner_id) AS n, min(owner_id) AS owner FROM k WHERE key <> '' GROUP BY key),
m AS (SELECT k.*, coalesce(c.n >= {MIN_DOCS} AND c.owner <> k.owner_id, false) AS gone FROM k LEFT JOIN c ON k.key = c.key),
j AS (SELECT rid, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone) AS kept, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed FROM m GROUP BY rid)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(j.kept, '') END AS text,
       coalesce(j.n_lines, 0) AS n_lines, coalesce(j.n_removed, 0) AS n_removed
FROM d LEFT JOIN j ON d.rid = j.rid
"""
