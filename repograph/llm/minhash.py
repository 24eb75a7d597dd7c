"""Operator 2: near-duplicate documents by MinHash with tensored banding and exact verification."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import chunks, documents, mix, release, shingles, small, staged, word_hashes
from .components import components

SHINGLE, THRESHOLD = 3, 0.5
#: Each of two collections has SIDE keys of ROWS minhashes. Table (i, j) is keyed by the pair of the first
#: collection's key i and the second's key j: SIDE * SIDE tables of 2 * ROWS minhashes from 2 * SIDE * ROWS
#: minhashes (72) instead of 2 * SIDE * SIDE * ROWS (864).
SIDE, ROWS = 12, 3
#: Keys of tables that a shard compares at once, about.
SHARD_KEYS = 2_000_000


def _multipliers(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    g = np.random.Generator(np.random.PCG64(seed))
    return g.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), g.integers(1, 2**63, n, dtype=np.uint64)


def signatures(hashes: np.ndarray, bounds: np.ndarray, side: int, rows: int, k: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprints, keys, distinct shingle counts) of texts that all have words; keys: text x 2 * side."""
    # distinct as the verified sets are, so that a ratio of sizes bounds the Jaccard similarity
    parts = [np.unique(shingles(hashes[a:b], k)) for a, b in zip(bounds[:-1], bounds[1:])]
    size = np.array([len(p) for p in parts])
    first = np.cumsum(size) - size
    s = np.concatenate(parts)
    mul, xor = _multipliers(2 * side * rows, seed)
    low = np.empty((len(parts), 2 * side * rows), np.uint64)
    for h in range(len(mul)):
        low[:, h] = np.minimum.reduceat((s ^ xor[h]) * mul[h], first)
    keys = np.zeros((len(parts), 2 * side), np.uint64)
    for r in range(rows):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + low[:, r :: rows])
    return fingerprints(hashes, bounds), keys, size


def fingerprints(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """64 bits of each text's sequence of words."""
    words = np.arange(len(hashes), dtype=np.uint64) - np.repeat(bounds[:-1], np.diff(bounds)).astype(np.uint64)
    one = np.add.reduceat(hashes * mix(words * np.uint64(2) + np.uint64(1)), bounds[:-1])
    two = np.add.reduceat(mix(hashes ^ np.uint64(0xA5A5A5A5)) * mix(words * np.uint64(2)), bounds[:-1])
    return mix(one ^ mix(two))


def _worded(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, bounds, which texts) of the texts that have words."""
    hashes, bounds = word_hashes(texts)
    keep = np.flatnonzero(np.diff(bounds) > 0)
    return hashes, np.concatenate([bounds[:-1][keep], bounds[-1:]]), keep


def _sign(side: int, rows: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0).to_pylist(), dtype=np.int64)
            for start, texts in chunks(batch.column(1).to_pylist()):
                hashes, b, keep = _worded(texts)
                if not len(keep):
                    continue
                prints, keys, size = signatures(hashes, b, side, rows, k)
                flat = keys.view(np.int64)
                offsets = pa.array(np.arange(len(keep) + 1, dtype=np.int32) * side)
                half = [pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(flat[:, i * side : (i + 1) * side]).ravel())) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[start + keep]), pa.array(prints.view(np.int64)), pa.array(size.astype(np.int32)), *half], names=["doc", "node", "size", "u", "v"])

    return run


def _shingle_sets(k: int):
    """Sorted distinct shingle hashes, 4 bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in chunks(batch.column(1).to_pylist()):
                hashes, b, keep = _worded(texts)
                if len(keep):
                    sets = [np.unique((shingles(hashes[x:y], k) >> np.uint64(32)).astype(np.uint32)).tobytes() for x, y in zip(b[:-1], b[1:])]
                    yield pa.RecordBatch.from_arrays([pa.array(fingerprints(hashes, b).view(np.int64)), pa.array(sets, pa.binary())], names=["node", "set"])

    return run


def jaccard(a: bytes, b: bytes) -> float:
    x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
    if not len(x) or not len(y):
        return 0.0
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    common = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return common / (len(x) + len(y) - common)


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(2), batch.column(3)
            for at in range(0, batch.num_rows, 512):
                got = np.array([jaccard(x, y) for x, y in zip(a.slice(at, 512).to_pylist(), b.slice(at, 512).to_pylist())])
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(got >= threshold)], names=["a", "b", "near"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """a, b, near of pairs (a, b) by their shingle sets; only the sets of the pairs' nodes move."""
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    some = sets.join(small(staged(nodes, "minhash-involved"), 16), "node", "left_semi")
    both = pairs.join(some.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a").join(some.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b")
    return staged(both.select("a", "b", "sa", "sb").mapInArrow(_verify(threshold), "a long, b long, near boolean"), "minhash-verified")


def _relabelled(comp: DataFrame | None, near: DataFrame) -> DataFrame | None:
    """comp (node, comp) with the components made one that near (a, b) joins."""
    if near.isEmpty():
        return comp
    if comp is None:
        return staged(components(near.select(F.col("a").alias("src"), F.col("b").alias("dst"))).select("node", F.col("root").alias("comp")), "minhash-comp")
    of_a, of_b = (comp.select(F.col("node").alias(x), F.col("comp").alias(f"c{x}")) for x in "ab")
    edges = near.select("a", "b").join(of_a, "a", "left").join(of_b, "b", "left").select(F.coalesce("ca", "a").alias("src"), F.coalesce("cb", "b").alias("dst"))
    joined = staged(components(edges).withColumnRenamed("node", "comp"), "minhash-joined")
    moved = comp.join(joined, "comp", "left").select("node", F.coalesce("root", "comp").alias("comp"))
    return staged(moved.unionByName(joined.join(comp.select(F.col("node").alias("comp")), "comp", "left_anti").select(F.col("comp").alias("node"), F.col("root").alias("comp"))), "minhash-comp")


def table_keys(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The keys of all tables, text x side * side: table (i, j) joins key i of the one and key j of the other collection."""
    n, side = u.shape
    table = np.arange(side * side, dtype=np.uint64).reshape(1, side, side)
    return mix(mix(u[:, :, None] * np.uint64(0x9E3779B97F4A7C15) + table) ^ v[:, None, :]).reshape(n, side * side)


def _to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each batch of texts."""
    block = TaskContext.get().partitionId() << 32
    for batch in batches:
        if batch.num_rows:
            columns = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), *(batch.column(i).flatten().to_numpy() for i in (2, 3))]
            yield pa.RecordBatch.from_arrays([pa.array([block]), *(pa.array([np.ascontiguousarray(c).tobytes()], pa.binary()) for c in columns)], names=["block", "nodes", "sizes", "u", "v"])
            block += 1


def _block_keys(u: bytes, v: bytes, n: int) -> np.ndarray:
    return table_keys(*(np.frombuffer(x, np.uint64).reshape(n, -1) for x in (u, v)))


def _shard_starts(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where the keys of each shard begin among sorted keys; shards are equal ranges of the keys' upper halves."""
    shard = (keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)
    return np.searchsorted(shard, np.arange(shards + 1, dtype=np.uint64))


def _shared_keys(classes: DataFrame) -> DataFrame:
    """node, size, key of the keys that several nodes have, and of a few others (by chance one in thousands).

    Most keys are one node's alone and needn't move as rows. A block of nodes sends each shard of the keys
    the lower halves of its distinct keys there, as one value; the shard answers with a bit for each, set if
    another block sent the same. A key of a hot bucket is one entry a block, and a shard holds about
    SHARD_KEYS entries. There are never more values than keys, so this grows as the input does.
    """
    payload = ["block", "nodes", "sizes", "u", "v"]
    blocks = staged(classes.select("node", "size", "u", "v").mapInArrow(_to_blocks, "block long, nodes binary, sizes binary, u binary, v binary"), "minhash-blocks")
    shards = max(1, -(-(blocks.agg(F.sum(F.length("u").cast("double") * F.length("v") / F.length("nodes") / 8)).first()[0] or 0) // SHARD_KEYS))
    shards = int(shards)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, nodes, u, v in zip(*(batch.column(c).to_pylist() for c in ("block", "nodes", "u", "v"))):
                keys = np.unique(_block_keys(u, v, len(nodes) // 8))
                at = _shard_starts(keys, shards)
                some = np.flatnonzero(np.diff(at))
                low = keys.astype(np.uint32)
                blobs = [low[at[s] : at[s + 1]].tobytes() for s in some]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(np.full(len(some), block), pa.int64()), pa.array(blobs, pa.binary())], names=["shard", "block", "blob"])

    def answer(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, np.uint32) for x in table.column("blob").to_pylist()]
        _, back, many = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        bits = np.split((many > 1)[back], np.cumsum([len(p) for p in parts])[:-1])
        return table.set_column(2, "blob", pa.array([np.packbits(b).tobytes() for b in bits], pa.binary()))

    def shared(table: pa.Table) -> pa.Table:
        held = {s: x for s, x in zip(table.column("shard").to_pylist(), table.column("blob").to_pylist()) if s >= 0}
        own = table.column("shard").to_pylist().index(-1)
        nodes, sizes, u, v = (table.column(c)[own].as_py() for c in payload[1:])
        nodes, sizes = np.frombuffer(nodes, np.int64), np.frombuffer(sizes, np.int32)
        keys = _block_keys(u, v, len(nodes))
        distinct, back, many = np.unique(keys, return_inverse=True, return_counts=True)
        at = _shard_starts(distinct, shards)
        wanted = many > 1
        for s, x in held.items():
            wanted[at[s] : at[s + 1]] |= np.unpackbits(np.frombuffer(x, np.uint8), count=at[s + 1] - at[s]).astype(bool)
        row, _ = np.nonzero(wanted[back].reshape(keys.shape))
        return pa.table([pa.array(nodes[row]), pa.array(sizes[row]), pa.array(keys[wanted[back].reshape(keys.shape)].view(np.int64))], names=["node", "size", "key"])

    routed = "shard long, block long, blob binary"
    answers = blocks.mapInArrow(send, routed).groupBy("shard").applyInArrow(answer, routed)
    none = {c: F.lit(None).cast("binary") for c in payload[1:]}
    whole = blocks.select("block", F.lit(-1).cast("long").alias("shard"), F.lit(None).cast("binary").alias("blob"), *payload[1:])
    return whole.unionByName(answers.withColumns(none)).groupBy("block").applyInArrow(shared, "node long, size int, key long")


def near_groups(docs: DataFrame, threshold: float = THRESHOLD, side: int = SIDE, rows: int = ROWS, k: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """(rows doc, node; groups node, root, keep): texts as nodes, and the nodes of every group of near duplicates or copies.

    Equal word sequences are one node (64 bits of them). Nodes that share a bucket of a table are
    candidates, verified by the Jaccard similarity of their shingle sets. The groups are exactly the
    connected components of all candidates that pass: two nodes of a bucket go without a comparison only
    if others have connected them already. First the least node of each bucket meets the rest; then, by
    node value, which is random, about 1, 4, 16, ... of a bucket's nodes lead in each round and meet those
    of other components, until every bucket is one component or all its nodes have led. So a group of
    thousands costs about as many comparisons as it has members. Nothing is capped; no task holds a bucket.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text")).dropna()
    signed = staged(base.mapInArrow(_sign(side, rows, k), "doc long, node long, size int, u array<long>, v array<long>"), "minhash-signatures")
    classes = staged(signed.groupBy("node").agg(F.min("doc").alias("rep"), F.count("*").alias("held"), F.first("size").alias("size"), F.first("u").alias("u"), F.first("v").alias("v")), "minhash-classes")

    keyed = staged(_shared_keys(classes), "minhash-keyed")
    release(docs.sparkSession)
    buckets = staged(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("node", "size")).alias("lead")).filter("n > 1").select("key", "n", F.col("lead.node").alias("lead"), F.col("lead.size").alias("lead_size")), "minhash-buckets")
    followers = staged(keyed.join(small(buckets, 40), "key").filter("node != lead"), "minhash-members")
    release(docs.sparkSession)
    fits = lambda x, y: F.least(x, y) >= threshold * 0.999 * F.greatest(x, y)
    # the text of a node is that of its least document; copies have equal word sequences
    texts = base.join(small(staged(classes.join(staged(followers.select("node").union(followers.select("lead")).distinct(), "minhash-nodes"), "node", "left_semi").select(F.col("rep").alias("doc")).distinct(), "minhash-reps"), 16), "doc", "left_semi")
    sets = staged(texts.mapInArrow(_shingle_sets(k), "node long, set binary").dropDuplicates(["node"]), "minhash-sets")

    pairs = staged(followers.filter(fits("size", "lead_size")).select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct(), "minhash-pairs")
    met = _verified(pairs, sets, threshold)
    comp = _relabelled(None, met.filter("near"))
    rest, led = followers.select("key", "n", "node", "size"), 1
    at = (F.col("node") / F.lit(2.0**64) + 0.5) * F.col("n")
    while True:
        rest = rest.withColumn("comp", F.col("node")) if comp is None else rest.drop("comp").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        rest = rest.filter(at >= (0 if led == 1 else led // 4)).select("key", "n", "node", "size", "comp")
        mixed = rest.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x != y").select("key")
        rest = staged(rest.join(mixed, "key"), "minhash-open")
        if rest.isEmpty():
            break
        lead = rest.filter(at < led).select("key", F.col("node").alias("a"), F.col("size").alias("a_size"), F.col("comp").alias("a_comp"))
        found = rest.join(lead, "key").filter("node > a AND comp != a_comp").filter(fits("size", "a_size")).select("a", F.col("node").alias("b")).distinct()
        now = _verified(staged(found.join(met.select("a", "b"), ["a", "b"], "left_anti"), "minhash-pairs"), sets, threshold)
        met = met.unionByName(now)
        comp = _relabelled(comp, now.filter("near"))
        led *= 4
    none = classes.select("node", F.col("node").alias("comp")).limit(0)
    involved = classes.select("node", "rep", "held").join(none if comp is None else comp, "node", "left").filter("held > 1 OR comp IS NOT NULL").select("node", F.coalesce("comp", "node").alias("root"), "rep")
    keeps = involved.groupBy("root").agg(F.min("rep").alias("keep"))
    return signed.select("doc", "node"), staged(involved.join(keeps, "root").select("node", "root", "keep"), "minhash-groups")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """doc_id, duplicate_of: a row for each document that has a kept near duplicate, the least doc_id of its group.

    Groups are connected components of verified pairs: at least `threshold` Jaccard similarity of
    k-word shingles (a text of under k words is one shingle). A document without words - null, empty,
    punctuation - is nobody's duplicate; neither is a row whose doc_id is null. Repeated rows count once;
    a doc_id whose rows have different texts is in the groups of them all. Texts are compared whole, of
    any length. An empty table gives no rows. Columns other than doc_id and text, whatever their names,
    are not read.
    """
    rows, groups = near_groups(docs, threshold, **options)
    met = rows.join(small(groups.select("node", "keep"), 16), "node").filter("doc != keep")
    return met.select(F.col("doc").alias("doc_id"), F.col("keep").alias("duplicate_of")).distinct()


def without_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """docs with one document of each group, the least doc_id's; of its rows the one of least fingerprint.

    Rows without a doc_id or without words stay as they are. Rows that share a doc_id are told apart by
    their texts: one that is in no group stays. The columns stay, whatever their names.
    """
    rows, groups = near_groups(docs, **options)
    gone, node, nth = (f"rg_{uuid.uuid4().hex}" for _ in range(3))
    lost = staged(rows.join(small(groups.select("node", "keep"), 16), "node").filter("doc != keep").select(F.col("doc").alias(gone)).distinct(), "minhash-gone")
    many = staged(docs.groupBy(F.col("doc_id").cast("long").alias(gone)).count().filter(F.col(gone).isNotNull() & (F.col("count") > 1)).select(gone), "minhash-repeated")
    if many.isEmpty():
        return docs.join(small(lost, 16), docs["doc_id"].cast("long") == lost[gone], "left_anti")
    id_at, text_at = docs.columns.index("doc_id"), docs.columns.index("text")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[int | None] = [None] * batch.num_rows
            for start, texts in chunks(batch.column(text_at).to_pylist()):
                hashes, b, keep = _worded(texts)
                for i, x in zip(keep.tolist(), fingerprints(hashes, b).view(np.int64).tolist() if len(keep) else ()):
                    out[start + i] = x
            ids = batch.column(id_at)
            yield batch.append_column(node, pa.array([x if i is not None else None for x, i in zip(out, ids.to_pylist())], pa.int64()))

    single = docs.join(small(lost, 16), docs["doc_id"].cast("long") == lost[gone], "left_anti")
    single = single.join(small(many, 16), single["doc_id"].cast("long") == many[gone], "left_anti")
    repeated = docs.join(small(many, 16), docs["doc_id"].cast("long") == many[gone], "left_semi")
    numbered = staged(repeated.mapInArrow(number, StructType([*docs.schema.fields, StructField(node, LongType())])), "minhash-numbered")
    g = groups.select(F.col("node").alias("g_node"), F.col("root").alias("g_root"), F.col("keep").alias("g_keep"))
    met = numbered.join(small(g, 24), numbered[node] == g["g_node"], "left")
    first = Window.partitionBy("g_root").orderBy(node)
    kept = met.filter(F.col("g_keep") == F.col("doc_id").cast("long")).withColumn(nth, F.row_number().over(first)).filter(F.col(nth) == 1)
    return single.unionByName(met.filter("g_keep IS NULL").select(*docs.columns)).unionByName(kept.select(*docs.columns))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
