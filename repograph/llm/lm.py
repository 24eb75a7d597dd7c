"""Operator 9: cross-entropy difference of a target and a background n-gram model."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, documents, mix, release, small, staged, word_hashes

#: A word is in the vocabulary from so many occurrences; others are one unknown word. A pair is kept from so many; the
#: mass of others goes to the back-off. Fixed counts: what is counted and kept grows with the input.
WORD_COUNT, PAIR_COUNT = 2, 2
DISCOUNT, SMOOTHING = 0.75, 0.5
#: Tokens of a block of documents, about, and distinct pairs or words that a shard of the counts holds, about.
BLOCK_TOKENS, SHARD_ROWS = 3_000_000, 2_000_000
#: Stands for the beginning of a text among the contexts.
_START = np.uint64(1)
_PAYLOAD, _PAIRS, _WORDS, _SUMS, _TOTALS = range(5)
_SCORES = "doc_id long, n_tokens long, target_loss double, background_loss double, loss_difference double"
_BLOCKS = "block long, docs array<long>, sizes array<int>, target array<boolean>, words binary, tokens binary, n_pairs long, n_words long"
_ROUTED = "shard long, block long, kind int, blob binary"
_ROUTED_ARROW = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("kind", pa.int32()), ("blob", pa.binary())])


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes: each in its least unsigned width (floats as they are), its bytes by plane, compressed."""
    out = []
    for a in arrays:
        if a.dtype.kind != "f":
            top = int(a.max()) if len(a) else 0
            a = a.astype(np.dtype("u1") if top < 1 << 8 else np.dtype("<u2") if top < 1 << 16 else np.dtype("<u4") if top < 1 << 32 else np.dtype("<u8"))
        planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()
        small = bytes(pa.compress(planes, codec="zstd", asbytes=True)) if planes else b""
        out.append(a.dtype.str[1:].encode() + len(a).to_bytes(8, "little") + len(small).to_bytes(8, "little") + small)
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        kind, n, size = np.dtype("<" + data[at : at + 2].decode()), int.from_bytes(data[at + 2 : at + 10], "little"), int.from_bytes(data[at + 10 : at + 18], "little")
        at += 18
        planes = pa.decompress(data[at : at + size], n * kind.itemsize, codec="zstd", asbytes=True) if size else b""
        out.append(np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(kind.itemsize, n).T).view(kind).ravel())
        at += size
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each block of documents: its distinct words, and its texts as places among them."""
    block, held, size = TaskContext.get().partitionId() << 32, [], 0

    def flush() -> pa.RecordBatch:
        words, tokens = np.unique(np.concatenate([h[1] for h in held]), return_inverse=True)
        sizes = np.concatenate([np.diff(h[2]) for h in held])
        n_pairs = len(np.unique(_codes(tokens, sizes, len(words))))
        columns = [
            [block], [np.concatenate([np.asarray(h[0]) for h in held])], [sizes.astype(np.int32)], [np.concatenate([h[3] for h in held])],
            [words.tobytes()], [pack(tokens)], [n_pairs], [len(words)],
        ]
        types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
        columns[1] = [[x for h in held for x in h[0].to_pylist()]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["block", "docs", "sizes", "target", "words", "tokens", "n_pairs", "n_words"])

    for batch in batches:
        target = np.array(batch.column(2).to_pylist(), bool)
        for start, texts in chunks(batch.column(1).to_pylist()):
            hashes, bounds = word_hashes(texts)
            held.append((batch.column(0).slice(start, len(texts)), hashes, bounds, target[start : start + len(texts)]))
            size += len(hashes)
            if size >= BLOCK_TOKENS:
                yield flush()
                block, held, size = block + 1, [], 0
    if held:
        yield flush()


def _codes(tokens: np.ndarray, sizes: np.ndarray, n_words: int) -> np.ndarray:
    """(context, word) of each token as one number; a text's first token has the context n_words."""
    context = np.empty(len(tokens), np.int64)
    context[1:] = tokens[:-1]
    context[(np.cumsum(sizes) - sizes)[sizes > 0]] = n_words
    return context * (n_words + 1) + tokens


class _Block:
    """Distinct pairs and words of a block, in the order of their shards; the same each time it is worked out."""

    def __init__(self, sizes: np.ndarray, target: np.ndarray, words: bytes, tokens: bytes) -> None:
        self.sizes = sizes.astype(np.int64)
        self.words = np.append(np.frombuffer(words, np.uint64), _START)
        n = len(self.words) - 1
        self.tokens = unpack(tokens)[0].astype(np.int64)
        code = _codes(self.tokens, self.sizes, n)
        of_target = np.repeat(target, self.sizes)
        order = np.argsort(code, kind="stable")
        code = code[order]
        first = np.flatnonzero(np.diff(code, prepend=-1))
        self.a = np.diff(np.append(first, len(code)))
        self.t = np.add.reduceat(of_target[order].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.repeat(np.arange(len(first)), self.a)
        self.c, self.w = code[first] // (n + 1), code[first] % (n + 1)

    def pair_order(self, shards: int) -> tuple[np.ndarray, np.ndarray]:
        """(pairs by shard, where each shard begins)."""
        key = mix(self.words[self.c] * np.uint64(0x9E3779B97F4A7C15) + self.words[self.w])
        shard = ((key >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        return order, np.searchsorted(shard[order], np.arange(shards + 1))

    def word_order(self, shards: int) -> tuple[np.ndarray, np.ndarray]:
        shard = _word_shard(self.words, shards)
        order = np.argsort(shard, kind="stable")
        return order, np.searchsorted(shard[order], np.arange(shards + 1))


def _word_shard(words: np.ndarray, shards: int) -> np.ndarray:
    return ((mix(words) >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _rows(rows: list[tuple[int, int | None, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_ROUTED_ARROW)], schema=_ROUTED_ARROW)


def _block_of(batch: pa.RecordBatch | pa.Table, i: int = 0) -> _Block:
    col = lambda name: batch.column(name)[i]
    return _Block(col("sizes").values.to_numpy(), col("target").values.to_numpy(zero_copy_only=False), col("words").as_py(), col("tokens").as_py())


def _runs(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.append(True, c[1:] != c[:-1])[: len(c)])
    return c[first], np.diff(np.append(first, len(c)))


def _route_pairs(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                b = _block_of(batch, i)
                order, at = b.pair_order(shards)
                for s in np.flatnonzero(np.diff(at)).tolist():
                    own = order[at[s] : at[s + 1]]
                    c, n = _runs(b.c[own])
                    yield _rows([(s, batch.column("block")[i].as_py(), _PAIRS, pack(b.words[c], n, b.words[b.w[own]], b.t[own], b.a[own]))])

    return run


def _count_pairs(word_shards: int, discount: float):
    """Returns each block its pairs' counts over all (0 where a pair isn't kept), and to the words' shards the kept mass of contexts."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        parts = [unpack(x.as_py()) for x in table.column("blob")]
        c = np.concatenate([np.repeat(p[0].astype(np.uint64), p[1]) for p in parts])
        w, t, a = (np.concatenate([p[i] for p in parts]).astype(d) for i, d in ((2, np.uint64), (3, np.int64), (4, np.int64)))
        order = np.lexsort((w, c))
        cs, ws = c[order], w[order]
        first = np.flatnonzero(np.append(True, (cs[1:] != cs[:-1]) | (ws[1:] != ws[:-1])))
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
        both = [np.add.reduceat(x[order], first) for x in (t, a)]
        kept = (both[0] >= PAIR_COUNT) | (both[1] >= PAIR_COUNT)
        both = [np.where(kept, x, 0) for x in both]
        back = np.empty(len(order), np.int64)
        back[order] = group
        rows, at = [], 0
        for block, p in zip(table.column("block").to_pylist(), parts):
            own = back[at : at + len(p[2])]
            at += len(p[2])
            rows.append((int(table.column("shard")[0].as_py()), block, _PAIRS, pack(both[0][own], both[1][own])))
        head = cs[first][kept]
        if len(head):
            start = np.flatnonzero(np.append(True, head[1:] != head[:-1]))
            sums = [np.add.reduceat(np.maximum(x[kept] - discount, 0.0), start) for x in both]
            shard = _word_shard(head[start], word_shards)
            for s in np.unique(shard).tolist():
                own = shard == s
                rows.append((s, None, _SUMS, pack(head[start][own], sums[0][own], sums[1][own])))
        return pa.Table.from_batches([_rows(rows)])

    return run


def _route_words(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                b, n = _block_of(batch, i), None
                n = len(b.words)
                counts = [np.bincount(x, y, n).astype(np.int64) for x in (b.w, b.c) for y in (b.t, b.a)]
                order, at = b.word_order(shards)
                for s in np.flatnonzero(np.diff(at)).tolist():
                    own = order[at[s] : at[s + 1]]
                    yield _rows([(s, batch.column("block")[i].as_py(), _WORDS, pack(b.words[own], *(x[own] for x in counts)))])

    return run


def _count_words(table: pa.Table) -> pa.Table:
    """Returns each block its words' counts over all, as word and as context, and the kept mass of them as contexts."""
    table = table.sort_by([("kind", "ascending"), ("block", "ascending")])
    kinds, blocks = table.column("kind").to_pylist(), table.column("block").to_pylist()
    parts = [unpack(x.as_py()) for x in table.column("blob")]
    own = [p for p, k in zip(parts, kinds) if k == _WORDS]
    words, back = np.unique(np.concatenate([p[0].astype(np.uint64) for p in own]), return_inverse=True)
    counts = [np.bincount(back, np.concatenate([p[i] for p in own]), len(words)).astype(np.int64) for i in range(1, 5)]
    sums = [np.zeros(len(words)) for _ in "ta"]
    for p, k in zip(parts, kinds):
        if k == _SUMS:
            at = np.searchsorted(words, p[0].astype(np.uint64))
            for x, y in zip(sums, p[1:]):
                x[at] += y
    rows, at = [], 0
    for block, p in zip([b for b, k in zip(blocks, kinds) if k == _WORDS], own):
        i = back[at : at + len(p[0])]
        at += len(p[0])
        rows.append((int(table.column("shard")[0].as_py()), block, _WORDS, pack(*(x[i] for x in counts), *(x[i] for x in sums))))
    known = counts[1] >= WORD_COUNT
    totals = np.array([known.sum(), counts[0][~known].sum(), counts[1][~known].sum(), counts[0].sum(), counts[1].sum()], np.float64)
    rows.append((int(table.column("shard")[0].as_py()), None, _TOTALS, totals.tobytes()))
    return pa.Table.from_batches([_rows(rows)])


def _score(totals: np.ndarray, pair_shards: int, word_shards: int, discount: float, smoothing: float):
    n_known, rare, total = totals[0], totals[1:3], totals[3:5]

    def run(table: pa.Table) -> pa.Table:
        kinds = table.column("kind").to_pylist()
        payload = table.slice(kinds.index(_PAYLOAD), 1)
        b = _block_of(payload)
        pairs, words = np.zeros((2, len(b.c))), np.zeros((6, len(b.words)))
        for out, kind, (order, at) in ((pairs, _PAIRS, b.pair_order(pair_shards)), (words, _WORDS, b.word_order(word_shards))):
            for i in (i for i, k in enumerate(kinds) if k == kind):
                s = table.column("shard")[i].as_py()
                out[:, order[at[s] : at[s + 1]]] = unpack(table.column("blob")[i].as_py())
        known = words[1] >= WORD_COUNT
        logs = np.empty((2, len(b.c)))
        for m in (0, 1):
            base = (np.where(known, words[m], rare[m]) + smoothing) / (total[m] + smoothing * (n_known + 2))
            n, kept = np.maximum(words[2 + m], 1), words[4 + m]
            logs[m] = np.log(np.maximum(pairs[m] - discount, 0) / n[b.c] + np.maximum(1 - kept / n, 1e-9)[b.c] * base[b.w])
        some = b.sizes > 0
        means = np.zeros((2, len(b.sizes)))
        if len(b.tokens):
            means[:, some] = np.round(-np.add.reduceat(logs[:, b.place], (np.cumsum(b.sizes) - b.sizes)[some], axis=1) / b.sizes[some], 6)
        cols = [pa.array(x, mask=~some) for x in (means[0], means[1], np.round(means[0] - means[1], 6))]
        return pa.table([payload.column("docs")[0].values, pa.array(b.sizes), *cols], names=["doc_id", "n_tokens", "target_loss", "background_loss", "loss_difference"])

    return run


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame, discount: float = DISCOUNT, smoothing: float = SMOOTHING) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, loss_difference for every document.

    Losses are mean nats a token (6 decimals); the lower the difference, the more a document is like the
    target. target_ids has the doc_id of target documents; the background is every document. Two bigram
    models over one vocabulary, with absolute discounting and back-off to smoothed words: every word and
    every pair seen twice is kept, at any input size.

    Documents are packed into blocks; a block sends each shard of the counts its distinct pairs once, as
    one compressed row, and gets their counts back in the same order, then likewise for words. So a hot
    pair or word is at most one entry a block, and no task holds more than a block or a shard.

    A text without words (null, empty, punctuation) has 0 tokens and null losses; one of any length is
    counted whole, within one block. Repeated rows count and score as often as they stand; a null doc_id is
    of the background. Without target documents the target model is uniform. An empty table gives no rows.
    Other columns, whatever their names, are not read.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    marked = small(staged(target_ids.select(F.col("doc_id").cast("long").alias("rg_t")).dropna().distinct(), "lm-target"), 16)
    rows = base.join(marked, F.col("doc_id") == F.col("rg_t"), "left").select("doc_id", "text", F.col("rg_t").isNotNull().alias("target"))
    blocks = staged(rows.mapInArrow(_blocks, _BLOCKS), "lm-blocks")
    held = blocks.agg(F.sum("n_pairs"), F.sum("n_words")).first()
    n_pairs, n_words = (max(1, -(-(x or 0) // SHARD_ROWS)) for x in held)
    payload = ["sizes", "target", "words", "tokens"]
    counted = blocks.select("block", *payload).mapInArrow(_route_pairs(n_pairs), _ROUTED).groupBy("shard").applyInArrow(_count_pairs(n_words, discount), _ROUTED)
    counted = staged(counted, "lm-pairs")
    release(docs.sparkSession)
    routed = blocks.select("block", *payload).mapInArrow(_route_words(n_words), _ROUTED).unionByName(counted.filter(F.col("kind") == _SUMS))
    of_words = staged(routed.groupBy("shard").applyInArrow(_count_words, _ROUTED), "lm-words")
    release(docs.sparkSession)
    totals = np.zeros(5)
    for r in of_words.filter(F.col("kind") == _TOTALS).select("blob").toLocalIterator():
        totals += np.frombuffer(r.blob, np.float64)
    returns = counted.filter(F.col("kind") == _PAIRS).unionByName(of_words.filter(F.col("kind") == _WORDS))
    none = {c: F.lit(None).cast(t) for c, t in (("docs", "array<long>"), ("sizes", "array<int>"), ("target", "array<boolean>"), ("words", "binary"), ("tokens", "binary"))}
    whole = blocks.select("block", F.lit(0).cast("long").alias("shard"), F.lit(_PAYLOAD).alias("kind"), F.lit(None).cast("binary").alias("blob"), "docs", *payload)
    return whole.unionByName(returns.withColumns(none)).groupBy("block").applyInArrow(_score(totals, n_pairs, n_words, discount, smoothing), _SCORES)


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_entropy_difference(documents(spark, sf_dir), documents(spark, sf_dir, "labels").filter("quality = 1"))
