"""Helpers the training-data operators share: work folders, size-checked broadcasts, word hashing."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.work import remove, shared_dir, staged, work_path  # noqa: F401

#: A join side is broadcast only when it was counted and is at most this large.
BROADCAST_BYTES = 8 << 20


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more, which it does as the JVM collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small(df: DataFrame, row_bytes: int, rows: int | None = None) -> DataFrame:
    """df with a broadcast hint if its counted rows fit BROADCAST_BYTES; without one beyond it."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n * row_bytes <= BROADCAST_BYTES else df


def int_id(column: str = "doc_id"):
    return F.col(column).cast("long")


# --- words of texts as 64-bit hashes, without a Python object per word ------------------------

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_MUL = np.uint64(0x9E3779B97F4A7C15)
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_POW = np.ones(64, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POW
    if len(_POW) < n:
        out = np.full(max(n, 2 * len(_POW)), np.uint64(6364136223846793005))
        out[0] = 1
        _POW = np.cumprod(out, dtype=np.uint64)
    return _POW


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser over uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers(128)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, offsets): text i has hashes[offsets[i]:offsets[i + 1]].

    Words are maximal runs of ASCII letters, digits and non-ASCII characters of the lower-cased text.
    """
    raw = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum([len(r) + 1 for r in raw], dtype=np.int64) if raw else np.zeros(0, np.int64)
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    inside = _WORD[data]
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0))
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    size = stops - starts
    first = np.cumsum(size) - size
    place = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(first, size)
    value = _BYTE[data[inside]] * _powers(int(size.max()))[place]
    hashes = mix(np.add.reduceat(value, first) + size.astype(np.uint64) * _MUL)
    return hashes, np.concatenate([[0], np.searchsorted(starts, ends)]).astype(np.int64)


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles of one text; a text of under k words is one shingle of all its words."""
    n = len(hashes)
    if n == 0:
        return hashes
    k = min(k, n)
    out = hashes[: n - k + 1].copy()
    for i in range(1, k):
        out = out * _MUL + hashes[i : n - k + 1 + i]
    return mix(out)


def chunks(texts: list[str | None], limit: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """(first index, texts) of runs of about `limit` characters, so that arrays stay small; a null is ''."""
    start, size, run = 0, 0, []
    for i, t in enumerate(texts):
        t = t or ""
        if run and size + len(t) > limit:
            yield start, run
            start, size, run = i, 0, []
        run.append(t)
        size += len(t)
    if run:
        yield start, run
