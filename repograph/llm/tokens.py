"""Operator 1: exact token counts of every prefix of a text, by dynamic programming over prefixes."""

from __future__ import annotations

import base64
import functools
import itertools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

VOCABULARY = os.environ.get("REPOGRAPH_BPE_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: How a text is cut before byte pairs are merged (the public pattern of this vocabulary).
CUT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Token budgets and prefix lengths whose answers the query reports.
BUDGETS, PREFIXES = (512, 2048, 8192), (1000, 4000)
#: Entries each of the two generations of a worker's memo holds; a memo only saves time.
MEMO = 400_000
#: White space that could be cut otherwise at the end of a prefix.
RUN = re.compile(r"\s\s")


class PrefixCounter:
    """Counts of every prefix of a text.

    In byte-pair encoding by rank, a sequence of tokens is the encoding of its bytes exactly if every
    two neighbours are (Antwerpen & Neubeck, 2024). So each prefix of a piece has one last token, and
    count[j] = count[j - len(last[j])] + 1: the last token is the one ending at j that is compatible
    with the last token of the prefix it leaves.
    """

    def __init__(self, vocabulary: str = VOCABULARY) -> None:
        import regex
        import tiktoken

        with open(vocabulary, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=CUT, mergeable_ranks=self.ranks, special_tokens={})
        self.merge = self.encoding._encode_single_piece
        self.cut = regex.compile(CUT)
        self.longest: dict[bytes, int] = {}
        for t in self.ranks:
            e = t[-3:]
            self.longest[e] = max(self.longest.get(e, 1), len(t))
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.pieces: dict[str, bytes | list[int]] = {}
        self.older: dict[str, bytes | list[int]] = {}

    def compatible(self, a: bytes, b: bytes) -> bool:
        if len(self.pairs) > MEMO:
            self.pairs.clear()
        whole = a + b
        got = self.pairs[(a, b)] = whole not in self.ranks and self.merge(whole) == [self.ranks[a], self.ranks[b]]
        return got

    def merged(self, piece: bytes) -> list[int]:
        """count[j] of piece[:j] for j from 0 to len(piece), of bytes that no cut divides."""
        last, count = [b""], [0]
        ranks, longest, pairs = self.ranks, self.longest, self.pairs
        for j in range(1, len(piece) + 1):
            reach = longest.get(piece[j - 3 if j > 3 else 0 : j], 2)
            for i in range(j - reach if j > reach else 0, j):
                t = piece[i:j]
                if t in ranks:
                    if i:
                        a = last[i]
                        fits = pairs.get((a, t))
                        if not (self.compatible(a, t) if fits is None else fits):
                            continue
                    last.append(t)
                    count.append(count[i] + 1)
                    break
            else:
                raise ValueError("a byte is not in the vocabulary")
        return count

    def piece_counts(self, piece: str) -> list[int]:
        """Token counts of piece[:1], piece[:2], ..., each prefix cut anew where it is cut otherwise."""
        raw = piece.encode("utf-8", "replace")
        count = self.merged(raw)
        if len(raw) == len(piece):
            out = count[1:]
        else:
            out = [count[e] for e in itertools.accumulate([len(c.encode("utf-8", "replace")) for c in piece])]
        if piece[0] == "'" and len(piece) > 2:  # 're and its like: the shorter prefix is two pieces
            for j in range(2, len(piece)):
                out[j - 1] = len(self.encoding.encode_ordinary(piece[:j]))
        return out

    def entry(self, piece: str) -> bytes | list[int]:
        """The differences of a piece's counts as signed bytes; the counts themselves if it has 128 characters or more."""
        c = self.piece_counts(piece)
        return bytes([(x - y) & 255 for x, y in zip(c, [0, *c])]) if len(c) < 128 else c

    def deltas(self, text: str) -> np.ndarray:
        """d with cumsum(d)[i - 1] the token count of text[:i]."""
        pieces, memo = self.cut.findall(text), self.pieces
        try:
            data = b"".join(map(memo.__getitem__, pieces))
        except (KeyError, TypeError):
            data = None
        if data is None:
            if len(memo) > MEMO:
                self.older, memo = memo, {}
                self.pieces = memo
            older = self.older
            for p in pieces:
                if p not in memo:
                    got = older.get(p)
                    memo[p] = self.entry(p) if got is None else got
            try:
                data = b"".join(map(memo.__getitem__, pieces))
            except TypeError:  # a piece of 128 characters or more has its counts instead
                parts = [np.frombuffer(x, np.int8) if isinstance(x, bytes) else np.diff(np.array(x, np.int64), prepend=0) for x in map(memo.__getitem__, pieces)]
                return self.spaces(text, pieces, np.concatenate(parts).astype(np.int64))
        return self.spaces(text, pieces, np.frombuffer(data, np.int8).astype(np.int64))

    def spaces(self, text: str, pieces: list[str], d: np.ndarray) -> np.ndarray:
        """A run of white space before ' word' lends its last space to the word; a prefix that ends with the run has it whole."""
        if not RUN.search(text):
            return d
        place = 0
        for a, b in zip(pieces, pieces[1:]):
            place += len(a)
            if a[-1].isspace() and b[0].isspace() and not a.strip():
                whole, before = self._run(a + b[0]), self._run(a)
                shift = (whole - before) - int(d[place])
                if shift:
                    d[place] += shift
                    if place + 1 < len(d):
                        d[place + 1] -= shift
        return d

    def _run(self, run: str) -> int:
        got = self.pieces.get(run)
        if got is None:
            got = self.piece_counts(run)
            return got[-1]
        return sum(np.frombuffer(got, np.int8).tolist()) if isinstance(got, bytes) else got[-1]


def pack(d: np.ndarray) -> bytes:
    """A byte that says the width, then the differences in that width."""
    for width in (1, 2, 4, 8):
        t = np.dtype(f"<i{width}")
        if not len(d) or np.iinfo(t).min <= d.min() and d.max() <= np.iinfo(t).max:
            return bytes([width]) + d.astype(t).tobytes()
    raise OverflowError


def counts(packed: bytes) -> np.ndarray:
    """Token counts of all prefixes, that of the empty one first."""
    d = np.frombuffer(packed, np.dtype(f"<i{packed[0]}"), offset=1)
    return np.concatenate([[0], np.cumsum(d, dtype=np.int64)])


def tokens_at(packed: bytes, n_chars: int) -> int:
    """Tokens of the first n_chars characters."""
    c = counts(packed)
    return int(c[min(max(n_chars, 0), len(c) - 1)])


def longest_within(packed: bytes, budget: int) -> int:
    """The most characters whose encoding has at most `budget` tokens (counts may fall as a token completes)."""
    return int(np.flatnonzero(counts(packed) <= budget)[-1]) if budget >= 0 else 0


@functools.lru_cache(maxsize=1)
def _counter(vocabulary: str) -> PrefixCounter:
    return PrefixCounter(vocabulary)


def prefix_token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, budgets: tuple[int, ...] = BUDGETS, prefixes: tuple[int, ...] = PREFIXES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, n_tokens, fits_<budget>, tokens_<prefix>, prefix_deltas for every row.

    prefix_deltas holds the exact token count of every prefix of the text (see counts()); fits_b is the
    length in characters of the longest prefix of at most b tokens, tokens_n the count of the first n
    characters. One pass over the rows, no shuffle; `vocabulary` is a file of ranks every executor sees.

    A null text gives nulls but for its doc_id; an empty one 0 and an empty table. Repeated rows and
    null ids give a row each; other columns are not read.
    """
    names = [*(f"fits_{b}" for b in budgets), *(f"tokens_{n}" for n in prefixes)]
    schema = "doc_id long, n_chars long, n_tokens long, " + "".join(f"{n} long, " for n in names) + "prefix_deltas binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows: list[list] = [[] for _ in range(3 + len(names))]
                for text in part.column(1).to_pylist():
                    if text is None:
                        for r in rows:
                            r.append(None)
                        continue
                    d = counter.deltas(text) if text else np.zeros(0, np.int64)
                    c = np.concatenate([[0], np.cumsum(d)])
                    found = [int(np.flatnonzero(c <= b)[-1]) for b in budgets] + [int(c[min(n, len(d))]) for n in prefixes]
                    for r, x in zip(rows, [len(d), int(c[-1]), *found, pack(d)]):
                        r.append(x)
                arrays = [part.column(0), *(pa.array(r, pa.int64()) for r in rows[:-1]), pa.array(rows[-1], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_chars", "n_tokens", *names, "prefix_deltas"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_token_counts(documents(spark, sf_dir))
