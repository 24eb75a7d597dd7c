"""Operator 6: benchmark decontamination by latent semantic retrieval with subsequence and answer checks."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, documents, small, staged, word_hashes

#: A document is cut into blocks of so many words; a passage is two neighbouring blocks, so each word is in two.
BLOCK = 16
#: Dimensions of the latent space, or one for every so many items if that is more; extra columns of the sketch, and how much each benchmark passage weighs in the decomposition.
DIMENSIONS, ITEMS_A_DIMENSION, OVERSAMPLE = 128, 8, 16
#: Words of the items that are searched at once: what goes to executors is bounded, larger benchmarks take several passes.
ITEM_WORDS = 20_000
#: A term in more than this share of passages separates nothing and is left out of the latent space; items that
#: it leaves less than COVERED of their words reach the exact check by the words they share with a passage.
MAX_DF, COVERED = 0.05, 0.75
#: A passage is a candidate from this cosine, less for items shorter than it, which fill less of it (see cut_off); it is a leak if the longest common subsequence covers so much of the item,
#: or a little less with the answer in place.
COSINE, COVER, COVER_WITH_ANSWER, ANSWER_COVER = 0.65, 0.7, 0.5, 0.8
#: Cells of a table of items by terms (beyond, the counts are searched), and words of stretches that are looked at together.
TABLE_CELLS, WORDS_AT_ONCE = 1 << 24, 1 << 20
SEED = 5
SCHEMA = "doc_id long, item_id long, cosine double, coverage double, answer_found boolean"


def words(text: str | None) -> list[int]:
    """The words of a text as hashes (see word_hashes)."""
    return word_hashes([text or ""])[0].tolist()


def answer_of(text: str | None) -> list[int]:
    """The item's answer: what follows its last 'answer:' or question mark, or else its last sentence, in words."""
    text = (text or "").strip()
    low = text.lower()
    for mark in ("answer:", "?"):
        at = low.rfind(mark)
        if at >= 0 and words(text[at + len(mark) :]):
            return words(text[at + len(mark) :])
    parts = [p for p in re.split(r"[.!\n]+", text) if words(p)]
    return words(parts[-1]) if parts else []


def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence, bits in parallel (Hyyrö, 2004)."""
    return _lcs(_places(a), len(a), b)


def _places(a: list) -> dict:
    """Where a has each word, as bits."""
    masks: dict = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    return masks


def _lcs(places: dict, n: int, b: list) -> int:
    full = (1 << n) - 1
    v = full
    for m in filter(None, map(places.get, b)):
        u = v & m
        v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


class Space:
    """Vocabulary, idf and projection: what executors get. Its size follows the benchmark, not the corpus."""

    def __init__(self, items: list[tuple[int, list[int], list[int]]]) -> None:
        self.items = items
        terms = sorted({w for _, ws, _ in items for w in ws})
        self.ids = {w: i for i, w in enumerate(terms)}
        self.hashes = np.array(terms, np.uint64)
        self.idf = np.ones(len(terms), np.float32)
        self.used = np.ones(len(terms), bool)
        self.basis = np.zeros((len(terms), 0), np.float32)
        self.queries = np.zeros((len(items), 0), np.float32)

    def matrix(self) -> np.ndarray:
        """TF-IDF rows of the items, of length 1."""
        out = np.zeros((len(self.items), len(self.ids)), np.float32)
        for i, (_, ws, _) in enumerate(self.items):
            for w in ws:
                out[i, self.ids[w]] += self.idf[self.ids[w]]
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def _encode(vocabulary: np.ndarray):
    """Texts as term numbers; -1 is a word that no benchmark item has."""
    size = len(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maybe = np.zeros(1 << 18, bool)
        maybe[vocabulary >> np.uint64(46)] = True
        for batch in batches:
            for start, texts in chunks(batch.column(1).to_pylist()):
                hashes, bounds = word_hashes(texts)
                terms = np.full(len(hashes), -1, np.int32)
                some = np.flatnonzero(maybe[hashes >> np.uint64(46)])
                at = np.minimum(np.searchsorted(vocabulary, hashes[some]), size - 1)
                terms[some] = np.where(vocabulary[at] == hashes[some], at, -1)
                rows = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(terms))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), rows], names=["doc_id", "terms"])

    return run


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())


def _blocks(terms: np.ndarray, sizes: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(block of each kept word, term of each kept word, document of each block, place of each block's first word)."""
    n = -(-sizes // BLOCK)
    doc = np.repeat(np.arange(len(sizes)), n)
    start = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * BLOCK + (np.cumsum(sizes) - sizes)[doc]
    keep = np.flatnonzero(terms >= 0)
    keep = keep[used[terms[keep]]]
    return np.searchsorted(start, keep, side="right") - 1, terms[keep], doc, start


def _passages(block_sums: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums of passages, first block of each): neighbours of one document, or the only block of a document."""
    if not len(doc):
        return block_sums, np.zeros(0, np.int64)
    with_next = np.append(doc[:-1] == doc[1:], False)
    alone = np.append(True, doc[1:] != doc[:-1]) & ~with_next
    first = np.flatnonzero(with_next | alone)
    out = block_sums[first]
    out[with_next[first]] += block_sums[first[with_next[first]] + 1]
    return out, first


def _sum_by(group: np.ndarray, n: int, rows: np.ndarray, m: np.ndarray) -> np.ndarray:
    """out[g] = sum of m[rows[i]] over the i with group[i] == g, for ascending groups of few members each.

    The k-th members of all groups are added at once; groups lie in order of size, so that is a slice.
    """
    out = np.zeros((n, m.shape[1]), m.dtype)
    size = np.bincount(group, minlength=n)
    order = np.argsort(-size, kind="stable")
    first = (np.cumsum(size) - size)[order]
    ordered = size[order]
    k = 0
    while (many := int(np.searchsorted(-ordered, -k, side="left"))) > 0:
        out[:many] += m[rows[first[:many] + k]]
        k += 1
    back = np.empty_like(out)
    back[order] = out
    return back


def _shared_words(block: np.ndarray, term: np.ndarray, block_doc: np.ndarray, first: np.ndarray, held: list[np.ndarray]) -> np.ndarray:
    """passage x item: words that both have, each as often as both have it. held[n - 1] tells which items have a term n times or more."""
    own = np.full(len(block_doc) + 1, -1)
    own[first] = np.arange(len(first))
    before = np.where(np.append(False, block_doc[1:] == block_doc[:-1])[block], own[block - 1], -1) if len(block) else np.zeros(0, int)
    passage, word = np.concatenate([own[block], before]), np.concatenate([term, term])
    passage, word = passage[passage >= 0], word[passage >= 0]
    key = np.sort(passage * len(held[0]) + word)
    run = np.flatnonzero(np.diff(key, prepend=-1))
    nth = np.arange(len(key)) - np.repeat(run, np.diff(np.append(run, len(key))))
    out = np.zeros((len(first), held[0].shape[1]), np.float32)
    for n, has in enumerate(held):
        some = key[nth == n]
        out += _sum_by(some // len(has), len(first), some % len(has), has)
    return out


def _may_share(inside: np.ndarray | None, block_doc: np.ndarray, first: np.ndarray, items: list[int], least: np.ndarray) -> np.ndarray:
    """The passages that may share `least` words with one of the items, by the words of their blocks (_Bags.in_blocks)."""
    if inside is None:
        return np.arange(len(first))
    mine = inside[:, items]
    held = mine[first]
    two = np.append(block_doc[1:] == block_doc[:-1], False)[first]
    held[two] += mine[first[two] + 1]
    return np.flatnonzero((held >= least).any(1))


def _may_hold(inside: np.ndarray, a: np.ndarray, b: np.ndarray, item: np.ndarray, width: np.ndarray, needed: np.ndarray) -> np.ndarray:
    """The cases of which some width[item] neighbours (all, if they are fewer) of inside[a:b, item] add up to needed[item]."""
    n = inside.shape[1]
    sums = np.zeros((len(inside) + 1, n), np.int32)
    np.cumsum(inside, 0, np.int32, sums[1:])
    sums, least, wide = sums.ravel(), needed[item], np.minimum(width[item], b - a)
    found = np.zeros(len(item), bool)
    left = np.flatnonzero(wide > 0)
    begin = a
    while len(left):
        at = begin[left] * n + item[left]
        good = sums[at + wide[left] * n] - sums[at] >= least[left]
        found[left[good]] = True
        begin = begin + 1
        left = left[~good & (begin[left] + wide[left] <= b[left])]
    return np.flatnonzero(found)


def _batches(batch: pa.RecordBatch, words_at_once: int = 40_000) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    sizes = np.diff(batch.column(1).offsets.to_numpy())
    cuts = np.cumsum(sizes) // words_at_once
    edges = [0, *np.flatnonzero(np.diff(cuts)) + 1, len(sizes)]
    for a, b in zip(edges[:-1], edges[1:]):
        if b > a:
            part = batch.slice(a, b - a)
            terms, size = _flat(part.column(1))
            yield part, terms, size


def fit_space(encoded: DataFrame, space: Space, dimensions: int = DIMENSIONS, max_df: float = MAX_DF, seed: int = SEED) -> Space:
    """idf over all blocks, then a randomised SVD of the passages' TF-IDF matrix A with the items' rows under it.

    The sketch is Y = (A'A) W for a random W: each task adds up its passages' part, the driver sums
    |vocabulary| x (dimensions + OVERSAMPLE) numbers of each task through an aggregation by term, and a
    Nystrom step turns W, Y into the leading right singular vectors. The items' rows weigh as much
    together as all passages, so that the space spans them.
    """
    n_terms = len(space.ids)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, total = np.zeros(n_terms, np.int64), 0
        everything = np.ones(n_terms, bool)
        for batch in batches:
            for _, terms, sizes in _batches(batch):
                block, term, doc, _ = _blocks(terms, sizes, everything)
                key = np.sort(block * n_terms + term)
                df += np.bincount(key[np.diff(key, prepend=-1) != 0] % n_terms, minlength=n_terms)
                total += len(doc)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, n_terms, dtype=np.int32)), pa.array(np.append(total, df))], names=["term", "n"])

    got = encoded.select("doc_id", "terms").mapInArrow(frequencies, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(n_terms + 1, np.int64)
    df[got.term.to_numpy() + 1] = got.n.to_numpy()
    total, df = int(df[0]), df[1:]
    space.idf = np.log((1 + total) / (1 + df)).astype(np.float32) + 1
    space.used = df <= max(max_df * total, 1)
    space.idf[~space.used] = 0
    q = space.matrix()
    width = min(dimensions + OVERSAMPLE, max(1, n_terms))
    sketch = np.random.Generator(np.random.PCG64(seed)).standard_normal((n_terms, width)).astype(np.float32)
    used = space.used
    wide = encoded.sparkSession.sparkContext.broadcast(sketch * space.idf[:, None])

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y = np.zeros((n_terms, width), np.float64)
        for batch in batches:
            for _, terms, sizes in _batches(batch):
                block, term, doc, _ = _blocks(terms, sizes, used)
                if not len(term):
                    continue
                p, first = _passages(_sum_by(block, len(doc), term, wide.value), doc)
                # each of a passage's blocks passes the passage's sketch to its terms
                own = np.zeros((len(doc), width), np.float32)
                own[first] += p
                two = np.append(doc[:-1] == doc[1:], False)[first]
                own[first[two] + 1] += p[two]
                order = np.argsort(term, kind="stable")
                some, group = np.unique(term[order], return_inverse=True)
                y[some] += _sum_by(group, len(some), block[order], own)
        some = np.flatnonzero(y.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(list(y[some].astype(np.float32)), pa.list_(pa.float32()))], names=["term", "y"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"term": pdf.term.iloc[:1], "y": [np.sum(np.stack(pdf.y.to_list()), 0, dtype=np.float64)]})

    sums = encoded.select("doc_id", "terms").mapInArrow(gram, "term int, y array<float>").groupBy("term").applyInPandas(add, "term int, y array<double>").toPandas()
    y = np.zeros((n_terms, width))
    if len(sums):
        y[sums.term.to_numpy()] = np.stack(sums.y.to_list()) * space.idf[sums.term.to_numpy()][:, None]
    w = sketch.astype(np.float64)
    # the mean of w'(A'A)w over random w is A's squared norm; an item's row has length 1
    weight = max(1.0, float((w * y).sum() / width)) / len(q)
    y += weight * (q.T.astype(np.float64) @ (q.astype(np.float64) @ w))
    shift = 1e-7 * np.linalg.norm(y)
    y += shift * w
    core = w.T @ y
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > 1e-10 * max(values.max(), 1e-30)
    half = y @ (vectors[:, good] / np.sqrt(values[good]))
    u, _, _ = np.linalg.svd(half, full_matrices=False)
    space.basis = u[:, :dimensions].astype(np.float32)
    at = q @ space.basis
    space.basis = space.basis * space.idf[:, None]
    space.queries = at / np.maximum(np.linalg.norm(at, axis=1, keepdims=True), 1e-9)
    return space


def _least_shared(n: int, cover: float) -> float:
    """How many of an item's n words at least one passage holds, if a stretch as long as _cover() looks at holds `cover` of them.

    Passages of two blocks begin at every block, so those at every other block part a stretch into so many
    pieces, and one of two neighbours misses at most half of what a short stretch has beyond a block.
    """
    stretch, words = n + max(2, n // 4), cover * n
    share = words / -(-(stretch + BLOCK - 1) // (2 * BLOCK))
    return max(share, words - (stretch - BLOCK) // 2) if BLOCK < stretch <= 2 * BLOCK else share


class _Bags:
    """How often each item has each term; what stretches of texts share with items, many at a time."""

    def __init__(self, items: list[list[int]], n_terms: int) -> None:
        self.n_terms = n_terms
        pairs = np.concatenate([np.array(w, np.int64) + i * n_terms for i, w in enumerate(items)])
        self.keys, self.counts = np.unique(pairs, return_counts=True)
        self.table = self.has = None
        if len(items) * n_terms <= TABLE_CELLS:
            self.table = np.zeros(len(items) * n_terms, np.uint8 if self.counts.max() < 256 else np.int32)
            self.table[self.keys] = self.counts
            self.has = np.ascontiguousarray(self.table.reshape(len(items), n_terms).T > 0).view(np.uint8)

    def in_blocks(self, block: np.ndarray, term: np.ndarray, n: int) -> np.ndarray | None:
        """block x item: how many of a block's words the item has; None beyond TABLE_CELLS."""
        return None if self.has is None else _sum_by(block, n, term, self.has)

    def of(self, keys: np.ndarray) -> np.ndarray:
        if self.table is not None:
            return self.table[keys]
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.counts[at], 0)

    def share(self, terms: np.ndarray, begin: np.ndarray, stop: np.ndarray, item: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Which stretches terms[begin:stop] have at least `least` words in common with their item, each as often as both have it."""
        out = []
        # words that no item has are left out before stretches are made of words
        kept = np.concatenate([[0], np.cumsum(terms >= 0)])
        terms, begin, stop = terms[terms >= 0], kept[begin], kept[stop]
        narrow = np.int64 if self.table is None else np.int32
        edges = [0, *(np.flatnonzero(np.diff(np.cumsum(stop - begin) // WORDS_AT_ONCE)) + 1), len(begin)]
        for a, b in zip(edges[:-1], edges[1:]):
            n = (stop - begin)[a:b]
            word = terms[np.arange(int(n.sum())) + np.repeat(begin[a:b] - (np.cumsum(n) - n), n)].astype(narrow)
            held = self.of(np.repeat((item[a:b] * self.n_terms).astype(narrow), n) + word)
            ends = np.cumsum(n)
            so_far = np.concatenate([[0], np.cumsum(held > 0, dtype=np.int32)])
            enough = so_far[ends] - so_far[ends - n] >= least[a:b]
            keep = np.flatnonzero(np.repeat(enough, n) & (held > 0))
            case, held = np.repeat(np.arange(b - a), n)[keep], held[keep]
            both, first, many = np.unique(case * self.n_terms + word[keep], return_index=True, return_counts=True)
            shared = np.bincount(both // self.n_terms, np.minimum(many, held[first]), b - a)
            out.append(a + np.flatnonzero(enough & (shared >= least[a:b])))
        return np.concatenate(out) if out else np.zeros(0, np.int64)


def contaminated(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, cover: float = COVER, cover_with_answer: float = COVER_WITH_ANSWER) -> DataFrame:
    """doc_id, item_id, cosine, coverage, answer_found: every leak of a benchmark item into a document.

    Passages (32 words, one every 16) and items meet in a latent space (fit_space); passages of at least
    `cosine` (cut_off) are candidates, and for items of frequent terms (COVERED) those that share words.
    A word that no item has can be part of no common subsequence; it takes room in a passage, no more. A candidate is a leak if the longest common subsequence of the item and the
    words around the passage covers `cover` of the item, or `cover_with_answer` with the answer's words
    in place (answer_of); items too short for an order of their own (under 5 words) need all. Every
    passage of every document is compared with every item.

    Null or wordless texts and items leak nothing and match nothing; a null id is kept as null. Rows with
    one doc_id give one row an item, the best; of items with one item_id each counts. Texts of any length are
    read whole. An empty benchmark or corpus gives no rows. Other columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    rows = benchmark.select(F.col("item_id").cast("long").alias("i"), F.col("text").alias("t")).distinct().orderBy("i", "t").toLocalIterator()
    found = spark.createDataFrame([], SCHEMA)
    for items in _in_blocks((r.i, words(r.t), answer_of(r.t)) for r in rows):
        found = found.unionByName(_leaks_of(docs, items, cosine, cover, cover_with_answer))
    best = F.max(F.struct("coverage", "cosine", "answer_found")).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.cosine", "b.coverage", "b.answer_found")


def _in_blocks(items: Iterator[tuple]) -> Iterator[list[tuple]]:
    held, n = [], 0
    for item in items:
        if not item[1]:
            continue
        if held and n + len(item[1]) > ITEM_WORDS:
            yield held
            held, n = [], 0
        held.append(item)
        n += len(item[1])
    if held:
        yield held


def cut_off(n_words: int, cosine: float) -> float:
    """The cosine from which a passage is a candidate for an item of so many words: `cosine` if the item fills a passage."""
    return cosine * min(1.0, (max(n_words, 4) / (2 * BLOCK)) ** 0.5)


def _leaks_of(docs: DataFrame, items: list[tuple[int, list[int], list[int]]], cosine: float, cover: float, cover_with_answer: float) -> DataFrame:
    spark = docs.sparkSession
    space = Space(items)
    encoded = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).filter("text IS NOT NULL").mapInArrow(_encode(space.hashes), "doc_id long, terms array<int>"), "decontam-terms")
    fit_space(encoded, space, max(DIMENSIONS, len(items) // ITEMS_A_DIMENSION))
    shared = spark.sparkContext.broadcast(space)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        numbered = [([s.ids[w] for w in ws], [s.ids[w] for w in answer]) for _, ws, answer in s.items]
        places = [_places(want) for want, _ in numbered]
        bags = _Bags([want for want, _ in numbered], len(s.used))
        lengths = np.array([len(want) for want, _ in numbered])
        needed = cover_with_answer * lengths
        # stretches of _cover() touch so many blocks; it looks at whole texts for less than half an item
        blocks_looked_at = -(-(_span(lengths) + BLOCK - 1) // BLOCK) if cover_with_answer >= 0.5 else np.full(len(lengths), 1 << 30)
        cuts = np.array([cut_off(len(want), cosine) for want, _ in numbered], np.float32)
        common = [i for i, (want, _) in enumerate(numbered) if s.used[want].mean() < COVERED]
        everything = np.ones(len(s.used), bool)
        often = np.zeros((len(s.used), len(common)), np.int32)
        for k, i in enumerate(common):
            np.add.at(often[:, k], numbered[i][0], 1)
        held = [(often >= n).astype(np.uint8) for n in range(1, int(often.max(initial=0)) + 1)]
        least = np.array([_least_shared(len(numbered[i][0]), cover_with_answer) for i in common], np.float32)
        for batch in batches:
            out: dict[tuple, tuple] = {}
            for part, terms, sizes in _batches(batch):
                block, term, block_doc, block_start = _blocks(terms, sizes, s.used)
                p, first = _passages(_sum_by(block, len(block_doc), term, s.basis), block_doc)
                doc, start = block_doc[first], block_start[first]
                p /= np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-9)
                sim = p @ s.queries.T
                begin = np.cumsum(sizes) - sizes
                ids = part.column(0).to_pylist()
                near_enough = sim >= cuts[None, :]
                block, term, _, _ = _blocks(terms, sizes, everything)
                inside = bags.in_blocks(block, term, len(block_doc))
                if common:
                    some = _may_share(inside, block_doc, first, common, least)
                    near_enough[np.ix_(some, common)] |= _shared_words(block, term, block_doc, first[some], held) >= least
                where, which = np.divmod(np.flatnonzero(near_enough), len(lengths))
                first_word = np.maximum(begin[doc[where]], start[where] - lengths[which])
                past = np.minimum((begin + sizes)[doc[where]], start[where] + 2 * BLOCK + lengths[which])
                # no common subsequence is longer than what the bags share, nor that than the item's words in the blocks around
                if inside is not None:
                    before, head = begin[doc[where]], np.searchsorted(block_doc, doc[where])
                    some = _may_hold(inside, head + (first_word - before) // BLOCK, head - (before - past) // BLOCK, which, blocks_looked_at, needed)
                    where, which, first_word, past = where[some], which[some], first_word[some], past[some]
                some = bags.share(terms, first_word, past, which, needed[which])
                for at, item, a, b in zip(where[some].tolist(), which[some].tolist(), first_word[some].tolist(), past[some].tolist()):
                    want, answer = numbered[item]
                    d = doc[at]
                    near = terms[a:b].tolist()
                    got = _cover(want, near, places[item])
                    if got < cover_with_answer:
                        continue
                    told = bool(answer) and lcs(answer, near) >= ANSWER_COVER * len(answer)
                    if got >= (1.0 if len(want) < 5 else cover) or (told and len(want) >= 5):
                        key = (ids[d], s.items[item][0])
                        best = (got, round(float(sim[at, item]), 4), told)
                        if key not in out or out[key] < best:
                            out[key] = best
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in out], pa.int64()), pa.array([k[1] for k in out], pa.int64()), pa.array([v[1] for v in out.values()], pa.float64()), pa.array([v[0] for v in out.values()], pa.float64()), pa.array([v[2] for v in out.values()], pa.bool_())],
                names=["doc_id", "item_id", "cosine", "coverage", "answer_found"],
            )

    return encoded.mapInArrow(search, SCHEMA)


def _span(n: int | np.ndarray) -> np.ndarray:
    """Words of the stretches in which _cover() looks for an item of n words."""
    return n + np.maximum(2, n // 4)


def _cover(want: list[int], near: list[int], places: dict | None = None) -> float:
    """Share of the item in its longest common subsequence with a stretch of about its own length."""
    span = int(_span(len(want)))
    places = _places(want) if places is None else places
    full = _lcs(places, len(want), near)
    if full < 0.5 * len(want) or len(near) <= span:
        return full / len(want)
    step = max(1, len(want) // 8)
    return max(_lcs(places, len(want), near[a : a + span]) for a in range(0, len(near) - span + step, step)) / len(want)


def without_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the documents that hold a benchmark item; rows without a doc_id stay."""
    name = f"rg_{uuid.uuid4().hex}"
    leaked = staged(contaminated(docs, benchmark, **options).select(F.col("doc_id").alias(name)).dropna().distinct(), "decontam-leaked")
    return docs.join(small(leaked, 16), docs["doc_id"].cast("long") == leaked[name], "left_anti")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))
