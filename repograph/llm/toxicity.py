"""Operator 8: toxicity by gradient-boosted trees over dense features, with isotonic calibration."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, small, staged

#: At most so many labelled rows fit the lexicon, the trees and the calibration (rows of least hash).
MAX_LABELLED = 20_000
THRESHOLD, SEED = 0.5, 11
#: A learned stem needs this much evidence (log-likelihood ratio) and this share of toxic rows among those that have it.
STEM_LLR, STEM_PRECISION, STEM_ROWS = 25.0, 0.9, 4
STEM_SIZES = range(4, 10)
INSULTS = frozenset(
    "idiot idiots stupid moron morons trash scum loser losers clown pathetic worthless disgusting dumb fool jerk filth vermin garbage "
    "idiota estupido imbecil basura asqueroso dummkopf abschaum widerlich wertlos imbecile ordure minable degoutant nul".split()
)
SECOND_PERSON = frozenset("you your yours yourself ur u du dich dir dein deine ihr euch tu te toi ton ta tes vous votre usted ustedes ti tus vosotros".split())
_FOLD = str.maketrans("0134578@$!", "oieastbasi")
_WORDS = re.compile(r"[^\W_]+")
_MASKED = re.compile(r"[^\W\d_]+[\d@$!*#]+[^\W\d_]+")
_MARKS = re.compile(r"[!?]{2,}|[$%&*#@]{2,}")
FEATURES = ("insults", "stems", "insult_kinds", "stem_kinds", "near_you", "you", "capitals", "shouted", "marks", "exclaim", "masked", "digits", "mean_word", "words")
_SPAN = 8


def stems_of(word: str) -> list[str]:
    return [word[:n] for n in STEM_SIZES if n <= len(word)]


def features(text: str | None, stems: frozenset[str]) -> list[float]:
    """Rates over the whole text; a null or wordless text has zeros."""
    text = text or ""
    words = _WORDS.findall(text.lower())
    n, size = len(words), max(1, len(text))
    if not n:
        return [0.0] * len(FEATURES)
    kinds = Counter(words)
    masked = _MASKED.findall(text)
    bad, stem = {w: c for w, c in kinds.items() if w in INSULTS}, {}
    if stems:
        for w, c in kinds.items():
            if len(w) >= 4 and any(w[:k] in stems for k in STEM_SIZES):
                stem[w] = c
    folded = sum(m.lower().translate(_FOLD) in INSULTS for m in masked)
    near = 0
    if bad or stem:
        at = [i for i, w in enumerate(words) if w in SECOND_PERSON]
        if at:
            hits = np.array([i for i, w in enumerate(words) if w in bad or w in stem])
            spots = np.array(at)
            k = np.searchsorted(spots, hits)
            left = np.abs(hits - spots[np.maximum(k - 1, 0)])
            right = np.abs(hits - spots[np.minimum(k, len(spots) - 1)])
            near = int((np.minimum(left, right) <= _SPAN).sum())
    raw = text.split()
    upper = sum(map(str.isupper, raw))
    return [
        (sum(bad.values()) + folded) / n, sum(stem.values()) / n, float(len(bad)), float(len(stem)), near / n, sum(kinds[w] for w in SECOND_PERSON if w in kinds) / n,
        sum(map(str.istitle, raw)) / n, upper / n, len(_MARKS.findall(text)) / n, (text.count("!") + text.count("?")) / size,
        len(masked) / n, sum(map(str.isdigit, words)) / n, sum(map(len, words)) / n, float(n),
    ]


class Boosted:
    """Trees of least squares on logistic gradients (Friedman, 2001), over at most 64 bins a feature."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, leaf: int = 5, l2: float = 1.0) -> None:
        self.rounds, self.depth, self.rate, self.leaf, self.l2 = rounds, depth, rate, leaf, l2
        self.base, self.trees, self.cuts = 0.0, [], []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 65)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
        self.cuts = [np.unique(np.append(c, np.nextafter(0, 1))) for c in self.cuts]
        bins = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)], 1)
        rate = np.clip(y.mean() if len(y) else 0.0, 1e-4, 1 - 1e-4)
        self.base = float(np.log(rate / (1 - rate)))
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            tree: list[tuple[int, float, float]] = [(-1, 0.0, 0.0)] * (2 ** (self.depth + 1))
            score = score + self._grow(tree, 1, np.arange(len(y)), bins, p - y, p * (1 - p))
            self.trees.append(tree)
        return self

    def _grow(self, tree: list, at: int, rows: np.ndarray, bins: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(g))
        todo = [(at, rows)]
        while todo:
            at, rows = todo.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            value = -self.rate * gs / (hs + self.l2)
            tree[at] = (-1, 0.0, float(value))
            best = (1e-6, -1, 0)
            if at < 2**self.depth and len(rows) >= 2 * self.leaf:
                for j, cuts in enumerate(self.cuts):
                    b = bins[rows, j]
                    size = len(cuts) + 1
                    gl = np.cumsum(np.bincount(b, g[rows], size))[:-1]
                    hl = np.cumsum(np.bincount(b, h[rows], size))[:-1]
                    nl = np.cumsum(np.bincount(b, minlength=size))[:-1]
                    gain = gl**2 / (hl + self.l2) + (gs - gl) ** 2 / (hs - hl + self.l2) - gs**2 / (hs + self.l2)
                    gain[(nl < self.leaf) | (len(rows) - nl < self.leaf)] = -1
                    if len(gain) and gain.max() > best[0]:
                        best = (float(gain.max()), j, int(gain.argmax()))
            if best[1] < 0:
                out[rows] = value
                continue
            j, k = best[1], best[2]
            tree[at] = (j, float(self.cuts[j][k]), 0.0)
            left = bins[rows, j] <= k
            todo += [(2 * at, rows[left]), (2 * at + 1, rows[~left])]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.trees:
            feature = np.array([t[0] for t in tree])
            cut, value = np.array([t[1] for t in tree]), np.array([t[2] for t in tree])
            at = np.ones(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[at]
                inner = f >= 0
                right = x[np.arange(len(x)), np.maximum(f, 0)] > cut[at]
                at = np.where(inner, 2 * at + right, at)
            out += value[at]
        return out


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: (scores, probabilities) to interpolate between."""
    if not len(score):
        return np.zeros(1), np.zeros(1)
    order = np.argsort(score, kind="stable")
    s, v = score[order], y[order].astype(float)
    blocks: list[list[float]] = []  # total, count, least, greatest score
    for a, b in zip(s.tolist(), v.tolist()):
        blocks.append([b, 1.0, a, a])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            t = blocks.pop()
            blocks[-1] = [blocks[-1][0] + t[0], blocks[-1][1] + t[1], blocks[-1][2], t[3]]
    xs = np.array([e for b in blocks for e in (b[2], b[3])])
    return xs, np.array([b[0] / b[1] for b in blocks for _ in (0, 1)])


class ToxicityModel:
    def __init__(self, stems: frozenset[str], trees: Boosted | None, curve: tuple[np.ndarray, np.ndarray] | None, prior: float) -> None:
        self.stems, self.trees, self.curve, self.prior = stems, trees, curve, prior

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        x = np.array([features(t, self.stems) for t in texts], float).reshape(-1, len(FEATURES))
        if self.trees is None:  # no labels: the lexicon alone
            return np.where(x[:, 0] > 0.005, 0.9, self.prior)
        return np.interp(self.trees.score(x), *self.curve)


def _llr(k1: np.ndarray, k0: np.ndarray, n1: int, n0: int) -> np.ndarray:
    k, n = k1 + k0, n1 + n0
    part = lambda o, e: np.where(o > 0, o * np.log(np.maximum(o, 1e-9) / np.maximum(e, 1e-9)), 0.0)
    return 2 * (part(k1, k * n1 / n) + part(k0, k * n0 / n) + part(n1 - k1, (n - k) * n1 / n) + part(n0 - k0, (n - k) * n0 / n))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, seed: int = SEED) -> ToxicityModel:
    """A model from labelled documents: a lexicon of stems, trees and a calibration curve.

    The labels' rows of least hash are used, at most max_labelled. Four fifths of them, by hash, train:
    words whose presence speaks for the toxic label become stems (word beginnings of 4 to 9 letters) of
    the lexicon, and trees are fit on the features. Isotonic calibration is fit on the last fifth, which
    neither has seen (on all rows if a part lacks a class). Rows with a null doc_id,
    label or text don't take part; of several labels for a document the greatest counts. Without two
    classes the built-in lexicon decides alone.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("rg_id"), F.col("toxic").cast("int").alias("rg_y")).dropna().groupBy("rg_id").agg(F.max("rg_y").alias("rg_y"))
        .orderBy(F.xxhash64("rg_id", F.lit(seed)), "rg_id").limit(max_labelled)
    )
    chosen = small(chosen, 16, max_labelled)
    rows = docs.select(F.col("doc_id").cast("long").alias("rg_id"), F.col("text").alias("rg_text")).dropna().join(chosen, "rg_id")
    rows = staged(rows.withColumn("rg_held", F.expr(f"pmod(xxhash64(rg_id, {seed + 1}), 5) = 4")), "toxicity-labelled")

    def stem_rows(keep: frozenset[str] | None, toxic: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: Counter[str] = Counter()
            for batch in batches:
                for text in batch.column(0).to_pylist():
                    found = {s for w in set(_WORDS.findall(text.lower())) for s in stems_of(w)}
                    seen.update(found if keep is None else found & keep)
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["stem", "n"])

        return train.filter(F.col("rg_y") == toxic).select("rg_text").mapInArrow(run, "stem string, n long").groupBy("stem").agg(F.sum("n").alias("n"))

    held = {(r.rg_held, r.y): r.n for r in rows.groupBy("rg_held", F.least(F.col("rg_y"), F.lit(1)).alias("y")).agg(F.count("*").alias("n")).collect()}
    n1, n0 = (held.get((True, y), 0) + held.get((False, y), 0) for y in (1, 0))
    prior = n1 / (n1 + n0) if n1 + n0 else 0.0
    if not n1 or not n0:
        return ToxicityModel(frozenset(), None, None, prior)
    apart = all(held.get((h, y), 0) for h in (True, False) for y in (0, 1))
    train = rows.filter(~F.col("rg_held")) if apart else rows
    if apart:
        n1, n0 = held[False, 1], held[False, 0]
    hits = stem_rows(None, 1).filter(F.col("n") >= STEM_ROWS).toPandas().set_index("stem").n
    # a stem that even without clean rows has too little evidence is not counted there
    hits = hits[_llr(hits.to_numpy(float), np.zeros(len(hits)), n1, n0) >= STEM_LLR] if len(hits) else hits
    stems: frozenset[str] = frozenset()
    if len(hits):
        clean = stem_rows(frozenset(hits.index), 0).toPandas().set_index("stem").n.reindex(hits.index).fillna(0)
        k1, k0 = hits.to_numpy(float), clean.to_numpy(float)
        good = (_llr(k1, k0, n1, n0) >= STEM_LLR) & (k1 >= STEM_PRECISION * (k1 + k0))
        stems = frozenset(hits.index[good])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t, stems) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(x, pa.list_(pa.float64()))], names=["rg_id", "y", "held", "x"])

    got: pd.DataFrame = rows.select("rg_id", "rg_text", "rg_y", "rg_held").mapInArrow(measure, "rg_id long, y int, held boolean, x array<double>").toPandas()
    got["key"] = [tuple(v) for v in got.x]
    got = got.sort_values(["rg_id", "y", "key"])
    x, y = np.array(got.x.tolist(), float), np.minimum(got.y.to_numpy(float), 1)
    held_out = got.held.to_numpy(bool) if apart else np.zeros(len(y), bool)
    trees = Boosted().fit(x[~held_out], y[~held_out])
    on = held_out if held_out.any() else ~held_out
    return ToxicityModel(stems, trees, isotonic(trees.score(x[on]), y[on]), prior)


def score(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, toxicity (calibrated probability, 4 decimals), is_toxic for every row; one pass, no shuffle.

    A null or empty text has the features of no words; a text of any length is read whole. Rows with one
    doc_id or a null one each give a row; an empty table gives none. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.round(np.concatenate([np.zeros(0), *(model.probabilities(batch.column(1).slice(i, 256).to_pylist()) for i in range(0, batch.num_rows, 256))]), 4)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array(p >= threshold)], names=["doc_id", "toxicity", "is_toxic"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("rg_text")).mapInArrow(run, "doc_id long, toxicity double, is_toxic boolean")


def without_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows whose probability reaches the threshold; the columns, and a null text's row, stay."""

    schema = docs.schema
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = [model.probabilities(batch.column(at).slice(i, 256).to_pylist()) for i in range(0, batch.num_rows, 256)]
            yield batch.filter(pa.array(np.round(np.concatenate([np.zeros(0), *p]), 4) < threshold))

    return docs.mapInArrow(run, schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, fit(docs, documents(spark, sf_dir, "labels")))
