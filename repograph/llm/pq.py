"""Operator 3: near-duplicate embeddings by product quantisation over inverted lists, with exact rerank."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, small, staged
from .components import components

THRESHOLD = 0.95
SUBSPACES, CODES, ROUNDS, SEED = 16, 256, 4, 3
#: A near pair's difference is taken to have in any one direction at least so many times its even share, 1 / sqrt(dim).
SPREAD = 3.0
#: Rows of least hash that are compared with all rows to see how much more of it near pairs have here, and how far beyond that is searched.
CALIBRATION, MARGIN = 2048, 1.25
#: Members of a list that one task searches, about.
LIST_ROWS = 20_000
#: Queries that meet a list at once.
AT_ONCE = 256
#: Rounding of single precision that the bounds allow for.
SLACK = 1e-3


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dim)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(1)[None, :] - 2 * (x @ centres.T), axis=1)


def _subspaces(dim: int, m: int) -> list[slice]:
    edges = np.linspace(0, dim, min(m, dim) + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:])]


def _kmeans(rows: DataFrame, start: list[np.ndarray], parts: Callable[[pa.RecordBatch], list[np.ndarray]], rounds: int) -> list[np.ndarray]:
    """Lloyd's rounds of several k-means over all rows at once; parts() gives a batch's points for each.

    Every task sums its rows by centre; the sums meet in a shuffle by centre.
    """
    centres = start
    for _ in range(rounds):
        shared = rows.sparkSession.sparkContext.broadcast(centres)

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now = shared.value
            total = [np.zeros((len(c), c.shape[1] + 1)) for c in now]
            for batch in batches:
                for t, c, x in zip(total, now, parts(batch)):
                    at = _nearest(x, c)
                    order = np.argsort(at, kind="stable")
                    first = np.flatnonzero(np.diff(at[order], prepend=-1))
                    if len(first):
                        t[at[order][first], :-1] += np.add.reduceat(x[order], first, axis=0)
                        t[:, -1] += np.bincount(at, minlength=len(c))
            out = [(s, i, t[i]) for s, t in enumerate(total) for i in np.flatnonzero(t[:, -1])]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.list_(pa.float64()))], names=["space", "centre", "sums"])

        summed = rows.mapInArrow(sums, "space int, centre int, sums array<double>").select("space", "centre", F.posexplode("sums").alias("at", "v")).groupBy("space", "centre", "at").agg(F.sum("v").alias("v"))
        got = summed.groupBy("space", "centre").agg(F.array_sort(F.collect_list(F.struct("at", "v")))["v"].alias("sums")).toPandas()
        centres = [c.copy() for c in centres]
        for s, i, v in zip(got.space, got.centre, got["sums"]):
            total = np.asarray(v, np.float64)
            centres[s][i] = (total[:-1] / total[-1]).astype(np.float32)
    return centres


def _link(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """label with the components that the edges a-b join made one (labels are least members)."""
    while True:
        la, lb = label[a], label[b]
        low = np.minimum(la, lb)
        if (la == lb).all():
            return label
        np.minimum.at(label, np.maximum(la, lb), low)
        while not np.array_equal(label[label], label):
            label = label[label]


def near_edges(vectors: DataFrame, threshold: float = THRESHOLD, subspaces: int = SUBSPACES, codes: int = CODES, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """src, dst: pairs that connect every group of vectors of at least `threshold` cosine.

    Unit vectors lie in inverted lists, about the square root of their number, and each has the codes of
    its residual's subspaces and the error of that. Every vector is a query. A vector within radius r of
    it (r from the threshold) can lie in another list only beyond the plane between the two centres, and
    asymmetric distances from lookup tables bound the true ones by the error. Both bounds take a share of
    r for the part of a near pair's difference that lies in one direction: at least SPREAD / sqrt(dim),
    and MARGIN times the most that the near pairs of CALIBRATION rows have, which brute force finds among
    all rows; never more than r, with which the search is exact. The exact cosine decides.

    Equal vectors collapse first. In each list, members near the member that is nearest the centre are
    linked to it and not compared with each other; a long list is searched in parts; a part links its
    matches into a forest, not all pairs. Vectors of each length are searched among themselves.
    """
    spark = vectors.sparkSession
    raw = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("v")).dropna()
    sizes = raw.filter(F.size("v") > 0).groupBy(F.size("v").alias("dim")).count().filter("count > 1").orderBy("dim").collect()
    out = spark.createDataFrame([], "src long, dst long")
    for row in sizes:
        out = out.unionByName(_edges_of(raw, row.dim, threshold, subspaces, codes, rounds))
    return out


def _edges_of(raw: DataFrame, dim: int, threshold: float, subspaces: int, codes: int, rounds: int) -> DataFrame:
    spark = raw.sparkSession

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), np.float64).reshape(-1, dim)
            norm = np.linalg.norm(x, axis=1)
            good = np.isfinite(norm) & (norm > 0)
            x = (x[good] / norm[good, None]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "x"])

    units = raw.filter((F.size("v") == dim) & ~F.exists("v", lambda e: e.isNull())).mapInArrow(unit, "id long, x binary")
    units = staged(units.withColumn("print", F.sha2("x", 256)), "pq-units")
    # equal vectors by aggregation and a join, so that no task holds all of a hot one; the fingerprint stands for the vector
    same = staged(units.groupBy("print").agg(F.min("id").alias("rep"), F.count("*").alias("held")), "pq-same")
    exact = units.select("print", "id").join(small(same.filter("held > 1").select("print", "rep"), 96), "print").filter("id != rep").select(F.col("rep").alias("src"), F.col("id").alias("dst")).distinct()
    rows = staged(units.groupBy("print").agg(F.min("id").alias("id"), F.first("x").alias("x")).select("id", "x"), "pq-distinct")
    n = rows.count()
    if n < 2:
        return exact
    lists = max(1, round(n**0.5))
    some = rows.orderBy(F.xxhash64("id", F.lit(SEED)), "id").limit(max(lists, codes)).toPandas()
    sample = np.frombuffer(b"".join(some.x), np.float32).reshape(-1, dim)
    coarse = _kmeans(rows, [sample[:lists].copy()], lambda b: [_matrix(b.column(1), dim)], rounds)[0]
    cuts = _subspaces(dim, subspaces)

    def residuals(x: np.ndarray) -> np.ndarray:
        return x - coarse[_nearest(x, coarse)]

    r0 = residuals(sample)[:codes]
    books = _kmeans(rows, [np.ascontiguousarray(r0[:, c]) for c in cuts], lambda b: (lambda r: [np.ascontiguousarray(r[:, c]) for c in cuts])(residuals(_matrix(b.column(1), dim))), rounds)
    radius = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    shared = spark.sparkContext.broadcast((coarse, books))

    def coded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, code, what the code says of the residual)."""
        centres, book = shared.value
        at = _nearest(x, centres)
        r = x - centres[at]
        code = np.stack([_nearest(np.ascontiguousarray(r[:, c]), b) for c, b in zip(cuts, book)], 1).astype(np.uint8)
        return at, code, np.concatenate([b[code[:, i]] for i, b in enumerate(book)], axis=1)

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The greatest share of r in one direction among the near pairs of the sample and the rows."""
        q, centres = trial.value, shared.value[0]
        dq = (q * q).sum(1)[:, None] + (centres**2).sum(1)[None, :] - 2 * q @ centres.T
        own, most = dq.argmin(1), 0.0
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                x = _matrix(batch.column(1).slice(start, 2000), dim)
                at, _, back = coded(x)
                error = np.linalg.norm(x - centres[at] - back, axis=1)
                i, j = np.nonzero(q @ x.T >= threshold)
                for k in range(0, len(i), 50_000):
                    a, b = i[k : k + 50_000], j[k : k + 50_000]
                    apart = np.linalg.norm(centres[at[b]] - centres[own[a]], axis=1)
                    plane = np.where(apart > 0, (dq[a, at[b]] - dq[a, own[a]]) / (2 * np.maximum(apart, 1e-9)), 0.0)
                    far = ((q[a] - centres[at[b]] - back[b]) ** 2).sum(1)
                    over = (far - error[b] ** 2 - radius**2) / (2 * np.maximum(error[b], 1e-3))
                    most = max(most, float(np.max(plane, initial=0.0)), float(np.max(over, initial=0.0)))
        yield pa.RecordBatch.from_arrays([pa.array([most])], names=["most"])

    trial = spark.sparkContext.broadcast(np.frombuffer(b"".join(rows.orderBy(F.xxhash64("id", F.lit(SEED + 1)), "id").limit(CALIBRATION).toPandas().x), np.float32).reshape(-1, dim))
    most = rows.mapInArrow(needed, "most double").agg(F.max("most")).first()[0] or 0.0
    part = min(1.0, max(SPREAD / dim**0.5, MARGIN * most / max(radius, 1e-9)))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, _ = shared.value
        for batch in batches:
            x = _matrix(batch.column(1), dim)
            at, code, back = coded(x)
            r = x - centres[at]
            columns = [batch.column(0), pa.array(at.astype(np.int32)), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(np.linalg.norm(r - back, axis=1).astype(np.float32)), pa.array((r * r).sum(1).astype(np.float32)), batch.column(1)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "list", "code", "error", "off", "x"])

    members = staged(rows.mapInArrow(encode, "id long, list int, code binary, error float, off float, x binary"), "pq-members")
    heads = members.groupBy("list").agg(F.min(F.struct("off", "id", "x")).alias("h")).select("list", "h.id", "h.x").toPandas()
    head_ids, head_x = np.full(lists, -1, np.int64), np.zeros((lists, dim), np.float32)
    head_ids[heads.list], head_x[heads.list] = heads.id, np.frombuffer(b"".join(heads.x), np.float32).reshape(-1, dim)
    leaders = spark.sparkContext.broadcast((head_ids, head_x))

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = leaders.value
        for batch in batches:
            at = batch.column(1).to_numpy()
            near = np.einsum("ij,ij->i", _matrix(batch.column(5), dim), x[at], dtype=np.float64) >= threshold
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids[at]), pa.array(near)], names=[*batch.schema.names, "head", "near"])

    members = members.mapInArrow(follow, "id long, list int, code binary, error float, off float, x binary, head long, near boolean")
    stars = members.filter("near AND id != head").select(F.col("head").alias("src"), F.col("id").alias("dst"))
    held = members.groupBy("list", "near").count().toPandas()
    cuts_of = np.ones((2, lists), np.int64)
    cuts_of[held.near.astype(int), held.list] = -(-held["count"] // LIST_ROWS)
    parts = spark.sparkContext.broadcast(cuts_of)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each part of each list that a query must meet; those near their list's head skip the others that are."""
        centres, n_parts = shared.value[0], parts.value
        norms = (centres**2).sum(1)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                x, own, linked = _matrix(some.column("x"), dim), some.column("list").to_numpy(), some.column("near").to_numpy(zero_copy_only=False)
                d = np.maximum(0, (x * x).sum(1)[:, None] + norms[None, :] - 2 * x @ centres.T)
                kinds, back = np.unique(own, return_inverse=True)
                apart = np.sqrt(np.maximum(0, norms[kinds][:, None] + norms[None, :] - 2 * centres[kinds] @ centres.T))[back]
                row, which = np.nonzero(d - d[np.arange(len(x)), own][:, None] <= 2 * (radius * part + SLACK) * apart + SLACK)
                for near in (0, 1):
                    keep = np.ones(len(row), bool) if not near else ~(linked[row] & (which == own[row]))
                    r, w = row[keep], which[keep]
                    times = n_parts[near][w]
                    r, w = np.repeat(r, times), np.repeat(w, times)
                    piece = np.arange(len(r)) - np.repeat(np.cumsum(times) - times, times)
                    yield pa.RecordBatch.from_arrays([some.column("id").take(pa.array(r)), pa.array(w.astype(np.int32)), pa.array(np.full(len(w), bool(near))), pa.array(piece.astype(np.int32)), some.column("x").take(pa.array(r))], names=["id", "list", "near", "piece", "x"])

    def search(queries: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"src": np.zeros(0, np.int64), "dst": np.zeros(0, np.int64)})
        if not len(queries) or not len(members):
            return none
        centres, book = shared.value
        xm = np.frombuffer(b"".join(members.x), np.float32).reshape(-1, dim)
        xq = np.frombuffer(b"".join(queries.x), np.float32).reshape(-1, dim)
        code = np.frombuffer(b"".join(members.code), np.uint8).reshape(len(xm), -1)
        error = members.error.to_numpy(np.float32)
        reach = error**2 + radius**2 + 2 * part * error * radius + SLACK
        ids = np.unique(np.concatenate([queries.id.to_numpy(np.int64), members.id.to_numpy(np.int64)]))
        nq, nm = np.searchsorted(ids, queries.id.to_numpy(np.int64)), np.searchsorted(ids, members.id.to_numpy(np.int64))
        label = np.arange(len(ids))
        centre = centres[int(members["list"].iloc[0])]
        for a in range(0, len(xq), AT_ONCE):
            q = xq[a : a + AT_ONCE] - centre
            far = np.zeros((len(q), len(xm)), np.float32)
            for i, (c, b) in enumerate(zip(cuts, book)):
                table = ((q[:, c][:, None, :] - b[None, :, :]) ** 2).sum(2)
                far += table[:, code[:, i]]
            row, col = np.nonzero(far <= reach[None, :])
            other = nq[a + row] != nm[col]
            row, col = row[other], col[other]
            for k in range(0, len(row), 100_000):
                rr, cc = row[k : k + 100_000], col[k : k + 100_000]
                near = np.einsum("ij,ij->i", xq[a + rr], xm[cc], dtype=np.float64) >= threshold
                if near.any():
                    label = _link(label, nq[a + rr[near]], nm[cc[near]])
        moved = np.flatnonzero(label != np.arange(len(ids)))
        return pd.DataFrame({"src": ids[label[moved]], "dst": ids[moved]}) if len(moved) else none

    pieces = spark.createDataFrame([(int(i), bool(n), int(cuts_of[int(n), i])) for i, n in zip(held.list, held.near)], "list int, near boolean, pieces long")
    keys = ["list", "near", "piece"]
    cut = members.join(F.broadcast(pieces) if len(held) < 100_000 else pieces, ["list", "near"]).withColumn("piece", F.expr("cast(pmod(xxhash64(id), pieces) as int)"))
    queries = members.select("id", "list", "x", "near").mapInArrow(probe, "id long, list int, near boolean, piece int, x binary")
    found = queries.groupBy(*keys).cogroup(cut.select(*keys, "id", "code", "error", "x").groupBy(*keys)).applyInPandas(search, "src long, dst long")
    return exact.unionByName(stars).unionByName(found)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", **options) -> DataFrame:
    """vec_id, duplicate_of: each vector that has a near duplicate with a lesser id, and the least id of its group.

    Groups are connected components of pairs of at least `threshold` cosine. Vectors that are null, empty,
    zero, not finite or have a null element, and rows without an id, are nobody's duplicates. Rows with one
    id and equal vectors count as one; of different vectors each is compared, under their one id. An empty
    table gives no rows. Other columns, whatever their names, are not read.
    """
    found = components(near_edges(vectors, threshold, id_col=id_col, vector_col=vector_col, **options))
    return found.filter("node != root").select(F.col("node").alias(id_col), F.col("root").alias("duplicate_of"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir, "embeddings"))
