"""Approximate nearest neighbours: multiprobe p-stable hashing and exact distance reranking.

Gaussian projections, cut into steps, give every vector a bucket in each of several tables. A query visits, in every
table, the buckets around its own in the order of the estimated probability that a neighbour at the
fitted distance lies there, until that adds up to its share of the wanted recall. Rows and probes meet by
(table, part of the buckets) in blocks of bounded size. A part is what agrees in a table's first few projections, so a
query's buckets, which lie around its own, are in few parts; the more rows, the more projections, in all and for parts. Large parts are
split by rows and by queries. Each block returns at most k candidates a query with exact distances; the candidates of all tables are merged.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cladeframe.llm import tokens
from cladeframe.llm.common import checkpointed

#: Tables, projections of a table at least (half as many as the number of rows has bits, if that is more), the step as a multiple of the fitted distance, and the recall that probes are counted for.
TABLES, PROJECTIONS, STEP, RECALL, SEED = 8, 8, 1.43, 0.95, 11
#: The distance is fitted to the k-th neighbours, among all rows, of this many vectors (those of the least md5 of their ids).
FIT_QUERIES, FIT_QUANTILE = 64, 0.9
#: Rows and queries that one block holds at most, about; queries of a task that works out probes.
BLOCK_ROWS, BLOCK_QUERIES, PROBE_TASK = 8192, 2048, 64
_BEAM, _REACH = 2048, 2


def valid(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and v (array of doubles or floats): rows with an id and a vector without null or non-finite components, not zero and of
    the most common length (ties: the longest). Of several rows of one id, the least vector counts."""
    x = F.col(vector_col)
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    fine = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("v", lambda e: e != 0)
    rows = rows.where(F.coalesce(fine, F.lit(False)))
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("v") == (common["d"] if common else 0)).groupBy("vec_id").agg(F.min("v").alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten(), dtype=np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of x from q, in double precision."""
    d = x - q
    return np.sqrt(np.einsum("ij,ij->i", d, d))


def fitted_distance(rows: DataFrame, k: int) -> float:
    """The distance at which neighbours are to be found: FIT_QUANTILE of the sample's distances to their k-th neighbour among all rows."""
    sample = rows.orderBy(F.md5(F.col("vec_id").cast("string")), "vec_id").limit(FIT_QUERIES).collect()
    if len(sample) < 2:
        return 1.0
    ids, q = np.array([r.vec_id for r in sample]), np.array([r.v for r in sample], np.float64)

    def nearest(batches):
        best = np.zeros((len(q), 0))
        for batch in batches:
            x, own = _matrix(batch.column("v")), np.asarray(batch.column("vec_id"))
            found = np.array([np.where(own == i, np.inf, distances(x, y)) for i, y in zip(ids, q)])
            best = np.sort(np.concatenate([best, found], axis=1), axis=1)[:, :k]
        at, _ = np.nonzero(np.isfinite(best))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(best[np.isfinite(best)])], names=["q", "d"])

    each = rows.mapInArrow(nearest, "q long, d double").withColumn("n", F.row_number().over(W.partitionBy("q").orderBy("d"))).where(F.col("n") <= k)
    far = each.groupBy("q").agg(F.max("d").alias("d")).agg(F.percentile("d", FIT_QUANTILE)).first()[0]
    return float(far) if far else 1.0


class Hashes:
    """The tables' projections, and the order in which a query probes. Buckets that agree in the first ``shared`` projections are one part."""

    def __init__(self, dim: int, distance: float, tables: int = TABLES, projections: int = PROJECTIONS, recall: float = RECALL, seed: int = SEED, shared: int = 0):
        rng = np.random.default_rng(seed)
        self.shared = min(shared, projections)
        self.distance, self.step = distance, STEP * distance
        self.a = rng.normal(size=(tables, dim, projections))
        self.b = rng.uniform(0, self.step, size=(tables, projections))
        self.wanted = 1 - (1 - recall) ** (1 / tables)
        self.salt = tokens.mixed(np.arange(1, projections + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)

    def cells(self, x: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        """Cell numbers by projection, and places within the cells."""
        p = (x @ self.a[table] + self.b[table]) / self.step
        cell = np.floor(p)
        return cell.astype(np.int64), (p - cell) * self.step

    def keys(self, cells: np.ndarray) -> np.ndarray:
        return tokens.mixed((cells.astype(np.uint64) * self.salt).sum(axis=-1, dtype=np.uint64)).view(np.int64)

    def parts(self, cells: np.ndarray) -> np.ndarray:
        return self.keys(np.where(np.arange(cells.shape[-1]) < self.shared, cells, 0))

    def probes(self, cell: np.ndarray, place: np.ndarray, beam: int = _BEAM) -> np.ndarray:
        """Cells of the buckets to visit, the likeliest first. A projection of the difference to a neighbour at the
        fitted distance is Gaussian, so each cell's probability is known; those of a bucket multiply. The beam of
        partial buckets is widened until the visited ones reach the wanted probability."""
        moves = np.arange(-_REACH, _REACH + 1)
        low = (moves * self.step - place[:, None]) / self.distance
        p = 0.5 * (_erf((low + self.step / self.distance) / math.sqrt(2)) - _erf(low / math.sqrt(2)))
        score, at = np.ones(1), np.zeros((1, 0), np.int64)
        for k in range(len(cell)):
            score = (score[:, None] * p[k][None]).ravel()
            best = np.argpartition(-score, beam)[:beam] if len(score) > beam else np.arange(len(score))
            score, at = score[best], np.concatenate([at[best // len(moves)], moves[best % len(moves)][:, None]], axis=1)
        order = np.argsort(-score, kind="stable")
        n = int(np.searchsorted(np.cumsum(score[order]), self.wanted)) + 1
        if n > len(order) and beam < len(moves) ** len(cell):
            return self.probes(cell, place, beam * 8)
        return cell + at[order[:n]]


def _erf(x: np.ndarray) -> np.ndarray:
    return np.vectorize(math.erf, otypes=[float])(x)


def _hashed(rows: DataFrame, hashes: Hashes) -> DataFrame:
    """A row for each row and table: the part and bucket, and the vector's bytes in the column's own precision."""

    def run(batches):
        for batch in batches:
            x, own = _matrix(batch.column("v")), _packed_vectors(batch.column("v"))
            for t in range(len(hashes.a)):
                cells = hashes.cells(x, t)[0]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(hashes.parts(cells)), pa.array(hashes.keys(cells)), batch.column("vec_id"), own], names=["t", "part", "bucket", "vec_id", "x"])

    return rows.mapInArrow(run, "t int, part long, bucket long, vec_id long, x binary")


def _packed_vectors(column: pa.Array) -> pa.Array:
    """Floats as 4 bytes a component, all else as doubles."""
    x = _matrix(column)
    kind = np.float32 if pa.types.is_float32(column.type.value_type) else np.float64
    return pa.array([r.tobytes() for r in x.astype(kind)], pa.binary())


def _unpacked(packed: pd.Series, dim: int) -> np.ndarray:
    """Vectors as doubles; what is not 8 bytes a component is floats."""
    raw = b"".join(packed)
    return np.frombuffer(raw, np.float32 if len(raw) == 4 * dim * len(packed) else np.float64).reshape(len(packed), dim).astype(np.float64)


def _probed(queries: DataFrame, hashes: Hashes) -> DataFrame:
    """A row for each query, table and part that it comes to: the keys to visit there."""

    def run(batches):
        for batch in batches:
            x, own, out = _matrix(batch.column("v")), _packed_vectors(batch.column("v")).to_pylist(), []
            for t in range(len(hashes.a)):
                cells, places = hashes.cells(x, t)
                for i, q in enumerate(batch.column("vec_id").to_pylist()):
                    visited = hashes.probes(cells[i], places[i])
                    keys, part = hashes.keys(visited), hashes.parts(visited)
                    order = np.argsort(part, kind="stable")
                    ends = np.flatnonzero(np.append(np.diff(part[order]) != 0, True)) + 1
                    for a, b in zip([0, *ends[:-1]], ends):
                        out.append((t, int(part[order[a]]), q, own[i], np.sort(keys[order[a:b]]).tobytes()))
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=["t", "part", "query_id", "q", "probes"])

    return queries.mapInArrow(run, "t int, part long, query_id long, q binary, probes binary")


def _blocks(data: DataFrame, asked: DataFrame, k: int, dim: int) -> DataFrame:
    """query_id, vec_id, score: the k nearest of every block for every query in it. Blocks are parts, split evenly by
    hash where they hold too many rows or queries; the counts that say so are joined, not broadcast by force."""
    n_rows = data.groupBy("t", "part").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("row_splits"))
    n_asked = asked.groupBy("t", "part").agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).cast("int").alias("query_splits"))
    splits = checkpointed(n_rows.join(n_asked, ["t", "part"]))
    pick = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    d = data.join(splits, ["t", "part"]).withColumn("rs", pick("vec_id", "row_splits")).withColumn("qs", F.explode(F.sequence(F.lit(0), F.col("query_splits") - 1))).drop("row_splits", "query_splits")
    a = asked.join(splits, ["t", "part"]).withColumn("qs", pick("query_id", "query_splits")).withColumn("rs", F.explode(F.sequence(F.lit(0), F.col("row_splits") - 1))).drop("row_splits", "query_splits")

    def search(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(queries):
            ids, x = rows["vec_id"].to_numpy(), _unpacked(rows["x"], dim)
            buckets, bucket = np.unique(rows["bucket"].to_numpy(), return_inverse=True)
            asked, y = queries["query_id"].to_numpy(), _unpacked(queries["q"], dim)
            square = np.einsum("ij,ij->i", x, x)
            for first in range(0, len(asked), 64):  # the matrix product only tells which rows may be near; distances are taken exactly
                rough = square - 2 * (y[first : first + 64] @ x.T)
                for q, z, r, probes in zip(asked[first : first + 64], y[first : first + 64], rough, queries["probes"].iloc[first : first + 64]):
                    here = ids != q
                    if probes is not None:
                        p = np.frombuffer(probes, np.int64)
                        visited = np.zeros(len(buckets) + 1, bool)
                        place = np.searchsorted(buckets, p)
                        visited[np.where(buckets[np.minimum(place, len(buckets) - 1)] == p, place, len(buckets))] = True
                        here &= visited[:-1][bucket]
                    at = np.flatnonzero(here)
                    if len(at) > k:
                        r = r[at]
                        at = at[r <= np.partition(r, k - 1)[k - 1] + 1e-9 * (square.max() + z @ z)]
                    d = distances(x[at], z)
                    best = np.lexsort((ids[at], d))[:k]
                    if len(best):
                        out.append((q, ids[at[best]].tolist(), d[best].tolist()))
        return pd.DataFrame(out, columns=["query_id", "ids", "ds"])

    keys = ["t", "part", "rs", "qs"]
    found = d.groupBy(*keys).cogroup(a.groupBy(*keys)).applyInPandas(search, "query_id long, ids array<long>, ds array<double>")
    return found.select("query_id", F.explode(F.arrays_zip("ids", "ds")).alias("x")).select("query_id", F.col("x.ids").alias("vec_id"), F.col("x.ds").alias("score"))


def nearest(df: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = RECALL) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: each query's k nearest rows found, by Euclidean distance in double
    precision, ties to the smaller vec_id; the query's own id is no candidate.

    ``queries`` has the same columns as ``df``. Rows whose id or vector is null, whose vector is zero, holds null or
    non-finite components or has another length than most take no part on either side; of several rows of one id one counts.
    Of equal vectors only the k + 1 smallest ids can be among anyone's k nearest, so only they are indexed. A
    query for which hashing finds fewer than k, though there are more rows, is searched exactly. No rows, no result.
    """
    every = checkpointed(valid(df, id_col, vector_col))
    asked = checkpointed(valid(queries, id_col, vector_col))
    rows = checkpointed(every.withColumn("n", F.row_number().over(W.partitionBy("v").orderBy("vec_id"))).where(F.col("n") <= k + 1).drop("n"))
    n = rows.count()
    first = rows.first()
    if first is None:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = len(first.v)
    asked = asked.where(F.size("v") == dim)
    asked = asked.repartition(max(1, min(10_000, math.ceil(asked.count() / PROBE_TASK))), "vec_id")
    # A projection has about three cells that many rows lie in: so many of them tell parts of BLOCK_ROWS rows apart.
    shared = math.ceil(math.log(max(1.0, n / BLOCK_ROWS), 3))
    hashes = Hashes(dim, fitted_distance(rows, k), projections=max(PROJECTIONS, round(math.log2(n) / 2)), recall=recall, shared=shared)
    found = _ranked(_blocks(_hashed(rows, hashes), _probed(asked, hashes), k, dim), k)
    found = checkpointed(found)
    least = min(k, n - 1)
    counted = asked.join(found.groupBy("query_id").count(), F.col("vec_id") == F.col("query_id"), "left").where(F.coalesce("count", F.lit(0)) < least).select("vec_id", "v")
    short = checkpointed(counted)
    if short.isEmpty():
        return found
    # Blocks of all rows for the few that are short: parts by hash alone, and every bucket visited.
    parts = max(1, math.ceil(n / BLOCK_ROWS))
    one = Hashes(dim, 1.0, tables=1)
    every_row = _hashed(rows, one).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)))
    exact = short.select(F.lit(0).alias("t"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"), F.col("vec_id").alias("query_id"), "v")
    return found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(_ranked(_blocks(every_row, _asked_everywhere(exact), k, dim), k))


def _asked_everywhere(asked: DataFrame) -> DataFrame:
    """Queries that visit every bucket."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("t", "part", "query_id")), _packed_vectors(batch.column("v")), pa.nulls(batch.num_rows, pa.binary())], names=["t", "part", "query_id", "q", "probes"])

    return asked.mapInArrow(run, "t int, part long, query_id long, q binary, probes binary")


def _ranked(candidates: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query over all tables and blocks; a row that several found counts once."""
    once = candidates.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
