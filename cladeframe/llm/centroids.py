"""Centroid clustering by sort-means over whole numbers.

Vectors become integers, so that distances, sums and ties are exact and a rerun or another partitioning gives the same
clusters. In each round every vector is scanned from its previous centroid outwards: the other centroids come in ascending distance from that one,
and the scan stops at the first that lies strictly beyond twice the vector's distance to it, as by the triangle inequality none
from there on can be nearer, or as near. Only the centroids travel: each round is one pass over narrow rows and one grouped sum.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cladeframe.llm.common import checkpointed

#: Components of a smaller magnitude are packed as 32-bit integers; differences of such, squared and summed over up to 2^7 of them, fit 64 bits.
NARROW = 1 << 27
#: Sums travel as digits in this base, so that they are exact at any magnitude and for any number of rows.
BASE_BITS = 40
_ROWS = 1 << 14


def whole(x: float, scale: int) -> int:
    """floor(scale * x) exactly, for any finite double."""
    p, q = x.as_integer_ratio()
    return scale * p // q


def unpacked(v: bytes) -> list[int] | None:
    """A vector of wide integers from its decimal text."""
    return [int(x) for x in v.split(b",")]


def kept_vectors(df: DataFrame, dims: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """id, ``v`` (packed 32-bit integers) or, where a component doesn't fit, ``wide`` (decimals joined by commas), of the vectors with exactly
    ``dims`` components, none null or non-finite; ``prev`` is 0."""
    x = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("e"))
    finite = ~F.exists("e", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    x = x.where((F.size("e") == dims) & finite)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                e = np.asarray(part.column("e").flatten(), dtype=np.float64).reshape(part.num_rows, dims)
                with np.errstate(over="ignore"):
                    y = np.floor(e * scale)
                narrow = (np.abs(y) < NARROW).all(axis=1)
                small = np.where(narrow[:, None], y, 0).astype("<i4")
                v = [small[i].tobytes() if ok else None for i, ok in enumerate(narrow)]
                wide = [None if ok else ",".join(str(whole(c, scale)) for c in e[i].tolist()).encode() for i, ok in enumerate(narrow)]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(v, pa.binary()), pa.array(wide, pa.binary()), pa.array(np.zeros(part.num_rows, np.int32))], names=["id", "v", "wide", "prev"])

    return x.mapInArrow(run, T.StructType([T.StructField("id", x.schema["id"].dataType), T.StructField("v", T.BinaryType()), T.StructField("wide", T.BinaryType()), T.StructField("prev", T.IntegerType())]))


def squared(a: list[int], b: list[int]) -> int:
    return sum((x - y) ** 2 for x, y in zip(a, b))


class Scan:
    """A set of centroids with, for each, the others in ascending distance from it."""

    def __init__(self, centroids: list[list[int]]):
        self.centroids = centroids
        k = len(centroids)
        self.between = [[squared(a, b) for b in centroids] for a in centroids]
        self.order = [sorted((j for j in range(k) if j != c), key=lambda j, c=c: (self.between[c][j], j)) for c in range(k)]
        self.narrow = all(abs(x) < NARROW for c in centroids for x in c)
        self.array = np.array(centroids, dtype=np.int64) if self.narrow else None

    def assigned(self, x: np.ndarray, prev: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each row (of equally near ones the smallest number) and the squared distance to it."""
        best, near = prev.astype(np.int64), np.zeros(len(x), np.int64)
        for c in np.unique(prev).tolist():
            rows = np.flatnonzero(prev == c)
            own = ((x[rows] - self.array[c]) ** 2).sum(axis=1)
            least, which = own.copy(), np.full(len(rows), c)
            going = np.arange(len(rows))
            for j in self.order[c]:
                # (a > 2 b for distances is a^2 > 4 b^2; the quotient keeps it within 64 bits.)
                going = going[own[going] >= -(-self.between[c][j] // 4)]
                if not len(going):
                    break
                d = ((x[rows[going]] - self.array[j]) ** 2).sum(axis=1)
                better = (d < least[going]) | ((d == least[going]) & (j < which[going]))
                least[going[better]], which[going[better]] = d[better], j
            best[rows], near[rows] = which, least
        return best, near

    def assigned_one(self, x: list[int], prev: int) -> tuple[int, int]:
        own = squared(x, self.centroids[prev])
        near, best = own, prev
        for j in self.order[prev]:
            if self.between[prev][j] > 4 * own:
                break
            d = squared(x, self.centroids[j])
            if (d, j) < (near, best):
                near, best = d, j
        return best, near


def _packed(part: pa.RecordBatch, dims: int) -> tuple[np.ndarray, list[tuple[int, list[int]]]]:
    """The rows as integers (0 where wide), and the wide rows with their places."""
    raw = part.column("v").to_pylist()
    none = bytes(4 * dims)
    x = np.frombuffer(b"".join(r or none for r in raw), "<i4").reshape(len(raw), dims).astype(np.int64)
    return x, [(i, unpacked(w)) for i, w in enumerate(part.column("wide").to_pylist()) if w is not None]


def _assign(rows: DataFrame, centroids: list[list[int]], dims: int) -> DataFrame:
    """``rows`` with ``prev`` set to the nearest centroid and ``distance`` (decimal text where it is beyond 64 bits: ``far``)."""
    scan = Scan(centroids)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                x, wide = _packed(part, dims)
                prev = np.asarray(part.column("prev"), dtype=np.int64)
                if scan.narrow:
                    best, near = scan.assigned(x, prev)
                    distance: list = near.tolist()
                else:
                    found = [scan.assigned_one(r, p) for r, p in zip(x.tolist(), prev.tolist())]
                    best, distance = np.array([b for b, _ in found], np.int64), [d for _, d in found]
                for i, w in wide:
                    best[i], distance[i] = scan.assigned_one(w, int(prev[i]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("v"), part.column("wide"), pa.array(best.astype(np.int32)), pa.array([d if d < 1 << 63 else None for d in distance], pa.int64())],
                    names=["id", "v", "wide", "prev", "distance"],
                )

    schema = T.StructType([*(f for f in rows.schema.fields if f.name != "distance"), T.StructField("distance", T.LongType())])
    return rows.mapInArrow(run, schema)


def _sums(rows: DataFrame, dims: int) -> dict[int, tuple[int, list[int]]]:
    """Count and componentwise sums of every non-empty cluster. A task sends at most clusters x components x digits rows."""
    mask = (1 << BASE_BITS) - 1

    def run(batches):
        total: dict[int, list] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                x, wide = _packed(part, dims)
                own = np.asarray(part.column("prev"), dtype=np.int64)
                for c in np.unique(own).tolist():
                    t = total.setdefault(c, [0, [0] * dims])
                    t[0] += int((own == c).sum())
                    t[1] = [a + b for a, b in zip(t[1], x[own == c].sum(axis=0).tolist())]
                for i, w in wide:
                    t = total[int(own[i])]
                    t[1] = [a + b for a, b in zip(t[1], w)]
        out = []
        for c, (n, sums) in total.items():
            out.append((c, -1, 0, n))
            for k, s in enumerate(sums):
                place = 0
                while s not in (0, -1):
                    out.append((c, k, place, s & mask))
                    s, place = s >> BASE_BITS, place + 1
                if s:
                    out.append((c, k, place, -1))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["c", "k", "place", "s"])

    digits = rows.select("id", "v", "wide", "prev").mapInArrow(run, "c int, k int, place int, s long").groupBy("c", "k", "place").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    out: dict[int, tuple[int, list[int]]] = {}
    for r in digits:
        n, sums = out.setdefault(r["c"], (0, [0] * dims))
        if r["k"] < 0:
            out[r["c"]] = (int(r["s"]), sums)
        else:
            sums[r["k"]] += int(r["s"]) << (BASE_BITS * r["place"])
    return out


def first_centroids(rows: DataFrame, k: int, salt: str, dims: int) -> list[list[int]]:
    """The ``k`` vectors whose ``salt:<id>`` has the least lowercase-hex sha256, in that order; rows without an id come last, those of one id in the order of their components."""
    h = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256)
    top = rows.orderBy(h.asc_nulls_last(), F.col("v").asc_nulls_last(), "wide").select("v", "wide").limit(k).collect()
    return [unpacked(r["wide"]) if r["v"] is None else np.frombuffer(bytes(r["v"]), "<i4").astype(int).tolist() for r in top]


def cluster(df: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, salt: str = "1", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, cluster, distance (squared), cluster_inertia, inertia (sums of distances over the cluster and over all) and centroid_sha256 of each vector.

    Vectors with another number of components than ``dims``, null ones and those with null or non-finite components are left out; the others' components
    become floor(scale * x). Repeated rows and ids count as rows. Fewer than ``k`` vectors are as many centroids; an empty table gives an empty
    one. Ties go to the smaller number; empty clusters keep their centroid. Sums and centroids are exact at any magnitude; a distance or
    inertia beyond 64 bits is null. Other columns of ``df``, whatever their names, aren't read.

    The driver holds ``k`` x ``dims`` integers and their sums. Each round writes a checkpoint of the packed vectors (4 bytes a component) with
    their clusters, from which the next scan goes on.
    """
    rows = checkpointed(kept_vectors(df, dims, scale, id_col, vector_col))
    centroids = first_centroids(rows, k, salt, dims)
    for done in range(rounds + 1 if centroids else 0):
        rows = checkpointed(_assign(rows, centroids, dims))
        if done < rounds:
            for c, (n, sums) in _sums(rows, dims).items():
                centroids[c] = [s // n for s in sums]
    if not centroids:
        rows = rows.withColumn("distance", F.lit(None).cast("long"))
    long_sum = F.when(F.count("distance") == F.count(F.lit(1)), F.sum(F.col("distance").cast("decimal(38,0)"))).alias("s")
    by = {r["prev"]: r["s"] for r in rows.groupBy("prev").agg(long_sum).collect()}  # at most k rows
    fits = lambda s: int(s) if s is not None and s < 1 << 63 else None
    total = fits(sum(by.values())) if all(s is not None for s in by.values()) else None
    told = [(c, fits(by.get(c)), total, hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centroids)]
    facts = df.sparkSession.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.select(F.col("id").alias("vec_id"), F.col("prev").alias("cluster"), "distance").join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle_sql(k: int = 16, rounds: int = 3) -> str:
    """The same rows in DuckDB, every distance taken (all integers within 64 bits)."""
    floor = "CASE WHEN s >= 0 THEN s // n ELSE -((-s + n - 1) // n) END"
    parts = [
        "v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, e FROM v ORDER BY sha256('1:' || vec_id) LIMIT {k})",
    ]
    for r in range(rounds + 1):
        parts.append(f"a{r} AS (SELECT vec_id, v.e, x.d, x.c FROM v, LATERAL (SELECT c, list_sum(list_transform(list_zip(v.e, c{r}.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM c{r} ORDER BY d, c LIMIT 1) x)")
        if r < rounds:
            parts.append(f"u{r} AS (SELECT c, i, sum(e[i])::BIGINT AS s, count(*)::BIGINT AS n FROM a{r}, range(1, 65) t(i) GROUP BY c, i)")
            parts.append(f"w{r} AS (SELECT c, list({floor} ORDER BY i) AS e FROM u{r} GROUP BY c)")
            parts.append(f"c{r + 1} AS (SELECT c{r}.c, coalesce(w{r}.e, c{r}.e) AS e FROM c{r} LEFT JOIN w{r} ON w{r}.c = c{r}.c)")
    return "WITH " + ",\n".join(parts) + f"\nSELECT vec_id, a{rounds}.c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a{rounds}.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c{rounds}.e, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} ON c{rounds}.c = a{rounds}.c"
