"""Centroid clustering with block-norm screening (operator 12).

Vectors become integers, ``floor(256 * x)``, so that assignments and means are exact and reruns agree. Lloyd's rounds
assign every vector to its nearest centroid, ties to the smaller number, and replace each centroid that has vectors by
the componentwise floor of their mean.

Screening. A vector is cut into segments of ``SEGMENT`` components. Of each segment two numbers are kept, once and for
all: its sum over the root of its length (the part along the diagonal) and the norm of the rest. By Cauchy-Schwarz the
rests of two segments are at least as far apart as their norms, and the two parts are orthogonal, so the squared
distance of two such compressed vectors is a lower bound of the true one. Lower bounds to all centroids are one
matrix product. The centroid with the least bound gets its exact distance first; then only centroids whose bound, less
the error of the floating point arithmetic, does not exceed that distance get exact integer distances.

Each round is one pass over the compressed table; tasks emit sums by cluster and component, added up by Spark, and
what reaches the driver are as many numbers as the centroids have components (``k`` is a parameter, not data).

Defined cases: vectors that are null, of another length, or hold null or non-finite components are not kept; components
stop at +-``LIMIT``, so that every squared distance of 64 components fits a long; fewer vectors than ``k`` start as
fewer centroids; equal hashes (repeated ids) go by components, null ids come last; repeated rows are vectors of
their own; a sum beyond a long is null; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import materialize, read, spare_memory

K, ROUNDS, DIMS, SCALE, SEED = 40, 5, 64, 256, 2
SEGMENT = 4
#: 64 * (2 * LIMIT) ** 2 < 2 ** 63.
LIMIT = 189_812_530
#: Vectors whose bounds, and pairs whose distances, are in memory at once.
ROWS, PAIRS = 4096, 1 << 14


def quantized(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """``(id, ints)`` of the vectors that are kept."""
    e = F.col(f"`{vector_col}`").cast("array<double>")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    cell = F.transform(e, lambda x: F.floor(F.greatest(F.least(x * scale, F.lit(float(LIMIT))), F.lit(float(-LIMIT)))).cast("int"))
    return vectors.where((F.size(e) == dims) & finite).select(F.col(f"`{id_col}`").alias("id"), cell.alias("ints"))


def segment_norms(v: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
    """Compressed vectors: of each segment the part along its diagonal and the norm of the rest."""
    starts = np.arange(0, v.shape[1], segment)
    lengths = np.diff(np.append(starts, v.shape[1]))
    sums = np.add.reduceat(v, starts, axis=1)
    rest = lengths * np.add.reduceat(v * v, starts, axis=1) - sums * sums  # exact integers
    return np.hstack([sums / np.sqrt(lengths), np.sqrt(rest / lengths)])


def nearest(v: np.ndarray, f: np.ndarray, centroids: np.ndarray, fc: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid and exact squared distance of each row, and how many exact distances that took."""
    size, size_c = (f * f).sum(axis=1)[:, None], (fc * fc).sum(axis=1)[None, :]
    bound = size + size_c - 2 * (f @ fc.T) - (1e-9 * (size + size_c) + 1e-6)
    at_most = ((v - centroids[bound.argmin(axis=1)]) ** 2).sum(axis=1)
    rows, cols = np.nonzero(bound <= at_most[:, None])
    exact = np.empty(len(rows), np.int64)
    for k in range(0, len(rows), PAIRS):
        exact[k : k + PAIRS] = ((v[rows[k : k + PAIRS]] - centroids[cols[k : k + PAIRS]]) ** 2).sum(axis=1)
    starts = np.searchsorted(rows, np.arange(len(v)))
    least = np.minimum.reduceat(exact, starts) if len(v) else exact
    hits = np.flatnonzero(exact == least[rows])
    first = hits[np.searchsorted(rows[hits], np.arange(len(v)))]
    return cols[first], least, len(v) + len(rows)


def _blocks(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Vectors and their compressed form, some rows at a time."""
    ints = batch.column(batch.schema.get_field_index("ints")).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width).astype(np.int64)
    norms = batch.column(batch.schema.get_field_index("norms")).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    for k in range(0, batch.num_rows, ROWS):
        yield k, ints[k : k + ROWS], norms[k : k + ROWS]


def compressed(kept: DataFrame, dims: int = DIMS) -> DataFrame:
    """``(id, ints, norms)``, written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spare_memory()
        for batch in batches:
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dims).astype(np.int64)
            f = segment_norms(v)
            offsets = np.arange(0, f.size + 1, f.shape[1], dtype=np.int32)
            yield pa.record_batch([*batch.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(f.ravel()))], ["id", "ints", "norms"])

    kind = kept.schema["id"].dataType.simpleString()
    return materialize(kept.mapInArrow(run, f"id {kind}, ints array<int>, norms array<double>"), "vectors")


def first_centroids(kept: DataFrame, k: int = K, seed: int = SEED) -> list[list[int]]:
    """The ``k`` kept vectors whose id has the smallest hash."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    top = kept.select(h.alias("h"), "ints").orderBy(F.col("h").asc_nulls_last(), "ints").limit(k)
    return [r["ints"] for r in top.collect()]


def moved_centroids(table: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """One round: means of the vectors nearest to each centroid, floored; empty ones stay."""
    dims, c = len(centroids[0]), np.array(centroids, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spare_memory()
        fc, sums, counts = segment_norms(c), np.zeros_like(c), np.zeros(len(c), np.int64)
        for batch in batches:
            for _, v, f in _blocks(batch, dims):
                cluster, _, _ = nearest(v, f, c, fc)
                order = np.argsort(cluster, kind="stable")
                met, starts = np.unique(cluster[order], return_index=True)
                sums[met] += np.add.reduceat(v[order], starts, axis=0)
                counts += np.bincount(cluster, minlength=len(c))
        some = np.flatnonzero(counts)
        cells = np.column_stack([counts[some], sums[some]])
        place = np.tile(np.arange(dims + 1, dtype=np.int32), len(some))
        yield pa.record_batch([pa.array(np.repeat(some, dims + 1).astype(np.int32)), pa.array(place), pa.array(cells.ravel())], ["cluster", "place", "total"])

    partial = table.select("ints", "norms").mapInArrow(run, "cluster int, place int, total long")
    totals = {(r["cluster"], r["place"]): int(r["total"]) for r in partial.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(20,0)")).alias("total")).collect()}
    return [[totals[j, d + 1] // totals[j, 0] for d in range(dims)] if (j, 0) in totals else old for j, old in enumerate(centroids)]


def assigned(table: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """``(id, cluster, distance)`` of every vector."""
    dims, c = len(centroids[0]), np.array(centroids, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spare_memory()
        fc = segment_norms(c)
        for batch in batches:
            for k, v, f in _blocks(batch, dims):
                cluster, distance, _ = nearest(v, f, c, fc)
                yield pa.record_batch([batch.column(0).slice(k, len(v)), pa.array(cluster.astype(np.int32)), pa.array(distance)], ["id", "cluster", "distance"])

    return table.mapInArrow(run, f"id {table.schema['id'].dataType.simpleString()}, cluster int, distance long")


def cluster_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, rounds: int = ROUNDS, dims: int = DIMS, seed: int = SEED) -> tuple[DataFrame, list[list[int]]]:
    """Clusters of all kept vectors as ``(id_col, cluster, distance)``, and the final centroids."""
    kept = quantized(vectors, id_col, vector_col, dims)
    kind = kept.schema["id"].dataType.simpleString()
    table = compressed(kept, dims)
    centroids = first_centroids(table, k, seed)
    if not centroids:
        return vectors.sparkSession.createDataFrame([], f"`{id_col}` {kind}, cluster int, distance long"), []
    for _ in range(rounds):
        centroids = moved_centroids(table, centroids)
    return assigned(table, centroids).withColumnRenamed("id", id_col), centroids


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kept vector's cluster and distance, with what its cluster and all add up to and the centroid's digest."""
    found, centroids = cluster_vectors(read(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    found = materialize(found, "clusters")
    total = F.sum(F.col("distance").cast("decimal(20,0)"))
    by_cluster = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(total.alias("s")).collect()}  # a row a centroid

    def fits(n: int) -> int | None:
        return n if n < 1 << 63 else None

    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    known = [(j, fits(by_cluster.get(j, 0)), digests[j]) for j in range(len(centroids))]
    table = F.broadcast(spark.createDataFrame(known, "cluster int, cluster_inertia long, centroid_sha256 string"))  # k rows
    return found.join(table, "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", F.lit(fits(sum(by_cluster.values()))).cast("long").alias("inertia"), "centroid_sha256"
    )


def _rounds_sql() -> str:
    def nearest_sql(r: int) -> str:
        return f"""a{r} AS MATERIALIZED (SELECT n, vec_id, v, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT n, vec_id, v, c,
    CAST(list_sum(list_transform(list_zip(v, w), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS BIGINT) AS d FROM v, c{r}) GROUP BY n, vec_id, v)"""

    def means_sql(r: int) -> str:
        return f"""m{r} AS (SELECT c, list(CAST((s - ((s % k) + k) % k) // k AS BIGINT) ORDER BY j) AS w FROM (SELECT c, j, sum(x) AS s, count(*) AS k
    FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM a{r}) GROUP BY c, j) GROUP BY c),
c{r + 1} AS MATERIALIZED (SELECT c, coalesce(m{r}.w, c{r}.w) AS w FROM c{r} LEFT JOIN m{r} USING (c))"""

    return ",\n".join(f"{nearest_sql(r)},\n{means_sql(r)}" for r in range(ROUNDS)) + f",\n{nearest_sql(ROUNDS)}"


OP12_SQL = f"""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
v AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id,
    list_transform(e, lambda x: CAST(floor(greatest(least(x * {SCALE}, {LIMIT}), -{LIMIT})) AS BIGINT)) AS v
  FROM e WHERE len(e) = {DIMS} AND len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || CAST(vec_id AS VARCHAR)) NULLS LAST, v) - 1 AS c, v AS w FROM v
  ORDER BY sha256('{SEED}:' || CAST(vec_id AS VARCHAR)) NULLS LAST, v LIMIT {K}),
{_rounds_sql()}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(w, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} USING (c)
"""
