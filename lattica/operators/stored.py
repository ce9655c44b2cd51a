"""Layouts that are written once and read often: vectors by cell, edges by source, events by id and time.

Each is a Parquet folder that any reader of Spark can use; a look-up reads the parts that can hold an answer.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators.search import SMALL_FRONTIER, live, top, vector_search
from lattica.session import checkpointed

# --- vectors: an inverted file --------------------------------------------------------------------------------

#: Most cells; rounds of Lloyd's iteration; cells that a search reads before it knows what it has to beat.
MOST_CELLS, ROUNDS, FIRST_CELLS = 4096, 6, 8
#: Vectors that centroids are fitted on are drawn, about so many a cell; all are indexed.
DRAWN = 256


def _units(vectors: pd.Series, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of usable vectors and these, as unit vectors."""
    good = [k for k, v in enumerate(vectors) if v is not None and len(v) == dim and all(x is not None for x in v)]
    m = np.stack([np.asarray(vectors.iloc[k], np.float64) for k in good]) if good else np.zeros((0, dim))
    norm = np.linalg.norm(m, axis=1)
    use = np.isfinite(norm) & (norm > 1e-10)
    return np.asarray(good, int)[use], m[use] / norm[use, None]


def fit_cells(items: DataFrame, dim: int, cells: int | None = None, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of unit vectors. Each round sums up in the workers; the driver gets ``cells`` sums of ``dim`` numbers."""
    usable = items.where(F.size("embedding") == dim)
    n = usable.count()
    cells = cells or int(min(MOST_CELLS, max(1, round(n**0.5))))
    share = min(1.0, DRAWN * cells / max(n, 1))
    drawn = checkpointed((usable.sample(False, share, seed=5) if share < 1 else usable).select("_id", "embedding"))
    first = drawn.orderBy(F.xxhash64("_id"), "_id").limit(cells).select("embedding").toPandas()
    c = _units(first["embedding"], dim)[1]
    for _ in range(rounds if len(c) else 0):
        now = c

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums, counts = np.zeros_like(now), np.zeros(len(now), np.int64)
            for batch in batches:
                _, u = _units(batch["embedding"], dim)
                own = (u @ now.T).argmax(axis=1)
                np.add.at(sums, own, u)
                counts += np.bincount(own, minlength=len(now))
            some = np.flatnonzero(counts)
            if len(some):  # a task may have no usable vector, and Arrow cannot make a column of lists from nothing
                yield pd.DataFrame({"cell": some, "total": list(sums[some])})

        parts = drawn.select("embedding").mapInPandas(run, "cell int, total array<double>").groupBy("cell")
        rows = parts.agg(F.array(*(F.sum(F.col("total")[k]) for k in range(dim))).alias("total")).collect()
        c = now.copy()
        for r in rows:
            total = np.asarray(r["total"])
            norm = np.linalg.norm(total)
            if norm > 1e-10:
                c[r["cell"]] = total / norm
    return c


def write_vectors(items: DataFrame, path: str, dim: int, cells: int | None = None) -> None:
    """Items ``(_id, embedding, …)`` in a folder a cell, and the table of cells: centroid and radius (the greatest distance of
    a unit vector in it). Items whose vector cannot be used, or has another
    length, are in cell -1, which no search by a vector of length ``dim`` needs."""
    c = fit_cells(items, dim, cells)

    @F.pandas_udf("struct<cell:int,far:double>")
    def place(vectors: pd.Series) -> pd.DataFrame:
        cell, far = np.full(len(vectors), -1), np.zeros(len(vectors))
        at, u = _units(vectors, dim)
        if len(at) and len(c):
            near = u @ c.T
            own = near.argmax(axis=1)
            cell[at], far[at] = own, np.sqrt(np.maximum(0.0, 2 - 2 * near[np.arange(len(u)), own]))
        return pd.DataFrame({"cell": cell, "far": far})

    placed = items.withColumn("_p", place("embedding")).select(*items.columns, F.col("_p.cell").alias("cell"), F.col("_p.far").alias("_far"))
    placed.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/lists")
    spark = items.sparkSession
    radius = spark.read.parquet(f"{path}/lists").groupBy("cell").agg(F.max("_far").alias("radius"))
    known = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(c)], "cell int, centroid array<double>")
    known.join(radius, "cell").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")


def search_vectors(
    spark: SparkSession, path: str, query: Sequence[float], limit: int, probes: int | None = None, kinds: Sequence[str] | None = None, before: Column | None = None
) -> DataFrame:
    """``vector_search`` over a folder of ``write_vectors``. Exact unless ``probes`` says how many cells to read.

    A unit vector in a cell is no nearer to the query than the centroid less the radius. So the nearest ``FIRST_CELLS``
    are searched first, and then all cells that may hold something as near as the last of what they gave."""
    q = np.asarray(query, np.float64)
    norm = np.linalg.norm(q)
    cells = spark.read.parquet(f"{path}/cells").orderBy("cell").toPandas()  # MOST_CELLS rows at most
    lists = spark.read.parquet(f"{path}/lists").drop("_far")
    if not len(cells) or len(q) != len(cells["centroid"].iloc[0]) or norm <= 1e-10:  # vectors of other lengths are in cell -1
        return vector_search(lists.where("cell = -1").drop("cell"), query, limit, kinds, before)
    away = np.sqrt(np.maximum(0.0, 2 - 2 * np.stack(cells["centroid"].to_list()) @ (q / norm)))
    order, names = np.argsort(away, kind="stable"), cells["cell"].to_numpy()

    def within(chosen: np.ndarray) -> DataFrame:
        return vector_search(lists.where(F.col("cell").isin([int(x) for x in names[chosen]])).drop("cell"), query, limit, kinds, before)

    if probes is not None:
        return within(order[:probes])
    worst = within(order[:FIRST_CELLS]).select("semantic").collect()  # limit rows
    if len(worst) < limit:
        return within(order)
    beaten = np.sqrt(max(0.0, 2 - 2 * min(r["semantic"] for r in worst))) + 1e-6
    return within(np.flatnonzero(away - cells["radius"].to_numpy() <= beaten))


# --- edges by source ------------------------------------------------------------------------------------------

BUCKETS, LANES = 64, 64


def write_edges(edges: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Edges both ways, in buckets by the node that they start from. A search joins whole buckets, so these need no order.

    With 0 buckets each edge is written once, where it is made: nothing is dealt, and a search reads all of them. That
    takes a fraction of the disk, and is the form for edges that only few levels are searched in."""
    if not buckets:
        edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"), "relation").write.mode("overwrite").parquet(path)
        return
    ways = F.array(F.struct(F.col("source_id").alias("a"), F.col("target_id").alias("b"), F.lit(True).alias("forward")), F.struct(F.col("target_id").alias("a"), F.col("source_id").alias("b"), F.lit(False).alias("forward")))
    both = edges.select("relation", F.explode(ways).alias("x")).select("x.*", "relation").withColumn("bucket", _bucket("a", buckets))
    both.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def _bucket(column: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int")


def _sent(df: DataFrame, rows: int) -> DataFrame:
    """A frontier as it is joined: sent to the other side, not that dealt to it, where it has few rows."""
    return F.broadcast(df) if rows <= SMALL_FRONTIER else df


def traverse_many(nodes: DataFrame, path: str, starts: Sequence[str], relations: Sequence[str], depth: int = 3, directed: bool = True, buckets: int = BUCKETS) -> DataFrame:
    """``(start, _id, level)``: live nodes within ``depth`` steps of each start, which is left out; all starts in one pass.

    A node's visits are a long with a bit a start (64 starts a pass), so a level is one join of the frontier with the
    buckets that it touches, one grouped OR, and one join with what was visited before. Each level is a checkpoint.
    ``buckets`` is what the edges were written with; without any all edges are joined, and from both ends if undirected."""
    spark = nodes.sparkSession
    starts = list(dict.fromkeys(starts))
    if len(starts) > LANES:
        parts = [traverse_many(nodes, path, starts[k : k + LANES], relations, depth, directed, buckets) for k in range(0, len(starts), LANES)]
        out = parts[0]
        for more in parts[1:]:
            out = out.union(more)
        return out
    bit = lambda k: (1 << k) - (1 << 64 if k == 63 else 0)  # noqa: E731  as a signed long
    visited = frontier = spark.createDataFrame([(s, bit(k)) for k, s in enumerate(starts)], "id string, lanes long")
    hits = spark.createDataFrame([], "id string, lanes long, level int")
    kind = "a string, b string, forward boolean, relation string, bucket int" if buckets else "a string, b string, relation string"
    edges = spark.read.schema(kind).parquet(path).where(F.col("relation").isin(*relations))
    if buckets and directed:
        edges = edges.where("forward")

    def steps() -> DataFrame:
        """``(id, lanes)``: the other ends of the frontier's edges."""
        to = F.col("b").alias("id"), "lanes"
        if buckets:
            touched = [r[0] for r in frontier.select(_bucket("id", buckets)).distinct().collect()]
            return edges.where(F.col("bucket").isin(touched)).join(_sent(frontier, n), F.col("a") == F.col("id")).select(*to)
        found = edges.join(_sent(frontier, n), F.col("a") == F.col("id")).select(*to)
        return found if directed else found.union(edges.join(_sent(frontier, n), F.col("b") == F.col("id")).select(F.col("a"), "lanes"))

    n = total = len(starts)
    for level in range(1, depth + 1):
        step = steps().groupBy("id").agg(F.bit_or("lanes").alias("lanes"))
        seen = visited.groupBy("id").agg(F.bit_or("lanes").alias("seen"))
        new = step.join(_sent(seen, total), "id", "left").select("id", F.col("lanes").bitwiseAND(F.bitwise_not(F.coalesce("seen", F.lit(0)))).alias("lanes")).where("lanes <> 0")
        frontier = checkpointed(new)
        n = frontier.count()
        if not n:
            break
        total += n
        hits, visited = hits.union(frontier.withColumn("level", F.lit(level))), visited.union(frontier)
    lane = F.explode(F.transform(F.array(*map(F.lit, starts)), lambda s, k: F.struct(s.alias("start"), k.alias("k"))))
    each = hits.select("id", "level", "lanes", lane.alias("x")).where(F.getbit("lanes", F.col("x.k")) == 1).select(F.col("x.start").alias("start"), F.col("id").alias("_id"), "level")
    # What was visited goes to the nodes, where it is small; else all nodes would be dealt by id to find those few.
    ids = _sent(hits.select(F.col("id").alias("_id")).distinct(), total)
    shown = live(nodes).select("_id").join(ids, "_id", "left_semi")
    return each.join(shown, "_id", "left_semi").select("start", "_id", "level")


# --- events by id and time --------------------------------------------------------------------------------------


def write_timeline(events: DataFrame, path: str, key: str, row_group: int = 8 << 20, ids: int = 1_000_000) -> None:
    """One row an event and id of the array ``key``, clustered by id and time; row groups have Bloom filters of ids.

    Ranges are by id and time, so an id with many events is many files, and a look-up skips what lies beside it."""
    each = events.withColumn("id", F.explode(key)).where("id IS NOT NULL").withColumn("micros", _micros(F.col("timestamp")))
    ordered = each.repartitionByRange("id", "micros").sortWithinPartitions("id", "micros")
    writer = ordered.write.mode("overwrite").option("parquet.block.size", str(row_group))
    writer.option("parquet.bloom.filter.enabled#id", "true").option("parquet.bloom.filter.expected.ndv#id", str(ids)).parquet(path)


def _micros(at: Column) -> Column:
    """A time as a number, by which row groups can be skipped; that of a time without a zone is not."""
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), at.cast("timestamp_ntz"))


def stored_events_of(spark: SparkSession, path: str, value: str, limit: int = 20, kind: str | None = None, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """``events_of`` over a folder of ``write_timeline``."""
    found = live(spark.read.parquet(path).where(F.col("id") == value))
    if kind is not None:
        found = found.where(F.col("event_type") == kind)
    if start is not None:
        found = found.where(F.col("micros") >= _micros(start))
    if end is not None:
        found = found.where(F.col("micros") <= _micros(end))
    return top(found, limit, F.col("timestamp").desc(), F.col("_id")).drop("id", "micros")
