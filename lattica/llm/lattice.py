"""Embedding near-duplicates by E8 lattice hashing (operator 4).

Unit vectors are projected to 8 dimensions by random orthonormal maps, scaled, and decoded to the nearest point of
the E8 lattice; a lattice point in one of several tables is a cell. A vector lives in its home cell of each table
and also probes the neighbouring cells that its residual points to (of the 240 least vectors of the lattice those
with the largest inner product). Two vectors meet where one's home is the other's home or probe; every pair that
meets is verified by its cosine in double precision.

The lattice is an argument and does not follow the number of vectors: whether a pair meets depends on its two vectors
alone, so a table links the same pairs whatever else is in it. For tables of many millions a caller may choose a finer
lattice (``lattice_for`` names one that suits a number): a cell is then a pair or triple of lattice points, with more
tables and probes; in every setting a pair at cosine 0.9 meets with a chance of at least 0.99 (measured; at 0.95 above
0.9999).

Every vector is indexed. Equal vectors are one representative with a multiplicity. A cell above ``cell_rows`` is
dealt as pairs of blocks, so a task stays bounded and no pair is lost. Each pair is counted in one of the cells it
meets in only (the one of least key), so a cell hands on a count and a spanning forest, never its pairs.

Defined cases: a vector that is null, empty, zero, or holds null or non-finite components links with nothing and
is its own component, as is a row without id; vectors of unequal length never link; repeated rows are vectors of
their own; labels and extra columns play no part; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import bounded_batches, connected_components, materialize, read
from lattica.llm.simhash import spanning_links


def least_vectors() -> np.ndarray:
    """The 240 shortest non-zero points of E8."""
    rows = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            rows.append(v)
    rows += [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(rows)


def _nearest_even(x: np.ndarray) -> np.ndarray:
    """The nearest integer point with an even sum: round, and where the sum is odd turn the worst coordinate."""
    r = np.rint(x)
    odd = np.flatnonzero(r.sum(1) % 2)
    e = x[odd] - r[odd]
    worst = np.abs(e).argmax(1)
    r[odd, worst] += np.where(e[np.arange(len(odd)), worst] >= 0, 1.0, -1.0)
    return r


def decode_e8(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8: the nearer of the even integer points and those shifted by a half."""
    a, b = _nearest_even(x), _nearest_even(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


@dataclass(frozen=True)
class Lattice:
    tables: int = 6
    probes: int = 2
    codes: int = 1
    scale: float = 4.0
    seed: int = 8

    def maps(self, dim: int) -> np.ndarray:
        """``tables * codes`` maps from ``dim`` to 8 dimensions, each with orthonormal columns times the scale."""
        rng = np.random.default_rng([self.seed, dim])
        wide = max(dim, 8)
        one = [np.linalg.qr(rng.normal(size=(wide, 8)))[0][:dim] for _ in range(self.tables * self.codes)]
        return np.array(one) * self.scale * np.sqrt(wide / 64)

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """``n x tables x (1 + probes)`` cell keys: the home cell, then the probed ones."""
        n, dim = unit.shape
        maps, around = _maps(self, dim), _around()
        out = np.empty((n, self.tables, 1 + self.probes), np.uint64)
        mult = np.random.default_rng([self.seed, 240]).integers(1, 2**63, size=(self.codes, 8), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for t in range(self.tables):
            points, gains = [], []
            for c in range(self.codes):
                x = unit @ maps[t * self.codes + c]
                p = decode_e8(x)
                points.append(p)
                gains.append((x - p) @ around.T)
            gain = np.concatenate(gains, axis=1)
            top = np.argpartition(-gain, self.probes, axis=1)[:, : self.probes] if self.probes else np.empty((n, 0), int)
            step = np.array([(2 * around).astype(np.int64).astype(np.uint64) @ mult[c] for c in range(self.codes)]).ravel()
            home = sum((2 * p).astype(np.int64).astype(np.uint64) @ mult[c] for c, p in enumerate(points))
            raw = np.concatenate([home[:, None], home[:, None] + step[top]], axis=1)
            raw = (raw + np.uint64(t * 1_000_003 + dim)) * np.uint64(0x9E3779B97F4A7C15)
            raw = (raw ^ (raw >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            out[:, t] = raw ^ (raw >> np.uint64(32))
        return out


#: Up to so many vectors, the lattice that suits them; beside it the number of cells that isotropic vectors fill as if
#: evenly (one by the sum of squared shares), and the recall at cosine 0.9, both measured in 64 dimensions.
SETTINGS = (
    (1_000_000, Lattice()),  # 255 cells, 0.997
    (30_000_000, Lattice(tables=10, probes=6, codes=2, scale=3.5)),  # 6,700 cells, 0.998
    (300_000_000, Lattice(tables=18, probes=4, codes=2)),  # 60,000 cells, 0.998
    (None, Lattice(tables=26, probes=8, codes=3, scale=3.5)),  # 400,000 cells, 0.998
)


def lattice_for(vectors: int) -> Lattice:
    return next(lattice for most, lattice in SETTINGS if most is None or vectors <= most)


_cache: dict = {}


def _maps(lattice: Lattice, dim: int) -> np.ndarray:
    if (lattice, dim) not in _cache:
        _cache[lattice, dim] = lattice.maps(dim)
    return _cache[lattice, dim]


def _around() -> np.ndarray:
    if "around" not in _cache:
        _cache["around"] = least_vectors()
    return _cache["around"]


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _by_length(lists: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrix of the vectors of each length."""
    size = lists.value_lengths().to_numpy(zero_copy_only=False)
    for dim in np.unique(size):
        rows = np.flatnonzero(size == dim)
        yield rows, lists.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), dim)


def near_vectors(
    vectors: DataFrame, threshold: float = 0.9, lattice: Lattice = Lattice(), cell_rows: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``vectors``."""
    bounded_batches(vectors.sparkSession)
    v = F.col("v")
    usable = F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    rows = rows.withColumn("ok", F.coalesce(usable, F.lit(False)))
    reps = materialize(rows.where("ok").groupBy("v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("m")), "representatives")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):  # each row goes out once for every cell
                batch = whole.slice(at, 500)
                for at_rows, x in _by_length(batch.column(0)):
                    keys = lattice.keys(unit_rows(x)).reshape(len(at_rows), -1).view(np.int64)
                    per = keys.shape[1]
                    take = pa.array(np.repeat(at_rows, per))
                    home = np.tile(np.arange(per) % (1 + lattice.probes) == 0, len(at_rows))
                    yield pa.record_batch(
                        [pa.array(keys.ravel()), pa.array(home), *(batch.column(k).take(take) for k in range(batch.num_columns))], ["key", "home", *batch.schema.names]
                    )

    kind = reps.schema["v"].dataType.simpleString()
    cells = reps.select("v", "rep", "m").mapInArrow(deal, f"key long, home boolean, v {kind}, rep long, m long")
    counted = cells.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if("home").alias("homes"))
    hot = materialize(counted.where((F.col("n") > cell_rows) & (F.col("homes") > 0)).select("key", F.ceil(F.col("n") / cell_rows).alias("k")), "hot")
    if hot.isEmpty():
        dealt = cells.withColumns({"own": F.lit(0), "i": F.lit(0), "j": F.lit(0)})
    else:
        own = F.pmod(F.xxhash64("rep"), F.coalesce("k", F.lit(1))).cast("int")
        dealt = cells.join(hot, "key", "left").withColumn("own", own)
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), (F.coalesce("k", F.lit(1)) - 1).cast("int"))))
        dealt = dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def groups(table: pa.Table, last: bool) -> tuple[list[pa.RecordBatch], pa.Table | None]:
            mark = np.stack([table[c].to_numpy() for c in ("key", "i", "j")], 1)
            cut = np.flatnonzero((mark[1:] != mark[:-1]).any(1)) + 1
            edge = [0, *cut.tolist(), *([len(mark)] if last else [])]
            found = [x for a, b in zip(edge, edge[1:]) if (x := pairs_in_cell(table.slice(a, b - a), threshold, lattice)) is not None]
            return found, None if last else table.slice(edge[-1])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                if held[0]["key"][0] == batch["key"][-1] and held[0]["j"][0] == batch["j"][-1] and held[0]["i"][0] == batch["i"][-1]:
                    continue
                out, rest = groups(pa.Table.from_batches(held).combine_chunks(), False)
                held = rest.to_batches()
                yield from out
        if held:
            yield from groups(pa.Table.from_batches(held).combine_chunks(), True)[0]

    met = dealt.select("key", "i", "j", "own", "home", "rep", "m", "v").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    met = materialize(met.mapInArrow(meet, "rep long, added long, root long"), "met")
    links = met.groupBy("rep").agg(F.sum("added").alias("added"))
    parts = connected_components(met.where("rep <> root"), "rep", "root")
    of_rep = reps.join(links, "rep", "left").join(parts.withColumnRenamed("id", "rep"), "rep", "left")
    of_rep = of_rep.select("v", (F.col("m") - 1 + F.coalesce("added", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    good = rows.where("ok").join(of_rep, "v").select("id", "n_links", "component_id")
    bad = rows.where("NOT ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = good.union(bad)
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def pairs_in_cell(cell: pa.Table, threshold: float, lattice: Lattice) -> pa.RecordBatch | None:
    """Links of one cell, or of one pair of blocks of a large cell: for each linked row what it adds, and its root."""
    home = cell["home"].to_numpy()
    n = len(home)
    if n < 2 or not home.any():
        return None
    own, key = cell["own"].to_numpy(), np.uint64(np.int64(cell["key"][0].as_py()).view(np.uint64))
    lists = cell["v"].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    unit = unit_rows(lists.flatten().to_numpy(zero_copy_only=False).reshape(n, -1))
    across = cell["i"][0].as_py() != cell["j"][0].as_py()
    m, added, touched = cell["m"].to_numpy(), np.zeros(n, np.int64), np.zeros(n, bool)
    keys = None
    step = max(1, (1 << 20) // n)  # of rows that are compared with all at once, so pairs are held up to a bound

    def blocks() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        nonlocal keys
        for a in range(0, n, step):
            q = np.arange(a, min(a + step, n))
            q = q[home[q]]
            near = unit[q] @ unit.T >= threshold
            near &= ~home[None, :] | (np.arange(n)[None, :] > q[:, None])  # two homes: once
            if across:
                near &= own[q][:, None] != own[None, :]
            i, j = np.nonzero(near)
            if not len(i):
                continue
            i = q[i]
            if keys is None:
                keys = lattice.keys(unit)
            mine = _least_meeting(keys, i, j) == key  # a pair that meets elsewhere at a lesser key is counted there
            np.add.at(added, i[mine], m[j[mine]])
            np.add.at(added, j[mine], m[i[mine]])
            touched[i] = touched[j] = True
            yield i, j

    root = spanning_links(n, blocks())
    rows = np.flatnonzero(touched)
    if not len(rows):
        return None
    reps = cell["rep"].to_numpy()
    return pa.record_batch([pa.array(reps[rows]), pa.array(added[rows]), pa.array(reps[root[rows]])], ["rep", "added", "root"])


def _least_meeting(keys: np.ndarray, i: np.ndarray, j: np.ndarray, step: int = 1 << 16) -> np.ndarray:
    """For each pair the least key of a cell in which it meets."""
    least = np.empty(len(i), np.uint64)
    for at in range(0, len(i), step):
        p, q = keys[i[at : at + step]], keys[j[at : at + step]]
        low = np.full(len(p), np.uint64(0xFFFFFFFFFFFFFFFF))
        for t in range(keys.shape[1]):
            for k in range(keys.shape[2]):
                low = np.where(p[:, t, 0] == q[:, t, k], np.minimum(low, q[:, t, k]), low)
                low = np.where(q[:, t, 0] == p[:, t, k], np.minimum(low, p[:, t, k]), low)
        least[at : at + step] = low
    return least


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links at cosine 0.9 or more among all ``embeddings``, and their components."""
    return near_vectors(read(spark, sf_dir, "embeddings", "vec_id", "embedding"))


OP4_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
c(id, reached) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT c.id, l.b FROM c JOIN l ON c.reached = l.a),
r AS (SELECT id, min(reached) AS component_id FROM c GROUP BY id),
n AS (SELECT a AS id, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings LEFT JOIN n ON vec_id = n.id LEFT JOIN r ON vec_id = r.id
"""
