"""What the corpus operators share: table reading, shared scratch tables, words, components."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a longest run of anything but space, tab, line feed, vertical tab, form feed, carriage return.
#: ``bytes.split()`` splits UTF-8 at exactly these six bytes.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
WORD_CLASS = r"[^\x20\x09-\x0D]+"

#: Most bytes of an Arrow batch of texts; by its rows alone a batch of long texts would have no bound.
BATCH_BYTES = 2 << 20

_scratch: list[tuple[SparkSession, str]] = []


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """One table of a data folder, by a path that only Spark has to understand."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Where it is unset on one machine (tests) a temporary folder is set as the session's checkpoint folder. On a
    cluster that would be another folder on every machine, so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="lattica-"))
        current = context._jsc.sc().getCheckpointDir()
    return current.get().rstrip("/")


def bounded_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Let Arrow batches of the session hold ``most`` bytes, where it allows more.

    Spark reads the setting when a query runs, so it stays set for the session; it changes the size of batches only.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) <= most:
        spark.conf.set(name, str(most))


_caches: dict[str, Callable[[], None]] = {}


def keeps_cache(owner: str, clear: Callable[[], None]) -> None:
    """Tell that a module keeps something between the tasks of a Python worker, and how to drop it."""
    _caches[owner] = clear


def spare_memory(owner: str = "") -> None:
    """Called by a task before its work: what the tasks of other operators left in this worker goes."""
    for name, clear in _caches.items():
        if name != owner:
            clear()


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lattica/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _scratch.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def scratch_mark() -> int:
    """How many tables were written so far; for ``release``."""
    return len(_scratch)


def release(begin: int, end: int | None = None) -> None:
    """Delete the tables written from one mark to another; nothing that is still to run may read them."""
    for spark, path in _scratch[begin:end]:
        _delete(spark, path)
    del _scratch[begin:end]


@atexit.register
def _cleanup() -> None:
    for spark, path in _scratch:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may already be gone
            return


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(id, component)`` for every node of ``edges``; component is the smallest id reachable.

    Alternating large-star and small-star steps until the edge set is a fixed point. A step is one grouped
    minimum (combined map-side) and one join that adaptive execution may split where a hub is hot; no
    neighbour list is ever built. Each round is written to the shared folder, so lineage stays short.
    Self-loops and repeated edges are harmless; an empty input gives an empty result.
    """

    def oriented(df: DataFrame) -> DataFrame:
        return df.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()

    def signature(df: DataFrame) -> tuple:
        row = df.agg(
            F.count(F.lit(1)),
            F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)),
            F.coalesce(F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31))), F.lit(0)),
        ).first()
        return tuple(row)

    def large_star(e: DataFrame) -> DataFrame:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        return oriented(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))

    def small_star(e: DataFrame) -> DataFrame:
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        down = e.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return oriented(down.union(low.select("u", F.col("m").alias("v"))))

    current = materialize(oriented(edges.select(F.col(a).alias("u"), F.col(b).alias("v"))), "edges")
    before = signature(current)
    while before[0]:
        following = materialize(small_star(large_star(current)), "edges")
        after = signature(following)
        current = following
        if after == before:
            break
        before = after
    roots = current.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return roots.union(current.select(F.col("u").alias("id"), F.col("v").alias("component")))
