"""Mixing sources to target weights by entropy balancing (operator 5).

Every document gets a rate, the expected number of its copies, as close as possible (in relative entropy,
weighted by size and bounded by ``cap``) to its prior rate, such that each source's words add up to the source's
target. The convex dual has one multiplier a source: a document's prior odds are tilted exponentially,

    rate = cap * q * exp(m) / (1 - q + q * exp(m)),   q = prior / cap,

and the multipliers solve sum(size * rate) = target. The prior is a column of the documents, or else follows their
length (``length_prior``): texts of some hundred to a few thousand words are wanted most. So a source is not
thinned or repeated evenly: its targets are met by rates that keep the priors' odds.

Newton's iterations are distributed: documents are summed into strata of equal source and prior (combined map-side,
so a hot source is a few rows a task), and each iteration is one grouped sum over the strata and one update of the
multiplier table; neither is collected. Each source's residual decides when all are done; iterations that do not
converge are an error. Up to ``FEW`` strata an iteration is one task, without an exchange.

Rates become whole copies by carrying the words over: within chunks of a source, from its longest document to
its shortest, each document takes the floor or the ceiling of its rate, whichever brings the words taken nearer
to those due. Chunks are of bounded size, dealt by a hash, so a hot source is many chunks.

Targets: sources in code-point order, null last, have the weights of a repeating pattern and share a total; a
target stops at ``cap`` times its source's size and the excess is shared again by weight until none is above.

Defined cases: a null or empty text has size 0 and is taken 0 times its size; an empty source has target 0; an
empty table gives an empty result; a null source is a source; repeated rows are rows of their own; extra columns
pass through, but for those with the names of results.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from lattica.llm.common import WORD_CLASS, bounded_batches, materialize, read, spare_memory

WEIGHTS = (5.0, 2.0, 1.0)
TOTAL_SHARE, CAP = 1.5, 2.0
CHUNK_ROWS = 4096
#: Up to so many strata and sources the tables of the dual are one partition each.
FEW = 50_000


def length_prior(size: Column) -> Column:
    """Prior rate by length: 1.25 at 256 to 511 words, 0.15 less for each halving or doubling of it, at least 0.5."""
    doublings = F.floor(F.log2(F.greatest(size, F.lit(1)).cast("double")))
    return F.greatest(1.25 - 0.15 * F.abs(doublings - 8), F.lit(0.5))


def ranked_sources(sizes: DataFrame, few: bool = False) -> DataFrame:
    """``sizes(source, words, n)`` with ``pos``, the place of the source in code-point order, null last.

    Distributed, but for ``few`` sources: rows are range-partitioned and numbered in their partition; only the
    partitions' row counts (bounded by their number) are summed up as offsets.
    """
    order = F.col("source").asc_nulls_last()
    if few:
        return sizes.withColumn("pos", (F.row_number().over(W.orderBy(order)) - 1).cast("long"))
    ordered = sizes.repartitionByRange(order).sortWithinPartitions(order)
    ordered = materialize(ordered.withColumn("part", F.spark_partition_id()), "sources")
    offsets = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    offsets = offsets.select("part", (F.sum("rows").over(W.orderBy("part")) - F.col("rows")).alias("offset"))
    local = F.row_number().over(W.partitionBy("part").orderBy(order)) - 1
    return ordered.withColumn("at", local).join(F.broadcast(offsets), "part").select("source", "words", "n", (F.col("at") + F.col("offset")).alias("pos"))


def _compact(df: DataFrame, few: bool) -> DataFrame:
    return df.coalesce(1) if few else df


def water_filled(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = TOTAL_SHARE, cap: float = CAP, few: bool = False) -> DataFrame:
    """``sources(source, words, pos)`` with ``target``; each round is one sum over the source table."""
    pattern = F.array(*(F.lit(float(w)) for w in weights))
    df = materialize(sources.withColumn("w", F.element_at(pattern, (F.pmod("pos", F.lit(len(weights))) + 1).cast("int"))), "weights")
    df = _compact(df, few)
    row = df.agg(F.coalesce(F.sum("words"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0.0))).first()
    total, unit, capped = share * row[0], 0.0, -1
    if row[1]:
        unit = total / row[1]
    limit = F.col("words") * cap
    while True:
        above = F.col("w") * F.lit(unit) > limit
        now = df.agg(
            F.count_if(above),
            F.coalesce(F.sum(F.when(above, F.col("words"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~above, F.col("w"))), F.lit(0.0)),
        ).first()
        if now[0] == capped or not now[2]:
            break
        capped, unit = now[0], (total - cap * now[1]) / now[2]
    return df.withColumn("target", F.when(F.col("w") * F.lit(unit) > limit, limit).otherwise(F.col("w") * F.lit(unit))).drop("w")


def tilted(strata: DataFrame, targets: DataFrame, cap: float = CAP, tolerance: float = 1e-9, most: int = 60, few: bool = False) -> DataFrame:
    """``(source, m)``: Newton's iterations on the dual; ``strata(source, prior, words)``, ``targets(source, words, target)``.

    They start from the multiplier that would meet the target if all priors were 1. A source whose target is all of
    its cap, or nothing, has an infinite multiplier. Raises where ``most`` iterations leave a residual.
    """
    share = F.when(F.col("words") > 0, F.col("target") / (F.col("words") * cap)).otherwise(0.0)
    start = F.when(share >= 1 - 1e-12, F.lit(float("inf"))).when(share <= 1e-12, F.lit(float("-inf"))).otherwise(F.log(share / (1 - share)) - F.log(F.lit(1 / (cap - 1))))
    current = _compact(materialize(targets.select("source", "target", start.alias("m")), "multipliers"), few)
    strata = _compact(strata.withColumnRenamed("source", "s"), few)
    for _ in range(most):
        rate = rate_of(F.col("prior"), F.col("m"), cap)
        sums = (
            strata.join(current, F.col("s").eqNullSafe(F.col("source")))
            .groupBy("source", "target", "m")
            .agg(F.sum(F.col("words") * rate).alias("got"), F.sum(F.col("words") * rate * (1 - rate / cap)).alias("slope"))
        )
        step = F.least(F.greatest((F.col("target") - F.col("got")) / F.col("slope"), F.lit(-4.0)), F.lit(4.0))
        finite = (F.abs("m") < float("inf")) & (F.col("slope") > 0)
        following = materialize(
            sums.select(
                "source",
                "target",
                F.when(finite, F.col("m") + step).otherwise(F.col("m")).alias("m"),
                F.when(finite, F.abs(F.col("got") - F.col("target")) / F.greatest("target", F.lit(1.0))).otherwise(0.0).alias("off"),
            ),
            "multipliers",
        )
        current = _compact(following, few)
        off = current.agg(F.max("off")).first()[0]
        if off is None or off <= tolerance:
            return current.select("source", "m")
    raise RuntimeError(f"the multipliers did not converge: after {most} iterations a source is off its target by {off:.3g} of it")


def rate_of(prior, m, cap: float = CAP):
    """The tilted rate; written without overflow for large multipliers."""
    q = prior / cap
    return F.when(m >= 0, cap * q / (q + (1 - q) * F.exp(-m))).otherwise(cap * q * F.exp(m) / (1 - q + q * F.exp(m)))


def mix(docs: DataFrame, cap: float = CAP, prior_col: str | None = None, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id", keep_text: bool = True) -> DataFrame:
    """``docs`` (without its text, if not ``keep_text``) with ``size``, ``source_size``, ``target``, ``rate``, ``copies`` and ``taken``; like names give way."""
    bounded_batches(docs.sparkSession)
    made = ["size", "source_size", "target", "rate", "copies", "taken"]
    names = [c for c in docs.columns if c not in made and (keep_text or c != text_col)]
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    size = F.regexp_count(text, F.lit(WORD_CLASS)).cast("long")
    given = None if prior_col is None else F.col(f"`{prior_col}`").cast("double").alias("given")
    base = docs.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)), size.alias("size"), F.xxhash64(text).alias("hash"), *([] if given is None else [given]))
    prior = length_prior(F.col("size")) if given is None else F.greatest(F.least(F.coalesce("given", F.lit(1.0)), F.lit(cap * 0.999)), F.lit(1e-6))
    base = base.withColumn("prior", prior)
    source, ident = f"c{names.index(source_col)}", f"c{names.index(id_col)}"
    sizes = materialize(base.groupBy(F.col(source).alias("source"), "prior").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")), "strata")
    few = sizes.count() <= FEW
    sizes = _compact(sizes, few)
    sources = ranked_sources(sizes.groupBy("source").agg(F.sum("words").alias("words"), F.sum("n").alias("n")), few)
    targets = _compact(materialize(water_filled(sources, cap=cap, few=few), "targets"), few)
    multipliers = tilted(sizes, targets, cap, few=few)
    plan = targets.withColumnRenamed("source", "s").join(multipliers, F.col("s").eqNullSafe(F.col("source"))).drop("source")
    chunk = F.pmod(F.xxhash64(F.col(ident), F.col("hash")), F.ceil(F.col("n") / CHUNK_ROWS).cast("long"))
    rated = base.join(plan, F.col(source).eqNullSafe(F.col("s")), "left").select(
        *(f"c{k}" for k in range(len(names))),
        "size",
        F.col("words").alias("source_size"),
        "target",
        rate_of(F.col("prior"), F.col("m"), cap).alias("rate"),
        F.col("pos").alias("_pos"),
        chunk.alias("_chunk"),
        F.col("hash").alias("_hash"),
    )
    out = rated.repartition("_pos", "_chunk").sortWithinPartitions("_pos", "_chunk", F.col("size").desc(), F.xxhash64(ident), ident, "_hash")
    out = out.mapInArrow(_carried(rated.columns, cap), StructType([*rated.schema.fields, StructField("copies", IntegerType())]))
    return out.select(
        *(F.col(f"c{k}").alias(c) for k, c in enumerate(names)), *made[:5], (F.col("size") * F.col("copies")).alias("taken")
    )


def _carried(columns: list[str], cap: float):
    """Whole copies for rows that come chunk by chunk, longest document first; words over or due are carried on."""
    at = [columns.index(c) for c in ("_pos", "_chunk", "size", "rate")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spare_memory()
        group, over = None, 0.0
        for batch in batches:
            copies = []
            for pos, chunk, n, rate in zip(*(batch.column(k).to_pylist() for k in at)):
                if group != (pos, chunk):
                    group, over = (pos, chunk), 0.0
                take, due = int(rate + 1e-9), rate * n + over
                if rate - take > 1e-9 and take + 1 <= cap and due - take * n > n / 2:
                    take += 1
                over = due - take * n
                copies.append(take)
            yield pa.record_batch([*batch.columns, pa.array(copies, pa.int32())], [*columns, "copies"])

    return run


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document: targets share 150 % of all words, at most twice a source's words."""
    mixed = mix(read(spark, sf_dir, "documents", "doc_id", "source", "text"), keep_text=False)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")
