"""The driver's tables seen as pages, events, graph, vectors and ingestion log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.operators import graph

EVENT_TYPES = {
    ("A", "F"): "approval", ("A", "O"): "action_item", ("N", "F"): "decision", ("N", "O"): "status_change", ("R", "F"): "cancellation", ("R", "O"): "risk",
}
LINE_ORDER = (
    "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def padded(column: str, width: int):
    return F.lpad(F.col(column).cast("string"), width, "0")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("page_id"),
        F.concat(F.lit("Minutes "), F.date_format("o_orderdate", "yyyy-MM-dd")).alias("title"),
        F.col("o_orderpriority").alias("space_key"),
        F.col("o_orderdate").alias("timestamp"),
        F.col("o_orderdate").alias("page_date"),
        F.col("o_orderstatus").alias("status"),
        F.lit(False).alias("has_cancelled"),
    )


def events(spark: SparkSession, sf_dir: str, partkey: int | None = None, custkey: int | None = None) -> DataFrame:
    """One event a line item. With a part or customer key only the pages that mention it are built: an event's
    number depends on all lines of its page, so pages are chosen before numbering and events after it."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = table(spark, sf_dir, "lineitem")
    if custkey is not None:
        orders = orders.where(F.col("o_custkey") == custkey)
        lines = lines.join(orders.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    if partkey is not None:
        named = lines.where(F.col("l_partkey") == partkey).select("l_orderkey").distinct()
        lines = lines.join(named, "l_orderkey", "left_semi")
    idx = F.row_number().over(W.partitionBy("l_orderkey").orderBy(*LINE_ORDER)) - 1
    kind = F.coalesce(
        *(F.when((F.col("l_returnflag") == a) & (F.col("l_linestatus") == b), F.lit(v)) for (a, b), v in EVENT_TYPES.items())
    )
    lines = lines.withColumn("idx", idx)
    if partkey is not None:
        lines = lines.where(F.col("l_partkey") == partkey)
    joined = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])
    return joined.select(
        F.concat(F.lit("event_"), "l_orderkey", F.lit("_"), "idx").alias("_id"),
        F.lit("Event").alias("type"),
        F.col("l_orderkey").cast("string").alias("page_id"),
        "idx",
        kind.alias("event_type"),
        F.concat(F.lit("item "), "l_partkey", F.lit(" qty "), F.floor("l_quantity")).alias("description"),
        (F.col("l_returnflag") == "R").alias("is_cancelled"),
        F.array(padded("l_partkey", 11)).alias("app_ids"),
        F.array(padded("o_custkey", 9)).alias("project_ids"),
        F.col("o_orderdate").alias("timestamp"),
        F.lit(False).alias("is_deleted"),
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.build_nodes(pages(spark, sf_dir), events(spark, sf_dir))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.build_edges(events(spark, sf_dir))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations with their place ``at`` (from 1): by turn, then role and text, so repeated turns have one each."""
    at = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", at.alias("at"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("vec_"), "vec_id").alias("_id"),
        F.col("vec_id"),
        F.col("vec_id").cast("string").alias("page_id"),
        F.when(F.col("label") % 2 == 0, "Event").otherwise("ConfPage").alias("type"),
        (F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'") + F.make_dt_interval(F.col("vec_id").cast("int"))).alias("timestamp"),
        F.lit(False).alias("is_deleted"),
        "embedding",
    )


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The vector of row 0: a query's argument, one row by its nature."""
    return list(table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()[0])


def ingestion(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pages (the latest event of each user) and the log (as of 15 January)."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("page_id"), "ts", "event_id", "event_type")
    newest = F.max_by(F.struct("ts", "event_type"), F.struct("ts", "event_id"))
    old = rows.where("ts < TIMESTAMP_NTZ'2024-01-15 00:00:00'").groupBy("page_id").agg(newest.alias("x"))
    log = old.select(
        "page_id",
        F.when(F.col("x.event_type") == "error", "error").otherwise("done").alias("status"),
        F.col("x.ts").alias("source_modified"),
        F.pmod(F.col("page_id").cast("int"), F.lit(5)).alias("retry_count"),
        F.lit(None).cast("string").alias("error_message"),
    )
    now = rows.groupBy("page_id").agg(newest.alias("x"))
    # every tenth page has not changed since the log was written, every seventh has no date
    same = F.pmod(F.col("page_id").cast("int"), F.lit(10)) == 0
    stored = log.select("page_id", F.col("source_modified").alias("_stored"))
    current = now.join(stored, "page_id", "left").select(
        "page_id",
        F.when(same, F.coalesce("_stored", "x.ts")).otherwise(F.col("x.ts")).alias("last_modified"),
        F.when(F.pmod(F.col("page_id").cast("int"), F.lit(7)) != 0, F.col("x.ts")).alias("page_date"),
    )
    return current, log
