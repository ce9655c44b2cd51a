"""Tables keyed by id: latest version per key, soft and hard deletes, ingestion log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PAGE_OWNED = ("ConfPage", "Table", "Event", "Attachment")


def latest_per_key(changes: DataFrame, keys: list[str], version: str, tie: list[str] | None = None) -> DataFrame:
    """The newest row of each key: a replace-upsert as a view over an append-only change log."""
    order = [F.col(version).desc(), *(F.col(t) for t in tie or [])]
    return changes.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def edge_key() -> Column:
    return F.concat_ws("__", "source_id", "relation", "target_id")


def upsert_edges(changes: DataFrame, version: str) -> DataFrame:
    """At most one edge for each source, relation and target."""
    return latest_per_key(changes.withColumn("_id", edge_key()), ["_id"], version)


def soft_delete_nodes(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """Flags the nodes that these ``pages(page_id)`` own; shared nodes stay."""
    hit = pages.select(F.col("page_id").alias("_page")).distinct()
    out = nodes.join(hit, nodes["page_id"] == F.col("_page"), "left")
    owned = F.col("_page").isNotNull() & F.col("type").isin(*PAGE_OWNED)
    return out.withColumn("is_deleted", F.coalesce(F.col("is_deleted"), F.lit(False)) | owned).drop("_page")


def soft_delete_rows(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """Flags all live rows of these pages (normalized rows, row vectors, chunks)."""
    hit = pages.select(F.col("page_id").alias("_page")).distinct()
    out = rows.join(hit, rows["page_id"] == F.col("_page"), "left")
    return out.withColumn("is_deleted", F.col("is_deleted") | F.col("_page").isNotNull()).drop("_page")


def purge_edges(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """Edges without those of these pages; edges without a page stay."""
    return edges.join(pages.select("page_id").distinct(), "page_id", "left_anti")


def set_embeddings(nodes: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Vectors put on existing nodes by id; ids without a node have no effect."""
    new = embeddings.select(F.col("_id"), F.col("embedding").alias("_new"))
    return nodes.join(new, "_id", "left").withColumn("embedding", F.coalesce("_new", "embedding")).drop("_new")


def upsert_rows(stored: DataFrame, rows: DataFrame, refreshed: DataFrame) -> DataFrame:
    """Normalized rows after an ingest of the ``refreshed(page_id)`` pages: their stored rows are flagged deleted, then
    each new row replaces that of its ``_id`` (``{page}_table_{t}_row_{r}``) or is added."""
    kept = soft_delete_rows(stored, refreshed).join(rows.select("_id"), "_id", "left_anti")
    return kept.unionByName(rows, allowMissingColumns=True)


def refresh_graph(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame, refreshed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after these pages were ingested again: what they owned is flagged, their edges go, then the new
    ones replace those of their id. Shared nodes keep their first date (they are never deleted)."""
    stale = soft_delete_nodes(nodes, refreshed)
    kept = stale.join(new_nodes.select("_id"), "_id", "left_anti")
    first = stale.where("first_seen IS NOT NULL").select("_id", F.col("first_seen").alias("_first"))
    fresh = new_nodes.join(first, "_id", "left").withColumn("first_seen", F.coalesce("_first", "first_seen")).drop("_first")
    return kept.unionByName(fresh, allowMissingColumns=True), replace_edges(purge_edges(edges, refreshed), new_edges)


def replace_edges(kept: DataFrame, new_edges: DataFrame) -> DataFrame:
    """Edges that a purge has left, with the new ones in the place of those of their source, relation and target: the newest
    of each as a grouped maximum, so no sort of all edges, and columns that nothing asks for are not carried."""
    both = kept.withColumn("_new", F.lit(0)).unionByName(new_edges.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    key = ["source_id", "relation", "target_id"]
    names = [c for c in both.columns if c != "_new"]
    newest = both.groupBy(*key).agg(F.max_by(F.struct(*(c for c in names if c not in key)), "_new").alias("_x"))
    return newest.select(*key, "_x.*").select(*names)


# --- ingestion control -------------------------------------------------------------------------------------


def with_log(pages: DataFrame, log: DataFrame) -> DataFrame:
    cols = log.select("page_id", F.col("status").alias("log_status"), F.col("source_modified").alias("log_modified"), F.lit(True).alias("logged"))
    return pages.join(cols, "page_id", "left")


def needs_upsert() -> Column:
    """New page, not done, unknown time, or modified since; on the columns of ``with_log``."""
    return (
        F.col("logged").isNull()
        | ~F.col("log_status").eqNullSafe("done")
        | F.col("log_modified").isNull()
        | F.coalesce(F.col("last_modified") > F.col("log_modified"), F.lit(False))
    )


def outcomes(pages: DataFrame, log: DataFrame) -> DataFrame:
    """Each page's ``outcome``: skipped, needs_review (no date) or work."""
    joined = with_log(pages, log)
    outcome = F.when(~needs_upsert(), "skipped").when(F.col("page_date").isNull(), "needs_review").otherwise("work")
    return joined.withColumn("outcome", outcome).drop("log_status", "log_modified", "logged")


def outcome_counts(pages: DataFrame, log: DataFrame) -> DataFrame:
    return outcomes(pages, log).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def mark_log(log: DataFrame, pages: DataFrame, status: str, reason: Column | None = None, at: Column | None = None) -> DataFrame:
    """The log with these ``pages(page_id)`` marked ``processing``, ``done``, ``error`` or ``needs_review``.

    ``error`` counts a retry and keeps its reason, ``needs_review`` keeps its reason, ``done`` clears it; ``at`` is the
    time of processing, for ``processing`` and ``done``. Pages that are not in the log have no effect.
    """
    if status not in ("processing", "done", "error", "needs_review"):
        raise ValueError(f"no such status: {status}")
    hit = pages.select("page_id").distinct().withColumn("_hit", F.lit(True))
    out = log.join(hit, "page_id", "left")
    marked = F.col("_hit").isNotNull()
    new = {"status": F.when(marked, status).otherwise(F.col("status"))}
    if status == "error":
        new["retry_count"] = F.when(marked, F.col("retry_count") + 1).otherwise(F.col("retry_count"))
    if status != "processing":
        text = F.lit(None).cast("string") if status == "done" or reason is None else reason
        new["error_message"] = F.when(marked, text).otherwise(F.col("error_message"))
    if at is not None and status in ("processing", "done"):
        new["processed_at"] = F.when(marked, at).otherwise(F.col("processed_at"))
    return out.withColumns(new).drop("_hit")


def log_transitions(log: DataFrame, results: DataFrame) -> DataFrame:
    """The log after ``results(page_id, new_status, error)``: rows that are not in the log have no effect."""
    joined = log.join(results, "page_id", "left")
    status = F.coalesce("new_status", "status")
    return joined.select(
        "page_id",
        status.alias("status"),
        (F.col("retry_count") + F.when(F.col("new_status") == "error", 1).otherwise(0)).alias("retry_count"),
        F.when(F.col("new_status") == "done", None).when(F.col("new_status") == "error", F.col("error")).otherwise(F.col("error_message")).alias("error_message"),
    )


def list_errors(log: DataFrame, max_retry: int = 3) -> DataFrame:
    return log.where((F.col("status") == "error") & (F.col("retry_count") < max_retry))


def log_entry(log: DataFrame, page_id: str) -> DataFrame:
    return log.where(F.col("page_id") == page_id)


# --- canonical schemas -------------------------------------------------------------------------------------


def schema_by_type(schemas: DataFrame) -> DataFrame:
    """The approved schema of the highest version of each table type."""
    return latest_per_key(schemas.where(F.col("status").isin("approved", "auto_approved")), ["table_type"], "version", ["schema_id"])


def schemas_with_status(schemas: DataFrame, pending: bool) -> DataFrame:
    wanted = ["pending_approval"] if pending else ["approved", "auto_approved"]
    return schemas.where(F.col("status").isin(*wanted))


def approve_schema(schemas: DataFrame, schema_id: str, by: str, at: Column) -> DataFrame:
    hit = F.col("schema_id") == schema_id
    return schemas.withColumns(
        {
            "status": F.when(hit, "approved").otherwise(F.col("status")),
            "approved_by": F.when(hit, F.lit(by)).otherwise(F.col("approved_by")),
            "approved_at": F.when(hit, at).otherwise(F.col("approved_at")),
        }
    )


def add_mapping(schemas: DataFrame, schema_id: str, header: str, column: str) -> DataFrame:
    kept = F.map_filter("column_mapping", lambda k, _: k != header)
    added = F.map_concat(kept, F.create_map(F.lit(header), F.lit(column)))
    return schemas.withColumn("column_mapping", F.when(F.col("schema_id") == schema_id, added).otherwise(F.col("column_mapping")))
