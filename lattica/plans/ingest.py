"""From pages to tables of the graph: parse, read attachments, normalize, extract, build, embed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.functions.text import chunk_udf
from lattica.operators import attach, extract, graph, normalize
from lattica.operators.parse import PARTS, flat, parse_pages
from lattica.sources.files import EXTRACTORS
from lattica.sources.providers import Embedder, Extractor, embed, model_events, model_ids

EVENT_SCHEMA = "page_id string, idx int, event_type string, description string, is_cancelled boolean, app_ids array<string>, project_ids array<string>"
_ATTACHMENT = "page_id string, attachment_id string, filename string, kind string, source string, text string, tables array<array<array<string>>>, error string, prov_path string"


def read_attachments(refs: DataFrame, metadata: DataFrame, files: DataFrame, extractors: dict[str, attach.Extractor], vision: bool = False) -> DataFrame:
    """Texts and tables of what pages refer to, and of what the source lists and no page refers to.

    ``metadata(page_id, pos, attachment_id, filename, url, size)``, ``files(page_id, filename, content)``.
    """
    named = attach.reconcile(refs.withColumnRenamed("seq", "ord"), metadata).withColumn("source", F.lit("page"))
    free = attach.orphans(refs, metadata).select(
        "page_id", "filename", "attachment_id", "url", F.concat(F.lit("page:"), "page_id").alias("prov_path"), F.lit(None).cast("int").alias("ord"),
        F.col("attachment_id").alias("meta_id"), F.col("url").alias("meta_url"), "size", F.lit("api").alias("source"),
    )
    wanted = attach.guarded(named.unionByName(free), vision)
    sources = wanted.select("page_id", "attachment_id", "source", "prov_path")
    content = wanted.join(files.select("page_id", "filename", "content"), ["page_id", "filename"], "left")
    found = attach.extract_text(content.select("page_id", "attachment_id", "filename", "kind", "content"), extractors)
    return found.join(sources, ["page_id", "attachment_id"])


def ingest(
    pages: DataFrame,
    schemas: DataFrame | None = None,
    known_ids: DataFrame | None = None,
    metadata: DataFrame | None = None,
    files: DataFrame | None = None,
    model: Extractor | None = None,
    embedder: Embedder | None = None,
    classifier: Callable[[str], str] | None = None,
    validator: Callable[[DataFrame], DataFrame] | None = None,
    extractors: dict[str, attach.Extractor] = EXTRACTORS,
    keep: Callable[[DataFrame], DataFrame] = lambda df: df,
    with_refs: bool = True,
) -> dict[str, DataFrame]:
    """One plan for all pages ``(page_id, title, page_date, html)``; every result is a lazy DataFrame.

    ``metadata`` and ``files`` are what the source has of attachments, ``model`` names further ids and the events of a
    page, ``embedder`` makes vectors, ``classifier`` names schemas for tables that none fits, ``validator`` tells which identifiers are
    valid (else ``known_ids`` do); what is not given is left out. Several results read the parsed pages and the attachments: ``keep`` is applied to
    both (a checkpoint, say), so that they are made once where more than one result is used. Without ``with_refs`` the pages' references, which only
    attachments need, are not looked for.
    """
    spark = pages.sparkSession
    told = [c for c in ("title", "page_date") if c in pages.columns]
    parts = [p for p in PARTS if with_refs or p != "refs"]
    parsed = keep(parse_pages(pages, parts=parts, carried=told))  # with what is told of the page, so that nothing has to be joined to it again
    failed = parsed.where("error IS NOT NULL").select("page_id", "error")
    flats = {w: flat(parsed.drop(*told), w) for w in parts}
    chunks, tables, cells = (flats[w] for w in ("chunks", "tables", "cells"))
    whole = parsed.where("error IS NULL").select("page_id", *(F.col(c) if c in told else F.lit(None).cast(t).alias(c) for c, t in (("title", "string"), ("page_date", "timestamp_ntz"))), "chunks", "tables", "cells")
    whole = whole.withColumnRenamed("page_date", "timestamp")
    dated = whole.select("page_id", "title", "timestamp")

    attachments = spark.createDataFrame([], _ATTACHMENT)
    more_tables = more_cells = None
    if metadata is not None and files is not None:
        attachments = keep(read_attachments(flats["refs"], metadata, files, extractors).select(*(c.split()[0] for c in _ATTACHMENT.split(", "))))
        more_tables, more_cells = attach.renumbered(tables, *attach.attachment_tables(attachments))
        # behind the page's own, in order
        behind = F.lit(1 << 30).cast("long") + F.row_number().over(W.partitionBy("page_id").orderBy("table_index", "row", "col"))
        tables = tables.withColumn("seq", F.col("seq").cast("long")).unionByName(more_tables.withColumn("seq", (F.lit(1 << 30) + F.col("table_index")).cast("long")))
        cells = cells.withColumn("seq", F.col("seq").cast("long")).unionByName(more_cells.withColumn("seq", behind))

    extra = attach.extraction_input(attachments).withColumn("seq", F.lit(0))
    texts = extract.collected_texts(chunks, cells, extra)
    candidates = extract.first_mentions(extract.scan_ids(texts))
    events = spark.createDataFrame([], EVENT_SCHEMA)
    if model is not None:
        inputs = extract.model_input(texts)
        named = extract.merge_named(candidates, model_ids(inputs, model))
        candidates = candidates.select("page_id", "ord", "id_type", "pos", "raw_value", "path").unionByName(
            named.select("page_id", F.lit(1 << 30).alias("ord"), "id_type", F.lit(0).alias("pos"), "raw_value", "path")
        )
        events = model_events(inputs, model)
    validated = extract.validate_ids(candidates, known_ids) if validator is None else keep(validator(candidates))
    out = {"parsed": parsed, "failed": failed, "chunks": chunks, "tables": tables, "cells": cells, "attachments": attachments, "texts": texts, "ids": validated}
    if with_refs:
        out["refs"] = flats["refs"]
    out["cancelled"] = extract.has_cancelled(chunks, cells, tables)

    top = tables.where("parent_table IS NULL")
    rows = None
    if schemas is not None:
        # tables are routed in the order of their pages' dates, undated ones last
        place = F.concat_ws(":", F.coalesce(F.date_format("timestamp", "yyyyMMddHHmmss"), F.lit("~")), "page_id", F.lpad(F.col("table_index").cast("string"), 10, "0"))
        prints = keep(normalize.fingerprints(top, cells).join(dated, "page_id").withColumn("ord", place))
        own = cells.join(prints.select("ord", "page_id", "table_index"), ["page_id", "table_index"])
        routes, added = normalize.route(prints, schemas, classifier)
        out["routes"] = routes.join(prints.select("ord", "page_id", "table_index"), "ord")
        if classifier is not None:
            out["added_schemas"] = added
        both = schemas.select("schema_id", "column_mapping").union(added.select("schema_id", "column_mapping"))
        rows = normalize.consolidate_routed(prints, own, routes, both).join(prints.select("ord", "page_id", "table_index"), "ord")
        out["rows"] = rows.select(graph.row_id().alias("_id"), "*", F.lit(False).alias("is_deleted"))

    # --- graph
    dated_pages = dated.join(out["cancelled"], "page_id", "left").withColumn("has_cancelled", F.coalesce("has_cancelled", F.lit(False)))
    when = dated.select("page_id", "timestamp")
    dated_events = events.join(when, "page_id").withColumn("_id", F.concat(F.lit("event_"), "page_id", F.lit("_"), "idx"))
    size = F.coalesce(F.size(chunk_udf()(F.coalesce("text", F.lit("")))), F.lit(0))
    known = attach.placed(attachments).withColumn("chunk_count", size).join(when, "page_id")
    mentioned = validated.where("is_valid").select("id_type", F.col("raw_value").alias("id"), "page_id").join(when, "page_id").select("id_type", "id", "page_id", "timestamp")
    out["events"] = dated_events
    out["nodes"] = graph.build_nodes(dated_pages, dated_events, top.join(when, "page_id"), known, mentioned)
    out["edges"] = graph.build_edges(dated_events, top, known, mentioned)
    if embedder is not None:
        out["vectors"] = embed(embedding_texts(whole, None if model is None else dated_events, more_tables, more_cells, None if more_cells is None else attachments), embedder)
    return out


def embedding_texts(pages: DataFrame, events: DataFrame | None, tables: DataFrame | None, cells: DataFrame | None, attachments: DataFrame | None) -> DataFrame:
    """``(_id, kind, page_id, text)`` of all that gets a vector: parsed ``pages(page_id, title, timestamp, chunks, tables, cells)``, events, table rows,
    the head row too, and chunks of attachments. ``tables`` and ``cells`` are those of attachments: a page's own are told where it stands. What is not
    there is None, so that no page is dealt to be joined with nothing."""
    rows = graph.page_row_texts(pages, "page_id", "title", "timestamp", "chunks")
    body = F.transform("chunks", lambda c: c["content"])
    of = lambda _id, kind, text: F.struct(_id.alias("_id"), F.lit(kind).alias("kind"), text.alias("text"))
    page = of(F.concat(F.lit("page_"), "page_id"), "ConfPage", graph.page_text(F.col("title"), F.col("timestamp"), body))
    own = F.concat(F.array(page), F.transform("rows", lambda r: of(graph.row_vector_id(r["table_index"], r["row"]), "row", r["text"])))
    parts = rows.select("page_id", F.explode(own).alias("x")).select("x._id", "x.kind", "page_id", "x.text")
    if events is not None:
        told = events.join(pages.select("page_id", "title"), "page_id")
        text = graph.event_text(*(F.col(c) for c in ("event_type", "description", "title", "timestamp", "app_ids", "project_ids")))
        parts = parts.unionByName(told.select("_id", F.lit("Event").alias("kind"), "page_id", text.alias("text")))
    if tables is not None and cells is not None:
        found = cells.join(tables.where("parent_table IS NULL").select("page_id", "table_index", "headers"), ["page_id", "table_index"])
        named = found.withColumns({"header": F.get("headers", F.col("col")), "text": normalize.cell_text(F.col("chunks"))})
        more = graph.row_texts(named).where("text <> ''")
        parts = parts.unionByName(more.select(graph.row_vector_id().alias("_id"), F.lit("row").alias("kind"), "page_id", "text"))
    if attachments is None:
        return parts
    pieces = attachments.where("error IS NULL AND text <> ''").select("page_id", "attachment_id", "filename", F.posexplode(chunk_udf()("text")).alias("idx", "chunk"))
    told = pieces.join(pages.select("page_id", "title", "timestamp"), "page_id")
    chunk = graph.chunk_text(F.col("filename"), F.col("title"), F.col("timestamp"), F.col("chunk"))
    return parts.unionByName(told.select(F.concat(graph.attachment_node_id(), F.lit("__chunk_"), "idx").alias("_id"), F.lit("chunk").alias("kind"), "page_id", chunk.alias("text")))
