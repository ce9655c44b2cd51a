"""Node, edge and text builders of the temporal graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.text import iso, strip
from lattica.operators.parse import run_at, runs_of

#: Columns of the node table beyond id, type, time, page and the delete flag.
NODE_COLUMNS = {
    "title": "string", "event_type": "string", "description": "string", "is_cancelled": "boolean", "has_cancelled": "boolean",
    "app_ids": "array<string>", "project_ids": "array<string>", "app_id": "string", "project_id": "string",
    "first_seen": "string", "last_seen": "string", "table_index": "int", "headers": "array<string>", "row_count": "int", "col_count": "int",
    "attachment_id": "string", "filename": "string", "attachment_type": "string", "source": "string", "chunk_count": "int", "prov_path": "string", "origin": "string",
    "row": "int", "col": "int",
}


def _nodes(df: DataFrame, kind: str | Column, node_id: Column, page_id: Column | None, **props: Column) -> DataFrame:
    extra = [props.get(name, F.lit(None)).cast(type_).alias(name) for name, type_ in NODE_COLUMNS.items()]
    page = (page_id if page_id is not None else F.lit(None)).cast("string").alias("page_id")
    return df.select(node_id.alias("_id"), (F.lit(kind) if isinstance(kind, str) else kind).alias("type"), F.col("timestamp"), page, F.lit(False).alias("is_deleted"), *extra)


def page_nodes(pages: DataFrame) -> DataFrame:
    return _nodes(pages, "ConfPage", F.concat(F.lit("page_"), "page_id"), F.col("page_id"), title=F.col("title"), has_cancelled=F.col("has_cancelled"))


def event_nodes(events: DataFrame) -> DataFrame:
    names = ("event_type", "description", "is_cancelled", "app_ids", "project_ids")
    return _nodes(events, "Event", F.col("_id"), F.col("page_id"), **{n: F.col(n) for n in names})


def seen_range(events: DataFrame, key: Column) -> DataFrame:
    """First and last date of each id over the pages that mention it; oldest-first ingest gives least and greatest."""
    return events.select(key.alias("id"), "timestamp").groupBy("id").agg(F.min("timestamp").alias("first"), F.max("timestamp").alias("timestamp"))


def mentions(events: DataFrame) -> DataFrame:
    """``(id_type, id, page_id, timestamp)`` of the applications and projects that events name."""
    both = events.select("page_id", "timestamp", F.size(_ids("app_ids")).alias("apps"), F.posexplode(F.concat(_ids("app_ids"), _ids("project_ids"))).alias("at", "id"))
    return both.select(F.when(F.col("at") < F.col("apps"), "app_id").otherwise("project_id").alias("id_type"), "id", "page_id", "timestamp")


def _ids(name: str) -> Column:
    return F.coalesce(name, F.array().cast("array<string>"))


def id_nodes(named: DataFrame) -> DataFrame:
    """Application and Project nodes of ``named(id_type, id, page_id, timestamp)``; shared by pages, owned by none."""
    seen = named.groupBy("id_type", "id").agg(F.min("timestamp").alias("first"), F.max("timestamp").alias("timestamp"))
    app = F.col("id_type") == "app_id"
    return _nodes(
        seen, F.when(app, "Application").otherwise("Project"), F.concat(F.when(app, "app_").otherwise("proj_"), "id"), None,
        app_id=F.when(app, F.col("id")), project_id=F.when(~app, F.col("id")), first_seen=iso(F.col("first")), last_seen=iso(F.col("timestamp")),
    )


def application_nodes(events: DataFrame) -> DataFrame:
    return id_nodes(mentions(events).where("id_type = 'app_id'"))


def project_nodes(events: DataFrame) -> DataFrame:
    return id_nodes(mentions(events).where("id_type = 'project_id'"))


def table_nodes(tables: DataFrame) -> DataFrame:
    """Nodes of top-level ``tables(page_id, table_index, headers, n_rows, n_cols, timestamp)``, those of attachments included."""
    return _nodes(
        tables, "Table", table_id(), F.col("page_id"), table_index=F.col("table_index"), headers=F.col("headers"),
        row_count=F.col("n_rows"), col_count=F.col("n_cols"),
    )


def table_id(index: Column | str = "table_index") -> Column:
    return F.concat("page_id", F.lit("_table_"), index)


def row_id() -> Column:
    return F.concat(table_id(), F.lit("_row_"), F.col("row"))


def row_vector_id(index: Column | str = "table_index", row: Column | str = "row") -> Column:
    """Vectors of rows have ids of their own: with two underscores, and of head rows too."""
    return F.concat(table_id(index), F.lit("__row_"), row)


def attachment_node_id() -> Column:
    return F.concat("page_id", F.lit("_att_"), "attachment_id")


def attachment_nodes(attachments: DataFrame) -> DataFrame:
    """Nodes of ``attachments(page_id, attachment_id, filename, kind, source, chunk_count, prov_path, origin,
    table_index, row, col, error, timestamp)``; one that could not be read has no node."""
    names = {"attachment_type": "kind"} | {n: n for n in ("attachment_id", "filename", "source", "chunk_count", "prov_path", "origin", "table_index", "row", "col")}
    return _nodes(attachments.where("error IS NULL"), "Attachment", attachment_node_id(), F.col("page_id"), **{n: F.col(c) for n, c in names.items()})


def build_nodes(pages: DataFrame, events: DataFrame, tables: DataFrame | None = None, attachments: DataFrame | None = None, named: DataFrame | None = None) -> DataFrame:
    """All nodes; applications and projects are those that events name, and those of ``named`` (see ``id_nodes``)."""
    both = mentions(events) if named is None else mentions(events).unionByName(named)
    parts = [page_nodes(pages), event_nodes(events), id_nodes(both)]
    if tables is not None:
        parts.append(table_nodes(tables))
    if attachments is not None:
        parts.append(attachment_nodes(attachments))
    return reduce(DataFrame.unionByName, parts)


def build_edges(events: DataFrame, tables: DataFrame | None = None, attachments: DataFrame | None = None, named: DataFrame | None = None) -> DataFrame:
    """HAS_EVENT from page, application and project; REFERENCES_APP and _PROJ from the page, once each; CONTAINS from
    the page to its tables, HAS_ATTACHMENT to its attachments. Each input is read once for each relation."""
    page = F.concat(F.lit("page_"), "page_id")
    named_by = F.posexplode(F.concat(F.array("page_id"), _ids("app_ids"), _ids("project_ids"))).alias("at", "id")
    each = events.select("_id", "page_id", F.size(_ids("app_ids")).alias("apps"), named_by)
    prefix = F.when(F.col("at") == 0, "page_").when(F.col("at") <= F.col("apps"), "app_").otherwise("proj_")
    has_event = each.select(F.concat(prefix, "id").alias("source_id"), F.lit("HAS_EVENT").alias("relation"), F.col("_id").alias("target_id"), "page_id")
    both = mentions(events) if named is None else mentions(events).unionByName(named)
    app = F.col("id_type") == "app_id"
    once = both.select("page_id", "id_type", "id").distinct()
    references = once.select(
        page.alias("source_id"), F.when(app, "REFERENCES_APP").otherwise("REFERENCES_PROJ").alias("relation"), F.concat(F.when(app, "app_").otherwise("proj_"), "id").alias("target_id"), "page_id"
    )
    parts = [has_event, references]
    if tables is not None:
        parts.append(tables.select(page.alias("source_id"), F.lit("CONTAINS").alias("relation"), table_id().alias("target_id"), "page_id"))
    if attachments is not None:
        read = attachments.where("error IS NULL")
        parts.append(read.select(page.alias("source_id"), F.lit("HAS_ATTACHMENT").alias("relation"), attachment_node_id().alias("target_id"), "page_id"))
    return reduce(DataFrame.unionByName, parts)


def merge_seen(stored: DataFrame, current: DataFrame, monotone: bool = False) -> DataFrame:
    """Stored ``(id, first_seen, last_seen)`` after current ``(id, seen)``: first is kept, last is replaced (or, if
    ``monotone``, never goes back)."""
    joined = stored.join(current, "id", "full")
    last = F.greatest("seen", "last_seen") if monotone else F.coalesce("seen", "last_seen")
    return joined.select("id", F.coalesce("first_seen", "seen").alias("first_seen"), last.alias("last_seen"))


# --- texts to embed ----------------------------------------------------------------------------------------


def page_text(title: Column, date: Column, chunks: Column) -> Column:
    body = F.array_join(F.filter(F.transform(F.coalesce(chunks, F.array().cast("array<string>")), strip), lambda x: x != ""), " ")
    return F.concat_ws("\n", F.concat(F.lit("Title: "), title), F.concat(F.lit("Date: "), F.date_format(date, "yyyy-MM-dd")), F.when(body != "", body))


def event_text(kind: Column, description: Column, title: Column, date: Column, apps: Column, projects: Column) -> Column:
    return F.concat_ws(
        "\n",
        F.concat(F.lit("["), kind, F.lit("] "), description),
        F.concat(F.lit("Page: "), title, F.lit(" | Date: "), F.date_format(date, "yyyy-MM-dd")),
        F.when(F.size(apps) > 0, F.concat(F.lit("Apps: "), F.array_join(apps, ", "))),
        F.when(F.size(projects) > 0, F.concat(F.lit("Projects: "), F.array_join(projects, ", "))),
    )


def row_texts(cells: DataFrame) -> DataFrame:
    """``cells(page_id, table_index, row, col, header, text)`` to one text a row; blank cells are left out."""
    named = F.concat(F.coalesce("header", F.concat(F.lit("col_"), F.col("col"))), F.lit(": "), strip(F.col("text")))
    listed = F.array_sort(F.collect_list(F.when(strip(F.col("text")) != "", F.struct("col", named.alias("s")))))
    grouped = cells.groupBy("page_id", "table_index", "row").agg(listed.alias("parts"))
    return grouped.select("page_id", "table_index", "row", F.array_join(F.transform("parts", lambda p: p["s"]), " | ").alias("text"))


def page_row_texts(pages: DataFrame, *kept: str) -> DataFrame:
    """``row_texts`` of the top-level tables of parsed pages ``(tables, cells)``, in an array ``rows(table_index, row, text)`` a page, with
    the columns ``kept``: what a row is made of stands in its page, so nothing is dealt. Parsed texts have no blanks around them."""
    cells = F.filter("cells", lambda c: (F.size(c["chunks"]) > 0) & F.get("tables", c["table_index"])["parent_table"].isNull())

    def named(c: Column) -> Column:
        header = F.coalesce(F.get(F.get("tables", c["table_index"])["headers"], c["col"]), F.concat(F.lit("col_"), c["col"]))
        text = F.concat(header, F.lit(": "), F.array_join(F.transform(c["chunks"], lambda x: x["content"]), " "))
        return F.struct(c["table_index"].alias("table_index"), c["row"].alias("row"), c["col"].alias("col"), text.alias("s"))

    told = pages.select(*kept, F.sort_array(F.transform(cells, named)).alias("_cells")).withColumn("_starts", runs_of("_cells", "table_index", "row"))

    def row(start: Column, k: Column) -> Column:
        first = F.get("_cells", start)
        texts = F.transform(run_at("_cells", "_starts", start, k), lambda x: x["s"])
        return F.struct(first["table_index"].alias("table_index"), first["row"].alias("row"), F.array_join(texts, " | ").alias("text"))

    return told.select(*kept, F.transform("_starts", row).alias("rows"))


def chunk_text(filename: Column, title: Column, date: Column, chunk: Column) -> Column:
    return F.concat_ws(
        "\n", F.concat(F.lit("File: "), filename), F.concat(F.lit("Page: "), title, F.lit(" | Date: "), F.date_format(date, "yyyy-MM-dd")), chunk
    )


def episode_bodies(pages: DataFrame, events: DataFrame) -> DataFrame:
    """One text a page: title, date, then its events in order."""
    line = F.concat(F.lit("- ["), "event_type", F.lit("] "), "description")
    lines = events.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("idx", line.alias("s")))).alias("lines"))
    body = F.array_join(F.transform("lines", lambda x: x["s"]), "\n")
    head = F.concat_ws("\n", F.concat(F.lit("Meeting: "), "title"), F.concat(F.lit("Date: "), F.date_format("timestamp", "yyyy-MM-dd")))
    return pages.join(lines, "page_id", "left").select("page_id", F.concat_ws("\n", head, body).alias("body"))
