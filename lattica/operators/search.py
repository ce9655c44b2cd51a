"""Reads: property and temporal look-ups, traversal, cosine search and re-ranking."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.functions.vectors import cosine_to, temporal_decay
from lattica.session import checkpointed


def live(df: DataFrame) -> DataFrame:
    return df.where("NOT is_deleted")


def top(df: DataFrame, limit: int, *order: Column) -> DataFrame:
    """The first rows of an order; a per-partition top-k and one merge, never a full sort."""
    return df.orderBy(*order).limit(limit)


def search_by_property(nodes: DataFrame, kind: str, name: str, value: object, limit: int = 100) -> DataFrame:
    """Live nodes of a type whose property equals, or as an array holds, the value."""
    is_array = nodes.schema[name].dataType.typeName() == "array"
    match = F.array_contains(name, value) if is_array else F.col(name) == value
    return top(live(nodes).where((F.col("type") == kind) & match), limit, F.col("_id"))


def events_of(
    events: DataFrame, key: str, value: str, limit: int = 20, kind: str | None = None, start: Column | None = None, end: Column | None = None
) -> DataFrame:
    """Live events that hold an id, newest first, optionally of one type and within inclusive dates."""
    found = live(events).where(F.array_contains(key, value))
    if kind is not None:
        found = found.where(F.col("event_type") == kind)
    if start is not None:
        found = found.where(F.col("timestamp") >= start)
    if end is not None:
        found = found.where(F.col("timestamp") <= end)
    return top(found, limit, F.col("timestamp").desc(), F.col("_id"))


def applications_of_project(events: DataFrame, applications: DataFrame, project_id: str) -> DataFrame:
    """Live applications that the project's live events name."""
    ids = live(events).where(F.array_contains("project_ids", project_id)).select(F.explode("app_ids").alias("app_id")).where("app_id <> ''").distinct()
    return live(applications).join(ids, "app_id", "left_semi")


def project_snapshot(events: DataFrame, pages: DataFrame, project_id: str) -> DataFrame:
    """The project's live events on the page of its latest event, oldest first, with the page's title."""
    own = checkpointed(live(events).where(F.array_contains("project_ids", project_id)))  # found once, read twice
    last = own.agg(F.max_by("page_id", F.struct("timestamp", "_id")).alias("page_id"))
    last = F.broadcast(last)  # one row: neither the events nor the pages are dealt anew to find it
    titles = F.broadcast(live(pages).join(last, "page_id", "left_semi").select("page_id", F.col("title").alias("page_title")))
    return own.join(last, "page_id").drop("title").join(titles, "page_id", "left").orderBy("timestamp", "_id")


def project_info(projects: DataFrame, project_id: str) -> DataFrame:
    """The live project of an id, or else one that has it among its ``raw_ids``, where the table has them."""
    found = live(projects)
    own = found.where(F.col("project_id") == project_id)
    if "raw_ids" not in projects.columns or not own.isEmpty():
        return own
    return found.where(F.array_contains("raw_ids", project_id)).orderBy("_id").limit(1)


def counted(found: DataFrame) -> DataFrame:
    """A timeline with ``count``, how many events it shows."""
    return found.withColumn("count", F.count(F.lit(1)).over(W.partitionBy()))


#: Most ids of a frontier that are held as a literal table and sent to the edges.
SMALL_FRONTIER = 100_000


def traverse(nodes: DataFrame, edges: DataFrame, start: str, relations: Sequence[str], depth: int = 3, directed: bool = True) -> DataFrame:
    """Live nodes within ``depth`` steps of ``start`` with their least ``level``; the start is left out.

    Deleted and missing nodes are not returned but walked through. Each level joins the frontier with the edges of
    these relations and keeps what was not reached before; only what was found is made distinct. A frontier of up to
    ``SMALL_FRONTIER`` ids is broadcast, a larger one is written to the checkpoint folder; nothing stays cached.
    """
    spark = nodes.sparkSession
    steps = edges.where(F.col("relation").isin(*relations)).select("source_id", "target_id")
    if not directed:
        ways = F.array(F.struct("source_id", "target_id"), F.struct(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id")))
        steps = steps.select(F.explode(ways).alias("x")).select("x.*")
    frontier, small = spark.createDataFrame([(start,)], "id string"), True
    reached, hit = [frontier], spark.createDataFrame([], "id string, level int")
    all_small = True
    for level in range(1, depth + 1):
        # A semi-join goes below what the edges are made of, unions and groups; a join would wait for all of them.
        ids = frontier.select(F.col("id").alias("source_id"))
        found = steps.join(F.broadcast(ids) if small else ids, "source_id", "left_semi").select(F.col("target_id").alias("id")).distinct()
        for before in reached:
            found = found.join(before, "id", "left_anti")
        first = found.limit(SMALL_FRONTIER + 1).collect()
        small = len(first) <= SMALL_FRONTIER
        frontier = spark.createDataFrame(first, "id string") if small else checkpointed(found)
        if not first:
            break
        reached.append(frontier)
        hit, all_small = hit.union(frontier.withColumn("level", F.lit(level))), all_small and small
    hit = hit.select(F.col("id").alias("_id"), "level")
    hit = F.broadcast(hit) if all_small else hit
    return live(nodes).join(hit.select("_id"), "_id", "left_semi").join(hit, "_id")


def induced_edges(edges: DataFrame, visible: DataFrame) -> DataFrame:
    ids = visible.select("_id")
    first = edges.join(ids, edges["source_id"] == ids["_id"], "left_semi")
    return first.join(ids, first["target_id"] == ids["_id"], "left_semi")


def counts_by_type(nodes: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """How many nodes of each type are shown, and of edges where these are given."""
    counts = nodes.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    if edges is None:
        return counts
    return counts.union(edges.agg(F.count(F.lit(1)).alias("n")).select(F.lit("Edges"), "n"))


def load_nodes(nodes: DataFrame, kinds: Sequence[str], include_deleted: bool = False, limit: int = 150) -> DataFrame:
    found = nodes.where(F.col("type").isin(*kinds))
    return top(found if include_deleted else live(found), limit, F.col("_id"))


#: How many characters a label shows of a title, a description, a page's id, a file name and any other id.
LABEL_TITLE, LABEL_DESCRIPTION, LABEL_PAGE, LABEL_FILE, LABEL_ID = 40, 28, 8, 30, 35


def label() -> Column:
    """Short name of a node in the view of the graph; its lines and their lengths are a fixed format."""
    first = lambda column, n: F.substring(column, 1, n)
    return (
        F.when(F.col("type") == "ConfPage", first(F.coalesce(F.when(F.col("title") != "", F.col("title")), "_id"), LABEL_TITLE))
        .when(F.col("type") == "Application", F.concat(F.lit("App\n"), F.coalesce("app_id", "_id")))
        .when(F.col("type") == "Project", F.concat(F.lit("Proj\n"), F.coalesce("project_id", "_id")))
        .when(F.col("type") == "Event", F.concat(F.lit("["), F.coalesce("event_type", F.lit("event")), F.lit("]\n"), first(F.coalesce("description", F.lit("")), LABEL_DESCRIPTION)))
        .when(F.col("type") == "Table", F.concat(F.lit("Table "), F.coalesce(F.col("table_index").cast("string"), F.lit("")), F.lit("\n("), first(F.coalesce("page_id", F.lit("")), LABEL_PAGE), F.lit(")")))
        .when(F.col("type") == "Attachment", first(F.coalesce(F.when(F.col("filename") != "", F.col("filename")), "_id"), LABEL_FILE))
        .otherwise(first(F.col("_id"), LABEL_ID))
    )


def display_name() -> Column:
    """One line for a list: the type in brackets, then what a reader knows the node by."""
    kind = F.col("type")
    shown = (
        F.when(kind == "ConfPage", F.substring(F.coalesce("title", "_id"), 1, 50))
        .when(kind == "Application", F.coalesce("app_id", "_id"))
        .when(kind == "Project", F.coalesce("project_id", "_id"))
        .when(kind == "Event", F.concat(F.coalesce("event_type", F.lit("")), F.lit(" — "), F.substring(F.coalesce("description", F.lit("")), 1, 40)))
        .when(kind == "Table", F.concat(F.lit("index="), F.coalesce(F.col("table_index").cast("string"), F.lit("")), F.lit(" page="), F.substring(F.coalesce("page_id", F.lit("")), 1, 10)))
        .when(kind == "Attachment", F.coalesce("filename", "_id"))
        .otherwise(F.substring("_id", 1, 50))
    )
    return F.concat(F.lit("["), kind, F.lit("] "), shown)


#: What a tooltip names of each type: its label and the column (fixed labels).
TOOLTIP_FIELDS = {
    "ConfPage": (("Title", "title"),),
    "Application": (("app_id", "app_id"), ("first_seen", "first_seen"), ("last_seen", "last_seen")),
    "Project": (("project_id", "project_id"), ("first_seen", "first_seen")),
    "Event": (("type", "event_type"), ("cancelled", "is_cancelled"), ("description", "description"), ("apps", "app_ids")),
    "Table": (("headers", "headers"), ("rows", "row_count")),
    "Attachment": (("file", "filename"), ("origin", "origin")),
}


def tooltip() -> Column:
    """Lines of HTML: id, type, day, a mark where deleted, then the fields of the type; an empty list has no line."""

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"<b>{name}:</b> "), value)

    def shown(name: str, column: str) -> Column:
        if column == "app_ids":
            return F.when(F.size("app_ids") > 0, line(name, F.array_join("app_ids", ", ")))
        text = F.array_join(F.slice("headers", 1, 6), ", ") if column == "headers" else F.substring("description", 1, 120) if column == "description" else F.col(column).cast("string")
        return line(name, F.coalesce(text, F.lit("")))

    lines = [
        line("ID", F.col("_id")),
        line("Type", F.col("type")),
        line("Date", F.date_format("timestamp", "yyyy-MM-dd")),
        F.when(F.col("is_deleted"), "<b style='color:red'>DELETED</b>"),
    ]
    for kind, fields in TOOLTIP_FIELDS.items():
        lines += [F.when(F.col("type") == kind, shown(name, column)) for name, column in fields]
    place = F.concat(F.lit("table "), "table_index", F.lit(" row "), "row", F.lit(" col "), "col")
    lines.append(F.when((F.col("type") == "Attachment") & (F.col("origin") == "table"), line("location", place)))
    return F.concat_ws("<br>", *lines)


# --- vectors -----------------------------------------------------------------------------------------------


def vector_search(
    items: DataFrame, query: Sequence[float], limit: int, kinds: Sequence[str] | None = None, before: Column | None = None, epsilon: float = 1e-10
) -> DataFrame:
    """Live items with a usable vector by descending cosine, ``semantic``; filters come before the score."""
    found = live(items).where(F.col("embedding").isNotNull())
    if kinds is not None:
        found = found.where(F.col("type").isin(*kinds))
    if before is not None:
        found = found.where(F.col("timestamp") <= before)
    scored = found.withColumn("semantic", cosine_to(query, epsilon)("embedding")).where("semantic IS NOT NULL AND NOT isnan(semantic)")
    return top(scored, limit, F.col("semantic").desc(), F.col("_id"))


def semantic_retrieve(
    sources: Sequence[tuple[str, DataFrame, Sequence[str] | None]], query: Sequence[float], reference: Column, limit: int = 20, overfetch: int = 3, before: Column | None = None
) -> DataFrame:
    """Best of several sources by cosine times decay. Each source is first cut to ``overfetch * limit`` by cosine
    alone: that is part of the meaning, a recent item behind the cut stays out."""
    parts = []
    for rank, (name, items, kinds) in enumerate(sources):
        cut = vector_search(items, query, overfetch * limit, kinds, before)
        parts.append(cut.select("_id", F.lit(name).alias("source"), F.lit(rank).alias("rank"), "timestamp", "semantic"))
    both = reduce(DataFrame.unionByName, parts).withColumn("temporal", temporal_decay(F.col("timestamp"), reference))
    both = both.withColumn("combined", F.col("semantic") * F.col("temporal"))
    return top(both, limit, F.col("combined").desc(), F.col("rank"), F.col("_id"))


def search_rows(rows: DataFrame, events: DataFrame, query: Sequence[float], limit: int = 10, project_id: str | None = None, app_id: str | None = None) -> DataFrame:
    """Rows by cosine, restricted to pages where one live event names both ids."""
    pages = live(events)
    if project_id is not None:
        pages = pages.where(F.array_contains("project_ids", project_id))
    if app_id is not None:
        pages = pages.where(F.array_contains("app_ids", app_id))
    if project_id is not None or app_id is not None:
        rows = rows.join(pages.select("page_id").distinct(), "page_id", "left_semi")
    return vector_search(rows, query, limit)


def serialize(df: DataFrame, drop: Sequence[str] = ("embedding",)) -> DataFrame:
    """``(_id, json)`` without vectors; times in ISO form."""
    plain = df.drop(*drop)
    cols = [F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss").alias(c) if t.startswith("timestamp") else F.col(c) for c, t in plain.dtypes]
    return plain.select("_id", F.to_json(F.struct(*cols)).alias("json"))
