"""Named queries over the driver's tables, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions.text import iso
from lattica.operators import attach, extract, graph, parse, search, store, stored
from lattica.plans import projection as src
from lattica.plans import sql
from lattica.plans.literal import LITERAL_QUERIES, LITERAL_SQL
from lattica.plans.runs import RUN_QUERIES, RUN_SQL
from lattica.session import shared_folder

APP, PART, PROJECT, CUSTOMER = "00000000005", 5, "000000007", 7
BEFORE = "TIMESTAMP_NTZ'1998-01-01 00:00:00'"
REFERENCE = "TIMESTAMP_NTZ'2026-01-01 00:00:00'"

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(text: str | None = None):
    """Register a function under its name, with its oracle."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if text is not None:
            _SQL[f.__name__] = text
        return f

    return add


def shown(df: DataFrame) -> DataFrame:
    return df.select("_id", "event_type", "description", "is_cancelled", iso(F.col("timestamp")).alias("at"))


SHOWN = f"_id, event_type, description, is_cancelled, strftime(ts, {sql.ISO}) AS at"


# --- timelines -----------------------------------------------------------------------------------------------


@query(f"WITH {sql.EVENTS} SELECT {SHOWN} FROM e WHERE app_id = '{APP}' ORDER BY ts DESC, _id LIMIT 20")
def app_timeline(spark, sf):
    return shown(search.events_of(src.events(spark, sf, partkey=PART), "app_ids", APP, 20))


@query(f"WITH {sql.EVENTS} SELECT {SHOWN} FROM e WHERE app_id = '{APP}' ORDER BY ts DESC, _id LIMIT 20")
def stored_timeline(spark, sf):
    """The same look-up over all events stored by application and time."""
    path = f"{shared_folder(spark)}/timeline-{uuid.uuid4().hex}"
    stored.write_timeline(src.events(spark, sf), path, "app_ids")
    return shown(stored.stored_events_of(spark, path, APP, 20))


@query(f"WITH {sql.EVENTS} SELECT _id, count(*) OVER () AS count FROM (SELECT _id FROM e WHERE project_id = '{PROJECT}' ORDER BY ts DESC, _id LIMIT 50)")
def timeline_count(spark, sf):
    """A timeline with the number of its events."""
    return search.counted(search.events_of(src.events(spark, sf, custkey=CUSTOMER), "project_ids", PROJECT, 50)).select("_id", "count")


@query(f"WITH {sql.EVENTS} SELECT {SHOWN} FROM e WHERE app_id = '{APP}' AND ts <= TIMESTAMP '1998-01-01' ORDER BY ts DESC, _id LIMIT 10")
def temporal_context_before(spark, sf):
    return shown(search.events_of(src.events(spark, sf, partkey=PART), "app_ids", APP, 10, end=F.expr(BEFORE)))


@query(f"WITH {sql.EVENTS} SELECT {SHOWN} FROM e WHERE project_id = '{PROJECT}' ORDER BY ts DESC, _id LIMIT 20")
def project_events(spark, sf):
    return shown(search.events_of(src.events(spark, sf, custkey=CUSTOMER), "project_ids", PROJECT, 20))


@query(
    f"WITH {sql.EVENTS} SELECT {SHOWN} FROM e WHERE project_id = '{PROJECT}' AND event_type = 'decision' "
    "AND ts >= TIMESTAMP '1996-01-01' AND ts <= TIMESTAMP '2001-01-01' ORDER BY ts DESC, _id LIMIT 20"
)
def project_events_typed_range(spark, sf):
    start, end = F.expr("TIMESTAMP_NTZ'1996-01-01 00:00:00'"), F.expr("TIMESTAMP_NTZ'2001-01-01 00:00:00'")
    return shown(search.events_of(src.events(spark, sf, custkey=CUSTOMER), "project_ids", PROJECT, 20, "decision", start, end))


@query(f"WITH {sql.EVENTS} SELECT {SHOWN} FROM e WHERE app_id = '{APP}' AND event_type = 'decision' ORDER BY ts DESC, _id LIMIT 20")
def application_events(spark, sf):
    return shown(search.events_of(src.events(spark, sf, partkey=PART), "app_ids", APP, 20, "decision"))


@query(f"WITH {sql.EVENTS} SELECT DISTINCT app_id FROM e WHERE project_id = '{PROJECT}'")
def apps_for_project(spark, sf):
    own = src.events(spark, sf, custkey=CUSTOMER)
    parts = src.table(spark, sf, "part").select(src.padded("p_partkey", 11).alias("app_id"), F.lit(False).alias("is_deleted"))
    return search.applications_of_project(own, parts, PROJECT).select("app_id")


@query(
    f"WITH {sql.EVENTS}, {sql.PAGES}, o AS (SELECT * FROM e WHERE project_id = '{PROJECT}'), l AS (SELECT arg_max(page_id, (ts, _id)) AS page_id FROM o) "
    f"SELECT {SHOWN.replace('ts,', 'o.ts,')}, title AS page_title FROM o JOIN l USING (page_id) LEFT JOIN p USING (page_id)"
)
def project_snapshot(spark, sf):
    pages = src.pages(spark, sf).withColumn("is_deleted", F.lit(False))
    found = search.project_snapshot(src.events(spark, sf, custkey=CUSTOMER), pages, PROJECT)
    return found.select("_id", "event_type", "description", "is_cancelled", iso(F.col("timestamp")).alias("at"), "page_title")


_RANGE = f"strftime(min(ts), {sql.ISO}) AS first_seen, strftime(max(ts), {sql.ISO}) AS last_seen"


@query(f"WITH {sql.EVENTS} SELECT 'proj_' || project_id AS _id, project_id, {_RANGE} FROM e WHERE project_id = '{PROJECT}' GROUP BY project_id")
def project_info(spark, sf):
    found = search.project_info(graph.project_nodes(src.events(spark, sf, custkey=CUSTOMER)), PROJECT)
    return found.select("_id", "project_id", "first_seen", "last_seen")


@query(f"WITH {sql.EVENTS} SELECT app_id AS id, {_RANGE} FROM e GROUP BY app_id")
def app_first_last_seen(spark, sf):
    found = graph.application_nodes(src.events(spark, sf))
    return found.select(F.col("app_id").alias("id"), "first_seen", "last_seen")


# --- graph ---------------------------------------------------------------------------------------------------


@query(f"WITH {sql.NODES} SELECT _id, type, page_id, strftime(ts, {sql.ISO}) AS at FROM n")
def graph_nodes_build(spark, sf):
    return src.nodes(spark, sf).select("_id", "type", "page_id", iso(F.col("timestamp")).alias("at"))


@query(f"WITH {sql.EVENTS}, {sql.EDGES} SELECT source_id || '__' || relation || '__' || target_id AS _id, page_id FROM g")
def graph_edges_build(spark, sf):
    return src.edges(spark, sf).select(store.edge_key().alias("_id"), "page_id")


@query(f"WITH {sql.NODES} SELECT _id, type, page_id, name AS label FROM n WHERE _id = 'page_7'")
def node_by_id(spark, sf):
    return src.nodes(spark, sf).where("_id = 'page_7'").select("_id", "type", "page_id", search.label().alias("label"))


@query(f"WITH {sql.EVENTS} SELECT _id, description FROM e WHERE app_id = '{APP}' ORDER BY _id LIMIT 100")
def search_by_property(spark, sf):
    return search.search_by_property(src.events(spark, sf, partkey=PART), "Event", "app_ids", APP).select("_id", "description")


_WALK = """, w(id, level) AS (
  SELECT 'proj_{project}', 0 UNION SELECT b, level + 1 FROM w JOIN s ON a = id WHERE level < {depth}),
m AS (SELECT id, min(level) AS level FROM w GROUP BY id)
SELECT _id, type, level FROM n JOIN m ON _id = id WHERE level > 0"""


@query(
    f"WITH RECURSIVE {sql.NODES}, {sql.EDGES}, s AS (SELECT DISTINCT source_id AS a, target_id AS b FROM g)"
    + _WALK.format(project=PROJECT, depth=3)
)
def bfs_depth3(spark, sf):
    """Three steps along all relations from a project."""
    relations = ["HAS_EVENT", "REFERENCES_APP", "REFERENCES_PROJ"]
    return search.traverse(src.nodes(spark, sf), src.edges(spark, sf), f"proj_{PROJECT}", relations, 3).select("_id", "type", "level")


@query(
    f"WITH RECURSIVE {sql.NODES}, {sql.EDGES}, h AS (SELECT DISTINCT source_id AS a, target_id AS b FROM g WHERE relation = 'HAS_EVENT'), "
    "s AS (SELECT a, b FROM h UNION SELECT b, a FROM h)" + _WALK.format(project=PROJECT, depth=2)
)
def bfs_undirected(spark, sf):
    """Two steps either way along HAS_EVENT from a project."""
    found = search.traverse(src.nodes(spark, sf), src.edges(spark, sf), f"proj_{PROJECT}", ["HAS_EVENT"], 2, directed=False)
    return found.select("_id", "type", "level")


_STARTS = "(SELECT 'proj_' || lpad(CAST(k AS VARCHAR), 9, '0') AS id FROM range(64) t(k))"


@query(
    f"WITH RECURSIVE {sql.NODES}, {sql.EDGES}, h AS (SELECT DISTINCT source_id AS a, target_id AS b FROM g WHERE relation = 'HAS_EVENT'), s AS (SELECT a, b FROM h UNION SELECT b, a FROM h), "
    f"w(start, id, level) AS (SELECT id, id, 0 FROM {_STARTS} UNION SELECT w.start, s.b, w.level + 1 FROM w JOIN s ON s.a = w.id WHERE w.level < 2) "
    "SELECT start, id AS _id, min(level) AS level FROM w WHERE id <> start AND id IN (SELECT _id FROM n) GROUP BY start, id"
)
def bfs_many(spark, sf):
    """Two steps either way along HAS_EVENT from 64 projects at once, over that relation's edges, stored once each."""
    path = f"{shared_folder(spark)}/edges-{uuid.uuid4().hex}"
    stored.write_edges(src.edges(spark, sf).where("relation = 'HAS_EVENT'"), path, 0)
    return stored.traverse_many(src.nodes(spark, sf), path, [f"proj_{k:09}" for k in range(64)], ["HAS_EVENT"], 2, directed=False, buckets=0)


_SHOWN_NODES = "s AS ((SELECT _id FROM n WHERE type = 'ConfPage' ORDER BY _id LIMIT 500) UNION ALL (SELECT _id FROM n WHERE type = 'Event' ORDER BY _id LIMIT 500))"
_SHOWN_EDGES = "SELECT source_id, relation, target_id FROM g WHERE source_id IN (SELECT _id FROM s) AND target_id IN (SELECT _id FROM s)"


def _visible(spark, sf):
    """What a view shows: the first nodes of each of two types."""
    nodes = src.nodes(spark, sf)
    return search.load_nodes(nodes, ["ConfPage"], limit=500).union(search.load_nodes(nodes, ["Event"], limit=500))


@query(f"WITH {sql.NODES}, {sql.EDGES}, {_SHOWN_NODES} {_SHOWN_EDGES}")
def induced_edges(spark, sf):
    """Edges of the whole graph among the nodes that a view shows."""
    return search.induced_edges(src.edges(spark, sf), _visible(spark, sf)).select("source_id", "relation", "target_id")


@query(
    f"WITH {sql.NODES}, {sql.EDGES}, {_SHOWN_NODES}, i AS ({_SHOWN_EDGES}) SELECT type, count(*) AS n FROM n WHERE _id IN (SELECT _id FROM s) GROUP BY type UNION ALL SELECT 'Edges', count(*) FROM i"
)
def ui_counts(spark, sf):
    """How many nodes of each type and how many edges a view shows."""
    visible = _visible(spark, sf)
    return search.counts_by_type(visible, search.induced_edges(src.edges(spark, sf), visible))


@query(
    f"WITH {sql.NODES} SELECT _id, '[' || type || '] ' || CASE type WHEN 'ConfPage' THEN substr(name, 1, 50) WHEN 'Event' THEN regexp_extract(name, '^.([^]]*)', 1) || ' — ' || "
    "substr(regexp_extract(name, '^[^]]*. (.*)$', 1), 1, 40) ELSE regexp_extract(name, ' (.*)$', 1) END AS name FROM n"
)
def ui_names(spark, sf):
    return src.nodes(spark, sf).select("_id", search.display_name().alias("name"))


_LINES = "'<b>ID:</b> ' || _id || '<br><b>Type:</b> ' || type || '<br><b>Date:</b> ' || strftime(ts, '%Y-%m-%d')"


@query(
    f"WITH {sql.NODES}, f AS (SELECT 'app_' || app_id AS _id, min(ts) AS first_seen FROM e GROUP BY app_id UNION ALL SELECT 'proj_' || project_id, min(ts) FROM e GROUP BY project_id) "
    f"SELECT n._id, md5({_LINES.replace('_id', 'n._id', 1).replace('ts,', 'n.ts,')} || CASE type WHEN 'ConfPage' THEN '<br><b>Title:</b> ' || name "
    "WHEN 'Event' THEN '<br><b>type:</b> ' || event_type || '<br><b>cancelled:</b> ' || is_cancelled || '<br><b>description:</b> ' || substr(description, 1, 120) || '<br><b>apps:</b> ' || app_id "
    f"ELSE '<br><b>' || CASE type WHEN 'Project' THEN 'project_id' ELSE 'app_id' END || ':</b> ' || regexp_extract(name, ' (.*)$', 1) || '<br><b>first_seen:</b> ' || strftime(first_seen, {sql.ISO}) "
    f"|| CASE type WHEN 'Application' THEN '<br><b>last_seen:</b> ' || strftime(n.ts, {sql.ISO}) ELSE '' END END) AS tooltip_md5 "
    "FROM n LEFT JOIN e ON n._id = e._id LEFT JOIN f ON n._id = f._id"
)
def ui_tooltips(spark, sf):
    return src.nodes(spark, sf).select("_id", F.md5(search.tooltip()).alias("tooltip_md5"))


@query(f"WITH {sql.NODES} SELECT type, count(*) AS n FROM n GROUP BY type")
def ui_counts_by_type(spark, sf):
    return search.counts_by_type(src.nodes(spark, sf))


@query(
    f"WITH {sql.NODES} SELECT n._id, CASE type WHEN 'ConfPage' THEN substr(name, 1, 40) WHEN 'Application' THEN 'App' || chr(10) || substr(name, 5) WHEN 'Project' THEN 'Proj' || chr(10) || substr(name, 9) "
    "ELSE '[' || event_type || ']' || chr(10) || substr(description, 1, 28) END AS label FROM n LEFT JOIN e ON n._id = e._id"
)
def ui_labels(spark, sf):
    return src.nodes(spark, sf).select("_id", search.label().alias("label"))


@query(f"WITH {sql.NODES} SELECT _id, type FROM n WHERE type IN ('Application', 'Project') ORDER BY _id LIMIT 150")
def load_nodes(spark, sf):
    return search.load_nodes(src.nodes(spark, sf), ["Application", "Project"]).select("_id", "type")


_URGENT = "SELECT page_id FROM p WHERE space_key = '1-URGENT'"


@query(f"WITH {sql.NODES} SELECT _id, type IN ('ConfPage', 'Event') AND coalesce(page_id IN ({_URGENT}), false) AS is_deleted FROM n")
def soft_delete_nodes(spark, sf):
    """All pages of one space are taken out; shared nodes stay."""
    urgent = src.pages(spark, sf).where("space_key = '1-URGENT'")
    return store.soft_delete_nodes(src.nodes(spark, sf), urgent).select("_id", "is_deleted")


@query(f"WITH {sql.EVENTS}, {sql.PAGES}, {sql.EDGES} SELECT source_id, relation, target_id FROM g WHERE page_id NOT IN ({_URGENT})")
def edge_purge(spark, sf):
    urgent = src.pages(spark, sf).where("space_key = '1-URGENT'")
    kept = store.purge_edges(src.events(spark, sf), urgent)  # edges are of the page of their event: purged before there are five an event
    return graph.build_edges(kept).select("source_id", "relation", "target_id")


@query("SELECT user_id, arg_max(event_type, (ts, -event_id)) AS event_type, arg_max(value, (ts, -event_id)) AS value FROM events GROUP BY user_id")
def upsert_nodes(spark, sf):
    """The newest version of each key of a change log."""
    changes = src.table(spark, sf, "events")
    return store.latest_per_key(changes, ["user_id"], "ts", ["event_id"]).select("user_id", "event_type", "value")


@query("SELECT user_id || '__DID__' || event_type AS _id, max(ts)::VARCHAR AS at FROM events GROUP BY user_id, event_type".replace("max(ts)::VARCHAR", f"strftime(max(ts), {sql.ISO})"))
def upsert_edges(spark, sf):
    """At most one edge per source, relation and target, the newest."""
    changes = src.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("source_id"), F.lit("DID").alias("relation"), F.col("event_type").alias("target_id"), "ts")
    return store.upsert_edges(changes, "ts").select("_id", iso(F.col("ts")).alias("at"))


@query(f"WITH {sql.PAGES} SELECT 'page_' || page_id AS _id, round(CAST(embedding[1] AS DOUBLE), 5) AS first FROM p LEFT JOIN embeddings ON page_id = CAST(vec_id AS VARCHAR)")
def set_embeddings(spark, sf):
    """Vectors put on the page nodes; pages without one keep none, vectors without a page have no effect."""
    pages = graph.page_nodes(src.pages(spark, sf)).select("_id", F.lit(None).cast("array<float>").alias("embedding"))
    found = store.set_embeddings(pages, src.vectors(spark, sf).select(F.concat(F.lit("page_"), "vec_id").alias("_id"), "embedding"))
    return found.select("_id", F.round(F.col("embedding")[0].cast("double"), 5).alias("first"))


_NODE_JSON = "'{\"type\":\"' || type || '\",\"page_id\":\"' || page_id || '\",\"timestamp\":\"' || strftime(ts, " + sql.ISO + ") || '\"}'"


@query(f"WITH {sql.VECTORS} SELECT _id, {_NODE_JSON} AS json FROM v")
def serialize_nodes(spark, sf):
    return search.serialize(src.vectors(spark, sf).select("_id", "type", "page_id", "timestamp", "embedding")).select(
        "_id", F.regexp_replace("json", '"_id":"[^"]*",', "").alias("json")
    )


# --- vectors -------------------------------------------------------------------------------------------------


@query(f"WITH {sql.VECTORS} SELECT _id, type, round(semantic, 4) AS score FROM v WHERE type = 'Event' AND ts <= TIMESTAMP '2025-01-01' ORDER BY semantic DESC, _id LIMIT 60")
def vector_nodes(spark, sf):
    found = search.vector_search(src.vectors(spark, sf), src.query_vector(spark, sf), 60, ["Event"], F.expr("TIMESTAMP_NTZ'2025-01-01 00:00:00'"))
    return found.select("_id", "type", F.round("semantic", 4).alias("score"))


@query(f"WITH {sql.VECTORS} SELECT 'row_' || vec_id AS _id, page_id, round(semantic, 4) AS score FROM v ORDER BY semantic DESC, 'row_' || vec_id LIMIT 60")
def vector_rows(spark, sf):
    """All vectors as those of table rows."""
    rows = src.vectors(spark, sf).withColumn("_id", F.concat(F.lit("row_"), "vec_id"))
    return search.vector_search(rows, src.query_vector(spark, sf), 60).select("_id", "page_id", F.round("semantic", 4).alias("score"))


@query(
    f"WITH {sql.VECTORS} SELECT 'chunk_' || vec_id AS _id, page_id, round(semantic, 4) AS score FROM v WHERE ts <= TIMESTAMP '2025-01-01' ORDER BY semantic DESC, 'chunk_' || vec_id LIMIT 60"
)
def vector_chunks(spark, sf):
    """All vectors as those of chunks, up to a day."""
    chunks = src.vectors(spark, sf).withColumn("_id", F.concat(F.lit("chunk_"), "vec_id"))
    found = search.vector_search(chunks, src.query_vector(spark, sf), 60, before=F.expr("TIMESTAMP_NTZ'2025-01-01 00:00:00'"))
    return found.select("_id", "page_id", F.round("semantic", 4).alias("score"))


@query(f"WITH {sql.VECTORS} SELECT _id, type, round(semantic, 4) AS score FROM v ORDER BY semantic DESC, _id LIMIT 60")
def vector_index(spark, sf):
    """The exact search by an index: cells that cannot hold one of the best are not read."""
    path = f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}"
    stored.write_vectors(src.vectors(spark, sf), path, 64)
    return stored.search_vectors(spark, path, src.query_vector(spark, sf), 60).select("_id", "type", F.round("semantic", 4).alias("score"))


_DECAY = "exp(-ln(2) * greatest(0, (epoch_us(TIMESTAMP '2026-01-01') - epoch_us(ts)) / 1e6 / 86400.0) / 365.0)"


@query(f"WITH {sql.VECTORS} SELECT _id, round({_DECAY}, 6) AS decay FROM v")
def temporal_decay(spark, sf):
    from lattica.functions.vectors import temporal_decay as decay

    return src.vectors(spark, sf).select("_id", F.round(decay(F.col("timestamp"), F.expr(REFERENCE)), 6).alias("decay"))


def _sources(spark, sf):
    v = src.vectors(spark, sf)
    return [("node", v.where("vec_id % 3 = 0"), ["Event", "ConfPage"]), ("row", v.where("vec_id % 3 = 1"), None), ("chunk", v.where("vec_id % 3 = 2"), None)]


_RETRIEVE = f"""WITH {sql.VECTORS}, k AS (SELECT *, vec_id % 3 AS rank, row_number() OVER (PARTITION BY vec_id % 3 ORDER BY semantic DESC, _id) AS rn FROM v),
c AS (SELECT *, {_DECAY} AS temporal FROM k WHERE rn <= 60), s AS (SELECT *, semantic * temporal AS combined FROM c ORDER BY combined DESC, rank, _id LIMIT 20) """
_SOURCE = "CASE rank WHEN 0 THEN 'node' WHEN 1 THEN 'row' ELSE 'chunk' END AS source"


@query(_RETRIEVE + f"SELECT _id, {_SOURCE}, round(combined, 4) AS score FROM s")
def semantic_retrieve(spark, sf):
    found = search.semantic_retrieve(_sources(spark, sf), src.query_vector(spark, sf), F.expr(REFERENCE), 20)
    return found.select("_id", "source", F.round("combined", 4).alias("score"))


@query(_RETRIEVE + f"SELECT _id, round(semantic, 4) AS semantic, round(temporal, 4) AS temporal, round(combined, 4) AS combined, strftime(ts, {sql.ISO}) AS at FROM s")
def search_response(spark, sf):
    found = search.semantic_retrieve(_sources(spark, sf), src.query_vector(spark, sf), F.expr(REFERENCE), 20)
    return found.select("_id", *(F.round(c, 4).alias(c) for c in ("semantic", "temporal", "combined")), iso(F.col("timestamp")).alias("at"))


_MEETING = ("000000899", "00000000511")


@query(
    f"WITH {sql.EVENTS}, {sql.VECTORS} SELECT v._id, round(semantic, 4) AS score FROM v WHERE page_id IN (SELECT page_id FROM e WHERE project_id = '000000257') "
    "ORDER BY semantic DESC, _id LIMIT 10"
)
def search_rows_restricted(spark, sf):
    """Rows of the pages where an event names a project, by cosine."""
    found = search.search_rows(src.vectors(spark, sf), src.events(spark, sf, custkey=257), src.query_vector(spark, sf), 10, project_id="000000257")
    return found.select("_id", F.round("semantic", 4).alias("score"))


@query(
    f"WITH {sql.EVENTS}, {sql.VECTORS} SELECT v._id, round(semantic, 4) AS score FROM v WHERE page_id IN (SELECT page_id FROM e WHERE project_id = '{_MEETING[0]}' AND app_id = '{_MEETING[1]}') "
    "ORDER BY semantic DESC, _id LIMIT 10"
)
def search_rows_of_both(spark, sf):
    """Rows of the pages where one event names both a project and an application, by cosine."""
    events = src.events(spark, sf, custkey=int(_MEETING[0]))
    found = search.search_rows(src.vectors(spark, sf), events, src.query_vector(spark, sf), 10, *_MEETING)
    return found.select("_id", F.round("semantic", 4).alias("score"))


@query(f"WITH {sql.VECTORS} SELECT _id, type, round(semantic, 4) AS score FROM v WHERE type IN ('ConfPage', 'Event') ORDER BY semantic DESC, _id LIMIT 10")
def search_graph_nodes(spark, sf):
    found = search.vector_search(src.vectors(spark, sf), src.query_vector(spark, sf), 10, ["ConfPage", "Event"])
    return found.select("_id", "type", F.round("semantic", 4).alias("score"))


# --- ingestion control -----------------------------------------------------------------------------------------


@query(f"WITH {sql.LOG} SELECT page_id FROM oc WHERE outcome <> 'skipped'")
def needs_upsert(spark, sf):
    pages, log = src.ingestion(spark, sf)
    return store.with_log(pages, log).where(store.needs_upsert()).select("page_id")


@query(f"WITH {sql.LOG} SELECT outcome, count(*) AS n FROM oc GROUP BY outcome")
def batch_outcome_counts(spark, sf):
    return store.outcome_counts(*src.ingestion(spark, sf))


@query(f"WITH {sql.LOG} SELECT page_id, strftime(page_date, {sql.ISO}) AS at FROM pg WHERE page_id IN ('7', '3', '12', '14', '99')")
def page_list(spark, sf):
    from lattica.sources.pages import pages_by_id

    pages, _ = src.ingestion(spark, sf)
    return pages_by_id(pages, ["7", "3", "12", "14", "99", "no such page"]).select("page_id", iso(F.col("page_date")).alias("at"))


@query(f"WITH {sql.LOG} SELECT page_id, retry_count FROM lg WHERE status = 'error' AND retry_count < 3")
def list_errors(spark, sf):
    return store.list_errors(src.ingestion(spark, sf)[1]).select("page_id", "retry_count")


@query(
    f"WITH {sql.LOG}, r AS (SELECT page_id, CASE WHEN CAST(page_id AS INTEGER) % 3 = 0 THEN 'error' ELSE 'done' END AS s FROM oc WHERE outcome = 'work') "
    "SELECT page_id, coalesce(s, status) AS status, CAST(retry_count + CASE WHEN s = 'error' THEN 1 ELSE 0 END AS INTEGER) AS retry_count, "
    "CASE WHEN s = 'error' THEN 'timeout' END AS error_message FROM lg LEFT JOIN r USING (page_id)"
)
def log_transitions(spark, sf):
    pages, log = src.ingestion(spark, sf)
    work = store.outcomes(pages, log).where("outcome = 'work'")
    status = F.when(F.pmod(F.col("page_id").cast("int"), F.lit(3)) == 0, "error").otherwise("done")
    return store.log_transitions(log, work.select("page_id", status.alias("new_status"), F.lit("timeout").alias("error")))


@query(
    f"WITH {sql.LOG} SELECT page_id, CASE WHEN event_type = 'error' THEN 'error' ELSE 'done' END AS status, strftime(ts, {sql.ISO}) AS at "
    "FROM x QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY ts DESC, event_id) = 1"
)
def log_latest(spark, sf):
    """Replace by page: the newest of each page's log rows."""
    status = F.when(F.col("event_type") == "error", "error").otherwise("done")
    rows = src.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("page_id"), status.alias("status"), "ts", "event_id")
    return store.latest_per_key(rows, ["page_id"], "ts", ["event_id"]).select("page_id", "status", iso(F.col("ts")).alias("at"))


_MARKS = ("processing", "done", "error", "needs_review")


@query(
    f"WITH {sql.LOG} SELECT page_id, (['processing', 'done', 'error', 'needs_review'])[CAST(page_id AS INTEGER) % 4 + 1] AS status, "
    "CAST(retry_count + CASE WHEN CAST(page_id AS INTEGER) % 4 = 2 THEN 1 ELSE 0 END AS INTEGER) AS retry_count, "
    "CASE WHEN CAST(page_id AS INTEGER) % 4 >= 2 THEN 'because' END AS error_message, CAST(page_id AS INTEGER) % 4 < 2 AS processed FROM lg"
)
def log_marks(spark, sf):
    """A quarter of the pages each is marked as in work, done, failed and to be reviewed."""
    log = src.ingestion(spark, sf)[1].withColumn("processed_at", F.lit(None).cast("timestamp_ntz"))
    quarter = F.pmod(F.col("page_id").cast("int"), F.lit(4))
    for k, mark in enumerate(_MARKS):
        log = store.mark_log(log, log.where(quarter == k), mark, F.lit("because"), F.expr(REFERENCE))
    return log.select("page_id", "status", "retry_count", "error_message", F.col("processed_at").isNotNull().alias("processed"))


@query(f"WITH {sql.LOG} SELECT page_id, status FROM lg WHERE page_id = '42'")
def log_entry(spark, sf):
    return store.log_entry(src.ingestion(spark, sf)[1], "42").select("page_id", "status")


@query(
    f"WITH {sql.PAGES} SELECT page_id, strftime(ts, {sql.ISO}) AS at FROM p WHERE space_key = '1-URGENT' AND ts >= TIMESTAMP '1996-01-01' AND ts <= TIMESTAMP '1997-01-01'"
)
def space_scan_range(spark, sf):
    from lattica.sources.pages import scan_space

    start, end = F.expr("TIMESTAMP_NTZ'1996-01-01 00:00:00'"), F.expr("TIMESTAMP_NTZ'1997-01-01 00:00:00'")
    return scan_space(src.pages(spark, sf), "1-URGENT", start, end).select("page_id", iso(F.col("page_date")).alias("at"))


# --- texts -----------------------------------------------------------------------------------------------------


@query(
    f"WITH {sql.PAGES}, d AS (SELECT CAST(doc_id AS VARCHAR) AS page_id, text FROM documents) "
    "SELECT page_id, md5('Title: ' || title || chr(10) || 'Date: ' || strftime(ts, '%Y-%m-%d') || chr(10) || trim(text)) AS text_md5 FROM p JOIN d USING (page_id)"
)
def page_text(spark, sf):
    """Text to embed of the pages that have a document."""
    docs = src.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("page_id"), "text")
    joined = src.pages(spark, sf).join(docs, "page_id")
    return joined.select("page_id", F.md5(graph.page_text(F.col("title"), F.col("timestamp"), F.array("text"))).alias("text_md5"))


@query(
    f"WITH {sql.EVENTS}, {sql.PAGES} SELECT _id, '[' || event_type || '] ' || description || chr(10) || 'Page: ' || title || ' | Date: ' || strftime(p.ts, '%Y-%m-%d') "
    "|| chr(10) || 'Apps: ' || app_id || chr(10) || 'Projects: ' || project_id AS text FROM e JOIN p USING (page_id)"
)
def event_text(spark, sf):
    joined = src.events(spark, sf).join(src.pages(spark, sf).select("page_id", "title"), "page_id")
    text = graph.event_text(*(F.col(c) for c in ("event_type", "description", "title", "timestamp", "app_ids", "project_ids")))
    return joined.select("_id", text.alias("text"))


@query(
    f"WITH {sql.EVENTS}, {sql.PAGES}, l AS (SELECT page_id, string_agg('- [' || event_type || '] ' || description, chr(10) ORDER BY idx) AS lines FROM e GROUP BY page_id) "
    "SELECT page_id, 'Meeting: ' || title || chr(10) || 'Date: ' || strftime(ts, '%Y-%m-%d') || coalesce(chr(10) || lines, '') AS body FROM p LEFT JOIN l USING (page_id)"
)
def episode_body(spark, sf):
    return graph.episode_bodies(src.pages(spark, sf), src.events(spark, sf))


@query(
    "SELECT conv_id, string_agg(role || ': ' || trim(text), ' | ' ORDER BY turn, role || ': ' || trim(text)) AS text FROM conversations WHERE trim(text) <> '' GROUP BY conv_id"
)
def row_text(spark, sf):
    """A conversation as one row: a cell a turn, headed by its role; repeated turns are cells of their own."""
    turns = src.table(spark, sf, "conversations")
    cells = turns.select(F.col("conv_id").alias("page_id"), F.lit(0).alias("table_index"), F.lit(0).alias("row"), F.col("turn").alias("col"), F.col("role").alias("header"), "text")
    return graph.row_texts(cells).select(F.col("page_id").alias("conv_id"), "text")


_END = "CASE WHEN {s} + 1000 < length(t) AND instr(substr(t, {s} + 1, 1000), ' ') > 0 AND 1000 - instr(reverse(substr(t, {s} + 1, 1000)), ' ') > 0 THEN {s} + 1000 - instr(reverse(substr(t, {s} + 1, 1000)), ' ') ELSE {s} + 1000 END"
_STRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
_PIECE = _STRIP.format(x="substr(t, s + 1, e - s)")
_CHUNKS = f"""WITH RECURSIVE b AS (SELECT doc_id, {_STRIP.format(x="text")} AS t FROM documents),
w(doc_id, t, k, s, e) AS (
  SELECT doc_id, t, 0, 0, CASE WHEN length(t) <= 1000 THEN length(t) ELSE {_END.format(s="0")} END FROM b WHERE length(t) > 0
  UNION ALL SELECT doc_id, t, k + 1, e - 150, {_END.format(s="(e - 150)")} FROM w WHERE length(t) > 1000 AND e - 150 > 0 AND e - 150 < length(t)),
c AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) AS idx, {_PIECE} AS chunk FROM w WHERE {_PIECE} <> '') """


@query(_CHUNKS + "SELECT doc_id, idx, md5(chunk) AS chunk_md5 FROM c")
def chunk_text(spark, sf):
    """Overlapping windows over all documents."""
    docs = src.table(spark, sf, "documents").select("doc_id", "text")
    return attach.text_chunks(docs, "doc_id").select("doc_id", "idx", F.md5("chunk").alias("chunk_md5"))


@query(
    _CHUNKS + ", p AS (SELECT o_orderkey AS doc_id, o_orderdate AS ts FROM orders) SELECT doc_id, idx, md5('File: doc_' || doc_id || '.pdf' || chr(10) || 'Page: Minutes ' "
    "|| strftime(ts, '%Y-%m-%d') || ' | Date: ' || strftime(ts, '%Y-%m-%d') || chr(10) || chunk) AS text_md5 FROM c JOIN p USING (doc_id)"
)
def chunk_context_text(spark, sf):
    docs = src.table(spark, sf, "documents").select("doc_id", "text")
    chunks = attach.text_chunks(docs, "doc_id")
    joined = chunks.join(src.pages(spark, sf).withColumn("doc_id", F.col("page_id").cast("long")), "doc_id")
    name = F.concat(F.lit("doc_"), "doc_id", F.lit(".pdf"))
    return joined.select("doc_id", "idx", F.md5(graph.chunk_text(name, F.col("title"), F.col("timestamp"), F.col("chunk"))).alias("text_md5"))


# --- identifiers -------------------------------------------------------------------------------------------------


def _mentions(spark, sf):
    """Each event as a text that names its application and its project."""
    text = F.concat(F.lit("App "), F.col("app_ids")[0], F.lit(" of project "), F.col("project_ids")[0], F.lit(", "), "description")
    return src.events(spark, sf).select("page_id", F.col("idx").alias("ord"), text.alias("text"), F.concat(F.lit("page:"), "page_id").alias("path"))


_TEXT = "'App ' || app_id || ' of project ' || project_id || ', ' || description"
_SCAN = f"WITH {sql.EVENTS}, s AS (SELECT page_id, idx AS ord, {_TEXT} AS text, 0 AS pos, 'app_id' AS id_type, app_id AS raw_value FROM e UNION ALL SELECT page_id, idx, {_TEXT}, 1, 'project_id', project_id FROM e)"
_FIRST = _SCAN + ", f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id, raw_value ORDER BY ord, pos) AS rn FROM s) WHERE rn = 1)"


@query(_SCAN + " SELECT page_id, CAST(ord AS INTEGER) AS ord, id_type, raw_value FROM s")
def regex_scan(spark, sf):
    return extract.scan_ids(_mentions(spark, sf)).select("page_id", "ord", "id_type", "raw_value")


_AT = "length(regexp_extract(text, '^(.*?)\\b' || raw_value || '\\b', 1)) + 1"


@query(_SCAN + f", c AS (SELECT *, {_AT} AS at_, greatest(1, {_AT} - 60) AS a FROM s) SELECT page_id, CAST(ord AS INTEGER) AS ord, raw_value, substr(text, a, at_ + length(raw_value) + 60 - a) AS context FROM c")
def id_context(spark, sf):
    found = extract.scan_ids(_mentions(spark, sf))
    return found.select("page_id", "ord", "raw_value", extract.context(F.col("text"), F.col("raw_value")).alias("context"))


@query(_FIRST + " SELECT page_id, raw_value, CAST(ord AS INTEGER) AS ord FROM f")
def candidate_dedup(spark, sf):
    return extract.first_mentions(extract.scan_ids(_mentions(spark, sf))).select("page_id", "raw_value", "ord")


def _validated(spark, sf):
    """Known are the applications of small parts and the projects of one segment."""
    apps = src.table(spark, sf, "part").where("p_size <= 25").select(F.lit("app_id").alias("id_type"), src.padded("p_partkey", 11).alias("id"))
    projects = src.table(spark, sf, "customer").where("c_nationkey < 12").select(F.lit("project_id").alias("id_type"), src.padded("c_custkey", 9).alias("id"))
    return extract.validate_ids(extract.first_mentions(extract.scan_ids(_mentions(spark, sf))), apps.union(projects))


_VALID = _FIRST + """, k AS (SELECT 'app_id' AS id_type, lpad(CAST(p_partkey AS VARCHAR), 11, '0') AS id FROM part WHERE p_size <= 25
  UNION ALL SELECT 'project_id', lpad(CAST(c_custkey AS VARCHAR), 9, '0') FROM customer WHERE c_nationkey < 12),
  va AS (SELECT f.*, k.id IS NOT NULL AS is_valid FROM f LEFT JOIN k ON f.id_type = k.id_type AND raw_value = id)"""


@query(_VALID + " SELECT page_id, id_type, raw_value, is_valid FROM va")
def validate_ids(spark, sf):
    return _validated(spark, sf).select("page_id", "id_type", "raw_value", "is_valid")


@query(_VALID + " SELECT page_id, raw_value, 'pending_review' AS status FROM va WHERE NOT is_valid")
def unvalidated_route(spark, sf):
    return extract.unvalidated(_validated(spark, sf), F.current_timestamp()).select("page_id", "raw_value", "status")


@query(_VALID + " SELECT page_id, id_type, string_agg(raw_value, ',' ORDER BY ord, pos) AS ids FROM va WHERE is_valid GROUP BY page_id, id_type")
def valid_id_lists(spark, sf):
    return extract.valid_by_type(_validated(spark, sf)).select("page_id", "id_type", F.array_join("ids", ",").alias("ids"))


@query(f"WITH {sql.EVENTS} SELECT page_id, md5(substr(string_agg({_TEXT}, ' ' ORDER BY idx), 1, 8000)) AS input_md5 FROM e GROUP BY page_id")
def model_input(spark, sf):
    return extract.model_input(_mentions(spark, sf)).select("page_id", F.md5("input").alias("input_md5"))


# --- pages -------------------------------------------------------------------------------------------------------


#: Pieces of a page: a tag, comment or declaration with the text behind it; the head has no text of the page.
_PIECES = r"""WITH h AS (SELECT page_id, regexp_replace(html, '<head>.*?</head>', '', 's') AS t FROM pages),
x AS (SELECT page_id, unnest(regexp_extract_all(t, '<!--.*?-->|<[^>]*>[^<]*', 0, 's')) AS piece, generate_subscripts(regexp_extract_all(t, '<!--.*?-->|<[^>]*>[^<]*', 0, 's'), 1) AS i FROM h),
y AS (SELECT page_id, i, CASE WHEN piece LIKE '<b>%' THEN 'bold' ELSE 'normal' END AS style,
  CASE WHEN piece LIKE '<!--%' THEN regexp_extract(piece, '^<!--(.*?)-->$', 1, 's') WHEN piece ILIKE '<!doctype%' THEN regexp_extract(piece, '^<![a-zA-Z]+ ([^>]*)>', 1)
  ELSE regexp_replace(replace(replace(replace(regexp_extract(piece, '^<[^>]*>(.*)$', 1, 's'), '&copy;', '©'), '&middot;', '·'), '&quot;', chr(34)), '&amp;?', '&', 'g') END AS raw FROM x),
z AS (SELECT page_id, i, style, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS text FROM y WHERE regexp_replace(raw, '^\s+|\s+$', '', 'g') <> ''),
n AS (SELECT *, CASE WHEN style IS DISTINCT FROM lag(style) OVER (PARTITION BY page_id ORDER BY i) THEN 1 ELSE 0 END AS new FROM z),
r AS (SELECT *, sum(new) OVER (PARTITION BY page_id ORDER BY i) - 1 AS seq FROM n)
SELECT CAST(page_id AS VARCHAR) AS page_id, CAST(seq AS INTEGER) AS seq, any_value(style) AS style, md5(string_agg(text, ' ' ORDER BY i)) AS content_md5 FROM r GROUP BY page_id, seq"""


@query(_PIECES)
def html_text(spark, sf):
    """Text chunks of all pages with their styles."""
    parsed = parse.parse_pages(src.table(spark, sf, "pages"), parts=["chunks"])
    return parse.flat(parsed, "chunks").select("page_id", "seq", "style", F.md5("content").alias("content_md5"))


@query(
    "SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '<a\\s[^>]*href=\"([^\"]*)\"', 1)) AS href FROM pages"
)
def html_links(spark, sf):
    return parse.html_links(src.table(spark, sf, "pages").select("page_id", "html"))


@query(
    "WITH s AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS at_ FROM conversations), "
    "c AS (SELECT *, CASE WHEN at_ > 1 AND role IS NOT DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY at_) THEN 0 ELSE 1 END AS new FROM s), "
    "r AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY at_) - 1 AS run FROM c) "
    "SELECT conv_id, CAST(run AS BIGINT) AS run, any_value(role) AS style, md5(string_agg(text, ' ' ORDER BY at_)) AS content_md5 FROM r GROUP BY conv_id, run"
)
def merge_runs(spark, sf):
    """Neighbouring turns of one role become one; repeated turns stand in the order of their role and text."""
    merged = parse.merge_runs(src.turns(spark, sf).select("conv_id", "at", F.col("role").alias("style"), F.col("text").alias("content")), ["conv_id"], "at")
    return merged.select("conv_id", "run", "style", F.md5("content").alias("content_md5"))


def queries() -> dict[str, Query]:
    return {**_QUERIES, **LITERAL_QUERIES, **RUN_QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**_SQL, **LITERAL_SQL, **RUN_SQL}
