"""SQL views that the oracle queries share; they restate ``projection`` for DuckDB."""

ISO = "'%Y-%m-%dT%H:%M:%S'"

EVENTS = """
e AS (
  SELECT 'event_' || l_orderkey || '_' || idx AS _id, CAST(l_orderkey AS VARCHAR) AS page_id, idx, l_partkey, o_custkey,
    CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'approval' WHEN 'AO' THEN 'action_item' WHEN 'NF' THEN 'decision'
      WHEN 'NO' THEN 'status_change' WHEN 'RF' THEN 'cancellation' WHEN 'RO' THEN 'risk' END AS event_type,
    'item ' || l_partkey || ' qty ' || CAST(floor(l_quantity) AS BIGINT) AS description, l_returnflag = 'R' AS is_cancelled,
    lpad(CAST(l_partkey AS VARCHAR), 11, '0') AS app_id, lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS project_id, o_orderdate AS ts
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity,
      l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS idx FROM lineitem) l
  JOIN orders ON l_orderkey = o_orderkey)
"""
PAGES = """
p AS (SELECT CAST(o_orderkey AS VARCHAR) AS page_id, 'Minutes ' || strftime(o_orderdate, '%Y-%m-%d') AS title, o_orderpriority AS space_key,
  o_orderdate AS ts, o_orderstatus AS status FROM orders)
"""
NODES = f"""{EVENTS.strip()}, {PAGES.strip()},
n AS (
  SELECT 'page_' || page_id AS _id, 'ConfPage' AS type, page_id, ts, title AS name FROM p
  UNION ALL SELECT _id, 'Event', page_id, ts, '[' || event_type || '] ' || description FROM e
  UNION ALL SELECT 'app_' || app_id, 'Application', NULL, max(ts), 'App ' || app_id FROM e GROUP BY app_id
  UNION ALL SELECT 'proj_' || project_id, 'Project', NULL, max(ts), 'Project ' || project_id FROM e GROUP BY project_id)
"""
EDGES = """
g AS (
  SELECT 'page_' || page_id AS source_id, 'HAS_EVENT' AS relation, _id AS target_id, page_id FROM e
  UNION ALL SELECT 'app_' || app_id, 'HAS_EVENT', _id, page_id FROM e
  UNION ALL SELECT 'proj_' || project_id, 'HAS_EVENT', _id, page_id FROM e
  UNION ALL SELECT DISTINCT 'page_' || page_id, 'REFERENCES_APP', 'app_' || app_id, page_id FROM e
  UNION ALL SELECT DISTINCT 'page_' || page_id, 'REFERENCES_PROJ', 'proj_' || project_id, page_id FROM e)
"""
VECTORS = """
q AS (SELECT CAST(embedding AS DOUBLE[]) AS qe FROM embeddings WHERE vec_id = 0),
v AS (SELECT 'vec_' || vec_id AS _id, vec_id, CAST(vec_id AS VARCHAR) AS page_id, CASE WHEN label % 2 = 0 THEN 'Event' ELSE 'ConfPage' END AS type,
  TIMESTAMP '2024-01-01' + to_days(CAST(vec_id AS INTEGER)) AS ts, list_cosine_similarity(CAST(embedding AS DOUBLE[]), qe) AS semantic
  FROM embeddings, q)
"""
LOG = """
x AS (SELECT CAST(user_id AS VARCHAR) AS page_id, ts, event_id, event_type FROM events),
lg AS (SELECT page_id, CASE WHEN arg_max(event_type, (ts, event_id)) = 'error' THEN 'error' ELSE 'done' END AS status, max(ts) AS modified,
  CAST(page_id AS INTEGER) % 5 AS retry_count FROM x WHERE ts < TIMESTAMP '2024-01-15' GROUP BY page_id),
pg AS (SELECT a.page_id, CASE WHEN CAST(a.page_id AS INTEGER) % 10 = 0 THEN coalesce(lg.modified, a.ts) ELSE a.ts END AS last_modified,
  CASE WHEN CAST(a.page_id AS INTEGER) % 7 <> 0 THEN a.ts END AS page_date
  FROM (SELECT page_id, max(ts) AS ts FROM x GROUP BY page_id) a LEFT JOIN lg USING (page_id)),
oc AS (SELECT pg.page_id, CASE WHEN lg.page_id IS NOT NULL AND lg.status = 'done' AND lg.modified IS NOT NULL AND NOT last_modified > lg.modified THEN 'skipped'
  WHEN page_date IS NULL THEN 'needs_review' ELSE 'work' END AS outcome FROM pg LEFT JOIN lg USING (page_id))
"""
