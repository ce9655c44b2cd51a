"""Queries over whole runs: incremental batches with their log and registry, the ingest plan, files of offices."""

from __future__ import annotations

import struct
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators import attach
from lattica.plans import projection as src
from lattica.plans.ingest import ingest
from lattica.plans.literal import _LINES, _order_pages
from lattica.session import shared_folder, stored
from lattica.sources.files import EXTRACTORS
from lattica.streaming.watch import PageTables

RUN_QUERIES: dict = {}
RUN_SQL: dict = {}


def query(text: str):
    def add(f):
        RUN_QUERIES[f.__name__], RUN_SQL[f.__name__] = f, text
        return f

    return add


# --- two batches: users as pages, their latest event before a day and at the end; those of kind error fail ---------


def _two_batches(spark: SparkSession, sf: str) -> PageTables:
    rows = src.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("page_id"), "ts", "event_id", "event_type")
    latest = lambda df: df.groupBy("page_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("title"), F.max("ts").alias("last_modified"))

    def work(pages: DataFrame) -> dict[str, DataFrame]:
        bad = pages.where("title = 'error'").select("page_id", F.lit("bad event").alias("error"))
        good = pages.where("title <> 'error'")
        nodes = good.select(F.concat(F.lit("page_"), "page_id").alias("_id"), "page_id", F.lit(None).cast("string").alias("first_seen"), "title")
        shared = good.groupBy("title").agg(F.date_format(F.min("last_modified"), "yyyy-MM-dd").alias("first_seen")).select(F.concat(F.lit("kind_"), "title").alias("_id"), F.lit(None).cast("string").alias("page_id"), "first_seen", "title")
        return {"nodes": nodes.union(shared), "failed": bad}

    tables = PageTables(spark, f"{shared_folder(spark)}/run-{uuid.uuid4().hex}", buckets=8)
    for number, batch in enumerate((latest(rows.where("ts < TIMESTAMP_NTZ'2024-01-15 00:00:00'")), latest(rows), latest(rows)), 1):
        tables.upsert(batch, work, source="events", number=min(number, 2))  # the second batch comes twice
    return tables


_TWO = """
x AS (SELECT CAST(user_id AS VARCHAR) AS page_id, ts, event_id, event_type FROM events),
a AS (SELECT page_id, arg_max(event_type, (ts, event_id)) AS t1, max(ts) AS m1 FROM x WHERE ts < TIMESTAMP '2024-01-15' GROUP BY page_id),
b AS (SELECT page_id, arg_max(event_type, (ts, event_id)) AS t2, max(ts) AS m2 FROM x GROUP BY page_id),
w AS (SELECT page_id, t1, m1, t2, m2, coalesce(m2 > m1, true) OR t1 = 'error' AS again FROM b LEFT JOIN a USING (page_id))
"""


@query(
    f"WITH {_TWO} SELECT page_id, CASE WHEN (again AND t2 = 'error') OR (NOT again AND t1 = 'error') THEN 'error' ELSE 'done' END AS status, "
    "CAST(coalesce(t1 = 'error', false) AS INTEGER) + CAST(again AND t2 = 'error' AS INTEGER) AS retry_count, CASE WHEN again AND t2 = 'error' THEN 'bad event' END AS error_message FROM w"
)
def incremental_log(spark, sf):
    """The log after two batches: pages that fail are logged alone, with their retries."""
    return _two_batches(spark, sf).log().select("page_id", "status", "retry_count", "error_message")


@query(
    f"WITH {_TWO}, p AS (SELECT page_id, CASE WHEN again AND t2 <> 'error' THEN t2 WHEN t1 <> 'error' THEN t1 END AS title FROM w), "
    "k AS (SELECT t1 AS title, strftime(min(m1), '%Y-%m-%d') AS first_seen, 1 AS n FROM a WHERE t1 <> 'error' GROUP BY t1 UNION ALL SELECT t2, strftime(min(m2), '%Y-%m-%d'), 2 FROM w WHERE again AND t2 <> 'error' GROUP BY t2) "
    "SELECT 'page_' || page_id AS _id, title, NULL AS first_seen FROM p WHERE title IS NOT NULL UNION ALL SELECT 'kind_' || title, title, arg_min(first_seen, n) FROM k GROUP BY title"
)
def incremental_nodes(spark, sf):
    """Nodes after two batches: those of the newest ingest of each page; shared ones keep the first date of the first."""
    return _two_batches(spark, sf).results("nodes").select("_id", "title", "first_seen")


@query(
    f"WITH {_TWO} SELECT 1 AS number, 'done' AS state, count(*) FILTER (t1 <> 'error') AS pages_done, count(*) FILTER (t1 = 'error') AS pages_error, 0 AS pages_skipped FROM a "
    "UNION ALL SELECT 2, 'done', count(*) FILTER (again AND t2 <> 'error'), count(*) FILTER (again AND t2 = 'error'), count(*) FILTER (NOT again) FROM w"
)
def ingest_runs(spark, sf):
    """What the registry says of the runs; a batch that comes again is no run."""
    return _two_batches(spark, sf).runs().select("number", "state", "pages_done", "pages_error", "pages_skipped")


# --- the ingest plan ----------------------------------------------------------------------------------------------


@query(
    f"WITH {_LINES}, c AS (SELECT page_id, max(r) AS n, min(ts) AS ts FROM l GROUP BY page_id), t AS ("
    "SELECT 'page_' || page_id AS _id, 'ConfPage' AS kind, 'Title: Order ' || page_id || chr(10) || 'Date: ' || strftime(ts, '%Y-%m-%d') || chr(10) || 'Order Total:' AS text FROM c "
    "UNION ALL SELECT page_id || '_table_0__row_0', 'row', 'Part: Part no | Quantity: Quantity | File: File' FROM c "
    "UNION ALL SELECT page_id || '_table_0__row_' || r, 'row', 'Part: ' || l_partkey || ' | Quantity: ' || quantity || CASE WHEN l_partkey % 3 = 0 THEN ' | File: file' ELSE '' END FROM l "
    "UNION ALL SELECT CAST(o_orderkey AS VARCHAR) || '_table_1__row_0', 'row', 'col_0: ' || o_orderpriority FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)) "
    "SELECT _id, kind, md5(text) AS text_md5, CAST(length(text) AS DOUBLE) AS vector FROM t"
)
def ingest_vectors(spark, sf):
    """All that the ingest plan makes vectors of, head rows too, with its ids; the embedder tells the length of a text."""
    pages = _order_pages(spark, sf).select("page_id", F.concat(F.lit("Order "), "page_id").alias("title"), F.col("timestamp").alias("page_date"), "html")
    found = ingest(pages, embedder=lambda texts: [[float(len(t))] for t in texts], keep=stored, with_refs=False)["vectors"]
    return found.select("_id", "kind", F.md5("text").alias("text_md5"), F.col("embedding")[0].cast("double").alias("vector"))


# --- office files: each order is a document and a workbook ---------------------------------------------------------


def _low_first(value: Column, n: int) -> Column:
    """A number as ``n`` bytes, the lowest first, as archives have them."""
    x = value.cast("long")
    turned = reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(F.shiftright(x, 8 * k).bitwiseAND(F.lit(255)), 8 * (n - 1 - k)) for k in range(n)])
    return F.unhex(F.lpad(F.hex(turned), 2 * n, "0"))


def _zipped(parts: DataFrame, names: dict[str, str], out: str) -> DataFrame:
    """``parts`` with ``out``, a zip archive of the binary columns of ``names`` (with their names in it) as they are. It is
    made by columns that stand on each other, so that checksums are made once."""
    literal = lambda b: F.unhex(F.lit(b.hex()))
    day = b"\x00\x00\x21\x00"  # the first that archives know
    facts, at, bodies, entries, length = {}, F.lit(0).cast("long"), [], [], 0
    for c, name in names.items():
        facts[f"_{c}"] = F.concat(literal(b"\x14\x00" + bytes(4) + day), _low_first(F.crc32(c), 4), _low_first(F.octet_length(c), 4), _low_first(F.octet_length(c), 4), literal(struct.pack("<2H", len(name), 0)))
        bodies += [literal(b"PK\3\4"), F.col(f"_{c}"), literal(name.encode()), F.col(c)]
        entries += [literal(b"PK\1\2\x14\x00"), F.col(f"_{c}"), literal(bytes(10)), _low_first(at, 4), literal(name.encode())]
        at, length = at + F.octet_length(c) + 30 + len(name), length + 46 + len(name)
    end = [literal(struct.pack("<4s4HL", b"PK\5\6", 0, 0, len(names), len(names), length)), _low_first(at, 4), literal(bytes(2))]
    return parts.withColumns(facts).withColumn(out, F.concat(*bodies, *entries, *end)).drop(*facts)


def _office_files(tables: DataFrame) -> DataFrame:
    """Of ``tables(page_id, head, rows)`` a document with a line of text and a workbook with a title, each with the rows
    of one table, and a file that nothing reads; all kinds in one pass, by Spark alone."""
    safe = lambda x: F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))

    def table(row: str, cell: tuple[str, str]) -> Column:
        line = lambda r: F.concat(F.lit(f"<{row}>{cell[0]}"), F.array_join(r, cell[1] + cell[0]), F.lit(f"{cell[1]}</{row}>"))
        return F.array_join(F.transform("rows", line), "")

    paragraph, end = "<w:p><w:r><w:t>", "</w:t></w:r></w:p>"
    document = F.concat(F.lit(f'<w:document xmlns:w="u"><w:body>{paragraph}'), F.col("head"), F.lit(f"{end}<w:tbl>"), table("w:tr", (f"<w:tc>{paragraph}", f"{end}</w:tc>")), F.lit("</w:tbl></w:body></w:document>"))
    book = F.concat(F.lit('<workbook><sheets><sheet name="'), F.col("head"), F.lit('"/></sheets></workbook>'))
    sheet = F.concat(F.lit("<worksheet><sheetData>"), table("row", ('<c t="inlineStr"><is><t>', "</t></is></c>")), F.lit("</sheetData></worksheet>"))
    escaped = tables.select("page_id", safe(F.col("head")).alias("head"), F.transform("rows", lambda r: F.transform(r, safe)).alias("rows"))
    parts = escaped.select("page_id", *(F.encode(x, "UTF-8").alias(c) for c, x in (("document", document), ("book", book), ("sheet", sheet))))
    packed = _zipped(_zipped(parts, {"document": "word/document.xml"}, "docx"), {"book": "xl/workbook.xml", "sheet": "xl/worksheets/sheet1.xml"}, "excel")
    content = {"docx": F.col("docx"), "excel": F.col("excel"), "zip": F.encode(F.lit("x"), "UTF-8")}
    each = packed.select("page_id", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), c.alias("content")) for k, c in content.items()))).alias("x"))
    return each.select("page_id", F.col("x.kind").alias("attachment_id"), F.concat(F.lit("a."), F.col("x.kind")).alias("filename"), "x.kind", "x.content")


@query(
    f"WITH {_LINES}, g AS (SELECT page_id, string_agg(l_partkey || chr(10) || quantity, chr(10) ORDER BY r) AS lines, string_agg(l_partkey || ' | ' || quantity, chr(10) ORDER BY r) AS bars, count(*) AS n FROM l GROUP BY page_id) "
    "SELECT page_id, 'docx' AS kind, md5('Order ' || page_id || chr(10) || lines) AS text_md5, n AS rows, CAST(NULL AS VARCHAR) AS error FROM g "
    "UNION ALL SELECT page_id, 'excel', md5('[Sheet: Order ' || page_id || ']' || chr(10) || bars), n, NULL FROM g "
    "UNION ALL SELECT page_id, 'zip', NULL, NULL, 'extraction_failed: no extractor for zip' FROM g"
)
def office_files(spark, sf):
    """Texts and tables of documents and workbooks made of orders, and of files that nothing reads."""
    lines = src.table(spark, sf, "lineitem").join(src.table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")
    at = F.row_number().over(src.W.partitionBy("l_orderkey").orderBy(*src.LINE_ORDER))
    rows = lines.select("l_orderkey", F.struct(at.alias("at"), F.array(F.col("l_partkey").cast("string"), F.floor("l_quantity").cast("string")).alias("row")).alias("x"))
    tables = rows.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["row"]).alias("rows"))
    named = tables.select(F.col("l_orderkey").cast("string").alias("page_id"), F.concat(F.lit("Order "), "l_orderkey").alias("head"), "rows")
    found = attach.extract_text(_office_files(named), EXTRACTORS)
    return found.select("page_id", "kind", F.md5("text").alias("text_md5"), F.when(F.size("tables") > 0, F.size(F.col("tables")[0]).cast("long")).alias("rows"), "error")
