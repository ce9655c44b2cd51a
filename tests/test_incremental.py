import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lattica import cli
from lattica.operators import parse
from lattica.plans.ingest import ingest
from lattica.streaming import watch
from lattica.streaming.watch import PageTables

DAY = lambda d: datetime(2024, 1, d)
CHUNKS = "page_id string, _id string, text string"


def page(ident, html, modified, date=None):
    return ident, "t", "S", html, modified, date


def frame(spark, rows):
    return spark.createDataFrame(rows, cli.PAGE_SCHEMA)


def light(pages):
    """Chunks and nodes of pages without the whole ingest plan; an id is what follows the word id."""
    text = F.regexp_extract("html", "<p>(.*)</p>", 1)
    ids = pages.select("page_id", F.regexp_extract("html", r"id (\d+)", 1).alias("raw_value")).where("raw_value <> ''")
    return {"chunks": pages.select("page_id", text.alias("content")), "ids": ids, "nodes": pages.selectExpr("page_id", "concat('page_', page_id) AS _id", "'' AS first_seen")}


def texts(tables, *more):
    return sorted((r.page_id, r.content, *(r[m] for m in more)) for r in tables.results("chunks", bool(more)).collect())


def test_results_of_a_changed_page(spark, tmp_path):
    tables = PageTables(spark, f"{tmp_path}/out", buckets=4)
    work = light
    tables.upsert(frame(spark, [page("a", "<p>id 123456789</p>", DAY(1)), page("b", "<p>b</p>", DAY(1))]), work)
    assert tables.results("ids").count() == 1
    two = frame(spark, [page("a", "<p>new</p>", DAY(2)), page("b", "<p>b</p>", DAY(1))])
    tables.upsert(two, work, source="s", number=1)
    tables.upsert(two.withColumn("html", two.title), work, source="s", number=1)  # a batch that was committed is passed over
    assert texts(tables) == [("a", "new"), ("b", "b")] and tables.results("ids").count() == 0
    assert texts(tables, "is_deleted") == [("a", "id 123456789", True), ("a", "new", False), ("b", "b", False)]
    assert {r._id for r in tables.results("nodes").collect()} == {"page_a", "page_b"}

    def down(pages):
        raise ValueError("down")

    for day in (3, 4):
        tables.upsert(frame(spark, [page("c", "x", DAY(day))]), down)
    got = {r.page_id: (r.status, r.retry_count, r.error_message) for r in tables.log().collect()}
    assert got["c"] == ("error", 2, "down") and got["a"] == ("done", 0, None)
    tables.upsert(frame(spark, [page("c", "<p>c</p>", DAY(4))]), work)  # tried again, for it is not done
    assert ("c", "c") in texts(tables)


def test_shared_nodes_of_two_batches(spark, tmp_path):
    """An application that pages of two batches name is one node, with the first date of the first."""
    known = f"{tmp_path}/known"
    spark.createDataFrame([("app_id", "11111111111"), ("project_id", "123456789")], "id_type string, id string").write.parquet(known)
    tables = PageTables(spark, f"{tmp_path}/out", buckets=2)
    work = cli.incremental_work(tables, cli.Inputs(known=known))
    for k, day in enumerate((5, 9)):
        tables.upsert(frame(spark, [page(f"p{k}", "<p>11111111111 and 123456789</p>", DAY(day), DAY(day))]), work)
    nodes = {r._id: r for r in tables.results("nodes").collect()}
    assert set(nodes) == {"page_p0", "page_p1", "app_11111111111", "proj_123456789"} and len(nodes) == tables.results("nodes").count()
    assert (nodes["app_11111111111"].first_seen[:10], nodes["app_11111111111"].last_seen[:10]) == ("2024-01-05", "2024-01-09")
    assert tables.results("edges").where("relation = 'REFERENCES_APP'").count() == 2
    tables.upsert(frame(spark, [page("p0", "<p>nothing</p>", DAY(20), DAY(20))]), work)
    tables.compact(0)
    assert {r._id for r in tables.results("nodes").collect()} == set(nodes) and tables.results("edges").where("relation = 'REFERENCES_APP'").count() == 1
    assert tables.results("nodes").where("_id = 'app_11111111111'").first().first_seen[:10] == "2024-01-05"


def test_bad_pages_are_logged_alone(spark, tmp_path):
    """40 bad pages of 20,000: 40 errors, and the others' rows."""
    tables = PageTables(spark, f"{tmp_path}/out", buckets=4)
    pages = spark.range(20_000).selectExpr("CAST(id AS STRING) AS page_id", "'t' AS title", "'S' AS space_key", "CAST(id AS STRING) AS html", "TIMESTAMP_NTZ'2024-01-01 00:00:00' AS last_modified", "CAST(NULL AS TIMESTAMP_NTZ) AS page_date")

    def work(batch):
        bad = batch.where("CAST(page_id AS INT) % 500 = 7").selectExpr("page_id", "concat('bad ', page_id) AS error")
        return {"chunks": batch.join(bad, "page_id", "left_anti").selectExpr("page_id", "concat('c', page_id) AS _id", "html AS text"), "failed": bad}

    tables.upsert(pages, work)
    log = {r.status: r.n for r in tables.log().groupBy("status").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    assert log == {"done": 19_960, "error": 40} and tables.results("chunks").count() == 19_960
    assert tables.log().where("status = 'error' AND error_message <> concat('bad ', page_id)").isEmpty()
    assert tables.runs().first().pages_error == 40


def test_a_page_that_cannot_be_parsed(spark):
    """It is a row with an error, no node is made of it and the batch goes on."""
    html = "<p>x</p>"
    source = spark.createDataFrame([("bad", html), ("good", html)], "page_id string, html string")

    class Walk(parse.PageWalk):
        def __init__(self, page_id, *more):
            if page_id == "bad":
                raise ValueError("unheard of")
            super().__init__(page_id, *more)

    assert parse.walked("bad", html, True, Walk)["error"] == "parse_failed: unheard of" and parse.walked("good", html, True, Walk)["error"] is None
    parsed = parse.parse_pages(source)
    broken = parsed.withColumn("error", F.when(F.col("page_id") == "bad", "parse_failed: x"))
    out = ingest(source, keep=lambda df: broken if df.columns == parsed.columns else df)
    assert [tuple(r) for r in out["failed"].collect()] == [("bad", "parse_failed: x")] and [r._id for r in out["nodes"].collect()] == ["page_good"]


def test_a_killed_run_leaves_the_old_state(spark, tmp_path, monkeypatch):
    tables = PageTables(spark, f"{tmp_path}/out", buckets=4)
    work = light
    tables.upsert(frame(spark, [page("a", "<p>a</p>", DAY(1))]), work)
    old = texts(tables)

    def killed(self, state):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(PageTables, "_publish", killed)
        with pytest.raises(KeyboardInterrupt):
            tables.upsert(frame(spark, [page("a", "<p>b</p>", DAY(2))]), work)
    assert texts(tables) == old and tables.log().count() == 1
    assert {r.state for r in tables.runs().collect()} == {"done", "running"}
    tables.upsert(frame(spark, [page("a", "<p>b</p>", DAY(2))]), work)
    assert texts(tables) == [("a", "b")]
    assert tables.vacuum() > 0 and texts(tables) == [("a", "b")]
    with pytest.raises(RuntimeError, match="another run"):
        tables._publish(tables.manifest())


def test_reads_do_not_grow_with_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(watch, "DELTAS", 3)
    tables = PageTables(spark, f"{tmp_path}/out", buckets=2)

    def work(pages):
        return {"chunks": pages.selectExpr("page_id", "concat('c', page_id) AS _id", "html AS text"), "edges": pages.selectExpr("page_id", "html AS target")}

    most = []
    for k in range(9):
        tables.upsert(frame(spark, [page("a", f"v{k}", DAY(k + 1)), page(f"p{k}", "x", DAY(1))]), work)
        tables.compact(3)
        most.append(max(len(f) for t in tables.manifest()["tables"].values() for f in t.values()))
    assert max(most) <= 4
    assert {r._id: r.text for r in tables.results("chunks").collect()} == {"ca": "v8"} | {f"cp{k}": "x" for k in range(9)}
    assert tables.results("edges").where("page_id = 'a'").count() == 1 and tables.log().count() == 10
    assert tables.read("edges").where("page_id = 'a'").count() <= 4  # what earlier ingests made is gone, but for the last few
    assert len(json.dumps(tables.manifest())) < 20_000


def test_schemas_of_earlier_batches(spark, tmp_path):
    """A schema that a batch named fits the tables of later ones."""
    spark.createDataFrame([], cli.SCHEMA_COLUMNS).write.parquet(f"{tmp_path}/schemas")

    def namer(prompt):
        sample = json.loads(prompt)["sample"]
        return json.dumps({"table_type": "t", "canonical_columns": [h.lower() for h in sample], "column_mapping": {h: h.lower() for h in sample}})

    tables = PageTables(spark, f"{tmp_path}/out", buckets=2)
    work = cli.incremental_work(tables, cli.Inputs(schemas=f"{tmp_path}/schemas", classifier=namer))
    table = lambda word: f"<table><tr><th>Acuerdo</th><th>Fecha</th></tr><tr><td>{word}</td><td>now</td></tr></table>"
    tables.upsert(frame(spark, [page("a", table("one"), DAY(1), DAY(1))]), work)
    tables.upsert(frame(spark, [page("b", table("two"), DAY(2), DAY(2)), page("c", table("three").replace("Acuerdo", "Riesgo").replace("Fecha", "Nivel"), DAY(2), DAY(2))]), work)
    routes = {r.page_id: (r.route, r.schema_id) for r in tables.results("routes").collect()}
    assert [routes[p][0] for p in "abc"] == ["new", "assigned", "new"] and routes["a"][1] == routes["b"][1] != routes["c"][1]
    assert sorted(r["values"].get("acuerdo", "-") for r in tables.results("rows").collect()) == ["-", "one", "two"]
    assert {r.schema_ord for r in tables.results("added_schemas").collect()} == {0, 1}
