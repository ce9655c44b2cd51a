"""What tasks of large joins hold: small rows, few sorts."""

import re

import pytest
from pyspark.sql import functions as F

from lattica.operators import attach, extract, store, stored


@pytest.fixture()
def dealt(spark):
    """Plans as of tables that are too large to be sent, before they are adapted."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield lambda df: df._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.adaptive.enabled")


def test_few_visits_are_sent_to_nodes_and_edges(spark, dealt, tmp_path):
    nodes = spark.createDataFrame([(f"n{k}", False) for k in range(9)], "_id string, is_deleted boolean")
    edges = spark.createDataFrame([(f"n{k}", "r", f"n{k + 1}") for k in range(8)], "source_id string, relation string, target_id string")
    stored.write_edges(edges, f"{tmp_path}/e", 4)
    found = stored.traverse_many(nodes, f"{tmp_path}/e", ["n0", "n5"], ["r"], 2, True, 4)
    assert sorted(map(tuple, found.collect())) == [("n0", "n1", 1), ("n0", "n2", 2), ("n5", "n6", 1), ("n5", "n7", 2)]
    assert "BroadcastHashJoin" in dealt(found.select(F.col("_id"))).split("is_deleted")[0]


def test_new_edges_replace_without_a_sort(spark, dealt):
    kind = "source_id string, relation string, target_id string, page_id string"
    kept = spark.createDataFrame([("a", "r", "b", "1"), ("a", "r", "c", None), ("a", "r", "c", None)], kind)
    new = spark.createDataFrame([("a", "r", "b", "2"), ("d", "r", "e", "2")], kind)
    out = store.replace_edges(kept, new)
    assert out.columns == kept.columns
    assert sorted(map(tuple, out.collect()), key=str) == [("a", "r", "b", "2"), ("a", "r", "c", None), ("d", "r", "e", "2")]
    plan = dealt(out.groupBy("source_id").count())
    assert "Window" not in plan and "Sort" not in plan and "max_by" not in plan


def test_attachment_tables_are_sorted_once(spark, dealt):
    own = spark.createDataFrame([("p", 0), ("p", 4), ("q", 1)], "page_id string, table_index int")
    found = spark.createDataFrame([("p", "b", 0), ("p", "a", 1), ("p", "a", 0), ("r", "c", 0)], "page_id string, attachment_id string, table_index int")
    out = attach.renumbered_tables(own, found).where("attachment_id IS NOT NULL")
    assert sorted((r.page_id, r.attachment_id, r.old_index, r.table_index) for r in out.collect()) == [("p", "a", 0, 5), ("p", "a", 1, 6), ("p", "b", 0, 7), ("r", "c", 0, 0)]
    assert len(re.findall(r"Sort \[page_id", dealt(out))) == 2  # of the attachments' tables, and of the pages they join


def test_has_cancelled_deals_no_chunks(spark, dealt):
    chunks = spark.createDataFrame([("a", "normal"), ("a", None), ("b", "cancelled"), ("n", None)], "page_id string, style string")
    cell = "page_id string, table_index int, chunks array<struct<content: string, style: string>>"
    rows = [("a", 0, [("x", None), ("y", "cancelled")]), ("c", 0, [("x", "normal"), ("y", None)]), ("c", 1, [("z", "cancelled")]), ("d", 0, []), ("e", 0, [("x", None)]), ("f", 0, None)]
    tables = spark.createDataFrame([(p, 0, None) for p in "acdef"] + [("c", 1, 0)], "page_id string, table_index int, parent_table int")
    found = extract.has_cancelled(chunks, spark.createDataFrame(rows, cell), tables)
    assert {r.page_id: r.has_cancelled for r in found.collect()} == {"a": True, "b": True, "c": False, "e": None, "n": None}
    assert "Generate" not in dealt(found)  # chunks are reduced where they stand, not dealt one by one
