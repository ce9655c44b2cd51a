import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import search, stored
from lattica.plans import projection as src
from lattica.plans import registry

SF = "/root/testdata/sf0.001"
VECTORS = "_id string, type string, timestamp timestamp_ntz, is_deleted boolean, embedding array<float>"


def scan_rows(df):
    """Rows that the scans of a plan put out: those of the row groups that were read."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(k).metrics().apply("numOutputRows").value() for k in range(leaves.size()))


@pytest.fixture()
def plain(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.enabled")


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(25, 32))
    m = np.vstack([centres[rng.integers(0, 25, 2000)] + 0.6 * rng.normal(size=(2000, 32)), 3 * centres, centres[:3]]).astype(np.float32)
    rows = [(f"v{k:04}", "Event" if k % 2 else "Row", None, k % 50 == 3, v.tolist()) for k, v in enumerate(m)]
    odd = [None, [], [0.0] * 32, [float("nan")] * 32, [1.0] * 31, [None] * 32]
    rows += [(f"x{k}", "Event", None, False, v) for k, v in enumerate(odd)]
    items = spark.createDataFrame(rows, VECTORS)
    path = f"{tmp_path_factory.mktemp('vectors')}/index"
    stored.write_vectors(items.repartition(3), path, 32, cells=20)
    return items, m, path


def test_indexed_search_is_exact(spark, vectors):
    items, m, path = vectors
    rng = np.random.default_rng(2)
    for q in [m[5], m[2000], rng.normal(size=32), -m[7], np.zeros(32)]:
        for limit, kinds in ((20, None), (7, ["Event"]), (3000, None)):
            want = [(r._id, round(r.semantic, 9)) for r in search.vector_search(items, q.tolist(), limit, kinds).collect()]
            got = [(r._id, round(r.semantic, 9)) for r in stored.search_vectors(spark, path, q.tolist(), limit, kinds=kinds).collect()]
            assert got == want
    assert spark.read.parquet(f"{path}/lists").count() == items.count()  # all are stored, those that cannot be found too


def test_probes_have_recall_and_prune(spark, vectors):
    items, m, path = vectors
    rng = np.random.default_rng(3)
    found = total = 0
    for k in rng.integers(0, 2000, 12):
        want = {r._id for r in search.vector_search(items, m[k].tolist(), 20).collect()}
        few = stored.search_vectors(spark, path, m[k].tolist(), 20, probes=6)
        found += len(want & {r._id for r in few.collect()})
        total += len(want)
    assert found >= 0.95 * total
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell#" in plan and plan.split("PartitionFilters: [")[1].split("]")[0].count(",") >= 5


def test_index_of_nothing(spark, tmp_path):
    stored.write_vectors(spark.createDataFrame([("a", "Row", None, False, None)], VECTORS), f"{tmp_path}/i", 4)
    assert stored.search_vectors(spark, f"{tmp_path}/i", [1.0, 0.0, 0.0, 0.0], 5).count() == 0


def test_index_where_a_task_has_no_usable_vector(spark, tmp_path):
    m = np.random.default_rng(4).normal(size=(9, 4)).astype(np.float32)
    some = spark.createDataFrame([(f"v{k}", "Row", None, False, v.tolist()) for k, v in enumerate(m)], VECTORS)
    zero = spark.createDataFrame([(f"z{k}", "Row", None, False, [0.0] * 4) for k in range(3)], VECTORS)
    for name, items in (("none", some.repartition(16)), ("unusable", some.repartition(1).union(zero.repartition(1)))):
        stored.write_vectors(items, f"{tmp_path}/{name}", 4)
        want = [r._id for r in search.vector_search(items, m[2].tolist(), 9).collect()]
        assert [r._id for r in stored.search_vectors(spark, f"{tmp_path}/{name}", m[2].tolist(), 9).collect()] == want and len(want) == 9
        assert spark.read.parquet(f"{tmp_path}/{name}/lists").count() == items.count()


def test_search_by_a_vector_of_another_length(spark, vectors):
    items, _, path = vectors
    for q, ids in (([1.0] * 31, ["x4"]), ([1.0] * 7, [])):
        assert [r._id for r in search.vector_search(items, q, 9).collect()] == ids
        assert [r._id for r in stored.search_vectors(spark, path, q, 9).collect()] == ids


@pytest.mark.parametrize("directed", [True, False])
def test_many_starts_at_once(spark, tmp_path, directed):
    rng = random.Random(directed)
    edges = [(f"n{rng.randrange(60)}", rng.choice(["r", "s", "no"]), f"n{rng.randrange(70)}") for _ in range(150)] + [("n1", "r", "n1"), ("n2", "r", "n3"), ("n2", "r", "n3")]
    nodes = spark.createDataFrame([(f"n{k}", k % 9 == 0) for k in range(65)], "_id string, is_deleted boolean")
    df = spark.createDataFrame(edges, "source_id string, relation string, target_id string")
    stored.write_edges(df, f"{tmp_path}/edges", 4)
    starts = [f"n{k}" for k in range(70)] + ["none", "n3"]  # more than one pass holds
    got = {(r.start, r._id): r.level for r in stored.traverse_many(nodes, f"{tmp_path}/edges", starts, ["r", "s"], 3, directed, 4).collect()}
    step = {}
    for a, r, b in edges:
        if r != "no":
            step.setdefault(a, set()).add(b)
            if not directed:
                step.setdefault(b, set()).add(a)
    want = {}
    for start in starts:
        level, reached, front = 0, {start}, {start}
        while front and level < 3:
            level += 1
            front = {b for a in front for b in step.get(a, ())} - reached
            reached |= front
            want |= {(start, b): level for b in front if int(b[1:]) < 65 and int(b[1:]) % 9}
    assert got == want and len(want) > 200
    one = {r._id: r.level for r in search.traverse(nodes, df, "n5", ["r", "s"], 3, directed).collect()}
    assert one == {b: level for (a, b), level in got.items() if a == "n5"}


@pytest.mark.parametrize("directed", [True, False])
def test_edges_stored_once_each(spark, tmp_path, directed):
    """Without buckets nothing is dealt and no edge is written twice; a search finds the same."""
    rng = random.Random(directed)
    edges = [(f"n{rng.randrange(60)}", rng.choice(["r", "s", "no"]), f"n{rng.randrange(70)}") for _ in range(150)] + [("n1", "r", "n1"), ("n2", "r", "n3"), ("n2", "r", "n3")]
    nodes = spark.createDataFrame([(f"n{k}", k % 9 == 0) for k in range(65)], "_id string, is_deleted boolean")
    df = spark.createDataFrame(edges, "source_id string, relation string, target_id string")
    stored.write_edges(df, f"{tmp_path}/dealt", 4)
    stored.write_edges(df, f"{tmp_path}/once", 0)
    assert spark.read.parquet(f"{tmp_path}/once").count() == len(edges)
    starts = [f"n{k}" for k in range(0, 70, 3)] + ["none"]
    found = [sorted(map(tuple, stored.traverse_many(nodes, f"{tmp_path}/{name}", starts, ["r", "s"], 2, directed, buckets).collect())) for name, buckets in (("dealt", 4), ("once", 0))]
    assert found[0] == found[1] and len(found[0]) > 20


def test_a_search_by_one_relation_stores_its_edges_alone(spark, monkeypatch):
    """``bfs_many`` walks along HAS_EVENT: three edges an event are stored, not five, and not both ways."""
    written, write = [], stored.write_edges
    monkeypatch.setattr(stored, "write_edges", lambda edges, path, *more: (written.append(path), write(edges, path, *more)))
    registry.queries()["bfs_many"](spark, SF)
    assert spark.read.parquet(written[0]).count() == 3 * src.events(spark, SF).count()


def test_a_look_up_reads_few_row_groups(spark, tmp_path, plain):
    """Over 60,000 events of 3,000 ids, one of which has a third of all."""
    ids = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("i"), F.pmod(F.xxhash64("id"), F.lit(3000))))
    events = spark.range(60_000).select(
        F.concat(F.lit("e"), "id").alias("_id"), F.array(ids, F.lit(None).cast("string")).alias("app_ids"), F.lit("risk").alias("event_type"), F.md5(F.col("id").cast("string")).alias("description"),
        F.lit(False).alias("is_deleted"), (F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'") + F.make_dt_interval((F.col("id") % 1000).cast("int"))).alias("timestamp"),
    )
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        stored.write_timeline(events, f"{tmp_path}/t", "app_ids", row_group=64 << 10, ids=3000)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    for value, most in (("i77", 0.1), ("hot", 0.5), ("none", 0.1)):
        want = [r._id for r in search.events_of(events, "app_ids", value, 20).collect()]
        got = stored.stored_events_of(spark, f"{tmp_path}/t", value, 20)
        assert [r._id for r in got.collect()] == want
        assert scan_rows(got) < most * 120_000
    late = stored.stored_events_of(spark, f"{tmp_path}/t", "hot", 5, start=F.expr("TIMESTAMP_NTZ'2026-09-01 00:00:00'"))
    assert [r._id for r in late.collect()] == [r._id for r in search.events_of(events, "app_ids", "hot", 5, start=F.expr("TIMESTAMP_NTZ'2026-09-01 00:00:00'")).collect()]
    assert scan_rows(late) < 0.1 * 120_000
