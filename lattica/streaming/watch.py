"""Incremental refresh: page snapshots as a stream, upserted batch by batch into tables that readers see whole.

Layout. Each table is a folder of commits, each split into buckets by the hash of its key. A manifest, one small JSON
file a commit, lists for each table and bucket the folders that make it up: a snapshot and the deltas since. It is
written last, under a new name, so a run that ends between two writes leaves the old state; readers follow the newest
manifest. A batch reads the buckets of its own pages; where a bucket has more than ``DELTAS`` deltas it is rewritten
as one snapshot. So what a batch reads does not grow with the number of batches before it.

Rows. What is made of a page counts where its commit is the page's newest; a page that is ingested again thereby
deletes what it owned. Rows with an ``_id`` stay, flagged, as the newest of their id; others go when their bucket is
compacted. Rows of no page (applications, projects, schemas) are shared: each id keeps the first ``first_seen`` that it
was given and the newest of everything else, and is never deleted.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lattica.operators.store import latest_per_key, needs_upsert, with_log
from lattica.session import checkpointed

LOG_SCHEMA = "page_id string, status string, source_modified timestamp_ntz, retry_count int, error_message string"
#: Buckets of a new store (some per GB that it will hold), and deltas after which a bucket is compacted.
BUCKETS, DELTAS = 64, 8
#: Manifests that are kept; readers of older ones are expected to have ended.
KEPT = 16
#: Tables whose rows belong to no page, and their key.
SHARED = {"shared_nodes": "_id", "added_schemas": "schema_id"}

#: What is made of pages: tables by name, and under ``failed`` the pages ``(page_id, error)`` that nothing was made of.
Work = Callable[[DataFrame], dict[str, DataFrame]]


class PageTables:
    """Tables of pages, of their ingestion log and of what was made of them."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS) -> None:
        self.spark, self.root, self._new_buckets = spark, root.rstrip("/"), buckets

    # --- manifest -------------------------------------------------------------------------------------------------

    def _fs(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def _names(self, path: str) -> list[str]:
        fs, target = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(target)) if fs.exists(target) else []

    def _put(self, path: str, text: str, replace: bool = False) -> None:
        """A file under its name only when it is whole."""
        fs, target = self._fs(path)
        _, draft = self._fs(f"{path}.{uuid.uuid4().hex}.tmp")
        out = fs.create(draft, True)
        out.write(bytearray(text.encode()))
        out.close()
        if replace:
            fs.delete(target, False)
        elif fs.exists(target):
            fs.delete(draft, False)
            raise RuntimeError(f"another run has written {path}")
        if not fs.rename(draft, target):
            raise RuntimeError(f"another run has written {path}")

    def manifest(self) -> dict:
        """The newest state: its commit, the last batch of each source, and the folders of each table's buckets."""
        names = [n for n in self._names(f"{self.root}/_manifest") if n.endswith(".json")]
        if not names:
            return {"commit": 0, "buckets": self._new_buckets, "batches": {}, "tables": {}, "schemas": {}}
        return json.loads(self.spark.read.text(f"{self.root}/_manifest/{names[-1]}", wholetext=True).first()[0])

    def _publish(self, state: dict) -> None:
        self._put(f"{self.root}/_manifest/{state['commit']:012d}.json", json.dumps(state))
        for name in [n for n in self._names(f"{self.root}/_manifest") if n.endswith(".json")][:-KEPT]:
            fs, old = self._fs(f"{self.root}/_manifest/{name}")
            fs.delete(old, False)

    # --- tables ---------------------------------------------------------------------------------------------------

    def _bucket(self, key: str, state: dict):
        return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(state["buckets"])).cast("int")

    def _write(self, state: dict, name: str, rows: DataFrame, snapshot: bool = False) -> None:
        """Rows as folders of the commit that is being made, entered in its manifest."""
        key = SHARED.get(name, "page_id")
        if not snapshot:
            rows = rows.withColumn("commit", F.lit(state["commit"]).cast("long"))
        folder = f"{name}/commit={state['commit']}-{uuid.uuid4().hex[:8]}"
        out = rows.withColumn("_bucket", self._bucket(key, state))
        out.hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{self.root}/{folder}")
        known = StructType.fromJson(json.loads(state["schemas"][name])) if name in state["schemas"] else StructType()
        fields = {f.name: f for f in [*known.fields, *rows.schema.fields]}
        state["schemas"][name] = json.dumps(StructType([f.__class__(f.name, f.dataType, True) for f in fields.values()]).jsonValue())
        entries = state["tables"].setdefault(name, {})
        for part in self._names(f"{self.root}/{folder}"):
            if part.startswith("_bucket="):
                bucket = part.removeprefix("_bucket=")
                entries[bucket] = [*([] if snapshot else entries.get(bucket, [])), f"{folder}/{part}"]

    def read(self, name: str, buckets: list[int] | None = None, state: dict | None = None, schema: str | None = None) -> DataFrame:
        """All stored rows of a table, with the ``commit`` that wrote them; of some buckets only, if these are given."""
        state = state or self.manifest()
        entries = state["tables"].get(name, {})
        paths = [f"{self.root}/{p}" for b, folders in entries.items() if buckets is None or int(b) in buckets for p in folders]
        kind = StructType.fromJson(json.loads(state["schemas"][name])) if name in state["schemas"] else None
        if not paths:
            return self.spark.createDataFrame([], kind if kind is not None else f"{schema or 'page_id string'}, commit long")
        return self.spark.read.schema(kind).parquet(*paths)

    def _touched(self, keys: DataFrame, key: str, state: dict) -> list[int]:
        return [r[0] for r in keys.select(self._bucket(key, state)).distinct().collect()]  # as many as buckets at most

    def log(self, buckets: list[int] | None = None, state: dict | None = None) -> DataFrame:
        return latest_per_key(self.read("log", buckets, state, LOG_SCHEMA), ["page_id"], "commit")

    def pages(self, schema: str | None = None) -> DataFrame:
        return latest_per_key(self.read("pages", schema=schema), ["page_id"], "commit")

    def _newest(self, buckets: list[int] | None = None, state: dict | None = None) -> DataFrame:
        return self.read("pages", buckets, state).groupBy("page_id").agg(F.max("commit").alias("_newest"))

    def shared(self, name: str, buckets: list[int] | None = None, state: dict | None = None) -> DataFrame:
        """Rows of no page, one an id."""
        key = SHARED[name]
        rows = self.read(name, buckets, state, f"{key} string")
        rest = [c for c in rows.columns if c not in (key, "first_seen", "commit")]
        aggs = [F.max_by(F.struct(F.lit(0).alias("_"), *rest), "commit").alias("x"), F.max("commit").alias("commit")]
        if "first_seen" in rows.columns:
            aggs.append(F.min_by("first_seen", F.when(F.col("first_seen").isNotNull(), F.col("commit"))).alias("first_seen"))
        return rows.groupBy(key).agg(*aggs).select(*(F.col(f"x.{c}").alias(c) if c in rest else F.col(c) for c in rows.columns))

    def results(self, name: str, with_deleted: bool = False) -> DataFrame:
        """Rows that the newest ingest of their page made, and those of no page; with ``with_deleted`` also those of
        ingests before it, as far as they are kept, and ``is_deleted`` tells them apart."""
        state = self.manifest()
        if name in SHARED:
            return self.shared(name, state=state).drop("commit")
        rows = self.read(name, state=state)
        if "_id" in rows.columns:
            rows = latest_per_key(rows, ["_id"], "commit")
        joined = rows.join(self._newest(state=state), "page_id").select(*rows.columns, "_newest")
        stale = F.col("commit") < F.col("_newest")
        out = joined.withColumn("is_deleted", stale) if with_deleted else joined.where(~stale)
        out = out.drop("_newest", "commit")
        if name == "nodes":
            out = out.unionByName(self.shared("shared_nodes", state=state).drop("commit"), allowMissingColumns=True)
        return out

    # --- batches --------------------------------------------------------------------------------------------------

    def upsert(self, batch: DataFrame, work: Work | None = None, review_undated: bool = False, source: str | None = None, number: int = 0) -> None:
        """Ingest the pages of a batch that need it, in one commit. A batch of a ``source`` whose ``number`` was
        committed is passed over. Pages that ``work`` names as failed are logged as errors, each with one retry more;
        where ``work`` itself raises all of the batch are. With ``review_undated`` pages without ``page_date`` are
        logged for review and not ingested."""
        state = self.manifest()
        if source is not None and state["batches"].get(source, 0) >= number:
            return
        run = self._begin(source, number)
        try:
            counts = self._ingest(batch, work, review_undated, source, number, state)
        except Exception as e:
            self._end(run, "failed", error=str(e)[:500])
            raise
        self._end(run, "done", **{f"pages_{k}": v for k, v in counts.items()})
        self.compact()

    def _ingest(self, batch: DataFrame, work: Work | None, review_undated: bool, source: str | None, number: int, state: dict) -> dict:
        state = json.loads(json.dumps(state)) | {"commit": state["commit"] + 1}
        newest = checkpointed(latest_per_key(batch, ["page_id"], "last_modified"))
        before = checkpointed(self.log(self._touched(newest, "page_id", state), state))
        todo = checkpointed(with_log(newest, before).where(needs_upsert()).select(newest.columns))
        undated = F.col("page_date").isNull() if review_undated else F.lit(False)
        good = todo.where(~undated)
        failed = self.spark.createDataFrame([], "page_id string, error string")
        if work is not None:
            try:
                made = work(good)
                failed = checkpointed(made.pop("failed", failed).select("page_id", "error"))
                drafts = json.loads(json.dumps(state))
                for name, rows in made.items():
                    if name == "nodes":
                        self._write(drafts, "shared_nodes", rows.where("page_id IS NULL"))
                        rows = rows.where("page_id IS NOT NULL")
                    self._write(drafts, name, rows)
                state = drafts
            except Exception as e:  # noqa: BLE001  the log keeps it; the stream goes on
                failed = good.select("page_id", F.lit(str(e)[:500]).alias("error"))
        status = F.when(undated, "needs_review").when(F.col("error").isNotNull(), "error").otherwise("done")
        marked = todo.join(failed.dropDuplicates(["page_id"]), "page_id", "left").withColumn("status", status)
        self._write(state, "pages", marked.where("status = 'done'").select(todo.columns))
        count = F.coalesce("_retries", F.lit(0)) + F.when(F.col("status") == "error", 1).otherwise(0)
        log = marked.join(before.select("page_id", F.col("retry_count").alias("_retries")), "page_id", "left").select(
            "page_id", "status", F.col("last_modified").alias("source_modified"), count.cast("int").alias("retry_count"),
            F.when(F.col("status") == "needs_review", "no date").when(F.col("status") == "error", F.col("error")).alias("error_message"),
        )
        seen = Observation()
        names = ("done", "error", "needs_review")
        self._write(state, "log", log.observe(seen, *(F.count_if(F.col("status") == s).alias(s) for s in names)))
        counts = {s: seen.get[s] for s in names}
        if source is not None:
            state["batches"][source] = number
        self._publish(state)
        return counts | {"skipped": newest.count() - sum(counts.values())}

    def compact(self, most: int = DELTAS) -> None:
        """Rewrite the buckets that have more than ``most`` deltas, each as one snapshot, in a commit of its own."""
        before = self.manifest()
        state = json.loads(json.dumps(before)) | {"commit": before["commit"] + 1}
        for name, entries in before["tables"].items():
            full = [int(b) for b, folders in entries.items() if len(folders) > most + 1]
            if not full:
                continue
            if name in SHARED:
                rows = self.shared(name, full, before)
            elif name in ("log", "pages"):
                rows = latest_per_key(self.read(name, full, before), ["page_id"], "commit")
            else:
                rows = self.read(name, full, before)
                if "_id" in rows.columns:
                    rows = latest_per_key(rows, ["_id"], "commit")
                else:
                    newest = self._newest(full, before)
                    rows = rows.join(newest, "page_id").where(F.col("commit") >= F.col("_newest")).select(rows.columns)
            for b in full:
                state["tables"][name][str(b)] = []
            self._write(state, name, rows, snapshot=True)
        if state["tables"] != before["tables"]:
            self._publish(state)

    def vacuum(self) -> int:
        """Delete the folders that no kept manifest names; returns how many. Not to be run beside a writer."""
        names = [n for n in self._names(f"{self.root}/_manifest") if n.endswith(".json")]
        states = [json.loads(r[0]) for n in names for r in [self.spark.read.text(f"{self.root}/_manifest/{n}", wholetext=True).first()]]
        used = {p.rsplit("/", 1)[0] for s in states for t in s["tables"].values() for folders in t.values() for p in folders}
        gone = 0
        for name in {n for s in states for n in s["tables"]}:
            for commit in self._names(f"{self.root}/{name}"):
                if f"{name}/{commit}" not in used:
                    fs, target = self._fs(f"{self.root}/{name}/{commit}")
                    gone += bool(fs.delete(target, True))
        return gone

    # --- runs -----------------------------------------------------------------------------------------------------

    def _begin(self, source: str | None, number: int) -> dict:
        run = {"run_id": f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}", "source": source or "", "number": number, "state": "running", "started": datetime.now(timezone.utc).isoformat()}
        self._put(f"{self.root}/_runs/{run['run_id']}.json", json.dumps(run))
        return run

    def _end(self, run: dict, state: str, **more) -> None:
        self._put(f"{self.root}/_runs/{run['run_id']}.json", json.dumps(run | {"state": state, "ended": datetime.now(timezone.utc).isoformat()} | more), replace=True)

    def runs(self) -> DataFrame:
        """Runs and their state (``running``, ``done`` or ``failed``), with how many pages were done, failed, put up
        for review and passed over. A run that is ``running`` and has no end was killed, or still runs."""
        schema = "run_id string, source string, number long, state string, started string, ended string, pages_done long, pages_error long, pages_needs_review long, pages_skipped long, error string"
        if not self._names(f"{self.root}/_runs"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("pathGlobFilter", "*.json").json(f"{self.root}/_runs")


def watch(spark: SparkSession, source: str, schema: str, tables: PageTables, checkpoint: str, every: str | None = None, work: Work | None = None) -> StreamingQuery:
    """Follow a folder of page snapshots; without ``every`` all that is there is taken once."""
    stream = spark.readStream.schema(schema).parquet(source)
    writer = stream.writeStream.foreachBatch(lambda df, n: tables.upsert(df, work, source=checkpoint, number=n + 1)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
