import json
import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from lattica.operators import attach
from lattica.sources import service
from lattica.sources.pages import project_pages


class Wiki:
    """A stub of the service: pages of two spaces, some failures, and how often and how many at once it was asked."""

    def __init__(self):
        self.pages = [self.page(k) for k in range(23)]
        self.asked, self.fail, self.active, self.most = Counter(), Counter(), 0, 0
        self.lock = threading.Lock()
        wiki = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):
                with wiki.lock:
                    wiki.asked[self.path] += 1
                    wiki.active += 1
                    wiki.most = max(wiki.most, wiki.active)
                    fails = wiki.fail[self.path.partition("?")[0]] > 0
                    wiki.fail[self.path.partition("?")[0]] -= fails
                try:
                    code, body = (503, b"") if fails else wiki.answer(urlparse(self.path))
                    self.send_response(code)
                    self.end_headers()
                    self.wfile.write(body)
                except OSError:
                    pass
                finally:
                    with wiki.lock:
                        wiki.active -= 1

            def log_message(self, *args):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.url = f"http://127.0.0.1:{self.server.server_port}"
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    def page(self, k, html=None):
        return {"id": k, "title": f"Minutes 2024-01-{k % 28 + 1:02}", "space": {"key": "S" if k % 4 else "T"}, "body": {"view": {"value": html or f"<p>{k}</p>"}}, "version": {"when": "2024-02-01T00:00:00.000Z"}}

    def answer(self, url):
        parts, query = url.path.strip("/").split("/"), {k: v[0] for k, v in parse_qs(url.query).items()}
        if parts[0] == "validate":
            if query["id"] == "hangs":
                time.sleep(3)
            time.sleep(0.05)
            return (200 if query["id"].startswith("1") else 404), b"{}"
        if parts[0] == "file":
            return (200, b"x" * int(parts[1])) if parts[1].isdecimal() else (404, b"")
        if parts[-1] == "attachment":
            n = int(parts[1]) % 3
            return 200, json.dumps({"results": [{"id": f"a{i}", "title": f"f{i}.docx", "_links": {"download": f"/file/{i}"}, "extensions": {"fileSize": i}} for i in range(n)]}).encode()
        if len(parts) == 2:
            found = [p for p in self.pages if str(p["id"]) == parts[1]]
            return (200, json.dumps(found[0]).encode()) if found else (404, b"")
        own = [p for p in self.pages if query.get("spaceKey", "") in ("", p["space"]["key"])]
        start, limit = int(query["start"]), int(query["limit"])
        return 200, json.dumps({"results": own[start : start + limit]}).encode()


@pytest.fixture(scope="module")
def wiki():
    found = Wiki()
    yield found
    found.server.shutdown()


@pytest.fixture()
def pages(spark, wiki):
    spark.dataSource.register(service.PageService)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    wiki.asked.clear()
    wiki.fail.clear()
    return lambda **options: spark.read.format("page_service").options(url=wiki.url, **options).load()


@pytest.mark.parametrize("limit,parts", [(5, 3), (23, 2), (1, 4), (100, 8)])
def test_all_pages_are_read_once(pages, wiki, limit, parts):
    got = project_pages(pages(limit=limit, parts=parts)).collect()
    assert sorted(int(r.page_id) for r in got) == list(range(23)) and {str(r.page_date)[:7] for r in got} == {"2024-01"}
    # each answer once, and one short or empty answer to end each partition
    assert set(wiki.asked.values()) == {1} and sum(wiki.asked.values()) <= 23 // limit + 1 + parts


def test_requests_that_fail_are_tried_again(pages, wiki):
    wiki.fail["/content"] = 2
    assert pages(limit=10, parts=1).count() == 23 and max(wiki.asked.values()) == 3
    wiki.fail["/content"] = 99
    with pytest.raises(Exception, match="503"):
        pages(limit=10, parts=1, tries=2).count()


def test_filters_are_pushed_down(pages, wiki):
    assert {r.page_id for r in pages(limit=5).where("page_id IN ('3', '9', 'none')").collect()} == {"3", "9"}
    assert set(wiki.asked) == {"/content/3", "/content/9", "/content/none"}
    wiki.asked.clear()
    assert {int(r.page_id) % 4 for r in pages(limit=5).where("space_key = 'T'").collect()} == {0}
    assert all("spaceKey=T" in path for path in wiki.asked)
    assert pages(space="S").where("page_id = '4'").count() == 0 and pages(space="S").count() == 17


def test_command_line_reads_a_service(spark, wiki, tmp_path):
    from lattica import cli

    wiki.pages[5] = wiki.page(5, "<p>ids 11111111111 and 99999999999</p>")
    given = cli.Inputs(validation=wiki.url)
    cli.run_batch(spark, cli.read_pages(spark, wiki.url, "S"), f"{tmp_path}/out", "S", "2024-01-05", "2024-01-09", None, given)
    ids = spark.read.parquet(f"{tmp_path}/out/ids").collect()
    assert {(r.page_id, r.raw_value, r.is_valid) for r in ids} == {("5", "11111111111", True), ("5", "99999999999", False)}
    assert {r.page_id for r in spark.read.parquet(f"{tmp_path}/out/chunks").collect()} == {"5", "6", "7"}
    assert {r._id for r in spark.read.parquet(f"{tmp_path}/out/nodes").collect()} == {"page_5", "page_6", "page_7", "app_11111111111"}


def test_a_stream_polls(spark, pages, wiki, tmp_path):
    from lattica.streaming.watch import PageTables

    tables = PageTables(spark, f"{tmp_path}/out", buckets=2)
    changed = threading.Event()

    def take(batch, n):
        if n == 1:
            wiki.pages[3] = wiki.page(3, "<p>new</p>") | {"version": {"when": "2024-03-01T00:00:00.000Z"}}
            wiki.pages.append(wiki.page(40))
        if n < 3:
            tables.upsert(project_pages(batch), source="poll", number=n + 1)
        else:
            changed.set()

    stream = spark.readStream.format("page_service").options(url=wiki.url, limit=5, parts=2).load()
    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{tmp_path}/check").trigger(processingTime="1 second").start()
    try:
        assert changed.wait(120)
    finally:
        query.stop()
    got = {r.page_id: r.html for r in tables.pages().collect()}
    assert len(got) == 24 and got["3"] == "<p>new</p>" and tables.read("pages").count() == 25  # unchanged pages were not taken again
    wiki.pages.pop()


def test_attachments_and_files(spark, wiki):
    pages = spark.createDataFrame([(str(k),) for k in (3, 4, 5)], "page_id string")
    listed = service.service_attachments(pages, wiki.url, parts=2)
    rows = attach.list_attachments(listed, wiki.url).collect()
    assert sorted((r.page_id, r.attachment_id, r.media_type, r.size) for r in rows) == [("4", "a0", "application/octet-stream", 0), ("5", "a0", "application/octet-stream", 0), ("5", "a1", "application/octet-stream", 1)]
    files = spark.createDataFrame([(1, f"{wiki.url}/file/7"), (2, f"{wiki.url}/file/none"), (3, None), (4, f"{wiki.url}/file/99999")], "n int, fetch_url string")
    got = {r.n: (r.content and len(r.content), r.error) for r in service.download(files, most=1000).collect()}
    assert got[1] == (7, None) and got[3] == (None, "download_failed: no address")
    assert "404" in got[2][1] and "more than 1000 bytes" in got[4][1]


def test_validation(spark, wiki):
    rows = [(f"p{k}", "app_id", v) for k, v in enumerate(["1a", "2b", "hangs", "1a", "1a", *(f"1{k}" for k in range(30))])]
    df = spark.createDataFrame(rows, "page_id string, id_type string, raw_value string")
    wiki.asked.clear()
    wiki.most = 0
    began = time.monotonic()
    got = {r.page_id: r.is_valid for r in service.validate_by_service(df, wiki.url, timeout=1.0, at_once=10, parts=1).collect()}
    assert time.monotonic() - began < 60 and len(got) == len(rows)
    assert (got["p0"], got["p1"], got["p2"], got["p3"], got["p20"]) == (True, False, False, True, True)
    assert 2 <= wiki.most <= 10 and wiki.asked["/validate?id=1a&type=app_id"] == 1
    assert service.validate_by_service(df, None).where(F.col("is_valid")).count() == 0
    assert service.validate_by_service(df.limit(0), wiki.url).count() == 0
