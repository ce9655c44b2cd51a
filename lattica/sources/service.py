"""A wiki behind an HTTP service: pages as a Spark data source (batch and stream), attachments, files, id validation.

``spark.dataSource.register(PageService)``, then

    spark.read.format("page_service").options(url=..., space=...).load()

The service answers ``GET {url}/content?spaceKey=&start=&limit=`` with at most ``limit`` results, ``GET {url}/content/{id}``
with one page and ``GET {url}/content/{id}/child/attachment`` with a page's attachments. Offsets are dealt to partitions
in turn, ``limit`` pages each, and a partition ends at its first short answer, so no total has to be known. A request
that fails is tried again; a task that fails reads its own offsets again. Look-ups by id and a filter on the space are
pushed down to the service; the session must have ``spark.sql.python.filterPushdown.enabled`` set to true.

As a stream each batch is a poll: all pages as they then are. ``PageTables.upsert`` takes those that have changed.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from urllib.error import HTTPError
from urllib.parse import quote, urlencode
from urllib.request import Request, urlopen

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

#: Columns of ``sources.pages.project_pages``.
RAW_PAGES = "page_id string, title string, space_key string, html string, version_when string, updated_when string"
LIMIT, PARTS, TRIES, TIMEOUT = 50, 8, 3, 30.0
#: Of the validation service and of downloads: calls of a task at once, seconds a call may take, most bytes of a file.
VALIDATIONS, VALIDATION_SECONDS = 10, 10.0
DOWNLOADS, FILE_BYTES = 4, 25 * 1024 * 1024


class TooLarge(ValueError):
    pass


def get(url: str, token: str | None = None, timeout: float = TIMEOUT, tries: int = TRIES, most: int | None = None, pause: float = 0.2) -> bytes:
    """The body of an answer, within ``timeout`` seconds in all a try. Server errors and lost connections are tried again,
    after a pause that doubles; other answers than 200 raise at once."""
    headers = {"Accept": "*/*"} | ({"Authorization": f"Bearer {token}"} if token else {})
    for left in range(tries - 1, -1, -1):
        ends = time.monotonic() + timeout
        try:
            with urlopen(Request(url, headers=headers), timeout=timeout) as answer:  # noqa: S310  the address is the operator's
                parts, size = [], 0
                while piece := answer.read1(1 << 16):
                    parts.append(piece)
                    size += len(piece)
                    if most is not None and size > most:
                        raise TooLarge(f"more than {most} bytes")
                    if time.monotonic() > ends:
                        raise TimeoutError(f"no answer in {timeout:g} s")
                return b"".join(parts)
        except HTTPError as e:
            if e.code < 500 or not left:
                raise
        except OSError:  # lost, refused or timed out
            if not left:
                raise
        time.sleep(pause)
        pause *= 2
    raise ValueError("tries must be 1 or more")


def page_row(raw: dict, space: str) -> tuple:
    return (
        str(raw["id"]), raw.get("title") or "", (raw.get("space") or {}).get("key") or space, ((raw.get("body") or {}).get("view") or {}).get("value") or "",
        (raw.get("version") or {}).get("when"), ((raw.get("history") or {}).get("lastUpdated") or {}).get("when"),
    )


class Offsets(InputPartition):
    """Every ``parts``-th answer from the ``part``-th on; or, with ``ids``, these pages."""

    def __init__(self, part: int, parts: int, ids: tuple[str, ...] | None = None) -> None:
        self.part, self.parts, self.ids = part, parts, ids


class _Pages:
    def __init__(self, options: dict) -> None:
        if "url" not in options:
            raise ValueError("page_service needs the option url")
        self.url, self.space, self.token = options["url"].rstrip("/"), options.get("space", ""), options.get("token")
        self.limit, self.parts = int(options.get("limit", LIMIT)), int(options.get("parts", PARTS))
        self.tries, self.timeout = int(options.get("tries", TRIES)), float(options.get("timeout", TIMEOUT))

    def _json(self, path: str, **query) -> dict:
        url = f"{self.url}/{path}" + (f"?{urlencode(query)}" if query else "")
        return json.loads(get(url, self.token, self.timeout, self.tries))

    def rows(self, given: Offsets) -> Iterator[tuple]:
        if given.ids is not None:
            for ident in given.ids[given.part :: given.parts]:
                try:
                    row = page_row(self._json(f"content/{quote(ident, safe='')}"), self.space)
                except HTTPError as e:
                    if e.code != 404:
                        raise
                    continue
                if not self.space or row[2] == self.space:
                    yield row
            return
        at = given.part * self.limit
        while True:
            found = self._json("content", spaceKey=self.space, status="current", start=at, limit=self.limit).get("results") or []
            yield from (page_row(raw, self.space) for raw in found)
            if len(found) < self.limit:
                return
            at += given.parts * self.limit


class PageReader(_Pages, DataSourceReader):
    ids: tuple[str, ...] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("page_id",):
                self._only([f.value])
            elif isinstance(f, In) and f.attribute == ("page_id",):
                self._only(f.value)
            elif isinstance(f, EqualTo) and f.attribute == ("space_key",) and self.space in ("", f.value):
                self.space = f.value
            yield f  # checked again by Spark, so the service's answer need not be trusted

    def _only(self, ids) -> None:
        wanted = dict.fromkeys(str(i) for i in ids)
        self.ids = tuple(wanted if self.ids is None else (i for i in self.ids if i in wanted))

    def partitions(self) -> list[InputPartition]:
        parts = self.parts if self.ids is None else max(1, min(self.parts, len(self.ids)))
        return [Offsets(k, parts, self.ids) for k in range(parts)]

    def read(self, partition: Offsets) -> Iterator[tuple]:
        return self.rows(partition)


class PageStream(_Pages, DataSourceStreamReader):
    """Polls, counted from 0."""

    polls = 0

    def initialOffset(self) -> dict:  # noqa: N802
        return {"poll": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        self.polls += 1
        return {"poll": self.polls}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.polls = max(self.polls, end["poll"])  # after a restart
        return [Offsets(k, self.parts) for k in range(self.parts)]

    def read(self, partition: Offsets) -> Iterator[tuple]:
        return self.rows(partition)


class PageService(DataSource):
    @classmethod
    def name(cls) -> str:
        return "page_service"

    def schema(self) -> str:
        return RAW_PAGES

    def reader(self, schema) -> PageReader:
        return PageReader(self.options)

    def streamReader(self, schema) -> PageStream:  # noqa: N802
        return PageStream(self.options)


def _each(df: DataFrame, column: str, call: Callable[[str], dict], made: str, at_once: int) -> DataFrame:
    """``df`` with what ``call`` makes of a column, some rows of a task at once, in small batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(at_once) as pool:
            for batch in batches:
                for k in range(0, len(batch), 4 * at_once):
                    some = batch.iloc[k : k + 4 * at_once].reset_index(drop=True)
                    found = pd.DataFrame(list(pool.map(call, some[column])), dtype=object)
                    yield pd.concat([some, found], axis=1)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{schema}, {made}")


def service_attachments(pages: DataFrame, url: str, token: str | None = None, parts: int = PARTS) -> DataFrame:
    """``(page_id, attachments)`` of ``pages(page_id)``, in the form that ``attach.list_attachments`` takes; a page whose
    listing fails has an ``error``."""

    def call(page_id: str) -> dict:
        try:
            found, at = [], 0
            while True:
                query = urlencode({"start": at, "limit": LIMIT})
                some = json.loads(get(f"{url}/content/{quote(page_id, safe='')}/child/attachment?{query}", token)).get("results") or []
                for r in some:
                    found.append(
                        {
                            "attachment_id": str(r["id"]), "filename": r.get("title") or "", "media_type": (r.get("metadata") or {}).get("mediaType"),
                            "link": (r.get("_links") or {}).get("download") or "", "size": (r.get("extensions") or {}).get("fileSize"),
                        }
                    )
                if len(some) < LIMIT:
                    return {"attachments": found, "error": None}
                at += LIMIT
        except Exception as e:  # noqa: BLE001  a page whose listing fails is data
            return {"attachments": [], "error": f"listing_failed: {e}"[:500]}

    kind = "attachments array<struct<attachment_id:string,filename:string,media_type:string,link:string,size:bigint>>, error string"
    return _each(pages.select("page_id").distinct().repartition(parts), "page_id", call, kind, DOWNLOADS)


def download(wanted: DataFrame, url_col: str = "fetch_url", token: str | None = None, most: int = FILE_BYTES, timeout: float = TIMEOUT) -> DataFrame:
    """``wanted`` with the ``content`` of each address, at most ``most`` bytes, or an ``error``."""

    def call(url: str | None) -> dict:
        try:
            if not url:
                raise ValueError("no address")
            return {"content": get(url, token, timeout, most=most), "error": None}
        except Exception as e:  # noqa: BLE001  a file that cannot be read is data
            return {"content": None, "error": f"download_failed: {e}"[:500]}

    return _each(wanted, url_col, call, "content binary, error string", DOWNLOADS)


def validate_by_service(candidates: DataFrame, url: str | None, timeout: float = VALIDATION_SECONDS, at_once: int = VALIDATIONS, parts: int = PARTS) -> DataFrame:
    """``candidates(id_type, raw_value, …)`` with ``is_valid``: a service's answer 200 to ``GET {url}/validate?id=&type=``.

    Each distinct id is asked once, ``at_once`` calls of a task at a time in ``parts`` tasks; any other answer, a failure or
    none within ``timeout`` seconds is invalid. Without an address all are."""
    if not url:
        return candidates.withColumn("is_valid", F.lit(False))

    def call(key: str) -> dict:
        kind, _, value = key.partition("\0")
        try:
            get(f"{url.rstrip('/')}/validate?{urlencode({'id': value, 'type': kind})}", timeout=timeout, tries=1)
        except Exception:  # noqa: BLE001  what cannot be validated is not valid
            return {"is_valid": False}
        return {"is_valid": True}

    ids = candidates.select("id_type", "raw_value").distinct().withColumn("_key", F.concat_ws("\0", "id_type", "raw_value"))
    asked = _each(ids.repartition(parts, "_key"), "_key", call, "is_valid boolean", at_once).drop("_key")
    return candidates.join(asked, ["id_type", "raw_value"], "left").withColumn("is_valid", F.coalesce("is_valid", F.lit(False)))
