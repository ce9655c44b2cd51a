"""Command line: ingest a snapshot of pages, or follow a folder of snapshots.

    python -m lattica.cli batch --pages IN --out OUT --space S [--start 2024-01-01 --end 2024-12-31 | --ids 1 2] [--resume] [INPUTS]
    python -m lattica.cli incremental --pages IN --out OUT --checkpoint DIR [--every "24 hours"] [INPUTS]
"""

from __future__ import annotations

import argparse
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators.extract import unvalidated
from lattica.operators.store import schemas_with_status
from lattica.plans.ingest import ingest
from lattica.session import build_session, checkpointed
from lattica.sources.files import read_files
from lattica.sources.pages import pages_by_id, project_pages, scan_space
from lattica.sources.providers import hashed_embedder
from lattica.sources.service import PageService, validate_by_service
from lattica.streaming.watch import PageTables, watch

PAGE_SCHEMA = "page_id string, title string, space_key string, html string, last_modified timestamp_ntz, page_date timestamp_ntz"
METADATA_SCHEMA = "page_id string, pos long, attachment_id string, filename string, url string, size long"
SCHEMA_COLUMNS = "schema_ord int, schema_id string, table_type string, canonical_columns array<string>, column_mapping map<string,string>, status string, version int"


@dataclass(frozen=True)
class Inputs:
    """What a run has beside its pages.

    ``attachments``: a folder with ``metadata`` (Parquet) and ``files/{page_id}/{file name}``; ``known``: a table
    ``(id_type, id)`` of the identifiers that are valid; ``schemas``: a table of canonical schemas, of which the
    approved count; ``vectors``: make vectors, by the stand-in that needs no service; ``classifier``: names schemas for
    tables that none fits (``normalize.classify``); ``validation``: address of a service that validates identifiers.
    """

    attachments: str | None = None
    known: str | None = None
    schemas: str | None = None
    vectors: bool = False
    classifier: Callable[[str], str] | None = None
    validation: str | None = None


def read_pages(spark: SparkSession, source: str, space: str | None = None) -> DataFrame:
    """Pages of a Parquet folder or of a service."""
    if not source.startswith(("http://", "https://")):
        return spark.read.schema(PAGE_SCHEMA).parquet(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PageService)
    return project_pages(spark.read.format("page_service").options(url=source, space=space or "").load())


def make_results(pages: DataFrame, given: Inputs, added: DataFrame | None = None) -> dict[str, DataFrame]:
    """The flat tables of the ingest plan that these inputs allow; ``added`` are schemas that earlier batches named."""
    spark = pages.sparkSession
    files = metadata = None
    if given.attachments:
        files = read_files(spark, f"{given.attachments}/files").withColumn("page_id", F.element_at(F.split("path", "/"), -2))
        metadata = spark.read.schema(METADATA_SCHEMA).parquet(f"{given.attachments}/metadata")
    schemas = schemas_with_status(spark.read.schema(SCHEMA_COLUMNS).parquet(given.schemas), pending=False) if given.schemas else None
    if schemas is not None and added is not None:
        schemas = schemas.unionByName(added, allowMissingColumns=True)
    known = spark.read.parquet(given.known) if given.known else None
    validator = partial(validate_by_service, url=given.validation) if given.validation else None
    out = ingest(pages, schemas, known, metadata, files, embedder=hashed_embedder() if given.vectors else None, classifier=given.classifier, validator=validator, keep=checkpointed)
    out["unvalidated"] = unvalidated(out["ids"], F.current_timestamp())
    for name in ("parsed", "texts", "events"):
        del out[name]
    if not given.attachments:
        del out["attachments"]
    return out


def write_results(pages: DataFrame, out: str, given: Inputs) -> None:
    """Write every flat table of the ingest plan."""
    for name, rows in make_results(pages, given).items():
        rows.write.mode("overwrite").parquet(f"{out}/{name}")


def run_batch(spark: SparkSession, pages: DataFrame, out: str, space: str | None, start: str | None, end: str | None, ids: list[str] | None, given: Inputs = Inputs(), resume: bool = False) -> None:
    """Ingest the chosen pages. With ``resume`` only those that the log says need it, and pages without a date are put
    up for review; results then come in versions (``PageTables.results``), else they replace what was there."""
    day = lambda s: s and F.lit(datetime.strptime(s, "%Y-%m-%d")).cast("timestamp_ntz")
    if ids:
        pages = pages_by_id(pages, ids)
    elif space is not None:
        pages = scan_space(pages, space, day(start), day(end))
    if resume:
        tables = PageTables(spark, out)
        tables.upsert(pages, incremental_work(tables, given), review_undated=True)
    else:
        write_results(pages, out, given)


def incremental_work(tables: PageTables, given: Inputs = Inputs()):
    """What an incremental run makes of a batch of pages: every flat table, and the pages that failed."""

    def work(pages: DataFrame) -> dict[str, DataFrame]:
        added = tables.results("added_schemas") if given.classifier is not None else None
        return make_results(pages, given, added if added is not None and "schema_ord" in added.columns else None)

    return work


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="lattica", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("mode", choices=("batch", "incremental"))
    parser.add_argument("--pages", required=True, help="Parquet folder of pages, or (batch) the address of a wiki service")
    parser.add_argument("--out", required=True)
    parser.add_argument("--space")
    parser.add_argument("--start")
    parser.add_argument("--end")
    parser.add_argument("--ids", nargs="+")
    parser.add_argument("--checkpoint")
    parser.add_argument("--every")
    parser.add_argument("--attachments", help="folder of attachment metadata and files")
    parser.add_argument("--resume", action="store_true", help="skip pages that are done, by the log in the output folder")
    parser.add_argument("--known", help="Parquet table of valid identifiers")
    parser.add_argument("--schemas", help="Parquet table of canonical schemas")
    parser.add_argument("--vectors", action="store_true", help="make vectors, by the stand-in embedder")
    parser.add_argument("--validation", help="address of a service that validates identifiers")
    args = parser.parse_args(argv)
    given = Inputs(args.attachments, args.known, args.schemas, args.vectors, validation=args.validation)
    if args.ids and args.mode != "batch":
        parser.error("--ids goes with batch only")
    if args.mode == "incremental" and not args.checkpoint:
        parser.error("incremental needs --checkpoint")
    spark = build_session()
    if args.mode == "batch":
        run_batch(spark, read_pages(spark, args.pages, args.space), args.out, args.space, args.start, args.end, args.ids, given, args.resume)
    else:
        tables = PageTables(spark, args.out)
        work = incremental_work(tables, given)
        watch(spark, args.pages, PAGE_SCHEMA, tables, args.checkpoint, args.every, work).awaitTermination()


if __name__ == "__main__":
    main()
