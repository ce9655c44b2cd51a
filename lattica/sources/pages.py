"""Page snapshots: scans, look-ups and projections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.text import iso_timestamp, title_date


def project_pages(raw: DataFrame) -> DataFrame:
    """``raw(page_id, title, space_key, html, version_when, updated_when)`` to pages: a page's date is that of its
    title, else when it was last modified."""
    modified = F.coalesce(iso_timestamp(F.col("version_when")), iso_timestamp(F.col("updated_when")))
    return raw.select(
        "page_id", "title", "space_key", F.coalesce("html", F.lit("")).alias("html"), modified.alias("last_modified"),
        F.coalesce(title_date(F.col("title")), modified).alias("page_date"),
    )


def scan_space(pages: DataFrame, space: str, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Pages of a space within inclusive dates, oldest first."""
    found = pages.where(F.col("space_key") == space)
    if start is not None:
        found = found.where(F.col("page_date") >= start)
    if end is not None:
        found = found.where(F.col("page_date") <= end)
    return found.orderBy("page_date", "page_id")


def pages_by_id(pages: DataFrame, ids: Sequence[str]) -> DataFrame:
    """The listed pages, oldest first, pages without a date last; unknown ids are left out."""
    wanted = pages.sparkSession.createDataFrame([(i,) for i in dict.fromkeys(ids)], "page_id string")
    return pages.join(wanted, "page_id", "left_semi").orderBy(F.col("page_date").asc_nulls_last(), "page_id")


def page_by_id(pages: DataFrame, page_id: str) -> DataFrame:
    return pages.where(F.col("page_id") == page_id)
