"""Attachments: references joined with what the source says, guards, extraction, chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.functions.text import attachment_kind, chunk_udf


def reconcile(refs: DataFrame, metadata: DataFrame, once: bool = False) -> DataFrame:
    """References ``(page_id, ord, attachment_id, filename, url)``, once per id in order, with the size and URL that
    the source has under the file name (of equal names the last). ``once`` says that they come once per id."""
    if not once:
        first = W.partitionBy("page_id", "attachment_id").orderBy("ord")
        refs = refs.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")
    last = W.partitionBy("page_id", "filename").orderBy(F.col("pos").desc())
    meta = metadata.withColumn("_rn", F.row_number().over(last)).where("_rn = 1")
    meta = meta.select("page_id", "filename", F.col("attachment_id").alias("meta_id"), F.col("url").alias("meta_url"), "size")
    return refs.join(meta, ["page_id", "filename"], "left")


def orphans(refs: DataFrame, metadata: DataFrame) -> DataFrame:
    """Attachments of a page that nothing refers to, the first of each file name."""
    free = metadata.join(refs.select("page_id", "filename").distinct(), ["page_id", "filename"], "left_anti")
    first = W.partitionBy("page_id", "filename").orderBy("pos")
    return free.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn", "pos")


def guarded(refs: DataFrame, vision: bool = False, max_bytes: int = 25 * 1024 * 1024) -> DataFrame:
    """References that can be read: a known kind, images only with vision, with a URL, not too large."""
    found = refs.withColumns({"kind": attachment_kind(F.col("filename")), "fetch_url": F.coalesce(F.nullif("meta_url", F.lit("")), F.nullif("url", F.lit("")))})
    found = found.where((F.col("kind") != "unknown") & F.col("fetch_url").isNotNull() & (F.coalesce("size", F.lit(0)) <= max_bytes))
    return found if vision else found.where("kind <> 'image'")


def list_attachments(pages: DataFrame, base: str) -> DataFrame:
    """One row per attachment of ``pages(page_id, attachments)``, with the defaults of missing values."""
    a = pages.select("page_id", F.posexplode("attachments").alias("pos", "a"))
    return a.select(
        "page_id", "pos", "a.attachment_id", "a.filename",
        F.coalesce("a.media_type", F.lit("application/octet-stream")).alias("media_type"),
        F.concat(F.lit(base), F.col("a.link")).alias("url"), F.coalesce("a.size", F.lit(0)).alias("size"),
    )


Extractor = Callable[[bytes, str], tuple[str, list]]
_TABLES = T.ArrayType(T.ArrayType(T.ArrayType(T.StringType())))
EXTRACTED = T.StructType([T.StructField(c, _TABLES if c == "tables" else T.StringType()) for c in ("page_id", "attachment_id", "filename", "kind", "text", "tables", "error")])


def extract_text(files: DataFrame, extractors: dict[str, Extractor]) -> DataFrame:
    """``files(page_id, attachment_id, filename, kind, content)`` to ``(…, text, tables, error)``; ``tables`` are lists
    of rows of cells; a failure is a row with an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found, errors = [], [], []
            for kind, name, content in zip(*(batch.column(c).to_pylist() for c in ("kind", "filename", "content"))):
                text, tables, error = None, [], None
                if content is None:
                    error = "download_failed: no content"
                elif kind not in extractors:
                    error = f"extraction_failed: no extractor for {kind}"
                else:
                    try:
                        text, tables = extractors[kind](content, name)
                    except Exception as e:  # noqa: BLE001  a bad file is data, not a failure of the job
                        error = f"extraction_failed: {e}"
                texts.append(text)
                found.append(tables)
                errors.append(error)
            kept = [batch.column(c) for c in ("page_id", "attachment_id", "filename", "kind")]
            made = [pa.array(texts, pa.string()), pa.array(found, pa.list_(pa.list_(pa.list_(pa.string())))), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays([*kept, *made], names=EXTRACTED.names)

    named = [F.col(c).cast("string") for c in ("page_id", "attachment_id", "filename", "kind")]
    return files.select(*named, "content").mapInArrow(run, EXTRACTED)


def attachment_tables(extracted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables and cells of ``extracted(page_id, attachment_id, tables, prov_path)``, in the form of those of a page: the
    first row of a table is its header; each cell is one chunk of normal style. Numbered by attachment (``table_index``)."""
    each = extracted.where("error IS NULL").select("page_id", "attachment_id", "prov_path", F.posexplode("tables").alias("table_index", "rows"))
    none = F.lit(None).cast("int")
    first = F.coalesce(F.try_element_at("rows", F.lit(1)), F.array().cast("array<string>"))
    tables = each.select(
        "page_id", "attachment_id", "table_index", none.alias("parent_table"), none.alias("parent_row"), none.alias("parent_col"), F.lit("").alias("chain"),
        F.transform(first, lambda h: F.trim(h)).alias("headers"), F.size("rows").alias("n_rows"), F.size(first).alias("n_cols"),
    )
    rows = each.select("page_id", "attachment_id", "prov_path", "table_index", F.posexplode("rows").alias("row", "x"))
    cells = rows.select("page_id", "attachment_id", "prov_path", "table_index", "row", F.posexplode("x").alias("col", "text"))
    chunk = F.when(F.trim("text") != "", F.array(F.struct(F.trim("text").alias("content"), F.lit("normal").alias("style")))).otherwise(F.array().cast("array<struct<content:string,style:string>>"))
    cells = cells.select("page_id", "attachment_id", "table_index", "row", "col", (F.col("row") == 0).alias("is_header"), F.lit(False).alias("is_propagated"), chunk.alias("chunks"), "prov_path")
    return tables, cells


def renumbered(page_tables: DataFrame, tables: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Attachment ``tables`` and ``cells`` with the numbers that follow those of their page's own tables."""
    numbers = renumbered_tables(page_tables, tables).where("attachment_id IS NOT NULL").withColumnRenamed("table_index", "_new")
    numbers = numbers.withColumnRenamed("old_index", "table_index")

    def moved(df: DataFrame) -> DataFrame:
        return df.join(numbers, ["page_id", "attachment_id", "table_index"]).drop("table_index", "attachment_id").withColumnRenamed("_new", "table_index")

    return moved(tables), moved(cells)


def placed(refs: DataFrame) -> DataFrame:
    """References ``(prov_path, …)`` with where they stand: ``origin`` table or page, and the innermost table, row and col."""

    def at(step: str) -> Column:
        return F.try_element_at(F.regexp_extract_all("prov_path", F.lit(rf"{step}:(\d+)"), 1), F.lit(-1)).cast("int")

    return refs.withColumns({"table_index": at("table"), "row": at("row"), "col": at("col")}).withColumn("origin", F.when(F.col("table_index").isNotNull(), "table").otherwise("page"))


def extraction_input(attachments: DataFrame) -> DataFrame:
    return attachments.where("error IS NULL AND text IS NOT NULL AND text <> ''").select("page_id", "text", "prov_path")


def text_chunks(texts: DataFrame, key: str, size: int = 1000, overlap: int = 150) -> DataFrame:
    """``(key, idx, chunk)`` of ``texts(key, text)``."""
    return texts.select(key, F.posexplode(chunk_udf(size, overlap)("text")).alias("idx", "chunk"))


def renumbered_tables(page_tables: DataFrame, attachment_tables: DataFrame) -> DataFrame:
    """Attachment tables after a page's own, numbered on from its greatest index; ``old_index`` keeps the one they had."""
    most = page_tables.groupBy("page_id").agg(F.max("table_index").alias("_most"))
    order = W.partitionBy("page_id").orderBy("attachment_id", "table_index")
    # Numbered before the join, which needs no order of its own then: the tables are sorted once.
    numbered = attachment_tables.select("page_id", "attachment_id", "table_index", F.row_number().over(order).alias("_rn")).join(most, "page_id", "left")
    moved = numbered.select(
        "page_id", (F.coalesce("_most", F.lit(-1)) + F.col("_rn")).cast("int").alias("table_index"), F.col("table_index").alias("old_index"), "attachment_id"
    )
    own = page_tables.select("page_id", "table_index", F.col("table_index").alias("old_index"), F.lit(None).cast("string").alias("attachment_id"))
    return own.unionByName(moved)


def location(chain: Column) -> tuple[Column, Column]:
    """Origin (table or page) and the last table of a provenance chain."""
    inside = F.coalesce(F.size(chain) > 0, F.lit(False))
    return F.when(inside, "table").otherwise("page"), F.when(inside, F.element_at(chain, -1))
