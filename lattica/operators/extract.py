"""Identifiers in texts: scan, context, order of first mention, merge, validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.functions.text import strip

#: Kinds of identifier in the order in which a chunk is scanned: eleven digits, then nine.
ID_FORMS = (("app_id", 11), ("project_id", 9))


def scan_ids(texts: DataFrame) -> DataFrame:
    """``(page_id, ord, id_type, pos, raw_value, path)``: each identifier once per chunk ``(page_id, ord, text, path)``."""
    def matches(kind: str, digits: int) -> Column:
        values = F.array_distinct(F.regexp_extract_all("text", F.lit(rf"(?U)\b(\d{{{digits}}})\b"), 1))
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("id_type"), v.alias("raw_value")))

    found = F.concat(*(matches(kind, digits) for kind, digits in ID_FORMS))
    return texts.select("page_id", "ord", "path", "text", F.posexplode(found).alias("pos", "x")).select("page_id", "ord", "path", "text", "pos", "x.*")


def context(text: Column, value: Column, width: int = 60) -> Column:
    """The value's first mention with up to ``width`` characters on either side."""
    at = F.regexp_instr(text, F.concat(F.lit(r"(?U)\b"), value, F.lit(r"\b")))
    begin = F.greatest(F.lit(1), at - width)
    return F.substring(text, begin, at + F.length(value) + width - begin)


def first_mentions(candidates: DataFrame) -> DataFrame:
    """Each identifier of a page once, where it is first found."""
    by = W.partitionBy("page_id", "raw_value").orderBy("ord", "pos")
    return candidates.withColumn("_rn", F.row_number().over(by)).where("_rn = 1").drop("_rn")


def merge_named(seen: DataFrame, named: DataFrame) -> DataFrame:
    """Identifiers ``named(page_id, id_type, raw)`` by a model, cleaned of separators, of exact length and not ``seen``."""
    cleaned = F.when(F.col("id_type") == "project_id", F.regexp_replace("raw", r"[ \-./]", "")).otherwise(F.regexp_replace("raw", r"[ \-.]", ""))
    length = F.when(F.col("id_type") == "project_id", 9).otherwise(11)
    valid = named.withColumn("raw_value", cleaned).where(F.col("raw_value").rlike(r"^(?U)\d+$") & (F.length("raw_value") == length))
    new = valid.join(seen.select("page_id", "raw_value").distinct(), ["page_id", "raw_value"], "left_anti")
    return new.select(
        "page_id", "id_type", "raw_value", F.concat(F.lit("LLM-detected: "), "raw").alias("context"), F.concat(F.lit("page:"), "page_id").alias("path")
    ).dropDuplicates(["page_id", "raw_value"])


def validate_ids(candidates: DataFrame, known: DataFrame | None) -> DataFrame:
    """``is_valid`` by a table of known ids; without one every id is invalid."""
    if known is None:
        return candidates.withColumn("is_valid", F.lit(False))
    hit = known.select("id_type", F.col("id").alias("raw_value"), F.lit(True).alias("_hit")).distinct()
    return candidates.join(hit, ["id_type", "raw_value"], "left").withColumn("is_valid", F.coalesce("_hit", F.lit(False))).drop("_hit")


def unvalidated(validated: DataFrame, detected_at: Column) -> DataFrame:
    return validated.where("NOT is_valid").withColumns({"detected_at": detected_at, "status": F.lit("pending_review")})


def valid_by_type(validated: DataFrame) -> DataFrame:
    """Ordered lists of the valid ids of each page."""
    order = F.array_sort(F.collect_list(F.struct("ord", "pos", "raw_value")))
    lists = validated.where("is_valid").groupBy("page_id", "id_type").agg(order.alias("x"))
    return lists.select("page_id", "id_type", F.transform("x", lambda s: s["raw_value"]).alias("ids"))


def model_input(texts: DataFrame, limit: int = 8000) -> DataFrame:
    """One text a page for the model: its chunks in order, joined by a space and cut to the model's limit."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"])
    joined = F.substring(F.array_join(parts, " "), 1, limit)
    return texts.groupBy("page_id").agg(joined.alias("input")).where(strip(F.col("input")) != "")


def collected_texts(chunks: DataFrame, cells: DataFrame, attachments: DataFrame) -> DataFrame:
    """``(page_id, ord, text, path)``: page chunks, then cells in order without copies and blanks, then attachments."""
    cell_text = F.array_join(F.transform("chunks", lambda c: c["content"]), " ")
    parts = [
        chunks.select("page_id", F.lit(0).alias("kind"), "seq", strip(F.col("content")).alias("text"), F.concat(F.lit("page:"), "page_id").alias("path")),
        cells.where("NOT is_propagated").select("page_id", F.lit(1).alias("kind"), "seq", strip(cell_text).alias("text"), F.col("prov_path").alias("path")),
        attachments.select("page_id", F.lit(2).alias("kind"), "seq", F.col("text"), F.col("prov_path").alias("path")),
    ]
    both = reduce(DataFrame.unionByName, parts).where("text <> ''")
    return both.withColumn("ord", F.row_number().over(W.partitionBy("page_id").orderBy("kind", "seq")) - 1).drop("kind", "seq")


def has_cancelled(chunks: DataFrame, cells: DataFrame, tables: DataFrame) -> DataFrame:
    """Whether the text or a top-level table of a page holds a cancelled chunk.

    Chunks are reduced to one answer a page or table before anything is joined or dealt: what tasks sort are small rows."""
    own = chunks.groupBy("page_id").agg(F.bool_or(F.col("style") == "cancelled").alias("hit"))
    hits = F.array_max(F.transform("chunks", lambda c: c["style"] == "cancelled"))  # nulls do not count
    by_table = cells.where(F.size("chunks") > 0).groupBy("page_id", "table_index").agg(F.bool_or(hits).alias("hit"))
    top = by_table.join(tables.where("parent_table IS NULL").select("page_id", "table_index"), ["page_id", "table_index"], "left_semi")
    return own.union(top.select("page_id", "hit")).groupBy("page_id").agg(F.bool_or("hit").alias("has_cancelled"))
