"""Tables to canonical rows: fingerprints, header similarity, clusters, best schema, consolidation, routing."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.functions.similarity import list_similarity, normal_headers
from lattica.functions.text import strip
from lattica.operators.components import components
from lattica.operators.header_index import similar_lists
from lattica.operators.parse import run_at, runs_of
from lattica.session import checkpointed, stored

CLUSTER_SIMILARITY, ASSIGN_SIMILARITY = 0.75, 0.70


def cell_text(chunks: Column) -> Column:
    return strip(F.array_join(F.transform(chunks, lambda c: c["content"]), " "))


def fingerprints(tables: DataFrame, cells: DataFrame, sample_rows: int = 3) -> DataFrame:
    """Headers (or what the first row says), sizes and up to ``sample_rows`` data rows, the first chunk of each cell."""
    first_chunk = F.coalesce(F.try_element_at("chunks", F.lit(1))["content"], F.lit(""))
    row = F.array_sort(F.collect_list(F.struct("col", first_chunk.alias("t"))))
    rows = cells.groupBy("page_id", "table_index", "row").agg(F.transform(row, lambda x: x["t"]).alias("texts"))
    listed = F.array_sort(F.collect_list(F.struct("row", "texts")))
    by_table = rows.groupBy("page_id", "table_index").agg(F.transform(listed, lambda x: x["texts"]).alias("all"))
    joined = tables.join(by_table, ["page_id", "table_index"], "left").withColumn("all", F.coalesce("all", F.array().cast("array<array<string>>")))
    headed = F.size("headers") > 0
    headers = F.when(headed, F.col("headers")).otherwise(F.coalesce(F.try_element_at("all", F.lit(1)), F.array().cast("array<string>")))
    return joined.select(
        "page_id", "table_index", headers.alias("headers"), F.size(headers).alias("col_count"), F.size("all").alias("row_count"),
        F.slice("all", F.when(headed, 2).otherwise(1), sample_rows).alias("samples"), headed.alias("headed"),
    )


def kinds_of(tables: DataFrame) -> DataFrame:
    """``(first, headers, names)``: each distinct list of headers of ``tables(ord, headers)``, its first table and the
    form in which headers are compared."""
    return tables.groupBy("headers").agg(F.min("ord").alias("first")).withColumn("names", normal_headers("headers"))


def similar_tables(tables: DataFrame, at_least: float = CLUSTER_SIMILARITY) -> DataFrame:
    """Pairs ``(a, b)`` of ``tables(ord, headers)`` whose earlier one is similar to the later; equal header lists
    meet as one, so a common layout costs one comparison and not one for each pair of its tables."""
    kinds = kinds_of(tables)
    lists = lambda a, h: kinds.select(F.col("first").alias(a), F.col("names").alias(h))
    pairs = similar_lists(lists("a", "ha"), lists("b", "hb"), at_least).where("a < b").select("a", "b")
    same = tables.join(kinds, "headers").where("ord <> first").select(F.col("first").alias("a"), F.col("ord").alias("b"))
    return pairs.union(same)


def clusters(tables: DataFrame, at_least: float = CLUSTER_SIMILARITY) -> DataFrame:
    """``(ord, cluster)``: connected components of similar tables, named by their first table."""
    found = components(tables.select(F.col("ord").alias("id")), similar_tables(tables, at_least))
    return found.select(F.col("id").alias("ord"), F.col("component").alias("cluster"))


#: Lists and schema names that one task compares where no schema is similar enough.
BLOCK_LISTS, BLOCK_NAMES = 4096, 20_000


def schema_names(schemas: DataFrame, *keys: str) -> DataFrame:
    """``(*keys, names)``: canonical columns and known headers, as headers are compared; those that are in ``own`` too,
    if there is such a column."""
    none = F.array().cast("array<string>")
    known = F.concat("canonical_columns", F.coalesce(F.map_keys("column_mapping"), none), F.coalesce("own", none) if "own" in schemas.columns else none)
    return schemas.select(*keys, known.alias("known")).select(*keys, normal_headers("known").alias("names"))


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """``df`` with a number from 0 in the order of a column, without one task for all: ranges are numbered each on its
    own, and what is summed up is a row a range."""
    ranges = checkpointed(df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_range", F.spark_partition_id()))
    sizes = ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(W.orderBy("_range")) - F.col("_n")).alias("_before"))
    at = F.row_number().over(W.partitionBy("_range").orderBy(order)) - 1 + F.col("_before")
    return ranges.join(before, "_range").withColumn(name, at).drop("_range", "_before")


def best_below(lists: DataFrame, names: DataFrame) -> DataFrame:
    """``(a, schema_ord, score)`` for lists ``(a, ha)`` that no index can answer, for no schema is near: blocks of lists
    with blocks of schemas ``(schema_ord, names)``, each pair of blocks a task of bounded size. Of a block each schema
    that is better than all before it is told, so the best of the first n schemas can be read for any n."""
    n_lists, n_names = lists.count(), names.agg(F.coalesce(F.sum(F.size("names")), F.lit(0))).first()[0]
    rows, columns = -(-n_lists // BLOCK_LISTS), -(-n_names // BLOCK_NAMES)
    if not rows or not columns:
        return lists.sparkSession.createDataFrame([], f"a {lists.schema['a'].dataType.simpleString()}, schema_ord int, score double")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = lists.withColumn("i", F.pmod(F.xxhash64("a"), F.lit(rows)).cast("int")).withColumn("j", each(columns))
    right = names.withColumn("j", F.pmod(F.xxhash64("schema_ord"), F.lit(columns)).cast("int")).withColumn("i", each(rows))

    def scored(some: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        them = sorted((int(k), list(n)) for k, n in zip(block["schema_ord"], block["names"]))
        rows = []
        for a, own in zip(some["a"], some["ha"]):
            best = 0.0
            for k, n in them:
                score = list_similarity(list(own), n)
                if score > best:
                    best = score
                    rows.append((a, k, score))
        return pd.DataFrame(rows, columns=["a", "schema_ord", "score"])

    kind = lists.schema["a"].dataType.simpleString()
    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(scored, f"a {kind}, schema_ord int, score double")


def best_of_kinds(kinds: DataFrame, schemas: DataFrame, at_least: float = ASSIGN_SIMILARITY, below: bool = True) -> DataFrame:
    """``(first, headers, schema_id, score)``: the most similar schema of each list of headers of ``kinds`` (see ``kinds_of``); of equals the
    first; none at similarity 0.

    ``schemas(schema_ord, schema_id, canonical_columns, column_mapping)``. The lists meet the schemas that share a near
    header with them (``similar_lists``); that answers all lists that some schema fits. With ``below`` the others are
    compared with all schemas, block by block, for the score that they are reported with.
    """
    kinds = checkpointed(kinds)
    names = checkpointed(schema_names(schemas, "schema_ord", "schema_id"))
    lists = kinds.select(F.col("first").alias("a"), F.col("names").alias("ha"))
    near = similar_lists(lists, names.select(F.col("schema_ord").alias("b"), F.col("names").alias("hb")), at_least).withColumnRenamed("b", "schema_ord")
    best = lambda rows: rows.groupBy("a").agg(F.max_by(F.struct("schema_ord", "score"), F.struct("score", -F.col("schema_ord"))).alias("x")).select("a", "x.schema_ord", "x.score")
    best_of = best(near)
    if below:
        best_of = checkpointed(best_of)
        best_of = best_of.union(best(best_below(lists.join(best_of, "a", "left_anti"), names.select("schema_ord", "names"))))
    found = best_of.join(names.select("schema_ord", "schema_id"), "schema_ord").join(kinds.select(F.col("first").alias("a"), "headers"), "a")
    return found.select(F.col("a").alias("first"), "headers", "schema_id", "score")


def best_match(tables: DataFrame, schemas: DataFrame, at_least: float = ASSIGN_SIMILARITY, below: bool = True) -> DataFrame:
    """``(ord, schema_id, score)``: the most similar schema of each table ``(ord, headers)``, by its list of headers (see ``best_of_kinds``)."""
    found = best_of_kinds(kinds_of(tables), schemas, at_least, below)
    return tables.select("ord", "headers").join(found, "headers").select("ord", "schema_id", "score")


def column_map(tables: DataFrame, schemas: DataFrame) -> DataFrame:
    """``(ord, col, canonical)`` of ``tables(ord, schema_id, headers)``: an exact header first, else without case."""
    heads = tables.select("ord", "schema_id", F.posexplode("headers").alias("col", "header"))
    entries = schemas.select("schema_id", F.posexplode("column_mapping").alias("entry", "name", "canonical"))
    joined = heads.join(entries, "schema_id").where(F.lower(F.trim("header")) == F.lower(F.trim("name")))
    by = W.partitionBy("ord", "col").orderBy((F.col("header") == F.col("name")).desc(), "entry")
    return joined.withColumn("_rn", F.row_number().over(by)).where("_rn = 1").select("ord", "col", "header", "canonical")


def consolidate(cells: DataFrame, mapping: DataFrame, headed: DataFrame) -> DataFrame:
    """Canonical rows ``(ord, row, values, cancelled_fields)`` of ``cells(ord, row, col, chunks)``: the header row and
    blank rows are left out; of cells with one canonical name the last counts."""
    # all that a table's cells need to know is one row, so cells are dealt once, by table
    columns = mapping.groupBy("ord").agg(F.collect_list(F.struct("col", "canonical")).alias("columns"))
    data = cells.join(headed.select("ord", "headed").join(columns, "ord"), "ord").where("NOT (headed AND row = 0)")
    cancelled = F.exists("chunks", lambda c: c["style"] == "cancelled")
    named = data.withColumn("of", F.explode(F.filter("columns", lambda x: x["col"] == F.col("col")))).select(
        "ord", "row", "col", F.col("of.canonical").alias("canonical"), F.struct(cell_text(F.col("chunks")).alias("text"), cancelled.alias("cancelled")).alias("v")
    )
    fields = named.groupBy("ord", "row", "canonical").agg(F.max_by("v", "col").alias("v"))
    rows = fields.groupBy("ord", "row").agg(F.array_sort(F.collect_list(F.struct("canonical", "v"))).alias("f"))
    rows = rows.where(F.exists("f", lambda x: x["v"]["text"] != ""))
    return rows.select(
        "ord", "row", F.map_from_entries(F.transform("f", lambda x: F.struct(x["canonical"], x["v"]["text"]))).alias("values"),
        F.transform(F.filter("f", lambda x: x["v"]["cancelled"]), lambda x: x["canonical"]).alias("cancelled_fields"),
    )


def novel_kinds(tables: DataFrame, schemas: DataFrame, at_least: float = ASSIGN_SIMILARITY) -> DataFrame:
    """``(first, headers, names)`` of the lists of headers that no given schema fits, with the first table that is large
    enough (two columns and rows) to name a new one."""
    known = best_match(tables, schemas, at_least, below=False).select("ord")
    return kinds_of(tables.where("col_count >= 2 AND row_count >= 2").join(known, "ord", "left_anti"))


def first_come(nodes: DataFrame, covers: DataFrame) -> DataFrame:
    """``(first)`` of those ``nodes(first)`` that no earlier one of the chosen covers, by ``covers(a, b)``, a before b.

    What a loop in order would choose, in rounds: a node none of whose earlier covering nodes is open is chosen, and
    what a chosen node covers is not. Each round is a checkpoint and settles the least open node at least."""
    state = checkpointed(nodes.select("first", F.lit(None).cast("boolean").alias("chosen")))
    edges = checkpointed(covers.select("a", "b"))
    while True:
        open_ = state.where("chosen IS NULL").select("first")
        if open_.isEmpty():
            return state.where("chosen").select("first")
        blocked = edges.join(open_, F.col("a") == F.col("first")).select(F.col("b").alias("first")).distinct()
        free = checkpointed(open_.join(blocked, "first", "left_anti").withColumn("free", F.lit(True)))
        taken = edges.join(free, F.col("a") == F.col("first")).select(F.col("b").alias("first")).distinct().withColumn("taken", F.lit(True))
        chosen = F.coalesce("chosen", F.col("free"), ~F.col("taken"))
        state = checkpointed(state.join(free, "first", "left").join(taken, "first", "left").select("first", chosen.alias("chosen")))


def route(tables: DataFrame, schemas: DataFrame, model: Callable[[str], str] | None = None, at_least: float = ASSIGN_SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Routes of ``tables(ord, headers, col_count, row_count)`` in the order of ``ord``, and the schemas that they add.

    A table that a schema fits is ``assigned``; else, if it has two columns and rows, it is ``new``: ``model`` is asked
    for a schema, which later tables meet (without a model none is added); else it is ``unknown``, with the score of
    the best schema known by then (0 for a new one). Routes are ``(ord, route, schema_id, score)``; added schemas come with the columns
    of ``schemas``, numbered on from them in the order of their tables, with ``since``, the table.

    Equal to a loop over the tables, by a graph: nodes are the lists of headers that no given schema fits, in the
    order of their first large enough tables; one covers a later one if the schema that the model names for it fits
    that. ``first_come`` chooses the schemas that are added. The model is called once for each such list, in the workers;
    of its answer the first schema counts, and that also fits the list that it was made for. No answer: unknown.
    """
    spark = tables.sparkSession
    tables = checkpointed(tables.select("ord", "headers", "col_count", "row_count"))
    kind = tables.schema["ord"].dataType.simpleString()
    added = spark.createDataFrame([], f"schema_ord int, schema_id string, table_type string, canonical_columns array<string>, column_mapping map<string,string>, since {kind}, own array<string>")
    if model is not None:
        nodes = checkpointed(novel_kinds(tables, schemas, at_least))
        told = nodes.select(F.col("first").alias("cluster"), F.array("headers").alias("variants"), F.col("headers").alias("sample"), F.lit(1).alias("tables"))
        named = classify(told, model).where("place = 0").withColumnRenamed("cluster", "first")
        named = checkpointed(named.join(nodes.select("first", F.col("headers").alias("own")), "first"))
        theirs = schema_names(named, "first").select(F.col("first").alias("b"), F.col("names").alias("hb"))
        near = similar_lists(nodes.select(F.col("first").alias("a"), F.col("names").alias("ha")), theirs, at_least)
        chosen = first_come(named, near.where("b < a").select(F.col("b").alias("a"), F.col("a").alias("b")))
        base = schemas.agg(F.coalesce(F.max("schema_ord") + 1, F.lit(0))).first()[0]
        added = numbered(named.join(chosen, "first"), "first", "at").select(
            (F.col("at") + base).cast("int").alias("schema_ord"), F.concat(F.lit("schema_"), "first").alias("schema_id"), "table_type", "canonical_columns", "column_mapping", F.col("first").alias("since"), "own"
        )
        added = checkpointed(added)
    given = schemas.select("schema_ord", "schema_id", "canonical_columns", "column_mapping", F.lit(None).cast(kind).alias("since"), F.lit(None).cast("array<string>").alias("own"))
    offered = checkpointed(given.union(added.select(given.columns)))
    names = checkpointed(schema_names(offered, "schema_ord", "schema_id", "since"))
    kinds = checkpointed(kinds_of(tables))
    lists = kinds.select(F.col("first").alias("a"), F.col("names").alias("ha"))
    near = similar_lists(lists, names.select(F.col("schema_ord").alias("b"), F.col("names").alias("hb")), at_least).withColumnRenamed("b", "schema_ord")

    def best(some: DataFrame, scores: DataFrame) -> DataFrame:
        """The best of the schemas that were there before each table."""
        known = scores.join(names.select("schema_ord", "schema_id", "since"), "schema_ord").join(kinds.select(F.col("first").alias("a"), "headers"), "a")
        known = some.select("ord", "headers").join(known, "headers").where("since IS NULL OR since < ord")
        return known.groupBy("ord").agg(F.max_by(F.struct("schema_id", "score"), F.struct("score", -F.col("schema_ord"))).alias("x")).select("ord", "x.schema_id", "x.score")

    makers = added.select(F.col("since").alias("ord"), F.col("schema_id").alias("made"))
    large = (F.col("col_count") >= 2) & (F.col("row_count") >= 2) if model is None else F.col("made").isNotNull()
    way = F.when(F.col("score").isNotNull(), "assigned").when(large, "new").otherwise("unknown")
    routed = checkpointed(tables.join(best(tables, near), "ord", "left").join(makers, "ord", "left").withColumn("route", way))
    left = routed.where("route = 'unknown'").select("ord", "headers")
    asked = lists.join(left.join(kinds, "headers").select(F.col("first").alias("a")).distinct(), "a", "left_semi")
    low = best(left, best_below(asked, names.select("schema_ord", "names"))).select("ord", F.col("score").alias("low"))
    out = routed.join(low, "ord", "left").select("ord", "route", F.coalesce("schema_id", "made").alias("schema_id"), F.round(F.coalesce("score", "low", F.lit(0.0)), 3).alias("score"))
    return out, added.drop("own")


def cluster_summaries(tables: DataFrame, labels: DataFrame, most: int = 50) -> DataFrame:
    """What a model is told of each cluster: its header variants (of more than ``most`` those of most tables, so that a
    prompt stays short), a sample and its size."""
    kinds = tables.join(labels, "ord").groupBy("cluster", "headers").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))
    place = F.row_number().over(W.partitionBy("cluster").orderBy(F.col("n").desc(), "first"))
    shown = kinds.withColumn("place", place).where(F.col("place") <= most)
    sizes = kinds.groupBy("cluster").agg(F.min_by("headers", "first").alias("sample"), F.sum("n").alias("tables"))
    return shown.groupBy("cluster").agg(F.array_sort(F.collect_list("headers")).alias("variants")).join(sizes, "cluster")


_FENCE = re.compile(r"^\s*```(?:json)?\s*|\s*```\s*$")


def classify(summaries: DataFrame, model: Callable[[str], str]) -> DataFrame:
    """``(cluster, place, table_type, canonical_columns, column_mapping)``: the schemas that ``model`` proposes for cluster
    summaries, one call a cluster, in the workers; code fences around an answer are taken off, an answer that is not
    JSON raises."""
    kind = summaries.schema["cluster"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for cluster, variants, sample, tables in zip(batch["cluster"], batch["variants"], batch["sample"], batch["tables"]):
                prompt = {"variants": [list(v) for v in variants], "sample": list(sample), "tables": int(tables)}
                found = json.loads(_FENCE.sub("", model(json.dumps(prompt))))
                for place, x in enumerate([found] if isinstance(found, dict) else found):
                    rows.append((cluster, place, x.get("table_type"), x.get("canonical_columns") or [], x.get("column_mapping") or {}))
            yield pd.DataFrame(rows, columns=["cluster", "place", "table_type", "canonical_columns", "column_mapping"])

    shown = summaries.select("cluster", "variants", "sample", F.col("tables").cast("long").alias("tables"))
    return shown.mapInPandas(run, f"cluster {kind}, place int, table_type string, canonical_columns array<string>, column_mapping map<string,string>")


def consolidate_routed(tables: DataFrame, cells: DataFrame, routes: DataFrame, schemas: DataFrame) -> DataFrame:
    """Rows of the tables that were assigned to a schema or made one."""
    matched = tables.join(routes.where("schema_id IS NOT NULL").select("ord", "schema_id"), "ord")
    return consolidate(cells, column_map(matched, schemas), tables).join(matched.select("ord", "schema_id"), "ord")


def prepare_and_consolidate(tables: DataFrame, cells: DataFrame, approved: DataFrame, at_least: float = ASSIGN_SIMILARITY) -> DataFrame:
    """Batch form: tables whose best approved schema is similar enough, consolidated, with their schema."""
    matched = tables.join(best_match(tables, approved, at_least, below=False), "ord")
    mapping = column_map(matched, approved)
    return consolidate(cells, mapping, tables).join(matched.select("ord", "schema_id"), "ord")


def parsed_tables(parsed: DataFrame) -> DataFrame:
    """``(page_id, table_index, headers, headed, cells(row, col, text, cancelled))`` of the tables of parsed pages that have cells, these in order.

    ``headers`` are those that ``fingerprints`` tells: of a table without a head what its first row says. It is made where the page stands:
    nothing is dealt, and the time is in proportion to the page. A table's place in its page is its number; parsed texts have no blanks
    around them."""

    def short(c: Column) -> Column:
        contents = F.transform(c["chunks"], lambda x: x["content"])
        first = F.when(F.size(F.get("tables", c["table_index"])["headers"]) == 0, F.coalesce(F.get(contents, F.lit(0)), F.lit("")))
        cancelled = F.exists(c["chunks"], lambda x: x["style"] == "cancelled")
        return F.struct(c["table_index"].alias("table_index"), c["row"].alias("row"), c["col"].alias("col"), F.array_join(contents, " ").alias("text"), cancelled.alias("cancelled"), first.alias("first"))

    pages = parsed.select("page_id", "tables", F.sort_array(F.transform("cells", short)).alias("cells")).withColumn("starts", runs_of("cells", "table_index"))
    each = F.transform("starts", lambda s, k: F.struct(F.get("tables", F.get("cells", s)["table_index"]).alias("t"), run_at("cells", "starts", s, k).alias("cells")))
    tables = pages.select("page_id", F.explode(each).alias("x")).select("page_id", "x.t.table_index", "x.t.headers", "x.cells")
    headed = F.size("headers") > 0
    first_row = F.transform(F.filter("cells", lambda c: c["row"] == F.get("cells", F.lit(0))["row"]), lambda c: c["first"])
    return tables.select("page_id", "table_index", F.when(headed, F.col("headers")).otherwise(first_row).alias("headers"), headed.alias("headed"), F.transform("cells", lambda c: c.dropFields("table_index", "first")).alias("cells"))


def consolidate_pages(parsed: DataFrame, approved: DataFrame, at_least: float = ASSIGN_SIMILARITY) -> DataFrame:
    """``(page_id, table_index, row, values, cancelled_fields, schema_id)``: ``prepare_and_consolidate`` for the tables of parsed pages, which are stored
    in the form of ``parsed_tables``.

    A schema and the canonical names of columns are found once for each list of headers; tables only look theirs up, and rows are
    made where the table stands. So no more than the distinct lists of headers is dealt, as long as those that a schema
    fits are few enough to be sent; else tables are dealt by their headers."""
    tables = stored(parsed_tables(parsed))
    kinds = kinds_of(tables.select(F.concat_ws(":", "page_id", "table_index").alias("ord"), "headers"))
    fits = checkpointed(best_of_kinds(kinds, approved, at_least, below=False).select(F.col("first").alias("ord"), "headers", "schema_id"))
    columns = column_map(fits, approved).groupBy("ord").agg(F.collect_list(F.struct("col", "canonical")).alias("columns"))
    name = lambda i: F.get(F.filter("columns", lambda x: x["col"] == i), F.lit(0))["canonical"]
    named = fits.join(columns, "ord").select("headers", "schema_id", F.transform("headers", lambda h, i: name(i)).alias("canonical"))
    # Written, as then its size is known: what is small is sent before the tables would be dealt.
    found = tables.join(stored(named), "headers")

    counts = lambda c: F.get("canonical", c["col"]).isNotNull() & ~(F.col("headed") & (c["row"] == 0))
    field = lambda c: F.struct(c["row"].alias("row"), F.get("canonical", c["col"]).alias("canonical"), c["col"].alias("col"), c["text"].alias("text"), c["cancelled"].alias("cancelled"))
    fields = F.sort_array(F.transform(F.filter("cells", counts), field))
    told = found.select("page_id", "table_index", "schema_id", fields.alias("fields"))
    # of cells with one canonical name the last counts: one that the next is not of the same row and name
    last = lambda f, i: F.coalesce((F.get("fields", i + 1)["row"] != f["row"]) | (F.get("fields", i + 1)["canonical"] != f["canonical"]), F.lit(True))
    told = told.withColumn("last", F.filter("fields", last)).withColumn("starts", runs_of("last", "row"))
    rows = told.select("page_id", "table_index", "schema_id", F.explode(F.transform("starts", lambda s, k: run_at("last", "starts", s, k))).alias("f"))
    rows = rows.where(F.exists("f", lambda x: x["text"] != ""))
    return rows.select(
        "page_id", "table_index", F.get("f", F.lit(0))["row"].alias("row"), F.map_from_entries(F.transform("f", lambda x: F.struct(x["canonical"], x["text"]))).alias("values"),
        F.transform(F.filter("f", lambda x: x["cancelled"]), lambda x: x["canonical"]).alias("cancelled_fields"), "schema_id",
    )
