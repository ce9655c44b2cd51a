"""Pages to flat tables of text chunks, table cells and attachment references.

One Arrow pass walks each page's tree; rows of all pages come out flat, so later operators are plain DataFrame
plans. Tables may be nested in cells: they are numbered before what they hold, and carry the cell they stand in.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache, reduce
from html import unescape
from itertools import accumulate, chain
from urllib.parse import unquote

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.functions.dom import DECLARATION, TEXT, Dom, attributes, parse_dom

#: The nearest of these elements around a text gives its style (fixed values).
STYLES = {
    "s": "cancelled", "strike": "cancelled", "del": "cancelled", "strong": "bold", "b": "bold", "u": "underline", "em": "italic", "i": "italic",
}
SKIPPED = frozenset(("script", "style", "head"))
#: The greatest spans that HTML allows (fixed values).
SPAN_LIMITS = {"colspan": 1000, "rowspan": 65534}
ATTACHMENT_PATH = "/download/attachments/"

_CHUNK = "struct<content: string, style: string>"
#: What a page has, in the order of the columns of ``parse_pages``.
PARTS = {
    "chunks": f"array<{_CHUNK}>",
    "tables": "array<struct<table_index: int, parent_table: int, parent_row: int, parent_col: int, chain: string, headers: array<string>, n_rows: int, n_cols: int>>",
    "cells": f"array<struct<table_index: int, row: int, col: int, is_header: boolean, is_propagated: boolean, chunks: array<{_CHUNK}>, prov_path: string>>",
    "refs": "array<struct<attachment_id: string, filename: string, url: string, prov_path: string>>",
}


def merge_chunks(parts: list[tuple[str, str]]) -> list[dict]:
    """Neighbours of equal style are joined with one space."""
    out: list[dict] = []
    for content, style in parts:
        if out and out[-1]["style"] == style:
            out[-1]["content"] += " " + content
        else:
            out.append({"content": content, "style": style})
    return out


def span(attrs: str, name: str) -> int:
    """A span as HTML reads it: 1 where it is no number or 0, and never above the format's limit."""
    value = attributes(attrs).get(name, "1").strip()
    if not (value.isascii() and value.isdecimal()):
        return 1
    return min(max(1, int(value[:10])), SPAN_LIMITS[name])


class Region:
    """A page or a cell: what stands in it and outside of the tables in it."""

    __slots__ = ("node", "parts", "tables", "links", "embedded")

    def __init__(self, node: int) -> None:
        self.node = node
        self.parts: list[tuple[str, str]] = []  # stripped texts with their styles
        self.tables: list[Table] = []
        self.links: list[tuple[str, str, str]] = []
        self.embedded: list[tuple[str, str, str]] = []


class Table:
    """A table's rows of cells: those of its sections, and its own, which count only where no section has any."""

    __slots__ = ("of_sections", "own")

    def __init__(self) -> None:
        self.of_sections: list[list[Region]] = []
        self.own: list[list[Region]] = []


SECTIONS, CELLS = frozenset(("thead", "tbody", "tfoot")), frozenset(("td", "th"))


class PageWalk:
    """One page's texts, tables, cells and references.

    Nodes come in document order, each after its parent, so one pass deals texts, links and tables to the page or the
    cell that they stand in; tables are then told in their order."""

    def __init__(self, page_id: str, html: str, keep_comments: bool = True) -> None:
        self.page_id, self.dom, self.keep_comments = page_id, parse_dom(html), keep_comments
        self.tables: list[dict] = []
        self.cells: list[dict] = []
        self.refs: list[dict] = []
        page = self.regions()
        self.chunks = merge_chunks(page.parts)
        for table in page.tables:
            walks = [self.table(table, "", None)]
            while walks:  # tables within tables, however deep, without recursion
                inner = next(walks[-1], None)
                if inner is None:
                    walks.pop()
                else:
                    walks.append(self.table(*inner))
        self.attachments(page, f"page:{page_id}")

    def regions(self) -> Region:
        """The page's own region; those of cells hang in its tables."""
        dom: Dom = self.dom
        page = Region(0)
        # For each node what its children are dealt to, whether their texts count, and their style: that of the
        # nearest styled element, up to the root.
        into: list = [page]
        counts, style = [True], ["normal"]
        tags, parents, data, styles = dom.tag, dom.parent, dom.data, STYLES.get
        for node in range(1, len(tags)):
            tag, up = tags[node], parents[node]
            place, shown, look = into[up], counts[up], style[up]
            if tag[0] == "#":
                if shown and (tag == TEXT or self.keep_comments):
                    text = data[node]
                    if tag == DECLARATION:
                        text = re.sub(r"(?i)^doctype\s+", "", text)
                    text = text.strip()
                    if text:
                        place.parts.append((text, look))
            else:
                look = styles(tag, look)
                kind = type(place)
                if kind is Region:
                    if tag == "table":
                        table = Table()
                        place.tables.append(table)
                        place, shown = table, False
                    elif tag in SKIPPED:
                        shown = False
                    elif tag == "a":
                        if ATTACHMENT_PATH[1:-1] in data[node] or "&" in data[node]:  # else no need to read the attributes
                            href = dom.attributes(node).get("href", "")
                            if ATTACHMENT_PATH in href:
                                place.links.append((href, unquote(href.split("?")[0].rsplit("/", 1)[-1]), href))
                    elif tag == "ri:attachment":
                        name = dom.attributes(node).get("ri:filename", "")
                        if name:
                            place.embedded.append((name, name, ""))
                elif kind is list:  # a row
                    if tag in CELLS:
                        cell = Region(node)
                        place.append(cell)
                        place, shown = cell, True
                    else:
                        place = None
                elif kind is Table:
                    if tag == "tr":
                        row: list[Region] = []
                        place.own.append(row)
                        place = row
                    else:
                        place = (place,) if tag in SECTIONS else None
                elif kind is tuple and tag == "tr":  # in a section of this table
                    row = []
                    place[0].of_sections.append(row)
                    place = row
                else:
                    place = None
            into.append(place)
            counts.append(shown)
            style.append(look)
        return page

    def span(self, cell: int, name: str) -> int:
        return span(self.dom.data[cell], name)

    def table(self, table: Table, chain: str, place: tuple[int, int, int] | None) -> Iterator[tuple]:
        """Record a table; yields what the tables in its cells are to be recorded with, each before the next cell."""
        index = len(self.tables)
        chain += f"/table:{index}" + (f"/row:{place[1]}/col:{place[2]}" if place else "")
        record = {"table_index": index, "parent_table": place and place[0], "parent_row": place and place[1], "parent_col": place and place[2]}
        record |= {"chain": chain, "headers": [], "n_rows": 0, "n_cols": 0}
        self.tables.append(record)
        waiting: dict[int, list] = {}  # column to [rows left, chunks]
        tags, attrs = self.dom.tag, self.dom.data
        for r, cells in enumerate(table.of_sections or table.own):
            head = r == 0 and bool(cells) and all(tags[c.node] == "th" for c in cells)
            col, n_cells = 0, 0

            def fill(col: int, upto_end: bool = False) -> int:
                while col in waiting or (upto_end and any(k > col for k in waiting)):
                    if col in waiting:
                        self.cell(index, r, col, False, True, waiting[col][1], chain)
                        waiting[col][0] -= 1
                        if not waiting[col][0]:
                            del waiting[col]
                    col += 1
                return col

            fresh: list[tuple[int, int, list]] = []
            for cell in cells:
                if waiting:
                    before = col
                    col = fill(col)
                    n_cells += col - before
                parts = merge_chunks(cell.parts)
                self.cell(index, r, col, head, False, parts, chain)
                n_cells += 1
                if head:
                    record["headers"].append(parts[0]["content"] if parts else "")
                across = 1
                if attrs[cell.node]:
                    down, across = self.span(cell.node, "rowspan"), self.span(cell.node, "colspan")
                    fresh += [(col + k, down - 1, parts) for k in range(across) if down > 1]
                if cell.links or cell.embedded:
                    self.attachments(cell, f"page:{self.page_id}{chain}/row:{r}/col:{col}")
                for inner in cell.tables:
                    yield inner, chain, (index, r, col)
                col += across
            if waiting:
                fill(col, upto_end=True)
            for at, left, parts in fresh:
                waiting[at] = [left, parts]
            record["n_rows"] += 1
            if r == 0:
                record["n_cols"] = n_cells

    def cell(self, table: int, row: int, col: int, head: bool, copied: bool, parts: list[dict], chain: str) -> None:
        path = f"page:{self.page_id}{chain}/row:{row}/col:{col}"
        self.cells.append({"table_index": table, "row": row, "col": col, "is_header": head, "is_propagated": copied, "chunks": parts, "prov_path": path})

    def attachments(self, region: Region, path: str) -> None:
        """Linked files, then embedded ones, below a node and outside of nested tables; once each."""
        known: set[str] = set()
        for ident, name, url in region.links + region.embedded:
            if ident not in known:
                known.add(ident)
                self.refs.append({"attachment_id": ident, "filename": name, "url": url, "prov_path": path})


def walked(page_id: str, html: str | None, keep_comments: bool, walk: type[PageWalk] = PageWalk) -> dict:
    """A page's parts, or why it has none."""
    try:
        w = walk(page_id, html or "", keep_comments)
    except Exception as e:  # noqa: BLE001  a bad page is data, not a failure of the job
        return {"page_id": page_id, "chunks": [], "tables": [], "cells": [], "refs": [], "error": f"parse_failed: {e}"[:500]}
    return {"page_id": w.page_id, "chunks": w.chunks, "tables": w.tables, "cells": w.cells, "refs": w.refs, "error": None}


#: A page whose tables are told by counting tags: no table in another, rows either in sections or right in the table, every
#: cell closed, and in a cell elements that hold text alone. In the rest of the page only what opens no region. All repeats are possessive, so a match
#: takes time in proportion to the page.
_TEXT = r"[^<]*+(?:<br ?/?>[^<]*+)*+"
_ATTRS = r"""(?:\s++[\w:-]++=(?:"[^"<>]*+"|'[^'<>]*+'|[\w%.#-]++))*+\s*+"""
def _rows(group: int) -> str:
    """One row; its cells' names are this group and the next."""
    inner = rf"<(a|b|strong|s|strike|del|u|em|i|span|code|p){_ATTRS}>{_TEXT}</\{group + 1}>{_TEXT}"
    return rf"(?:[^<]*+<tr{_ATTRS}>(?:[^<]*+<(t[dh]){_ATTRS}>{_TEXT}(?:{inner})*+</\{group}>)*+[^<]*+</tr>)"


_PLAIN = re.compile(
    rf"(?:{_TEXT}(?:</?(?:b|strong|s|strike|del|u|em|i|span|code|p|div|h[1-6]){_ATTRS}>"
    rf"|<table{_ATTRS}>(?:{_rows(1)}++|(?:[^<]*+<(thead|tbody|tfoot){_ATTRS}>{_rows(4)}*+[^<]*+</\3>)*+)[^<]*+</table>))*+{_TEXT}"
)
_LINK = re.compile(r"<a\s([^>]*)>")


def plain_refs(page_id: str, html: str, known_plain: bool = False) -> list[dict] | None:
    """What ``PageWalk`` finds as references, without a tree; None where the page is not as plain as that needs."""
    linked, lower = ATTACHMENT_PATH[1:-1] in html or "&" in html, html.lower()
    if not linked and "ri:attachment" not in lower:
        return []
    if not known_plain and ("rowspan" in lower or not _PLAIN.fullmatch(html)):
        return None
    refs, known = [], set()
    for m in _LINK.finditer(html):
        href = attributes(m[1]).get("href", "")
        if ATTACHMENT_PATH not in href:
            continue
        at = m.start()
        start, row = html.rfind("<table", 0, at), html.rfind("<tr", 0, at)
        if "span" in lower[row:at]:
            return None
        place = (html.count("<table", 0, start), html.count("<tr", start, at) - 1, html.count("<td", row, at) + html.count("<th", row, at) - 1)
        if (*place, href) not in known:
            known.add((*place, href))
            path = "page:%s/table:%d/row:%d/col:%d" % (page_id, *place)
            refs.append({"attachment_id": href, "filename": unquote(href.split("?")[0].rsplit("/", 1)[-1]), "url": href, "prov_path": path})
    return refs


def _around(html: str) -> tuple[list[dict], list[str]]:
    """Chunks of a plain page whose tables hold one text each, and the style that each table stands in."""
    walk = PageWalk("", html)
    return walk.chunks, [c["chunks"][0]["style"] for c in walk.cells]


#: What stands around tables is often the same on many pages; longer ones are not kept.
_around_kept, _KEPT_LENGTH = lru_cache(1024)(_around), 2000


def _texts(inner: str, style: str) -> list[dict]:
    """Chunks of a plain cell in a table of this style: elements in it hold text alone."""
    if "<" not in inner and "&" not in inner:
        text = inner.strip()
        return [{"content": text, "style": style}] if text else []
    parts, look = [], style
    for k, piece in enumerate(inner.split("<")):
        if k:
            tag, _, piece = piece.partition(">")
            if tag[0] == "/":
                look = style
            elif not tag.startswith("br"):
                look = STYLES.get(tag.split(None, 1)[0], style)
        text = (unescape(piece) if "&" in piece else piece).strip()
        if text:
            parts.append((text, look))
    return merge_chunks(parts)


class Cells:
    """The cells of many pages as columns, so that no cell of a plain page is an object of its own."""

    def __init__(self) -> None:
        self.ends, self.chunk_ends = [0], [0]
        self.table_index: list[int] = []
        self.row: list[int] = []
        self.col: list[int] = []
        self.is_header: list[bool] = []
        self.is_propagated: list[bool] = []
        self.content: list[str] = []
        self.style: list[str] = []
        self.prov_path: list[str] = []

    def add(self, cells: list[dict]) -> None:
        for name in ("table_index", "row", "col", "is_header", "is_propagated", "prov_path"):
            getattr(self, name).extend([c[name] for c in cells])
        for c in cells:
            self.add_chunks(c["chunks"])

    def add_row(self, page_id: str, table: int, row: int, head: bool, cols: Sequence[int]) -> None:
        """Cells of a row; their chunks are to follow."""
        n = len(cols)
        self.table_index += [table] * n
        self.row += [row] * n
        self.col += cols
        self.is_header += [head] * n
        self.is_propagated += [False] * n
        before = f"page:{page_id}/table:{table}/row:{row}/col:"
        self.prov_path += [before + str(c) for c in cols]

    def add_chunks(self, chunks: list[dict]) -> None:
        """Those of the next cell."""
        for x in chunks:
            self.content.append(x["content"])
            self.style.append(x["style"])
        self.chunk_ends.append(len(self.content))

    def end_page(self) -> None:
        self.ends.append(len(self.row))

    def array(self, kind: pa.DataType) -> pa.Array:
        fields = list(kind.value_type)
        one = list(fields[5].type.value_type)
        chunk = pa.StructArray.from_arrays([pa.array(self.content, pa.string()), pa.array(self.style, pa.string())], fields=one)
        columns = {"chunks": pa.ListArray.from_arrays(pa.array(self.chunk_ends, pa.int32()), chunk)}
        arrays = [columns[f.name] if f.name in columns else pa.array(getattr(self, f.name), f.type) for f in fields]
        return pa.ListArray.from_arrays(pa.array(self.ends, pa.int32()), pa.StructArray.from_arrays(arrays, fields=fields))


#: A cell of a plain row: its kind, attributes, text, and what follows that in it.
_CELL = re.compile(r"<t([dh])(?=[\s>])([^>]*)>([^<]*)(.*?)</t[dh]>", re.S)


def _row(row: str, style: str) -> tuple[bool, int, list[int], list[list[dict]]]:
    """Of a plain row whether it is a head, if it is the first; the number of its cells, their columns and chunks."""
    cells = _CELL.findall(row)
    cols, col = [], 0
    for _, attrs, _, _ in cells:
        cols.append(col)
        col += span(attrs, "colspan") if attrs else 1
    return bool(cells) and all(c[0] == "h" for c in cells), len(cells), cols, [_texts(text + rest, style) for _, _, text, rest in cells]


#: First rows are often the same in many tables; longer ones are not kept.
_row_kept = lru_cache(4096)(_row)
_OPEN, _BETWEEN, _CLOSE = "><td>", "</td><td>", "</td></tr>"


def plain_page(page_id: str, html: str, into: Cells | None, refs: bool = True) -> dict | None:
    """What ``walked`` gives of a page, without a tree of its tables; None where it is not as plain as that needs.

    The tree is made of what stands around the tables, with a text in each for its style; rows and cells are told by
    splitting. Cells are added to ``into``, if there is one."""
    if "rowspan" in html.lower() or not _PLAIN.fullmatch(html):
        return None
    found = plain_refs(page_id, html, True) if refs else []
    if found is None:
        return None
    first, *pieces = html.split("<table")
    around, inside = [first], []
    for piece in pieces:
        content, _, behind = piece.partition("</table>")
        inside.append(content)
        around += ["<table><tr><td>x</td></tr></table>", behind]
    frame = "".join(around)
    chunks, styles = (_around_kept if len(frame) <= _KEPT_LENGTH else _around)(frame)
    tables = []
    for index, (content, style) in enumerate(zip(inside, styles)):
        rows = content.split("<tr")[1:]
        heads, n_cols = [], 0
        for r, row in enumerate(rows if into is not None else rows[:1]):
            if r == 0:
                head, n_cols, cols, texts = (_row_kept if len(row) <= _KEPT_LENGTH else _row)(row, style)
                if head:
                    heads = [t[0]["content"] if t else "" for t in texts]
                if into is not None:
                    into.add_row(page_id, index, r, head, cols)
                    for t in texts:
                        into.add_chunks(t)
                continue
            end = row.rfind(_CLOSE)
            cells = row[len(_OPEN) : end].split(_BETWEEN)
            if not row.startswith(_OPEN) or end < len(_OPEN) or row.count("<td") + row.count("<th>") + row.count("<th ") != len(cells):  # not all as simple as that
                _, _, cols, texts = _row(row, style)
                into.add_row(page_id, index, r, False, cols)
                for t in texts:
                    into.add_chunks(t)
                continue
            into.add_row(page_id, index, r, False, range(len(cells)))
            contents, looks, ends = into.content, into.style, into.chunk_ends
            for cell in cells:
                if "<" in cell or "&" in cell:
                    into.add_chunks(_texts(cell, style))
                else:
                    cell = cell.strip()
                    if cell:
                        contents.append(cell)
                        looks.append(style)
                    ends.append(len(contents))
        tables.append({"table_index": index, "parent_table": None, "parent_row": None, "parent_col": None, "chain": f"/table:{index}", "headers": heads, "n_rows": len(rows), "n_cols": n_cols})
    return {"page_id": page_id, "chunks": chunks, "tables": tables, "refs": found, "error": None}


def read_page(page_id: str, html: str | None, keep_comments: bool, into: Cells | None, refs: bool = True) -> dict:
    """``walked``, with the cells in ``into``; tables of plain pages are told without a tree. ``refs``: whether they are asked for."""
    found = plain_page(page_id, html, into, refs) if html and "<table" in html else None
    if found is None:
        found = walked(page_id, html, keep_comments)
        if into is not None:
            into.add(found["cells"])
    if into is not None:
        into.end_page()
    return found


def linked(page_id: str, html: str | None, keep_comments: bool) -> dict:
    """``walked`` where only the references are asked for."""
    refs = plain_refs(page_id, html or "")
    return walked(page_id, html, keep_comments) if refs is None else {"page_id": page_id, "refs": refs, "error": None}


def parse_pages(pages: DataFrame, keep_comments: bool = True, id_col: str = "page_id", html_col: str = "html", parts: Sequence[str] = tuple(PARTS), carried: Sequence[str] = (), once: bool = False) -> DataFrame:
    """One row a page with nested chunks, tables, cells and references, or those of them that ``parts`` names; ``flat`` makes
    them rows. A page that cannot be parsed is a row with an ``error`` and nothing else. ``carried`` columns of the pages go along.
    ``once`` keeps of a page's references with one id the first."""
    parts = [p for p in PARTS if p in parts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = _arrow_kinds()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                some = whole.slice(at, 256)
                ids, texts = (c.to_pylist() for c in some.columns[:2])
                cells = Cells() if "cells" in parts else None
                if parts == ["refs"]:
                    found = [linked(i, h, keep_comments) for i, h in zip(ids, texts)]
                else:
                    found = [read_page(i, h, keep_comments, cells, "refs" in parts) for i, h in zip(ids, texts)]
                if once:
                    for w in found:
                        first: dict[str, dict] = {}
                        for r in w["refs"]:
                            first.setdefault(r["attachment_id"], r)
                        w["refs"] = list(first.values())
                columns = [cells.array(kinds[name]) if name == "cells" else _column([w[name] for w in found], kinds[name]) for name in ("page_id", *parts, "error")]
                yield pa.RecordBatch.from_arrays([*columns, *some.columns[2:]], ["page_id", *parts, "error", *carried])

    more = pages.select(*carried)
    schema = ", ".join(["page_id string", *(f"{p} {PARTS[p]}" for p in parts), "error string", *(f"{c} {more.schema[c].dataType.simpleString()}" for c in carried)])
    return pages.select(F.col(id_col).cast("string"), F.col(html_col).cast("string"), *carried).mapInArrow(run, schema)


def _column(values: list, kind: pa.DataType) -> pa.Array:
    """Lists and dicts as one array for each field, without a look at each value's type; lists and dicts are never null."""
    if pa.types.is_list(kind):
        ends = pa.array([0, *accumulate(map(len, values))], pa.int32())
        return pa.ListArray.from_arrays(ends, _column(list(chain.from_iterable(values)), kind.value_type))
    if pa.types.is_struct(kind):
        return pa.StructArray.from_arrays([_column([v[name] for v in values], f.type) for f in kind for name in (f.name,)], fields=list(kind))
    return pa.array(values, kind)


def _arrow_kinds() -> dict[str, pa.DataType]:
    s, i, b = pa.string(), pa.int32(), pa.bool_()
    chunks = pa.list_(pa.struct([("content", s), ("style", s)]))
    tables = pa.struct(
        [("table_index", i), ("parent_table", i), ("parent_row", i), ("parent_col", i), ("chain", s), ("headers", pa.list_(s)), ("n_rows", i), ("n_cols", i)]
    )
    cells = pa.struct([("table_index", i), ("row", i), ("col", i), ("is_header", b), ("is_propagated", b), ("chunks", chunks), ("prov_path", s)])
    refs = pa.struct([("attachment_id", s), ("filename", s), ("url", s), ("prov_path", s)])
    return {"page_id": s, "chunks": chunks, "tables": pa.list_(tables), "cells": pa.list_(cells), "refs": pa.list_(refs), "error": s}


def flat(parsed: DataFrame, what: str) -> DataFrame:
    """Rows of ``chunks``, ``tables``, ``cells`` or ``refs``, with their place ``seq`` in the page and what it carried along."""
    carried = [c for c in parsed.columns if c not in ("page_id", *PARTS, "error")]
    return parsed.select("page_id", *carried, F.posexplode(what).alias("seq", "x")).select("page_id", "seq", "x.*", *carried)


def runs_of(items: str, *keys: str) -> Column:
    """Places in the array column ``items`` of structs at which one of the fields ``keys`` is not what it was before. The column is
    looked up by place, so it should be one that is there and not an expression."""
    other = lambda x, i: reduce(Column.__or__, [~F.get(items, i - 1)[k].eqNullSafe(x[k]) for k in keys], i == 0)
    return F.filter(F.transform(items, lambda x, i: F.when(other(x, i), i)), lambda i: i.isNotNull())


def run_at(items: str, starts: str, start: Column, k: Column) -> Column:
    """The structs of ``items`` from the ``k``-th of ``starts`` up to the next."""
    return F.slice(items, start + 1, F.coalesce(F.get(starts, k + 1), F.size(items)) - start)


def merge_runs(chunks: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Neighbouring rows of equal ``style`` become one, contents joined with a space."""
    by = W.partitionBy(*keys).orderBy(order)
    new = (~F.col("style").eqNullSafe(F.lag("style").over(by))).cast("int")
    runs = chunks.withColumn("_new", new).withColumn("run", F.sum("_new").over(by.rowsBetween(W.unboundedPreceding, 0)) - 1)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "content"))), lambda x: x["content"]), " ")
    return runs.groupBy(*keys, "run").agg(F.first("style").alias("style"), joined.alias("content"))


def prov_path(page: Column, chain: Column, row: Column, col: Column, attachment: Column) -> Column:
    """``page:P/table:i[/row:r/col:c].../row:r/col:c/attachment:A``; ``chain`` holds structs of index, row and col."""
    step = F.transform(
        chain, lambda t: F.concat(F.lit("table:"), t["idx"].cast("string"), F.coalesce(F.concat(F.lit("/row:"), t["row"], F.lit("/col:"), t["col"]), F.lit("")))
    )
    place = F.concat(F.lit("row:"), row, F.lit("/col:"), col)
    return F.concat_ws("/", F.concat(F.lit("page:"), page), step, place, F.concat(F.lit("attachment:"), attachment))


def expand_rowspans(raw: DataFrame) -> DataFrame:
    """Cells ``(page_id, table_index, row, col, rowspan, colspan, text)`` with the copies that spans of rows make."""
    rows = raw.withColumn("down", F.explode(F.sequence(F.lit(0), F.greatest("rowspan", F.lit(1)) - 1)))
    rows = rows.withColumn("right", F.explode(F.when(F.col("down") == 0, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.greatest("colspan", F.lit(1)) - 1))))
    return rows.select(
        "page_id", "table_index", (F.col("row") + F.col("down")).alias("row"), (F.col("col") + F.col("right")).alias("col"), "text", (F.col("down") > 0).alias("is_propagated")
    )


def html_links(pages: DataFrame) -> DataFrame:
    """``(page_id, href)`` of each distinct link, however it is quoted; not those in comments and scripts."""

    @F.pandas_udf("array<string>")
    def links(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for htmls in batches:
            rows = []
            for html in htmls:
                dom = parse_dom(html or "")
                found = (dom.attributes(node).get("href") for node, tag in enumerate(dom.tag) if tag == "a")
                rows.append(list(dict.fromkeys(h for h in found if h is not None)))
            yield pd.Series(rows)

    return pages.select("page_id", F.explode(links("html")).alias("href"))
