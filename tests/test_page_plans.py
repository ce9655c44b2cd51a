import random

import pytest
from pyspark.sql import functions as F

from lattica.operators import attach, graph, normalize, parse, search
from lattica.plans import registry
from lattica.plans.ingest import ingest

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_only_what_is_asked_for_is_built(spark):
    html = "<p>t</p><table><tr><th>H</th></tr><tr><td>a<a href='/download/attachments/1/f.pdf'>f</a></td></tr></table>"
    pages = spark.createDataFrame([("1", html, 7)], "page_id string, html string, day int")
    whole = parse.parse_pages(pages)
    for name in parse.PARTS:
        some = parse.parse_pages(pages, parts=[name], carried=["day"])
        assert some.columns == ["page_id", name, "error", "day"]
        rows = parse.flat(some, name)
        assert rows.where("day <> 7").isEmpty() and sorted(map(repr, rows.drop("day").collect())) == sorted(map(repr, parse.flat(whole, name).collect()))


@pytest.mark.parametrize("name", ["batch_normalize", "ingest_vectors", "collect_text", "page_part_edges"])
def test_pages_are_parsed_once(spark, name):
    """What the parts of these plans read is stored; no part parses the pages again."""
    assert "MapInArrow" not in plan(registry.queries()[name](spark, SF))


def test_a_page_is_walked_in_one_pass():
    """No part of the tree is visited again for texts, tables or links: each node's tag is read a few times at most."""

    class Counted(list):
        reads = 0

        def __getitem__(self, k):
            Counted.reads += 1
            return super().__getitem__(k)

    made = parse.parse_dom

    def counting(html):
        dom = made(html)
        dom.tag = Counted(dom.tag)
        return dom

    html = "<table>" + "".join(f"<tr><td><b>{k}</b></td><td><i>x</i></td></tr>" for k in range(500)) + "</table>"
    parse.parse_dom = counting
    try:
        walk = parse.PageWalk("1", html)
    finally:
        parse.parse_dom = made
    assert len(walk.cells) == 1000 and Counted.reads <= 2 * len(walk.dom.tag)


def test_a_snapshot_does_not_deal_the_pages(spark):
    events = spark.createDataFrame([("e1", "1", ["p"], 1, False), ("e2", "2", ["p"], 2, False), ("e3", "2", ["q"], 3, False)], "_id string, page_id string, project_ids array<string>, timestamp int, is_deleted boolean")
    pages = spark.createDataFrame([("1", "One", False), ("2", "Two", False)], "page_id string, title string, is_deleted boolean")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = search.project_snapshot(events, pages, "p")
        assert [(r._id, r.page_title) for r in found.collect()] == [("e2", "Two")]
        assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_references_of_plain_pages_need_no_tree(monkeypatch):
    """Pages made at random: what counting tags finds is what the tree gives, and ordinary pages of tables are never walked."""
    rng = random.Random(7)
    link = "<a class='q' href='/download/attachments/%d/x%%20y.pdf?v=1&amp;x=2'>f</a>"
    texts = ["", "x", "<b>y</b> z", "<p>k<br></p>", "<a href=/q>n</a>"]
    cell = lambda: (t := rng.choice(("td", "th"))) and f"<{t}{' colspan=2' if rng.random() < 0.03 else ''}>{rng.choice(texts)}{link % rng.randrange(3) if rng.random() < 0.5 else ''}</{t}>"
    rows = lambda: "".join("<tr>" + "".join(cell() for _ in range(rng.randrange(4))) + "</tr>\n" for _ in range(rng.randrange(4)))
    table = lambda: "<table>" + rng.choice((rows(), f"<thead>{rows()}</thead><tbody>{rows()}</tbody>")) + "</table>"
    odd = ["</s>", "<td>", "<td rowspan=2>", "</tr>", "<table>", "</table>", "<!-- <tr> -->", "<li>", "<script>", "<ri:attachment ri:filename=f />", "</td>", link % 4]
    plain = 0
    for k in range(4000):
        html = "".join(rng.choice(("<s>", "</s>", "<p>", "text", "")) + table() for _ in range(rng.randrange(4)))
        if k % 2:
            at = rng.randrange(len(html) + 1)
            html = html[:at] + rng.choice(odd) + html[at:]
        found = parse.plain_refs("p", html)
        assert found is None or found == parse.walked("p", html, True)["refs"], html
        plain += bool(found)
    assert plain > 200
    monkeypatch.setattr(parse, "walked", None)
    assert parse.linked("p", f"<s><table><tbody><tr><td>1</td><td>{link % 1}</td></tr></tbody></table></s><p>Total:</p><table><tr><td colspan=2>x</td></tr></table>", True)["refs"]


def test_references_once_a_page_need_no_exchange(spark):
    pages = spark.createDataFrame([("p", "<table><tr><td><a href='/download/attachments/1/x'>f</a></td><td><a href='/download/attachments/1/x'>f</a></td></tr></table>"), ("q", None)], "page_id string, html string")
    refs = parse.flat(parse.parse_pages(pages, parts=["refs"], once=True), "refs").withColumnRenamed("seq", "ord")
    none = F.broadcast(spark.createDataFrame([], "page_id string, pos long, filename string, attachment_id string, url string, size long"))
    found = attach.reconcile(refs, none, once=True)
    assert [r.prov_path for r in found.collect()] == ["page:p/table:0/row:0/col:0"]
    shown = found.select("attachment_id", "prov_path")._jdf.queryExecution().executedPlan().toString()
    assert shown.count("Exchange hashpartitioning(page_id") == 1 and "filename#" in shown.split("Exchange hashpartitioning(page_id")[1].split(")")[0]  # that of the metadata


def random_pages(n):
    """Pages of tables, every other with something odd at some place."""
    rng = random.Random(11)
    texts = ["", "x", " y ", "<b>y</b> z", "a&amp;b", "<p>k<br></p>m", "<del>7</del>", "<s>g</s> <i>h</i>", "<a href='/download/attachments/1/f%20g.pdf?v=1&amp;x=2'>f</a>", "u<br/>v", "\u00a0w\x1c"]
    cell = lambda t: f"<{t}{rng.choice(('', '', '', ' colspan=2', ' class=q', chr(10) + 'id=i'))}>{rng.choice(texts)}</{t}>"
    row = lambda t=None: "<tr>" + rng.choice(("", "", " ")).join(cell(t or rng.choice(("td", "td", "td", "th"))) for _ in range(rng.randrange(5))) + "</tr>" + rng.choice(("", chr(10)))
    rows = lambda: rng.choice((row("th"), row(), "")) + "".join(row("td") for _ in range(rng.randrange(4)))
    table = lambda: rng.choice(("<table>", "<table class='t'>")) + rng.choice((rows(), f"<thead>{row('th')}</thead><tbody>{rows()}</tbody>")) + "</table>"
    odd = ["</s>", "<td>", "<td rowspan=2>", "</tr>", "<table>", "</table>", "<!-- <tr> -->", "<li>", "<script>", "<ri:attachment ri:filename=f />", "</td>", "<table><tr><td>n</td></tr></table>", "&quot", "<del>"]
    for k in range(n):
        html = "".join(rng.choice(("<s>", "</s>", "<p>", "<b>q</b>", "text", "")) + table() for _ in range(rng.randrange(1, 4))) + rng.choice(("", "<p>e"))
        if k % 2:
            at = rng.randrange(len(html) + 1)
            html = html[:at] + rng.choice(odd) + html[at:]
        yield html


def test_tables_of_plain_pages_need_no_tree(monkeypatch):
    """What splitting finds is what the tree gives, and ordinary pages of tables are never walked."""
    kind, plain = parse._arrow_kinds()["cells"], 0
    for html in random_pages(4000):
        want, cells = parse.walked("p", html, True), parse.Cells()
        found = parse.plain_page("p", html, cells)
        plain += found is not None
        if found is not None:
            cells.end_page()
            assert found | {"cells": cells.array(kind).to_pylist()[0]} == want, html
            assert parse.plain_page("p", html, None, False)["tables"] == want["tables"], html
    assert plain > 1500
    monkeypatch.setattr(parse, "walked", None)
    page = "<h1>O</h1><s><table><thead><tr><th>Part <b>no</b></th></tr></thead><tbody><tr><td>1</td><td><del>2</del></td></tr></tbody></table></s><p>Total:</p><table><tr><td colspan=2>x</td></tr></table>"
    assert [t["n_rows"] for t in parse.read_page("p", page, True, parse.Cells())["tables"]] == [2, 1]


def test_rows_and_texts_of_tables_are_made_in_their_page(spark):
    """Without a join or an exchange by page, and the same as by joins and groups, for odd pages too."""
    whole = parse.parse_pages(spark.createDataFrame(list(enumerate(random_pages(150))), "page_id long, html string"))
    head = "<table><tr><th>Part</th><th>No</th><th>part</th></tr>"
    pages = [f"{head}<tr><td>1</td><td>2</td><td>{x}</td></tr><tr><td></td></tr>{y}</table>" for x in ("", "<s>3</s>", "<table><tr><td>Part</td><td>No</td></tr><tr><td>8</td><td>9</td></tr></table>") for y in ("", "<tr><td rowspan=2>4<td colspan=2>5</tr><tr></tr>")]
    whole = whole.union(parse.parse_pages(spark.createDataFrame([(f"q{k}", h) for k, h in enumerate(pages)], "page_id string, html string"))).cache()
    tables, cells = parse.flat(whole, "tables"), parse.flat(whole, "cells")
    top = tables.where("parent_table IS NULL").select("page_id", "table_index", "headers")
    named = cells.join(top, ["page_id", "table_index"]).withColumns({"header": F.get("headers", F.col("col")), "text": normalize.cell_text(F.col("chunks"))})
    want = sorted(map(tuple, graph.row_texts(named).where("text <> ''").collect()))
    assert sorted(map(tuple, graph.page_row_texts(whole, "page_id").select("page_id", F.inline("rows")).collect())) == want and len(want) > 200

    schemas = spark.createDataFrame([(0, "s", ["part", "no"], {"Part": "part", "No": "no", "x": "no"}), (1, "t", ["x"], {"x": "x", "y": "x"})], "schema_ord int, schema_id string, canonical_columns array<string>, column_mapping map<string,string>")
    ordered = lambda df: df.withColumn("ord", F.concat_ws(":", "page_id", "table_index"))
    rows = lambda df, key: sorted((r[key], r.row, str(r["values"]), str(r.cancelled_fields), r.schema_id) for r in df.collect())
    want = rows(normalize.prepare_and_consolidate(ordered(normalize.fingerprints(tables, cells)), ordered(cells), schemas), "ord")
    found = normalize.consolidate_pages(whole, schemas)
    assert rows(ordered(found), "ord") == want and len(want) > 12
    assert "Exchange hash" not in found._jdf.queryExecution().executedPlan().toString()
    whole.unpersist()
    texts = ingest(spark.createDataFrame([("1", pages[0])], "page_id string, html string"), embedder=lambda t: [[0.0]] * len(t))["vectors"]
    assert "Join" not in plan(texts) and texts.where("kind = 'row'").count() == 2
