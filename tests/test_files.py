import io
import random
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from lattica.operators import attach
from lattica.plans import runs
from lattica.sources import files


def archive(parts, pack=zipfile.ZIP_STORED, comment=b""):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", pack) as z:
        for name, text in parts:
            z.writestr(name, text)
        z.comment = comment
    return data.getvalue()


PARTS = [("a.xml", b"<a>1</a>" * 50), ("b/c.xml", "é".encode()), ("empty", b"")]


def answer(read, name):
    try:
        return read(name)
    except Exception as e:  # noqa: BLE001
        return type(e), str(e)


def test_plain_archives_are_read_without_zipfile(monkeypatch):
    plain = [archive(PARTS), archive(PARTS, zipfile.ZIP_DEFLATED)]
    monkeypatch.setattr(zipfile, "ZipFile", None)
    for data in plain:
        assert [(n, files.Archive(data).read(n)) for n in files.Archive(data).namelist()] == PARTS


def test_any_archive_reads_as_by_zipfile():
    """Also hurt ones: each byte of two archives changed, and cuts, which give the same texts or the same errors."""
    whole = [archive(PARTS), archive(PARTS, zipfile.ZIP_DEFLATED), archive(PARTS, comment=b"note"), b"junk" + archive(PARTS), archive([("é", b"x")]), archive(PARTS * 2)]
    hurt = [w[:k] + bytes([w[k] ^ bit]) + w[k + 1 :] for w in whole[:2] for k in range(len(w)) for bit in (1, 64)] + [whole[0][:k] for k in range(0, len(whole[0]), 7)]
    for data in whole + hurt:
        want = answer(lambda n: (z := zipfile.ZipFile(io.BytesIO(data))) and (z.namelist(), [answer(z.read, x) for x in [*z.namelist(), "none"]]), "")
        got = answer(lambda n: (z := files.Archive(data)) and (z.namelist(), [answer(z.read, x) for x in [*z.namelist(), "none"]]), "")
        assert got == want


def documents(rng):
    word = lambda: rng.choice(["", "x", " a b ", "ñ]", "&amp;", "&#65;", "<!--c-->", "\r\n", "line\n2", "<![CDATA[<w:t>]]>", "\x85"])
    many = lambda f, n: "".join(f() for _ in range(rng.randrange(n)))
    text = lambda: rng.choice(["<w:t>{}</w:t>", '<w:t xml:space="preserve">{}</w:t>', "<w:t/>", "<m:t>{}</m:t>", "<w:tab/>"] if odd else ["<w:t>{}</w:t>"]).format(word() if odd else rng.choice(["", "x", " a b ", "ñ]", "l\n2"]))
    paragraph = lambda: f"<w:p>{rng.choice(['', '<w:pPr/>']) if odd else ''}{many(lambda: f'<w:r>{many(text, 3)}</w:r>', 3)}</w:p>"
    table = lambda deep=0: f"<w:tbl>{many(lambda: f'<w:tr>{many(lambda: f'<w:tc>{many(paragraph, 3)}{table(1) if odd and not deep and rng.random() < 0.2 else str()}</w:tc>', 3)}</w:tr>', 3)}</w:tbl>"
    for k in range(600):
        odd = k % 2
        start = rng.choice(["", '<?xml version="1.0" encoding="UTF-8"?>']) if odd else ""
        space = rng.choice(['xmlns:w="u" xmlns:m="m"', 'xmlns:w="u"', 'xmlns:w="u" xmlns:w="v"', ""]) if odd else 'xmlns:w="u"'
        yield f"{start}<w:document {space}><w:body>{many(lambda: rng.choice([paragraph, table])(), 5)}</w:body></w:document>".encode()


def sheets(rng):
    def cell(k):
        place, kind = rng.choice(["", "", f' r="{rng.choice(["A", "C", "AB"])}{k}"']), rng.choice(["", "n", "s", "inlineStr", "str"])
        inner = rng.choice(["", "<v>1</v>", "<v></v>", "<v>0</v>", "<is><t>a b</t></is>", "<is><t></t></is>", "<is><t>é</t><t>2</t></is>", "<f>x</f><v>3</v>", "<v>&lt;</v>"])
        return f'<c{place}{rng.choice(["", chr(32) + "s=" + chr(34) + "2" + chr(34)])}' + (f' t="{kind}"' if kind else "") + f">{inner}</c>"

    for _ in range(600):
        rows = "".join(f'<row{rng.choice(["", chr(32) + "r=" + chr(34) + "3" + chr(34)])}>{"".join(cell(k) for k in range(rng.randrange(4)))}</row>' for _ in range(rng.randrange(4)))
        yield f"<worksheet{rng.choice(['', chr(32) + 'xmlns=' + chr(34) + 'u' + chr(34), ' a'])}><sheetData>{rows}</sheetData></worksheet>".encode()


@pytest.mark.parametrize("kind", ["docx", "excel"])
def test_plain_parts_read_as_by_the_tree(monkeypatch, kind):
    rng, plain, seen = random.Random(4), files._plain, []
    if kind == "docx":
        made = [archive([("word/document.xml", d)]) for d in documents(rng)]
    else:
        book = lambda: rng.choice(['<workbook><sheets><sheet name="S 1"/></sheets></workbook>', '<workbook><sheets><sheet name="A &amp; B" sheetId="1"/></sheets></workbook>', '<workbook xmlns:r="r"><sheets><sheet name="T" r:id="x"/></sheets></workbook>'])
        strings = "<sst><si><t>first</t></si><si><t>se</t><t>cond</t></si></sst>"
        made = [archive([("xl/workbook.xml", book()), ("xl/worksheets/sheet1.xml", s), ("xl/sharedStrings.xml", strings)]) for s in sheets(rng)]
    read = lambda: [answer(lambda d: files.EXTRACTORS[kind](d, "f"), d) for d in made]
    monkeypatch.setattr(files, "_plain", lambda *a: (seen.append(plain(*a)), seen[-1])[1])
    got = read()
    monkeypatch.setattr(files, "_plain", lambda *a: None)
    assert got == read()
    assert 200 < sum(x is not None for x in seen) < len(seen) - 100


def test_lines_are_read_once_for_all_kinds_of_files(spark, tmp_path):
    at = {"l_partkey": "id", "l_quantity": "1.0D", "l_orderkey": "id % 3"}
    lines = spark.range(9).select(*(F.expr(at.get(c, "0")).alias(c) for c in {"l_orderkey", *runs.src.LINE_ORDER}))
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(3).select(F.col("id").alias("o_orderkey")).write.parquet(f"{tmp_path}/orders.parquet")
    found = runs.office_files(spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1 and "Union" not in plan and plan.count("lineitem") <= 1
    assert found.count() == 9 and found.where("error IS NULL AND rows = 3").count() == 6
    packed = {r.attachment_id: r.content for r in runs._office_files(spark.createDataFrame([("p", "a<&\"b", [["<", "&"]])], "page_id string, head string, rows array<array<string>>")).collect()}
    for kind, n in (("docx", 1), ("excel", 2)):
        z = zipfile.ZipFile(io.BytesIO(packed[kind]))
        assert z.testzip() is None and len(z.namelist()) == n == len(files._directory(bytes(packed[kind])))
    assert "Python" not in runs._office_files(spark.createDataFrame([("p", "h", [["1", "2"]])], "page_id string, head string, rows array<array<string>>"))._jdf.queryExecution().executedPlan().toString()
    assert files.read_docx(bytes(packed["docx"]), "") == ('a<&"b\n<\n&', [[["<", "&"]]]) and files.read_xlsx(bytes(packed["excel"]), "")[0] == '[Sheet: a<&"b]\n< | &'


def test_extracted_columns(spark):
    df = spark.createDataFrame([(1, "a", None, "docx", b"")], "page_id long, attachment_id string, filename string, kind string, content binary")
    assert attach.extract_text(df, files.EXTRACTORS).schema == attach.EXTRACTED
    assert struct.calcsize("<4s4H2LH") == files._END.size
