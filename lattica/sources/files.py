"""Text of office files by the standard library alone; other kinds by plug-ins where their library is installed."""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Collection, Iterator
from functools import lru_cache
from typing import Protocol
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class FileExtractor(Protocol):
    """``(content, file name)`` to the text and the tables (lists of rows of cells) of a file."""

    def __call__(self, content: bytes, filename: str) -> tuple[str, list[list[list[str]]]]: ...


# --- archives ----------------------------------------------------------------------------------------------------

_END, _ENTRY, _LOCAL = struct.Struct("<4s4H2LH"), struct.Struct("<4s6H3L5H2L"), struct.Struct("<4s5H3L2H")
#: Flags of an entry that change nothing here: options of the packer, sizes repeated after the data, UTF-8 names.
_FLAGS = 0x80E


def _directory(content: bytes) -> dict[str, tuple[int, ...]] | None:
    """Entries by name of an archive of the plainest form: one piece, nothing before or after, parts in order, stored or
    deflated, ASCII names without extra fields; None for any other."""
    at = len(content) - _END.size
    if at < 0:
        return None
    mark, disk, first, _, _, size, start, comment = _END.unpack_from(content, at)
    if mark != b"PK\5\6" or disk or first or comment or start + size != at:
        return None
    rows, p = [], start
    while p < at:
        if p + _ENTRY.size > at:
            return None
        mark, _, need, flags, method, _, _, crc, packed, size, n, extra, note, disk, _, _, offset = _ENTRY.unpack_from(content, p)
        name = content[p + _ENTRY.size : p + _ENTRY.size + n]
        p += _ENTRY.size + n
        if mark != b"PK\1\2" or need > 63 or flags & ~_FLAGS or method not in (0, 8) or extra or note or disk or not name.isascii() or p > at:
            return None
        rows.append((name.decode("ascii"), offset, method, crc, packed, size))
    ends = [r[1] for r in rows[1:]] + [start]
    found = {name: (offset, end, *rest) for (name, offset, *rest), end in zip(rows, ends) if offset < end and name.isprintable()}
    return found if len(found) == len(rows) else None


class Archive:
    """Names and parts of a zip archive. ``zipfile`` takes longer to open a small file than its text takes to read, so
    plain archives are read in place; all others, and parts that do not fit their entry, are left to ``zipfile``."""

    def __init__(self, content: bytes) -> None:
        self._content, self._entries = content, _directory(content)
        self._zip = zipfile.ZipFile(io.BytesIO(content)) if self._entries is None else None

    def namelist(self) -> list[str]:
        return self._zip.namelist() if self._zip else list(self._entries)

    def read(self, name: str) -> bytes:
        if self._zip is None:
            data = self._plain(name)
            if data is not None:
                return data
            self._zip = zipfile.ZipFile(io.BytesIO(self._content))
        return self._zip.read(name)

    def _plain(self, name: str) -> bytes | None:
        entry = self._entries.get(name)
        if entry is None:
            return None
        offset, end, method, crc, packed, size = entry
        at = offset + _LOCAL.size
        if at > end:
            return None
        mark, *_, n, extra = _LOCAL.unpack_from(self._content, offset)
        data = self._content[at + n + extra : at + n + extra + packed]
        if mark != b"PK\3\4" or self._content[at : at + n] != name.encode("ascii") or at + n + extra + packed > end:
            return None
        if method:
            unpacker = zlib.decompressobj(-15)
            try:
                data = unpacker.decompress(data)
            except zlib.error:
                return None
            if not unpacker.eof:
                return None
        return data if len(data) == size and zlib.crc32(data) == crc else None


# --- trees -------------------------------------------------------------------------------------------------------


@lru_cache(1024)
def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _parts(archive: Archive, pattern: str) -> list[str]:
    found = [n for n in archive.namelist() if re.fullmatch(pattern, n)]
    return sorted(found, key=lambda n: [int(x) for x in re.findall(r"\d+", n)])


class Tree:
    """A part with the tags that it has of each local name: mostly one, by which elements are found without a look at all."""

    def __init__(self, data: bytes) -> None:
        self.root = ElementTree.fromstring(data)
        self._tags: dict[str, list[str]] = {}
        for tag in {x.tag for x in self.root.iter()}:
            self._tags.setdefault(_local(tag), []).append(tag)

    def tags(self, name: str) -> Collection[str]:
        return self._tags.get(name, ())

    def each(self, node: ElementTree.Element, name: str) -> Iterator[ElementTree.Element]:
        """The node and all below it that have a local name, in order."""
        tags = self.tags(name)
        if len(tags) == 1:
            return node.iter(tags[0])
        return (x for x in node.iter() if x.tag in tags) if tags else iter(())

    def texts(self, node: ElementTree.Element) -> str:
        return "".join([x.text or "" for x in self.each(node, "t")])

    def table(self, node: ElementTree.Element) -> list[list[str]]:
        """The rows of a table; the text of a table in a cell belongs to the cell."""
        rows, cells = self.tags("tr"), self.tags("tc")
        return [[self.texts(c).strip() for c in row if c.tag in cells] for row in node if row.tag in rows]


# --- plain parts ---------------------------------------------------------------------------------------------------
# Parts of tags and texts alone, without properties, entities or comments, as simple writers make them. Each pattern
# spells out a whole part, so what it fits is well formed; all other parts go through the tree.

_TEXT = r"[^<>&\x00-\x08\x0b-\x1f\ufffe\uffff]*+"
_RUNS = rf'<w:p>(?:<w:r>(?:<w:t(?: xml:space="preserve")?>{_TEXT}</w:t>)*+</w:r>)*+</w:p>'
_DOCUMENT = re.compile(rf"(<w:document[^<>&]*+>)<w:body>((?:{_RUNS}|<w:tbl>(?:<w:tr>(?:<w:tc>(?:{_RUNS})*+</w:tc>)*+</w:tr>)*+</w:tbl>)*+)</w:body></w:document>")
_CELL = rf'<c(?: r="[A-Z]+[0-9]+")?(?: s="[0-9]+")?(?: t="inlineStr"><is><t>{_TEXT}</t></is>|(?: t="[a-z]+")?>(?:<v>{_TEXT[:-2]}++</v>)?)</c>'
_ROW = r'<row(?: r="[0-9]+")?(?: spans="[0-9: ]+")?>'
_SHEET = re.compile(rf"(<worksheet[^<>&]*+>)<sheetData>((?:{_ROW}(?:{_CELL})*+</row>)*+)</sheetData></worksheet>")
_BOOK = re.compile(r'(<workbook[^<>&]*+>)<sheets>((?:<sheet name="[^<>&"\x00-\x1f\ufffe\uffff]*+"(?: sheetId="[0-9]+")?/>)*+)</sheets></workbook>')
#: In such parts: a text, which only a run has; a cell of a sheet or the end of its row.
_RUN = re.compile(">([^<]+)")
_VALUES = re.compile(r'<c(?: r="([A-Z]+)[0-9]+")?(?: s="[0-9]+")?(?: t="([A-Za-z]+)")?>(?:<is><t>|<v>)?([^<]*)|</(row)>')
_NAME = re.compile('name="([^"]*)"')


@lru_cache(1024)
def _well_formed(tag: str) -> bool:
    """Of the first tag of a part: its attributes and namespaces."""
    try:
        ElementTree.fromstring(f"{tag}</{tag[1:].split()[0].rstrip('>')}>")
    except ElementTree.ParseError:
        return False
    return True


def _plain(form: re.Pattern[str], data: bytes) -> str | None:
    """What is within a part of a plain form; None for any other part."""
    try:
        found = form.fullmatch(data.decode("utf-8"))
    except UnicodeDecodeError:
        return None
    return found[2] if found and _well_formed(found[1]) else None


def _plain_document(body: str) -> tuple[list[str], list[list[list[str]]]]:
    first, *pieces = body.split("<w:tbl>")
    inside, outside, texts = [], [first], _RUN.findall
    for piece in pieces:
        table, _, after = piece.partition("</w:tbl>")
        inside.append(table)
        outside.append(after)
    lines = ["".join(texts(p)) for piece in outside for p in piece.split("</w:p>")[:-1]]
    return lines, [[["".join(texts(c)).strip() for c in row.split("</w:tc>")[:-1]] for row in t.split("</w:tr>")[:-1]] for t in inside]


def read_docx(content: bytes, filename: str) -> tuple[str, list[list[list[str]]]]:
    """Paragraphs, then the cells of tables."""
    data = Archive(content).read("word/document.xml")
    plain = _plain(_DOCUMENT, data)
    lines, tables = _document(data) if plain is None else _plain_document(plain)
    lines += [c for t in tables for row in t for c in row]
    return "\n".join([x for x in lines if x.strip()]), tables


def _document(data: bytes) -> tuple[list[str], list[list[list[str]]]]:
    tree = Tree(data)
    body, of_text, of_table = tree.root[0], tree.tags("p"), tree.tags("tbl")
    lines = [tree.texts(p) for p in body if p.tag in of_text]
    return lines, [tree.table(t) for t in body if t.tag in of_table]


def read_pptx(content: bytes, filename: str) -> tuple[str, list[list[list[str]]]]:
    """A heading for each slide, the lines of its frames and the cells of its tables."""
    lines, tables = [], []
    archive = Archive(content)
    for n, name in enumerate(_parts(archive, r"ppt/slides/slide\d+\.xml"), 1):
        slide = Tree(archive.read(name))
        lines.append(f"[Slide {n}]")
        found = [slide.table(t) for t in slide.each(slide.root, "tbl")]
        inside = {id(p) for t in slide.each(slide.root, "tbl") for p in t.iter()}
        lines += [s for p in slide.each(slide.root, "p") if id(p) not in inside and (s := slide.texts(p).strip())]
        lines += [c for t in found for row in t for c in row if c]
        tables += found
    return "\n".join(lines), tables


def _sheets(archive: Archive) -> list[tuple[str, str]]:
    """Title and part of each sheet in the order of the workbook, whose relations name the parts."""
    data = archive.read("xl/workbook.xml")
    plain = _plain(_BOOK, data)
    parts, names = _parts(archive, r"xl/worksheets/sheet\d+\.xml"), archive.namelist()
    targets: dict[str, str] = {}
    if "xl/_rels/workbook.xml.rels" in names:
        for r in ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels")):
            target = r.get("Target", "")
            targets[r.get("Id", "")] = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    if plain is None:
        book = Tree(data)
        sheets = [(x.get("name", ""), next((v for k, v in x.items() if k.endswith("}id")), "")) for x in book.each(book.root, "sheet")]
    else:
        sheets = [(name, "") for name in _NAME.findall(plain)]
    found = [(name, targets.get(relation) or (parts[at] if at < len(parts) else "")) for at, (name, relation) in enumerate(sheets)]
    return [(name, part) for name, part in found if part in names]


@lru_cache(1024)
def _column(letters: str) -> int:
    at = 0
    for letter in letters:
        at = at * 26 + ord(letter) - 64
    return at


def _rows(data: bytes) -> Iterator[list[tuple[str, str | None, str | None]]]:
    """The cells of each row of a sheet: column, kind and text."""
    plain = _plain(_SHEET, data)
    if plain is not None:
        row = []
        for column, kind, text, end in _VALUES.findall(plain):
            if end:
                yield row
                row = []
            else:
                row.append((column, kind, text or None))
        return
    sheet = Tree(data)
    of_value = sheet.tags("v")
    for row in sheet.each(sheet.root, "row"):
        cells = []
        for c in row:
            kind = c.get("t")
            text = sheet.texts(c) if kind == "inlineStr" else next((v.text or "" for v in c if v.tag in of_value), None)
            cells.append((re.match(r"[A-Z]*", c.get("r", ""))[0], kind, text))
        yield cells


def read_xlsx(content: bytes, filename: str) -> tuple[str, list[list[list[str]]]]:
    """A heading for each sheet and its rows, cells parted by bars; blank rows are left out."""
    lines, tables = [], []
    archive = Archive(content)
    shared: list[str] = []
    if "xl/sharedStrings.xml" in archive.namelist():
        strings = Tree(archive.read("xl/sharedStrings.xml"))
        shared = [strings.texts(x) for x in strings.root if x.tag in strings.tags("si")]
    for title, name in _sheets(archive):
        rows = []
        for row in _rows(archive.read(name)):
            cells: dict[int, str] = {}
            for column, kind, text in row:
                if kind == "s" and text is not None:
                    text = shared[int(text)]
                cells[_column(column) - 1 if column else len(cells)] = text or ""
            values = [cells.get(k, "") for k in range(max(cells, default=-1) + 1)]
            if "".join(values).strip():
                rows.append(values)
        lines += [f"[Sheet: {title}]", *[" | ".join(r) for r in rows]]
        tables.append(rows)
    return "\n".join(lines), tables


def read_pdf(content: bytes, filename: str) -> tuple[str, list[list[list[str]]]]:
    """Needs the optional library pypdf; without it the row gets an error."""
    from pypdf import PdfReader

    return "\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(content)).pages), []


def image_reader(describe) -> FileExtractor:
    """An extractor of images by a vision provider ``describe(content, media_type) -> text``."""
    kinds = {"png": "image/png", "gif": "image/gif", "webp": "image/webp", "bmp": "image/bmp"}

    def read(content: bytes, filename: str) -> tuple[str, list[list[list[str]]]]:
        return describe(content, kinds.get(filename.rpartition(".")[2].lower(), "image/jpeg")), []

    return read


EXTRACTORS = {"docx": read_docx, "pptx": read_pptx, "excel": read_xlsx, "pdf": read_pdf}


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``(filename, path, content, size)`` of the files below a path."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("filename"), "path", "content", F.col("length").alias("size"))
