"""Text, date and identifier expressions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ISO = "yyyy-MM-dd'T'HH:mm:ss"

#: Extension to kind of attachment (fixed values).
ATTACHMENT_KINDS = {
    "pdf": "pdf", "xlsx": "excel", "xls": "excel", "docx": "docx", "doc": "docx", "pptx": "pptx", "ppt": "pptx",
    "png": "image", "jpg": "image", "jpeg": "image", "gif": "image", "bmp": "image", "webp": "image",
}


def strip(c: Column) -> Column:
    """Without white space (Unicode) at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def iso(c: Column) -> Column:
    return F.date_format(c, ISO)


#: The formats of dates in titles, in the order in which they are tried.
TITLE_DATES = ((r"(\d{4}-\d{2}-\d{2})", "yyyy-MM-dd"), (r"(\d{2}/\d{2}/\d{4})", "dd/MM/yyyy"), (r"(\d{2}-\d{2}-\d{4})", "dd-MM-yyyy"))


def title_date(title: Column) -> Column:
    """Date in a title: the first match of each format in turn, the first that is a valid day wins."""
    return F.coalesce(
        *(F.try_to_timestamp(F.nullif(F.regexp_extract(title, p, 1), F.lit("")), F.lit(f)).cast("timestamp_ntz") for p, f in TITLE_DATES)
    )


def iso_timestamp(c: Column) -> Column:
    """ISO time without its zone, which is dropped and not converted."""
    return F.regexp_replace(c, r"(Z|[+-]\d{2}:?\d{2})$", "").cast("timestamp_ntz")


def attachment_kind(filename: Column) -> Column:
    kinds = F.create_map(*(F.lit(x) for pair in ATTACHMENT_KINDS.items() for x in pair))
    extension = F.lower(F.regexp_extract(filename, r"\.([^.]*)$", 1))
    return F.coalesce(F.try_element_at(kinds, extension), F.lit("unknown"))


def chunks_of(text: str | None, size: int = 1000, overlap: int = 150) -> list[str]:
    """Overlapping windows that end at a space where there is one; always moves on and covers the whole text."""
    text = (text or "").strip()
    if len(text) <= size:
        return [text] if text else []
    out, start = [], 0
    while start < len(text):
        end = start + size
        if end < len(text) and (space := text.rfind(" ", start + 1, end)) > start:
            end = space
        if piece := text[start:end].strip():
            out.append(piece)
        start = end - overlap if end - overlap > start else end
    return out


def chunk_udf(size: int = 1000, overlap: int = 150):
    @F.pandas_udf("array<string>")
    def chunk(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: chunks_of(t, size, overlap))

    return chunk
