"""Seams for models and services, with deterministic stand-ins that need no network."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    def __call__(self, texts: list[str]) -> list[list[float]]: ...


class Extractor(Protocol):
    def __call__(self, text: str) -> str: ...


def hashed_embedder(dim: int = 64) -> Embedder:
    """Unit vectors of hashed words: equal texts get equal vectors, texts that share words similar ones."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = np.zeros(dim)
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                v[h % dim] += 1.0 if h >> 63 else -1.0
            norm = np.linalg.norm(v)
            out.append((v / norm if norm else v).astype(np.float32).tolist())
        return out

    return embed


def embed(df: DataFrame, embedder: Embedder, text_col: str = "text", into: str = "embedding", size: int = 256) -> DataFrame:
    """Vectors of texts, ``size`` texts a call. Where a call fails its texts are tried one by one; a text that fails
    keeps its row, without a vector and with the reason in ``{into}_error``."""

    @F.arrow_udf("struct<v:array<float>,error:string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        def vectors(texts: list[str]) -> tuple[list, list]:
            try:
                found = list(embedder(texts))
                return found, [None] * len(found)
            except Exception as e:  # noqa: BLE001  rows stay, unembedded, as when the service is down
                if len(texts) == 1:
                    return [None], [str(e)[:500]]
                each = [vectors([t]) for t in texts]
                return [v for x, _ in each for v in x], [e for _, x in each for e in x]

        for whole in batches:
            texts = [t or "" for t in whole.to_pylist()]
            found = [vectors(texts[at : at + size]) for at in range(0, len(texts), size)]
            columns = [pa.array([v for x in found for v in x[k]], kind) for k, kind in ((0, pa.list_(pa.float32())), (1, pa.string()))]
            yield pa.StructArray.from_arrays(columns, ["v", "error"])

    out = df.withColumn("_v", run(text_col))
    return out.select(*df.columns, F.col("_v.v").alias(into), F.col("_v.error").alias(f"{into}_error"))


def _answer(text: str, extractor: Extractor) -> dict:
    """A model's answer as an object, without code fences; an empty one where the call or the answer fails."""
    try:
        found = json.loads(re.sub(r"^\s*```(?:json)?\s*|\s*```\s*$", "", extractor(text)))
    except Exception:  # noqa: BLE001
        return {}
    return found if isinstance(found, dict) else {}


def model_events(inputs: DataFrame, extractor: Extractor) -> DataFrame:
    """Events that a model finds in ``inputs(page_id, input)``, numbered by page in its order; a failed call finds none."""
    fields = "event_type:string,description:string,is_cancelled:boolean,app_ids:array<string>,project_ids:array<string>"

    @F.pandas_udf(f"array<struct<{fields}>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        strings = lambda x: [str(v) for v in x] if isinstance(x, list) else []
        for texts in batches:
            rows = []
            for text in texts:
                events = [e for e in _answer(text, extractor).get("events") or [] if isinstance(e, dict)]
                rows.append(
                    [
                        {
                            "event_type": str(e.get("event_type", "")), "description": str(e.get("description", "")), "is_cancelled": bool(e.get("is_cancelled")),
                            "app_ids": strings(e.get("app_ids")), "project_ids": strings(e.get("project_ids")),
                        }
                        for e in events
                    ]
                )
            yield pd.Series(rows)

    return inputs.select("page_id", F.posexplode(run("input")).alias("idx", "x")).select("page_id", "idx", "x.*")


def model_ids(inputs: DataFrame, extractor: Extractor) -> DataFrame:
    """``(page_id, id_type, raw)`` that a model names in ``inputs(page_id, input)``; a failed call names nothing."""

    @F.pandas_udf("array<struct<id_type:string,raw:string>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            rows = []
            for text in texts:
                found = _answer(text, extractor)
                named = [("app_id", x) for x in found.get("additional_app_ids") or []] + [("project_id", x) for x in found.get("additional_project_ids") or []]
                rows.append([{"id_type": k, "raw": str(x)} for k, x in named])
            yield pd.Series(rows)

    return inputs.select("page_id", F.explode(run("input")).alias("x")).select("page_id", "x.*")
