"""Session settings and engine configuration."""

from __future__ import annotations

import re
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class EngineConfig:
    """Limits and thresholds of the operators."""

    chunk_size: int = 1000
    chunk_overlap: int = 150
    max_attachment_bytes: int = 25 * 1024 * 1024
    id_context_chars: int = 60
    llm_text_chars: int = 8000
    sample_rows: int = 3
    assign_similarity: float = 0.70
    cluster_similarity: float = 0.75
    half_life_days: float = 365.0
    overfetch: int = 3
    norm_epsilon: float = 1e-10
    max_retry: int = 3
    property_limit: int = 100
    poll_hours: int = 24


def build_session(app: str = "lattica", **conf: str) -> SparkSession:
    """UTC, adaptive execution; everything else is left to the cluster."""
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    builder = SparkSession.builder.appName(app)
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which all machines share; ``spark.checkpoint.dir`` names it on a cluster."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lattica-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the session's checkpoint folder and read back."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet beside the checkpoints and read back: what several parts of a plan read is made once, and a
    part reads only its columns."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
