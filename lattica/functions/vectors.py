"""Vector scores."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def cosine_to(query: Sequence[float], epsilon: float = 1e-10):
    """Arrow UDF: cosine with a fixed vector, one matrix product a batch; null for unusable vectors."""
    q = np.asarray(query, np.float64)
    q_norm = float(np.linalg.norm(q)) if len(q) else 0.0

    @F.pandas_udf("double")
    def cosine(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in batches:
            out = np.full(len(vectors), np.nan)
            good = [k for k, v in enumerate(vectors) if v is not None and len(v) == len(q)]
            if good and q_norm >= epsilon:
                m = np.stack([np.asarray(vectors.iloc[k], np.float64) for k in good])
                norm = np.linalg.norm(m, axis=1)
                use = norm >= epsilon
                out[np.asarray(good)[use]] = (m[use] @ q) / (norm[use] * q_norm)
            yield pd.Series(out)

    return cosine


def temporal_decay(timestamp: Column, reference: Column, half_life_days: float = 365.0) -> Column:
    """exp(-ln 2 * age / half life); 1 for times after the reference and for null."""
    seconds = (F.unix_micros(reference.cast("timestamp")) - F.unix_micros(timestamp.cast("timestamp"))) / F.lit(1e6)
    days = F.greatest(F.lit(0.0), seconds / F.lit(86400.0))
    return F.coalesce(F.exp(-F.log(F.lit(2.0)) * days / F.lit(half_life_days)), F.lit(1.0))
