"""Models that a user plugs in: an embedder and a distiller. The defaults need no network and are deterministic."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Embed = Callable[[list[str]], np.ndarray]


def hashed_embedding(size: int = 64) -> Embed:
    """Signed hashed words, mean-pooled and set to unit length; empty texts give zeros."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), size), np.float32)
        for row, text in zip(out, texts):
            for w in re.findall(r"\w+", (text or "").lower()):
                h = zlib.crc32(w.encode("utf-8", "surrogatepass"))
                row[h % size] += 1 if h >> 16 & 1 else -1
            n = np.linalg.norm(row)
            if n:
                row /= n
        return out

    return embed


def embedded(df: DataFrame, text: str, embed: Embed, name: str = "embedding", batch: int = 256) -> DataFrame:
    """df with the vectors of a text column, computed in Arrow batches."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            rows = [v for at in range(0, len(s), batch) for v in embed(s.iloc[at : at + batch].tolist()).astype(np.float32).tolist()]
            yield pd.Series(rows, index=s.index)

    return df.withColumn(name, run(F.col(text)))


def distilled_core(text: Column, most: int = 160) -> Column:
    """The extractive default of the distiller: the first sentence of the exchange."""
    body = F.regexp_replace(text, r"^[a-z]+: ", "")
    return F.substring(F.regexp_extract(body, r"(?s)^(.*?(?:[.?!。]|\n|$))", 1), 1, most)


def distilled(df: DataFrame, text: str, distil: Callable[[list[str]], list[str]] | None = None, name: str = "exchange_core") -> DataFrame:
    """df with a distilled text; distil is called on batches, or the extractive default is used inside the JVM."""
    if distil is None:
        return df.withColumn(name, distilled_core(F.col(text)))

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series(distil(s.tolist()), index=s.index)

    return df.withColumn(name, run(F.col(text)))
