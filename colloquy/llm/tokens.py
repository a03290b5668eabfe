"""Sizes of texts in tokens of a public tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
_LOADED: dict = {}


def counter(vocabulary: str = VOCABULARY):
    """A function from texts to their numbers of tokens; the vocabulary is loaded once a worker."""
    if vocabulary not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a core runs one task
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(vocabulary)
        t.encode_special_tokens = True
        _LOADED[vocabulary] = t
    t = _LOADED[vocabulary]
    return lambda texts: [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]


def sized(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """docs with the text replaced by its number of tokens; rows with a NULL text are left out."""
    keep = [c for c in docs.columns if c != text]
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary)
        for b in batches:
            texts = b.column(text).to_pylist()
            n = [k for at in range(0, len(texts), 256) for k in count(texts[at : at + 256])]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(n, pa.int64())], names=[*keep, "tokens"])

    return docs.where(f"`{text}` is not null").mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", tokens bigint")
