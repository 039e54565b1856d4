"""Sizes of texts in tokens of a public tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where every executor finds the vocabulary, as ranks of a byte-level BPE.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: How such a BPE cuts a text before it merges (a fixed value, published with the vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_tokens(df: DataFrame, ident: str, text: str, keep: list[str] = (), path: str = VOCABULARY) -> DataFrame:
    """``ident, *keep, n_tokens`` of every row; null texts have 0. The texts themselves don't leave the task."""
    schema = df.select(ident, *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) if t else 0 for t in batch["_text"].to_pylist()]
            yield pa.record_batch({c: batch[c] for c in (ident, *keep)} | {"n_tokens": pa.array(sizes, pa.int64())})

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.schema) + ", n_tokens long"
    return df.select(ident, *keep, F.col(text).alias("_text")).mapInArrow(run, kind)
