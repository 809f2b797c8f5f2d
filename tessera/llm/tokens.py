"""Token counts of texts by a public tokenizer's vocabulary file."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-tokenization pattern that belongs to this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoding(path: str):
    """The tokenizer of a vocabulary file of ranks, kept per Python process."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, keys: list[str], text: str, path: str | None = None) -> DataFrame:
    """(keys, tokens): tokens of each row's whole text; NULL and empty texts have none. One row comes out per row in.

    `path` is a vocabulary file that every executor can read, by default that of the session's `spark.tessera.vocabulary`.
    """
    path = path or df.sparkSession.conf.get("spark.tessera.vocabulary", VOCABULARY)
    types = dict(df.dtypes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.select(keys).columns, pa.array(n, pa.int64())], names=[*keys, "tokens"])

    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "tokens bigint"])
    return df.select(*keys, text).mapInArrow(count, schema)
