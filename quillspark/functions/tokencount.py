"""Token counts of texts under a public tokenizer's vocabulary file."""

from __future__ import annotations

import base64

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary of a byte-level BPE tokenizer is read from unless a path is given.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How that tokenizer splits text before merging. Fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_LOADED: dict = {}


def encoding(path: str = RANKS, pattern: str = PATTERN):
    """The tokenizer of a rank file; one per worker process."""
    if (path, pattern) not in _LOADED:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[path, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path, pattern]


def token_counts(df: DataFrame, keep: list[str], text: str, path: str = RANKS) -> DataFrame:
    """The columns ``keep`` and tokens (bigint): the number of tokens of each whole text, 0 for null."""
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep) + ", tokens bigint"

    def run(batches):
        enc = encoding(path)
        for b in batches:
            sizes = [0 if t is None else len(enc.encode_ordinary(t)) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sizes, pa.int64())], names=[*keep, "tokens"])

    return df.select(*keep, F.col(text).cast("string").alias("_text")).mapInArrow(run, schema)
