"""Token counts by a public byte-level vocabulary; its file's path is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the vocabulary's tokenizer splits a text before it looks up pieces.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


#: Bytes that a vocabulary's file may have at most, as it is sent to the executors.
MOST_BYTES = 64 << 20


def vocabulary_file(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(MOST_BYTES + 1)
    if len(data) > MOST_BYTES:
        raise ValueError(f"a vocabulary of more than {MOST_BYTES} bytes")
    return data


@lru_cache(2)
def encoding_of(data: bytes):
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines())}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoding(path: str):
    return encoding_of(vocabulary_file(path))


def with_token_counts(df: DataFrame, keep: list[str], text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns `keep` and `tokens` bigint of the whole text; null and empty texts have 0, blank ones what their
    blanks take. Texts that name special tokens are ordinary text. The vocabulary's file is read by the driver and sent
    along, so that executors need not have it; its size is checked."""
    schema = df.select(*keep).schema
    shared = df.sparkSession.sparkContext.broadcast(vocabulary_file(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding_of(shared.value).encode_ordinary
        for b in batches:
            counts = [len(encode(s)) if (s := t.as_py()) else 0 for t in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 1)), pa.array(counts, pa.int64())], [*keep, "tokens"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return df.select(*keep, F.col(text).alias("__text")).mapInArrow(run, f"{fields}, tokens bigint")
