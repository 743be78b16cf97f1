"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.session import ship, spread

#: A byte-level BPE vocabulary as ranks; the driver reads it and sends it along.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that cuts a text before byte pairs are merged.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_ENCODERS: dict[int, object] = {}


def encoder(ranks: bytes):
    """The encoding of a ranks file, built once a process."""
    key = hash(ranks)
    if key not in _ENCODERS:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        _ENCODERS[key] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return _ENCODERS[key]


def token_sizes(df: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = (), vocabulary: str = VOCABULARY) -> DataFrame:
    """``(id, tokens, *keep)``: one row per id; a null text has 0 tokens.

    Whole texts are encoded; strings of special tokens are ordinary text. Of
    rows repeated under one id one counts, the one of the most tokens.
    """
    ship(df.sparkSession)
    with open(vocabulary, "rb") as f:
        ranks = f.read()
    names = [f"keep{i}" for i in range(len(keep))]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks)
        for batch in batches:
            sizes = [len(enc.encode_ordinary(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *(batch.column(2 + i) for i in range(len(keep)))], names=["id", "tokens", *names])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *(F.col(c).cast("string").alias(n) for c, n in zip(keep, names)))
    rows = spread(rows.where("id IS NOT NULL"))
    sized = rows.mapInArrow(count, ", ".join(["id long", "tokens long", *(f"{n} string" for n in names)]))
    best = sized.groupBy("id").agg(F.max(F.struct("tokens", *names)).alias("r"))
    return best.select("id", "r.tokens", *(F.col(f"r.{n}").alias(c) for n, c in zip(names, keep)))
