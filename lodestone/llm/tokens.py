"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import for_every_core

#: Vocabulary of the byte-level tokenizer (ranks, one "base64 rank" pair a line).
VOCABULARY = os.environ.get("TOKENIZER_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: How the tokenizer splits text before its merges.  A fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters after which a call's stretch ends at the next place where no token can reach
#: across, so that a very long text costs time in proportion to its length and its tokens
#: are those of the whole: before a blank that follows something, and behind a run of
#: letters or of digits.
STRETCH = 200_000
_BETWEEN = r"(?<=\S)(?=\s)|(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})"


@lru_cache(maxsize=2)
def encoding(path: str):
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str, path: str = VOCABULARY) -> int:
    """Tokens of the whole text; 0 for an empty one."""
    enc, n, at = encoding(path), 0, 0
    while at < len(text):
        m = _between().search(text, at + STRETCH) if len(text) - at > STRETCH else None
        end = m.start() if m else len(text)
        n += len(enc.encode_ordinary(text[at:end]))
        at = end
    return n


@lru_cache(maxsize=1)
def _between():
    import regex

    return regex.compile(_BETWEEN)


def document_sizes(documents: DataFrame, *columns: str, path: str = VOCABULARY) -> DataFrame:
    """doc_id, the named columns, tokens.  A null text has 0 tokens.  A row without
    doc_id is no document; a document that is there twice (same id) counts once, with
    its least text."""
    kept = ["doc_id", *columns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b[kept].copy()
            out["tokens"] = [0 if t is None else count_tokens(t, path) for t in b["text"]]
            yield out

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in documents.select(*kept).schema) + ", tokens bigint"
    # texts stay where they are read; only sizes are shuffled, and repeated ids meet there
    rows = documents.where("doc_id is not null").select(*kept, "text")
    sized = for_every_core(rows, "doc_id").mapInPandas(run, schema)
    return sized.groupBy("doc_id").agg(*[F.min(c).alias(c) for c in columns], F.min("tokens").alias("tokens"))
