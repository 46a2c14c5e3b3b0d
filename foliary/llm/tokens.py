"""Encoding texts with the public byte-level tokenizer (problem 8)."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.session import spread, tokenizer_dir

# Fixed value: the public split pattern of the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Before a single space between two other characters no token of the pattern goes on, so texts may be cut there.
SAFE = re.compile(r"(?<=\S)(?= \S)")
LONG = 100_000


def rank_file(name: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> bytes:
    """The contents of a rank file (under one megabyte); read by the driver only."""
    with open(f"{folder or tokenizer_dir()}/{name}", "rb") as f:
        return f.read()


@lru_cache(maxsize=4)
def encoding(ranks: bytes):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
    return tiktoken.Encoding("local", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def safe_parts(text: str, long: int = LONG) -> list[str]:
    """A text as parts of about `long` characters whose encodings join to that of the text."""
    if len(text) <= long:
        return [text]
    parts, at = [], 0
    while len(text) - at > long:
        m = SAFE.search(text, at + long)
        if not m:
            break
        parts.append(text[at : m.start()])
        at = m.start()
    return [*parts, text[at:]]


def encode(text: str | None, enc) -> np.ndarray:
    """ids of one text as numbers; none for a null or empty text. Strings of special tokens are ordinary text."""
    if not text:
        return np.empty(0, np.int32)
    parts = [enc.encode_to_numpy(p, disallowed_special=()) for p in safe_parts(text)]
    return (parts[0] if len(parts) == 1 else np.concatenate(parts)).astype(np.int32)


def decode(ids: list[int] | np.ndarray, enc) -> bytes:
    """The exact bytes of ids; characters cut between two pieces stay cut."""
    return b"".join(map(enc.decode_single_token_bytes, map(int, ids)))


def encode_texts(df: DataFrame, id_col: str, text_col: str, ranks: bytes | None = None) -> DataFrame:
    """id_col, ids (array of int) of every row.

    Null and empty texts give an empty list; rows with a null id or repeated rows are encoded like any other, one row out for
    each row in; an empty table gives an empty table; other columns are not read. No exchange: each task encodes its own rows.
    """
    ranks = ranks or rank_file()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks)
        for b in batches:
            each = [encode(t, enc) for t in b.column(1).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in each], dtype=np.int64)]).astype(np.int32)
            flat = np.concatenate(each) if each else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))], names=["id", "ids"])

    kind = dict(df.dtypes)[id_col]
    return spread(df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)
