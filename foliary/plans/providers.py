"""Where models plug in, with deterministic local stand-ins."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_CHARS = 28_000


class Embedder(Protocol):
    def __call__(self, texts: list[str]) -> np.ndarray: ...


class Generator(Protocol):
    def __call__(self, question: str, context: str) -> str: ...


def hash_embedder(dim: int = 64) -> Embedder:
    """Signed feature hashing of words and word pairs: texts that share words get like vectors, the same everywhere."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), dtype=np.float32)
        for i, t in enumerate(texts):
            ws = re.findall(r"[^\W_]+", t.lower())
            for f in (*ws, *(f"{a} {b}" for a, b in zip(ws, ws[1:]))):
                h = xxhash.xxh3_64_intdigest(f)
                out[i, h % dim] += 1 if h >> 63 else -1
        return out

    return embed


def extractive_generator(question: str, context: str) -> str:
    """The context sentence that shares most words with the question."""
    asked = set(re.findall(r"[^\W_]{3,}", question.lower()))
    parts = [s.strip() for s in re.split(r"(?<=[.!?])\s+|\n+", context) if s.strip() and not s.startswith("[")]
    return max(parts, key=lambda s: (len(asked & set(re.findall(r"[^\W_]{3,}", s.lower()))), -len(s)), default="")


def embed(df: DataFrame, text_col: str, embedder: Embedder, role: str = "passage", into: str = "embedding") -> DataFrame:
    """Adds unit vectors of a text column; texts are headed by their role and cut at the model's limit. Null texts have null vectors."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            at = [i for i, t in enumerate(texts) if t is not None]
            v = np.asarray(embedder([f"{role}: {texts[i]}"[:MOST_CHARS] for i in at]), dtype=np.float64) if at else np.empty((0, 1))
            v = v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-12)
            out: list = [None] * len(texts)
            for i, x in zip(at, v.astype(np.float32)):
                out[i] = x.tolist()
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), pa.array(out, pa.list_(pa.float32()))], names=[*names, into])

    src = df.select(*names, F.col(text_col).cast("string").alias("_text"))
    shape = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + f", `{into}` array<float>"
    return src.mapInArrow(run, shape)


def generate(df: DataFrame, question: str, context: str, generator: Callable[[str, str], str], into: str = "answer") -> DataFrame:
    return df.withColumn(into, F.udf(generator, "string", useArrow=True)(F.coalesce(question, F.lit("")), F.coalesce(context, F.lit(""))))
