"""Embedders: a deterministic default by feature hashing, and a hook for a real model."""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

DIM = 384
_WORD = re.compile(r"\w+")


def hash_embed(text: str, dim: int = DIM) -> list[float]:
    """Words hashed to signed components, normalised; zero for a text without words."""
    v = np.zeros(dim, np.float32)
    for w in _WORD.findall(text.lower()):
        h = xxhash.xxh64_intdigest(w)
        v[h % dim] += 1.0 if h >> 63 else -1.0
    n = float(np.linalg.norm(v))
    return (v / n if n else v).tolist()


Model = Callable[[list[str]], list[list[float]]]


def first_of(loaders: list[Callable[[], Model]], warm: tuple[str, ...] = ("warm up",)) -> Callable[[], Model]:
    """A loader that takes the first of several that loads and embeds the ``warm`` texts, so a worker
    starts warm; if none does, words are hashed."""

    def load() -> Model:
        for loader in loaders:
            try:
                model = loader()
                if len(model(list(warm))) == len(warm):
                    return model
            except Exception:  # not available here: the next one
                continue
        return lambda texts: [hash_embed(t) for t in texts]

    return load


def embed(text: Column, load: Callable[[], Model] | None = None) -> Column:
    """struct(vector, error) of each text. ``load`` makes the model once per worker process;
    a batch that fails is tried row by row, so one bad text costs no other."""

    @F.pandas_udf("vector array<float>, error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = load() if load else lambda texts: [hash_embed(t) for t in texts]
        for s in batches:
            texts = [t if t is not None else "" for t in s]
            try:
                vectors, errors = model(texts), [None] * len(texts)
            except Exception:
                vectors, errors = [], []
                for t in texts:
                    try:
                        vectors.append(model([t])[0])
                        errors.append(None)
                    except Exception as e:
                        vectors.append(None)
                        errors.append(str(e))
            yield pd.DataFrame({"vector": pd.Series(vectors, dtype=object), "error": pd.Series(errors, dtype=object)})

    return run(text)


def pack(vector: list[float]) -> bytes:
    return struct.pack(f"{len(vector)}f", *vector)


def unpack(blob: bytes) -> list[float]:
    return list(struct.unpack(f"{len(blob) // 4}f", blob))


def unpack_column(c: Column | str) -> Column:
    """Packed native floats to arrays, for imports of blob columns."""

    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else np.frombuffer(b, np.float32, len(b) // 4).tolist())

    return run(c)


def pack_column(c: Column | str) -> Column:
    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else np.asarray(v, np.float32).tobytes())

    return run(c)
