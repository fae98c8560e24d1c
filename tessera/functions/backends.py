"""Outside models as backends: injected functions over batches, with deterministic stand-ins that need no network."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


class Embedder(Protocol):
    """Vectors of one length for a batch of texts."""

    def __call__(self, texts: list[str]) -> list[list[float]]: ...


class Generator(Protocol):
    """An answer for each (question, context)."""

    def __call__(self, questions: list[str], contexts: list[str]) -> list[str]: ...


class VectorBackend(Protocol):
    """What a vector store offers, over DataFrames; sources.vector_index.VectorIndex is one."""

    def upsert(self, chunks: DataFrame) -> int: ...
    def search(self, probes: DataFrame, k: int) -> DataFrame: ...
    def delete(self, documents: DataFrame) -> int: ...
    def update_tags(self, documents: DataFrame) -> int: ...
    def count(self) -> int: ...
    def health(self) -> dict[str, object]: ...
    def clear(self) -> None: ...


class Registry:
    """Named factories; a second one of a name takes its place only if asked to."""

    def __init__(self) -> None:
        self._made: dict[tuple[str, str], Callable] = {}

    def register(self, kind: str, name: str, factory: Callable, replace: bool = False) -> None:
        if (kind, name) in self._made and not replace:
            raise ValueError(f"{kind} {name} is registered")
        self._made[kind, name] = factory

    def create(self, kind: str, name: str, **options: object) -> object:
        if (kind, name) not in self._made:
            raise KeyError(f"no {kind} named {name}; there are {sorted(n for k, n in self._made if k == kind)}")
        return self._made[kind, name](**options)


def hashed_vectors(dim: int = 64) -> Embedder:
    """A stand-in: words add plus or minus one to a place that their hash tells; unit length. An empty text counts as one blank."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dim))
        for i, text in enumerate(texts):
            for word in (text or " ").lower().split() or [" "]:
                h = hashlib.md5(word.encode(), usedforsecurity=False).hexdigest()
                out[i, int(h[:8], 16) % dim] += 1 if h[8] >= "8" else -1
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(size == 0, 1, size)).tolist()

    return embed


def first_sentence() -> Generator:
    """A stand-in: the context's sentence that shares most words with the question; the first on a tie."""

    def answer(questions: list[str], contexts: list[str]) -> list[str]:
        out = []
        for q, c in zip(questions, contexts, strict=True):
            asked = set(re.findall(r"\w+", q.lower()))
            sentences = [s for s in re.split(r"(?<=[.!?])\s+", c or "") if s]
            out.append(max(sentences, key=lambda s: len(asked & set(re.findall(r"\w+", s.lower()))), default=""))
        return out

    return answer


def embedded(df: DataFrame, key: str, text: str, backend: Embedder, batch: int = 100) -> DataFrame:
    """(key, embedding) of each text; the backend sees ``batch`` texts at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in range(0, len(frame), batch):
                part = frame.iloc[i : i + batch]
                yield pd.DataFrame({key: part[key], "embedding": backend([x or " " for x in part[text].fillna("")])})

    return df.select(key, text).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, embedding array<double>")


def generated(df: DataFrame, key: str, question: str, context: str, backends: list[Generator], batch: int = 50) -> DataFrame:
    """(key, answer, backend) by the first backend that doesn't fail on the batch."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in range(0, len(frame), batch):
                part = frame.iloc[i : i + batch]
                answers, used = [None] * len(part), -1
                for n, backend in enumerate(backends):
                    try:
                        answers, used = backend(part[question].fillna("").tolist(), part[context].fillna("").tolist()), n
                        break
                    except Exception:  # noqa: S112, PERF203  the next backend is the way to go on
                        continue
                yield pd.DataFrame({key: part[key], "answer": answers, "backend": used})

    return df.select(key, question, context).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, answer string, backend int")
