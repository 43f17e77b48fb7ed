"""Model plug-ins.  None is bundled; they are pickled to the tasks."""

from __future__ import annotations

import time
from collections.abc import Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame

from .functions import constants as K


class Embedder(Protocol):
    name: str

    def embed(self, texts: Sequence[str], task: str) -> list[list[float]]:
        """One vector per text; ``task`` is ``document`` or ``query``."""


class Generator(Protocol):
    def generate(self, prompt: str) -> str: ...


class Extractor(Protocol):
    def extract(self, text: str) -> str:
        """JSON text with the vitals of a report."""


def wait_after(error: Exception, attempt: int) -> float:
    """Seconds to wait after a failed attempt: longer when a quota is used up."""
    message = str(error).lower()
    if any(marker in message for marker in K.QUOTA_MARKERS):
        return min(K.QUOTA_WAIT * attempt, K.QUOTA_WAIT_MAX)
    return K.ERROR_WAIT * attempt


def embed_batch(
    embedder: Embedder, texts: list[str], task: str, attempts: int, sleep=time.sleep
) -> list[list[float]]:
    problem: Exception | None = None
    for attempt in range(1, attempts + 1):
        try:
            vectors = embedder.embed(texts, task)
            if len(vectors) != len(texts):
                raise ValueError(f"{len(vectors)} vectors for {len(texts)} texts")
            return vectors
        except Exception as error:
            problem = error
            sleep(wait_after(error, attempt))
    raise RuntimeError(f"embedding failed after {attempts} attempts: {problem}")


def embed(
    df: DataFrame,
    embedder: Embedder,
    text: str = "text",
    task: str = "document",
    out: str = "embedding",
    batch_size: int = K.EMBED_BATCH,
    attempts: int = K.EMBED_ATTEMPTS,
    title: str | None = None,
) -> DataFrame:
    """Add a vector column (and the model name), in small batches per task.

    With ``title`` the title goes in front of the text, for embedders that take
    context.  A failing batch fails the task, which Spark may run again.
    """
    schema = ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields
    ) + f", `{out}` array<float>, embedding_model string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            texts = frame[text].tolist()
            if title:
                texts = [f"{a}\n{b}" for a, b in zip(frame[title], texts)]
            vectors: list[list[float]] = []
            for start in range(0, len(texts), batch_size):
                vectors += embed_batch(
                    embedder, texts[start : start + batch_size], task, attempts
                )
            frame[out] = vectors
            frame["embedding_model"] = embedder.name
            yield frame

    return df.mapInPandas(run, schema)


def generate(
    df: DataFrame,
    generators: Sequence[Generator],
    prompt: str = "prompt",
    out: str = "answer",
    attempts: int = K.GENERATE_ATTEMPTS,
    wait: float = K.GENERATE_WAIT,
) -> DataFrame:
    """Add the answer of the first generator that works, each tried twice."""
    schema = ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields
    ) + f", `{out}` string"

    def one(text: str) -> str:
        problem: Exception | None = None
        for generator in generators:
            for _ in range(attempts):
                try:
                    return generator.generate(text)
                except Exception as error:
                    problem = error
                    time.sleep(wait)
        raise RuntimeError(f"no generator answered: {problem}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            frame[out] = [one(p) for p in frame[prompt]]
            yield frame

    return df.mapInPandas(run, schema)
