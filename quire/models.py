"""Model calls behind an interface, with a stand-in that needs no model."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


class ModelClient(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...

    def chat(self, prompt: str) -> str: ...


class HashModel:
    """Deterministic vectors and replies from hashes of the text; for tests and dry runs."""

    def __init__(self, size: int = 16, longest: int | None = None):
        self.size, self.longest = size, longest

    def embed(self, texts: list[str]) -> list[list[float]]:
        if self.longest and any(len(t) > self.longest for t in texts):
            raise ValueError("input too long")
        return [[b / 255 for b in hashlib.sha256(t.encode()).digest()[: self.size]] for t in texts]

    def chat(self, prompt: str) -> str:
        return hashlib.sha256(prompt.encode()).hexdigest()[:16]


#: Lengths that an input is cut to in turn when a model refuses it.
RETRIES = (None, 2000, 1000, 400)
LONGEST = 3000
#: Texts of a call, and their words' estimated tokens, at most; calls that a task has under way at once.
BATCH_TEXTS, BATCH_TOKENS, CONCURRENT = 64, 8192, 4


def shaped(vector: list[float], size: int) -> list[float]:
    """Cut and made a unit vector again if longer, padded with zeros if shorter."""
    v = np.asarray(vector, np.float64)
    if len(v) > size:
        norm = float(np.linalg.norm(v[:size])) or 1.0
        return (v[:size] / norm).tolist()
    return [*v.tolist(), *[0.0] * (size - len(v))]


def embed_with_retries(client: ModelClient, text: str, size: int, cuts: tuple = RETRIES) -> list[float]:
    """The vector of a text, cut ever shorter until the model takes it; zeros if it never does."""
    for cut in cuts:
        try:
            return shaped(client.embed([text[:cut]])[0], size)
        except ValueError:
            continue
    return [0.0] * size


def batches_of(texts: list[str], most: int = BATCH_TEXTS, tokens: int = BATCH_TOKENS) -> Iterator[list[str]]:
    """texts in order, in batches within both bounds; a text beyond the second is a batch of its own."""
    held: list[str] = []
    spent = 0
    for t in texts:
        n = len(t.split()) * 13 // 10
        if held and (len(held) == most or spent + n > tokens):
            yield held
            held, spent = [], 0
        held, spent = [*held, t], spent + n
    if held:
        yield held


def embed_batch(client: ModelClient, texts: list[str], size: int, refused: bool = False) -> tuple[list[list[float]], bool]:
    """Vectors of texts, and whether the model refused any: a refused batch is halved until what it refuses stands alone, and that is cut shorter.

    If it takes the first half, the second holds what it refuses, and isn't asked for whole again.
    """
    if not refused:
        try:
            vectors = client.embed(texts)
        except ValueError:
            pass
        else:
            if len(vectors) != len(texts):
                raise RuntimeError(f"embeddings: {len(vectors)} for inputs: {len(texts)}")
            return [shaped(v, size) for v in vectors], False
    if len(texts) == 1:
        return [embed_with_retries(client, texts[0], size, RETRIES[1:])], True
    half = len(texts) // 2
    first, bad = embed_batch(client, texts[:half], size)
    second, _ = embed_batch(client, texts[half:], size, refused=not bad)
    return first + second, True


def embed_all(client: ModelClient, texts: list[str], size: int, most: int = BATCH_TEXTS, tokens: int = BATCH_TOKENS, concurrent: int = CONCURRENT) -> list[list[float]]:
    """Vectors of texts in their order, by batches, so many calls at once; an error other than a refusal is raised."""
    with ThreadPoolExecutor(concurrent) as pool:
        return [v for vectors, _ in pool.map(lambda b: embed_batch(client, b, size), batches_of(texts, most, tokens)) for v in vectors]


def embed(chunks: DataFrame, client: ModelClient, size: int) -> DataFrame:
    """id, embedding of chunks (id, chunk_type, plain_text), by batches; a chunk without text is embedded by its type's name."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [(t or "")[:LONGEST] or f"[{k}]" for t, k in zip(pdf["plain_text"], pdf["chunk_type"])]
            yield pd.DataFrame({"id": pdf["id"], "embedding": embed_all(client, texts, size)})

    return chunks.select("id", "chunk_type", "plain_text").mapInPandas(run, "id long, embedding array<double>")
