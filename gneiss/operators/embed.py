"""Embedding providers: an offline one of hashed words, and HTTP ones.

HTTP providers run in ``mapInArrow`` with one client per partition, in sub-batches, and repeat
a request on transport errors and on status 429, 500, 502, 503 and 504."""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import os
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

MAX_BATCH = 32
RETRY_STATUS = frozenset({429, 500, 502, 503, 504})
OPENAI_CHARS = 24_000
OLLAMA_CHARS = 1_500
_WORD = re.compile("[a-z0-9]+").findall


class EmbeddingError(Exception):
    """An embedding request failed for good; the message never holds a key or a text."""


def hash_vectors(df: DataFrame, text_col: str = "text", dimensions: int = 64, vector_col: str = "vector") -> DataFrame:
    """``df`` with hashed word vectors; a null text has no words and so the zero vector."""
    schema = T.StructType([*[f for f in df.schema if f.name != vector_col], T.StructField(vector_col, T.ArrayType(T.DoubleType()))])
    kept = [f.name for f in df.schema if f.name != vector_col]

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                flat = hashed_all([t or "" for t in part.column(text_col).to_pylist()], dimensions).ravel()
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * dimensions, pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], vectors], names=schema.names)

    return df.mapInArrow(run, schema)


def backoff(attempt: int, retry_after: str | None) -> float:
    """Seconds to wait before the next attempt (attempts count from 0)."""
    try:
        return min(max(float(retry_after), 0.0), 60.0)
    except (TypeError, ValueError):
        return float(min(2**attempt, 30))


def post_json(url: str, body: dict, headers: dict[str, str], timeout: float, retries: int, sleep: Callable[[float], None] = time.sleep, send=None) -> dict:
    """The JSON answer to a POST; ``send(url, data, headers, timeout)`` gives (status, headers, bytes)."""
    send = send or _send
    for attempt in range(retries + 1):
        wait, why = None, "no answer"
        try:
            status, answer, data = send(url, json.dumps(body).encode(), headers, timeout)
            if 200 <= status < 300:
                return json.loads(data)
            why, wait = f"status {status}", answer.get("Retry-After")
            if status not in RETRY_STATUS:
                raise EmbeddingError(f"embedding endpoint answered with {why}")
        except OSError as e:
            why = type(e).__name__
        if attempt < retries:
            sleep(backoff(attempt, wait))
    raise EmbeddingError(f"embedding endpoint failed after {retries + 1} attempts: {why}")


def _send(url, data, headers, timeout):
    request = urllib.request.Request(url, data=data, headers={"Content-Type": "application/json", **headers}, method="POST")
    try:
        with urllib.request.urlopen(request, timeout=timeout) as r:
            return r.status, dict(r.headers), r.read()
    except urllib.error.HTTPError as e:
        return e.code, dict(e.headers), b""


@dataclass
class Provider:
    """Where and with what texts are embedded."""

    kind: str
    model: str
    base_url: str = ""
    api_key_env: str | None = None
    batch_size: int = MAX_BATCH
    max_chars: int | None = None
    timeout: float = 60.0
    retries: int = 4
    send: Callable | None = None
    sleep: Callable[[float], None] = time.sleep
    _dimensions: int | None = field(default=None, repr=False)

    @property
    def model_id(self) -> str:
        return f"{self.kind}:{self.model}"

    @property
    def max_input_chars(self) -> int:
        return self.max_chars or {"ollama": OLLAMA_CHARS}.get(self.kind, OPENAI_CHARS)

    def embed(self, text: str) -> list[float]:
        return self.embed_batch([text])[0]

    def dimensions(self) -> int:
        """Asked for once, with a probe text."""
        if self._dimensions is None:
            self._dimensions = int(self.model) if self.kind == "hash" else len(self.embed("dimension probe"))
        return self._dimensions

    def embed_batch(self, texts: Sequence[str]) -> list[list[float]]:
        texts = [t[: self.max_input_chars] for t in texts]
        if self.kind == "hash":
            return [hashed(t, int(self.model)) for t in texts]
        if self.kind == "ollama":
            url = self.base_url.rstrip("/") + "/api/embeddings"
            return [post_json(url, {"model": self.model, "prompt": t}, {}, self.timeout, self.retries, self.sleep, self.send)["embedding"] for t in texts]
        key = os.environ.get(self.api_key_env or "", "")
        headers = {"Authorization": f"Bearer {key}"} if key else {}
        out: list[list[float]] = []
        for at in range(0, len(texts), self.batch_size):
            part = texts[at : at + self.batch_size]
            answer = post_json(self.base_url.rstrip("/") + "/embeddings", {"model": self.model, "input": part}, headers, self.timeout, self.retries, self.sleep, self.send)
            rows = sorted(answer.get("data", []), key=lambda r: r["index"])
            if len(rows) != len(part):
                raise EmbeddingError("embedding endpoint answered with another number of vectors")
            out += [r["embedding"] for r in rows]
        return out


class _Spots(dict):
    """Words to the number of their dimension, plus ``dimensions`` where the sign is negative;
    remembered for a bounded number of words."""

    def __init__(self, dimensions: int):
        super().__init__()
        self.dimensions = dimensions

    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        digest = hashlib.md5(word.encode()).hexdigest()
        self[word] = spot = int(digest[:8], 16) % self.dimensions + self.dimensions * (int(digest[8], 16) % 2)
        return spot


@functools.lru_cache(maxsize=8)
def _spots(dimensions: int) -> _Spots:
    return _Spots(dimensions)


def hashed_all(texts: Sequence[str], dimensions: int) -> np.ndarray:
    """A row of signed word counts for each text, each word hashed to one dimension."""
    of = _spots(dimensions).__getitem__
    rows = [list(map(of, _WORD(t.lower()))) for t in texts]
    size = np.fromiter(map(len, rows), np.int64, len(rows))
    spots = np.fromiter(itertools.chain.from_iterable(rows), np.int64, int(size.sum()))
    counts = np.bincount(np.repeat(np.arange(len(rows)), size) * 2 * dimensions + spots, minlength=2 * dimensions * len(rows)).reshape(len(rows), 2, dimensions)
    return (counts[:, 0] - counts[:, 1]).astype(np.float64)


def hashed(text: str, dimensions: int) -> list[float]:
    return hashed_all([text], dimensions)[0].tolist()


def build_provider(kind: str, model: str, base_url: str | None = None, api_key_env: str | None = None, **more) -> Provider:
    if kind == "openai":
        if not base_url or not api_key_env:
            raise EmbeddingError("an openai provider needs a base_url and the name of a key variable")
    elif kind not in ("ollama", "hash"):
        raise EmbeddingError(f"unknown embedding provider '{kind}'")
    return Provider(kind, model, base_url or "http://localhost:11434", api_key_env, **more)


class Resolver:
    """One provider for each distinct configuration."""

    def __init__(self, default: tuple, make: Callable[..., Provider] = build_provider):
        self.default, self.make, self.made = default, make, {}

    def of(self, override: tuple | None = None) -> Provider:
        spec = override or self.default
        if spec not in self.made:
            self.made[spec] = self.make(*spec)
        return self.made[spec]


def embed_column(df: DataFrame, provider: Provider, text_col: str = "embed_text", vector_col: str = "vector") -> DataFrame:
    """``df`` with a vector for each text."""
    if provider.kind == "hash":
        return hash_vectors(df, text_col, int(provider.model), vector_col)
    schema = T.StructType([*[f for f in df.schema if f.name != vector_col], T.StructField(vector_col, T.ArrayType(T.DoubleType()))])
    kept = [f.name for f in df.schema if f.name != vector_col]

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                vectors = provider.embed_batch([t or "" for t in part.column(text_col).to_pylist()])
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], pa.array(vectors, pa.list_(pa.float64()))], names=schema.names)

    return df.mapInArrow(run, schema)
