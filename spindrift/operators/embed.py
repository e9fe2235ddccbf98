"""Embedding providers and the vectorised embedding step."""

from __future__ import annotations

import json
import math
import os
import urllib.request
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..session import spread

BATCH = 32
FAKE_WIDTH = 256
IDENTITY_FORM = "title-heading-v1"


class EmbeddingError(RuntimeError):
    """A provider's answer that cannot be used."""


class IdentityMismatch(RuntimeError):
    """The index holds vectors of another kind."""


class Provider(Protocol):
    name: str
    model: str
    dims: int  # 0: not known before the first answer

    def embed(self, texts: list[str]) -> list[list[float]]: ...


def fnv1a(data: bytes) -> int:
    h = 2166136261
    for b in data:
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return h


@lru_cache(1 << 16)
def _known_hash(word: str) -> int:
    return fnv1a(word.encode("utf-8", "surrogatepass"))


def fake_vector(text: str, width: int = FAKE_WIDTH) -> list[float]:
    """Hashed bag of words with unit length: a deterministic stand-in that needs no model."""
    v = [0.0] * width
    for w, n in Counter(text.lower().split()).items():
        # Long words are not remembered, so that what is remembered is bounded.
        v[(_known_hash(w) if len(w) < 64 else fnv1a(w.encode("utf-8", "surrogatepass"))) % width] += n
    norm = math.sqrt(sum(x * x for x in v))
    return [x / norm for x in v] if norm else v


@dataclass
class Fake:
    name: str = "fake"
    model: str = "fake-model"
    dims: int = FAKE_WIDTH

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [fake_vector(t, self.dims) for t in texts]


def _post(url: str, body: dict, headers: dict[str, str], timeout: float) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return json.loads(answer.read())


@dataclass
class Ollama:
    model: str
    base_url: str = "http://localhost:11434"
    timeout: float = 60.0
    post: Callable[[str, dict, dict, float], dict] = _post
    name: str = "ollama"
    dims: int = 0

    def embed(self, texts: list[str]) -> list[list[float]]:
        """One prompt a request."""
        out = []
        for t in texts:
            got = self.post(f"{self.base_url.rstrip('/')}/api/embeddings", {"model": self.model, "prompt": t}, {}, self.timeout).get("embedding")
            if not got:
                raise EmbeddingError(f"{self.model}: no embedding in the answer")
            out.append(got)
        return out


@dataclass
class OpenAI:
    """An OpenAI-compatible endpoint; its rows may come in any order and are put back by index."""

    model: str
    api_key: str
    base_url: str = "https://api.openai.com/v1"
    timeout: float = 60.0
    post: Callable[[str, dict, dict, float], dict] = _post
    name: str = "openai"
    dims: int = 1536

    def embed(self, texts: list[str]) -> list[list[float]]:
        try:
            rows = self.post(f"{self.base_url.rstrip('/')}/embeddings", {"model": self.model, "input": texts}, {"Authorization": f"Bearer {self.api_key}"}, self.timeout).get("data", [])
        except OSError as e:
            raise EmbeddingError(redact(str(e), self.api_key)) from None
        by_index = {r.get("index"): r.get("embedding") for r in rows}
        if len(rows) != len(texts) or set(by_index) != set(range(len(texts))):
            raise EmbeddingError(f"{len(texts)} texts, answers for {sorted(map(str, by_index))}")
        return [by_index[i] for i in range(len(texts))]


@dataclass
class Onnx:
    """A local sentence model: tokenizer.json and model.onnx; mean of the last states, unit length."""

    folder: str
    model: str = "all-MiniLM-L6-v2"
    name: str = "local"
    dims: int = 384
    max_tokens: int = 256

    def embed(self, texts: list[str]) -> list[list[float]]:
        import numpy as np
        import onnxruntime
        from tokenizers import Tokenizer

        if not hasattr(self, "_session"):
            self._session = onnxruntime.InferenceSession(f"{self.folder}/model.onnx")
            self._tokenizer = Tokenizer.from_file(f"{self.folder}/tokenizer.json")
            self._tokenizer.enable_truncation(self.max_tokens)
            self._tokenizer.enable_padding()
        rows = self._tokenizer.encode_batch(texts)
        ids, mask = np.array([r.ids for r in rows], np.int64), np.array([r.attention_mask for r in rows], np.int64)
        known = {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)}
        states = self._session.run(None, {i.name: known[i.name] for i in self._session.get_inputs()})[0]
        mean = (states * mask[..., None]).sum(1) / np.maximum(mask.sum(1, keepdims=True), 1)
        return (mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-12)).tolist()


#: Where the default provider looks for its model's files.
MODEL_VARIABLE, MODEL_FOLDER = "SPINDRIFT_MODEL", "~/.cache/spindrift/all-MiniLM-L6-v2"


def default() -> Onnx:
    """The local model; an error that says what to put where if its files are not there. Never the fake."""
    folder = os.path.expanduser(os.environ.get(MODEL_VARIABLE, "") or MODEL_FOLDER)
    missing = [f for f in ("model.onnx", "tokenizer.json") if not os.path.exists(f"{folder}/{f}")]
    if missing:
        raise EmbeddingError(f"the default provider needs {' and '.join(missing)} of a sentence model in {folder} (or the folder {MODEL_VARIABLE} names); or set the provider to ollama, openai or, for tests, fake")
    return Onnx(folder)


def redact(message: str, secret: str, most: int = 300) -> str:
    """The message without the secret, cut to whole characters of at most ``most`` bytes; what was cut ends in dots."""
    shown = message.replace(secret, "[redacted]") if secret else message
    raw = shown.encode("utf-8", "replace")
    return shown if len(raw) <= most else raw[:most].decode("utf-8", "ignore") + "..."


def check(vectors: list[list[float]], n: int, dims: int) -> list[list[float]]:
    """The vectors, if there are n finite ones of one width, the given one unless it is 0."""
    if len(vectors) != n:
        raise EmbeddingError(f"{n} texts, {len(vectors)} vectors")
    for v in vectors:
        if not v or len(v) != (dims or len(vectors[0])) or not all(map(math.isfinite, v)):
            raise EmbeddingError("a vector is empty, not finite or of another width")
    return vectors


def embed(rows: DataFrame, text: Column | str, provider: Provider, column: str = "embedding", batch: int = BATCH) -> DataFrame:
    """``rows`` with an embedding of ``text``; a bad answer fails the task, so nothing partial is kept."""
    kept = rows.schema.fields
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + f", {column} array<float>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            asked = b.column(b.num_columns - 1).to_pylist()
            out: list[list[float]] = []
            for lo in range(0, len(asked), batch):
                part = asked[lo : lo + batch]
                out += check(provider.embed(part), len(part), provider.dims)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.list_(pa.float32()))], [*b.schema.names[:-1], column])

    return spread(rows.withColumn("__text", C.text(text))).mapInArrow(run, schema)


# ---------------------------------------------------------------- identity of an index


def identity(provider: Provider, dims: int | None = None) -> str:
    """provider/model/width/form: what vectors of one index have in common."""
    return f"{provider.name}/{provider.model}/{provider.dims if dims is None else dims}/{IDENTITY_FORM}"


def parse_identity(recorded: str, provider: Provider) -> int | None:
    """The recorded width, if everything else is this provider's; None if not."""
    head, tail = f"{provider.name}/{provider.model}/", f"/{IDENTITY_FORM}"
    if not (recorded.startswith(head) and recorded.endswith(tail) and len(recorded) > len(head) + len(tail) - 1):
        return None
    width = recorded[len(head) : len(recorded) - len(tail)]
    return int(width) if width.isascii() and width.isdigit() and str(int(width)) == width else None


def compatible(recorded: str, provider: Provider) -> bool:
    """Whether vectors of this provider may join an index; an unknown width takes any recorded one over 0."""
    width = parse_identity(recorded, provider)
    return width is not None and (width == provider.dims if provider.dims else width > 0)
