"""Embedding and generation behind small interfaces: deterministic offline stand-ins, HTTP backends on demand."""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import Protocol
from urllib.error import URLError
from urllib.request import Request, urlopen

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.template import Template
from ..functions.text import PROMPT
from ..settings import Settings


#: Words whose numbers a task remembers.
REMEMBERED = 1 << 16


class ModelError(RuntimeError):
    """A model server that can't be reached, or a model that isn't installed."""


class Embedder(Protocol):
    name: str
    dim: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Generator(Protocol):
    def generate(self, prompts: list[str]) -> list[str]: ...


class HashingEmbedder:
    """Counts of hashed words: the same vectors everywhere and without a model, but they carry no meaning."""

    name = "hashing"

    def __init__(self, dim: int):
        self.dim = dim

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            vector = [0.0] * self.dim
            for word, n in Counter(text.split()).items():
                vector[word_number(word) % self.dim] += n
            out.append(vector)
        return out


@lru_cache(REMEMBERED)
def word_number(word: str) -> int:
    """The first eight hex digits of a word's md5."""
    return int(hashlib.md5(word.encode("utf-8")).hexdigest()[:8], 16)


class HttpEmbedder:
    def __init__(self, settings: Settings):
        self.url, self.name, self.dim = f"{settings.base_url}/api/embed", settings.embed_model, settings.embed_dim

    def embed(self, texts: list[str]) -> list[list[float]]:
        return post(self.url, {"model": self.name, "input": texts})["embeddings"]


class FirstLineGenerator:
    """An extractive stand-in: it thinks aloud and then gives the first line of the first chunk in the context of a prompt that `template` made."""

    def __init__(self, template: str = PROMPT):
        self.around = Template(template).between("context")

    def generate(self, prompts: list[str]) -> list[str]:
        return [f"<think>\n{len(p)} characters to read\n</think>\n{self.first_line(p)}\n" for p in prompts]

    def first_line(self, prompt: str) -> str:
        before, after = self.around
        context = prompt.partition(before)[2] if before else prompt
        context = context.partition(after)[0] if after else context
        return context.partition("]\n")[2].partition("\n")[0] if context else "The context does not hold the answer."


class HttpGenerator:
    def __init__(self, settings: Settings):
        self.url = f"{settings.base_url}/api/generate"
        self.body = {"model": settings.chat_model, "stream": False, "think": False, "options": {"temperature": settings.temperature, "num_ctx": settings.num_ctx}}

    def generate(self, prompts: list[str]) -> list[str]:
        return [post(self.url, self.body | {"prompt": p})["response"] for p in prompts]


def post(url: str, body: dict, timeout: float = 600) -> dict:
    with urlopen(Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"}), timeout=timeout) as r:
        return json.load(r)


def with_embeddings(rows: DataFrame, embedder: Embedder, text_col: str = "chunk", batch: int = 64, name: str = "embedding") -> DataFrame:
    """rows with a vector of floats per text, embedded in calls of at most `batch` texts. A null text has a null vector."""
    keep = rows.columns
    read = rows.select(F.col(text_col).alias("_embed_text"), *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).to_pylist()
            have = [i for i, t in enumerate(texts) if t is not None]
            vectors: list[list[float] | None] = [None] * len(texts)
            for at in range(0, len(have), batch):
                part = have[at : at + batch]
                for i, v in zip(part, embedder.embed([texts[i] for i in part]), strict=True):
                    if len(v) != embedder.dim:
                        raise ValueError(f"the model gave {len(v)} numbers, {embedder.dim} are set")
                    vectors[i] = v
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(vectors, pa.list_(pa.float32()))], [*keep, name])

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return read.mapInArrow(run, f"{schema}, `{name}` array<float>")


def with_answers(rows: DataFrame, generator: Generator, prompt_col: str = "prompt", name: str = "answer") -> DataFrame:
    """rows with the generator's raw answer to each prompt."""
    keep = rows.columns
    read = rows.select(F.col(prompt_col).alias("_prompt"), *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(generator.generate(b.column(0).to_pylist()), pa.string())], [*keep, name])

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return read.mapInArrow(run, f"{schema}, `{name}` string")


def installed(base_url: str, timeout: float = 5) -> set[str]:
    """The names of the models that a server has."""
    try:
        with urlopen(f"{base_url}/api/tags", timeout=timeout) as r:
            return {m["name"] for m in json.load(r)["models"]}
    except (URLError, TimeoutError) as e:
        raise ModelError(f"No model server answers at {base_url}.") from e


def preflight(settings: Settings, chat: bool = True, have: set[str] | None = None) -> None:
    """An error that names the first needed model that isn't installed: the embedding model, then the chat model if it is asked for."""
    have = installed(settings.base_url) if have is None else have
    for model in [settings.embed_model, *([settings.chat_model] if chat else [])]:
        if not any(f"{n}:".startswith(f"{model}:") for n in have):
            raise ModelError(f"The model {model!r} is not installed.")
