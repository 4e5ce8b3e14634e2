"""Settings of the engine: the process environment over a .env file over defaults."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields
from pathlib import Path

from .functions.template import Template
from .functions.text import PROMPT

#: Field -> environment variable; names and defaults are fixed values.
NAMES = {
    "pdf_dir": "PDF_DIR",
    "store_path": "STORE_PATH",
    "collection": "COLLECTION_NAME",
    "base_url": "OLLAMA_BASE_URL",
    "embed_model": "EMBED_MODEL",
    "embed_dim": "EMBED_DIM",
    "chat_model": "CHAT_MODEL",
    "temperature": "TEMPERATURE",
    "num_ctx": "NUM_CTX",
    "chunk_size": "CHUNK_SIZE",
    "chunk_overlap": "CHUNK_OVERLAP",
    "top_k": "TOP_K",
    "store_buckets": "STORE_BUCKETS",
    "prompt_template": "PROMPT_TEMPLATE",
}


@dataclass(frozen=True)
class Settings:
    pdf_dir: str = "pdfs"
    store_path: str = "store"
    collection: str = "dev_profiles"
    base_url: str = "http://localhost:11434"
    embed_model: str = "nomic-embed-text"
    embed_dim: int = 768
    chat_model: str = "deepseek-r1:1.5b"
    temperature: float = 0.4
    num_ctx: int = 8192
    chunk_size: int = 1200
    chunk_overlap: int = 200
    top_k: int = 5
    batch_size: int = 64
    store_buckets: int = 64
    prompt_template: str = PROMPT

    def __post_init__(self):
        if self.chunk_size < 1 or self.chunk_overlap < 0 or self.chunk_overlap > self.chunk_size:
            raise ValueError("chunk_overlap must be from 0 to chunk_size, chunk_size at least 1")
        if self.embed_dim < 1 or self.top_k < 1 or self.batch_size < 1 or self.store_buckets < 1:
            raise ValueError("embed_dim, top_k, batch_size and store_buckets must be at least 1")

        if unknown := set(Template(self.prompt_template).slots) - {"context", "question"}:
            raise ValueError(f"PROMPT_TEMPLATE may have the slots context and question, not {', '.join(sorted(unknown))}")

    @classmethod
    def load(cls, env: dict[str, str] | None = None, dotenv: str | Path | None = ".env") -> Settings:
        """Numbers are parsed strictly: a variable that is set to nothing is an error for them."""
        values = read_dotenv(dotenv) if dotenv else {}
        values.update(os.environ if env is None else env)
        kinds = {f.name: type(f.default) for f in fields(cls)}
        return cls(**{f: kinds[f](values[v]) for f, v in NAMES.items() if v in values})


def read_dotenv(path: str | Path) -> dict[str, str]:
    """KEY=value lines; blank lines and # comments are passed over, `export` and paired quotes are dropped; no file, no values."""
    path, out = Path(path), {}
    if path.is_file():
        for line in path.read_text(encoding="utf-8").splitlines():
            key, eq, value = line.strip().removeprefix("export ").partition("=")
            if eq and not key.startswith("#"):
                value = value.strip()
                out[key.strip()] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"" else value
    return out
