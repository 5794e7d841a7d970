"""Embedding texts: a protocol, an offline embedder, and an Arrow map that applies either.

No model files are at hand, so the default hashes tokens into a fixed number of signed buckets. It is deterministic and
needs no dependency; nothing is claimed about its relevance.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import query_prefix

#: Tokens of a text that count, as the models that this stands for cut their input.
LONGEST = 512
_TOKEN = re.compile(r"\w+", re.UNICODE)


class Embedder(Protocol):
    model: str

    def documents(self, texts: list[str]) -> np.ndarray: ...

    def query(self, text: str) -> np.ndarray: ...


def mean_pooled(tokens: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Unit vectors of the means of unmasked tokens; tokens: (texts, length, width), mask: (texts, length)."""
    m = mask[:, :, None].astype(tokens.dtype)
    return unit((tokens * m).sum(axis=1) / np.maximum(m.sum(axis=1), 1e-9))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


class HashingEmbedder:
    """Unit vectors of signed token counts."""

    def __init__(self, width: int = 256, model: str = "hashing"):
        self.width, self.model = width, model

    def documents(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.width))
        for i, text in enumerate(texts):
            for token in _TOKEN.findall((text or "").lower())[:LONGEST]:
                h = zlib.crc32(token.encode())
                out[i, h % self.width] += 1 if h >> 31 else -1
        return unit(out).astype(np.float32)

    def query(self, text: str) -> np.ndarray:
        return self.documents([query_prefix(self.model) + text])[0]


#: Models by name that this process has loaded.
_LOADED: dict[str, tuple] = {}


class ModelEmbedder:
    """Mean-pooled token vectors of a model that every process loads once, when it first meets a text.

    load() gives (tokenize, forward): tokenize takes texts and the most tokens of one and gives (ids, mask), forward takes
    these and gives token vectors, both as (texts, length[, width]) arrays. Only load and the name travel to workers;
    texts that share a name share a model.
    """

    def __init__(self, model: str, load: Callable[[], tuple], together: int = 64):
        self.model, self.load, self.together = model, load, together

    def documents(self, texts: list[str]) -> np.ndarray:
        if self.model not in _LOADED:
            _LOADED[self.model] = self.load()
        tokenize, forward = _LOADED[self.model]
        out = []
        for i in range(0, len(texts), self.together):
            ids, mask = tokenize([t or "" for t in texts[i : i + self.together]], LONGEST)
            out.append(mean_pooled(forward(ids, mask), mask))
        return np.concatenate(out).astype(np.float32) if out else np.zeros((0, 0), np.float32)

    def query(self, text: str) -> np.ndarray:
        return self.documents([query_prefix(self.model) + text])[0]


def embed(df: DataFrame, text: str, embedder: Embedder, name: str = "embedding") -> DataFrame:
    """df with a unit vector of the text; a batch of rows is embedded at once."""
    kept = [c for c in df.columns if c != name]
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept), f"`{name}` array<float>"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = kept.index(text)
        for b in batches:
            vectors = embedder.documents([t or "" for t in b.column(at).to_pylist()]) if b.num_rows else np.zeros((0, 0))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(vectors), pa.list_(pa.float32()))], [*kept, name])

    return df.select(*kept).mapInArrow(each, schema)


def index_rows(chunks: DataFrame) -> DataFrame:
    """Chunks as flat records: scalars only, references joined by commas, missing values as empty."""
    flat = {c: F.coalesce(c, F.lit("")) for c in ("doc_id", "revision", "chip_part", "section_path", "element_type", "peripheral", "register_name", "figure_id", "image_path", "table_id", "render_text", "citation")}
    pages = {c: F.coalesce(c, F.lit(0)) for c in ("page_start", "page_end")}
    refs = {c: F.array_join(F.coalesce(c, F.array().cast("array<string>")), ",") for c in ("figure_refs", "table_refs")}
    return chunks.withColumns(flat | pages | refs)


def build_index(chunks: DataFrame, embedder: Embedder) -> DataFrame:
    return embed(index_rows(chunks), "render_text", embedder)
