"""Vectors of texts by any encoder, and what identifies it."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass
from pathlib import Path
from typing import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.sources.store import compatibility, hash_vector


@dataclass(frozen=True)
class Embedder:
    """A function from texts to vectors that workers can load, their dimension, and a fingerprint of what made them."""

    dim: int
    fingerprint: str
    encode: Callable[[list[str]], list[list[float]]]
    batch: int = 64


def stand_in(dim: int) -> Embedder:
    """Vectors by hash, where there is no model."""
    return Embedder(dim, model_fingerprint(f"hash-{dim}", dim), lambda texts: [hash_vector(t, dim) for t in texts])


def model_fingerprint(model: str, dim: int) -> str:
    """A digest of the dimension and the model's name, or, for a local folder, of its settings and of both ends of its weights."""
    digest, root = hashlib.sha256(f"dim={dim}\n".encode()), Path(model)
    if not root.is_dir():
        digest.update(f"model={model.strip().lower()}".encode())
        return f"sha256:{digest.hexdigest()}"
    try:
        name = json.loads((root / "config.json").read_text(encoding="utf-8")).get("_name_or_path")
    except (OSError, ValueError, AttributeError):
        name = None
    digest.update(f"model={str(name or root.name).strip().lower()}\n".encode())
    for settings in ("modules.json", "config.json", "sentence_bert_config.json"):
        if (root / settings).is_file():
            digest.update(settings.encode() + (root / settings).read_bytes())
    end = 1 << 20
    for path in sorted([*root.glob("*.safetensors"), *root.glob("pytorch_model*.bin")]):
        size = path.stat().st_size
        digest.update(f"{path.name}:{size}".encode())
        with path.open("rb") as file:
            digest.update(file.read(end))
            if size > end:
                file.seek(size - end)
                digest.update(file.read(end))
    return f"sha256:{digest.hexdigest()}"


def embedded(rows: DataFrame, text: str, by: Embedder, column: str = "embedding") -> DataFrame:
    """``rows`` with unit vectors of ``text`` (null: empty), made in batches of ``by.batch``; a vector of another dimension is an error."""

    @F.pandas_udf("array<double>")
    def vectors(texts: pd.Series) -> pd.Series:
        own, out = texts.fillna("").tolist(), []
        for at in range(0, len(own), by.batch):
            for v in by.encode(own[at : at + by.batch]):
                if len(v) != by.dim:
                    raise ValueError(f"a vector has {len(v)} numbers, not {by.dim}")
                norm = sum(x * x for x in v) ** 0.5
                out.append([x / norm for x in v] if norm else list(v))
        return pd.Series(out, dtype="object")

    return rows.withColumn(column, vectors(F.col(text)))


def index_rows(documents: DataFrame, fragments: DataFrame, vectors: DataFrame, collection: str) -> tuple[DataFrame, DataFrame]:
    """(vectors of a collection with their fragments' texts, documents of it that have vectors)."""
    own = documents.where(F.col("collection") == collection)
    held = vectors.join(fragments.select("fragment_id", "doc_id", "text"), "fragment_id").join(own.select("doc_id"), "doc_id")
    return held, own.join(held.select("doc_id"), "doc_id", "left_semi")


def with_embedding(meta, vector, fingerprint: str):
    """A struct of metadata as it was, but with a new summary vector and fingerprint."""
    return meta.withField("embedding_fingerprint", F.lit(fingerprint)).withField("summary_embedding", vector)


def validate(documents: DataFrame, vectors: DataFrame, fingerprint: str) -> None:
    """An error with up to three examples if documents have vectors of another encoder."""
    told = compatibility(documents, vectors, fingerprint, samples=3).first()
    if told.mismatched:
        raise ValueError(f"{told.mismatched} of {told.documents} documents have vectors of another encoder, for example {told.examples}")
