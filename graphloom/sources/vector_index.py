"""Vector indexes: built incrementally by an embedder that the caller gives, overlaid, described."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import first_filled
from ..functions.vectors import norm, unit

# Prefixes that model families want before documents and queries.
PREFIXES = {"nomic-embed-text": ("search_document: ", "search_query: "), "multilingual-e5": ("passage: ", "query: "), "e5-": ("passage: ", "query: ")}

#: A list of texts to a list of vectors.
Embedder = Callable[[list[str]], list[list[float]]]


@dataclass(frozen=True)
class IndexInfo:
    """What decides whether rows of an earlier index may be used again."""

    provider: str
    model: str
    dimensions: int
    semantic: bool = True
    document_prefix: str = ""
    query_prefix: str = ""
    extra: dict = field(default_factory=dict, compare=False)


def prefixes(model: str) -> tuple[str, str]:
    return next((p for name, p in PREFIXES.items() if model.startswith(name)), ("", ""))


def hash_embedder(dimensions: int = 64) -> Embedder:
    """Deterministic vectors from hashed words and trigrams, for tests and offline use."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = np.zeros(dimensions)
            for w in text.lower().split():
                for g in [w, *(w[i : i + 3] for i in range(len(w) - 2))]:
                    h = int.from_bytes(hashlib.blake2b(g.encode(), digest_size=8).digest(), "big")
                    v[h % dimensions] += 1 if h >> 63 else -1
            out.append(v.tolist())
        return out

    return embed


def node_text(nodes: DataFrame) -> Column:
    """The text that stands for a node: a line per field, null and empty ones and provisional summaries left out."""
    have = set(nodes.columns)
    lines = []
    for c in ("type", "title", "summary", "description", "path", "aliases", "tags"):
        if c in have:
            value = F.array_join(c, "\n") if c in ("aliases", "tags") else F.col(c)
            if c == "summary" and "summary_provisional" in have:
                value = F.when(~F.coalesce("summary_provisional", F.lit(False)), value)
            lines.append(first_filled(value))
    return F.concat_ws("\n", *lines)


def build_index(nodes: DataFrame, embedder: Embedder, info: IndexInfo, previous: DataFrame | None = None, previous_info: IndexInfo | None = None) -> DataFrame:
    """(node_id, vector, norm, text_hash); rows of ``previous`` with the same text are used again, if the indexes agree.

    A vector of another size, or with a value that is no number, fails the build.
    """
    texts = nodes.select(F.col("id").alias("node_id"), F.concat(F.lit(info.document_prefix), node_text(nodes)).alias("text"))
    hashed = texts.withColumn("text_hash", F.sha2(F.col("text").cast("binary"), 256))
    reuse = previous is not None and previous_info == info
    misses = hashed.join(previous.select("node_id", "text_hash"), ["node_id", "text_hash"], "left_anti") if reuse else hashed
    size = info.dimensions

    def embed(batches):
        import pandas as pd

        for pdf in batches:
            vectors = embedder(pdf["text"].tolist())
            for v in vectors:
                if len(v) != size or not np.isfinite(v).all():
                    raise ValueError(f"embedding of {len(v)} values, not {size} finite ones")
            yield pd.DataFrame({"node_id": pdf["node_id"], "vector": [np.asarray(v, float).tolist() for v in vectors], "text_hash": pdf["text_hash"]})

    made = misses.mapInPandas(embed, "node_id string, vector array<double>, text_hash string").withColumn("vector", unit(F.col("vector")))
    if reuse:
        made = made.unionByName(previous.select("node_id", "vector", "text_hash").join(hashed.select("node_id", "text_hash"), ["node_id", "text_hash"], "left_semi"))
    return made.withColumn("norm", norm(F.col("vector")))


def overlay(base: DataFrame, delta: DataFrame, base_info: IndexInfo, delta_info: IndexInfo) -> DataFrame:
    """``base`` with the rows of ``delta`` in place of its own."""
    if (base_info.provider, base_info.dimensions) != (delta_info.provider, delta_info.dimensions):
        raise ValueError("the indexes differ in provider or dimensions")
    return base.join(delta.select("node_id"), "node_id", "left_anti").unionByName(delta)


def write_index(index: DataFrame, info: IndexInfo, folder: str) -> None:
    index.write.mode("overwrite").parquet(f"{folder}/rows")
    index.sparkSession.createDataFrame([(json.dumps(asdict(info)),)], "info string").coalesce(1).write.mode("overwrite").json(f"{folder}/info")


def read_index(spark: SparkSession, folder: str) -> tuple[DataFrame, IndexInfo]:
    raw = json.loads(spark.read.schema("info string").json(f"{folder}/info").first()["info"])
    return spark.read.parquet(f"{folder}/rows"), IndexInfo(**raw)


def describe(index: DataFrame, info: IndexInfo) -> DataFrame:
    return index.agg(F.count("*").alias("rows")).select(F.lit(info.provider).alias("provider"), F.lit(info.model).alias("model"), F.lit(info.dimensions).alias("dimensions"), "rows")


def is_stale(spark: SparkSession, vault: str, built_at) -> bool:
    """Whether any file of the vault is younger than the index."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(vault, wholetext=True)
    return not files.select(F.col("_metadata.file_modification_time").alias("t")).filter(F.col("t") > F.lit(built_at)).isEmpty()
