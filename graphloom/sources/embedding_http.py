"""Embeddings over HTTP from servers that speak the common ``/embeddings`` and ``/models`` requests."""

from __future__ import annotations

import json
import urllib.error
import urllib.request

from .vector_index import Embedder

#: Where local servers usually listen, asked in this order when no base is given.
LOCAL_BASES = ("http://127.0.0.1:11434/v1", "http://127.0.0.1:1234/v1")


class EmbeddingError(RuntimeError):
    """The server can't be reached, or its answer can't be used."""


def _request(url: str, body: dict | None, timeout: float, key: str | None = None) -> dict:
    data = None if body is None else json.dumps(body).encode()
    headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
    try:
        with urllib.request.urlopen(urllib.request.Request(url, data, headers), timeout=timeout) as answer:
            return json.load(answer)
    except (OSError, ValueError, urllib.error.URLError) as e:
        raise EmbeddingError(f"{url}: {e}") from e


def list_models(base: str, timeout: float = 5.0) -> list[str]:
    return [m["id"] for m in _request(f"{base.rstrip('/')}/models", None, timeout).get("data", [])]


def resolve_target(model: str | None, base: str | None = None, timeout: float = 5.0) -> tuple[str, str]:
    """(base, model) to use: the pinned model at the given base, or at the first local one that serves it."""
    if not model:
        raise EmbeddingError("no model is pinned: vectors of different models can't be compared")
    seen = []
    for place in (base,) if base else LOCAL_BASES:
        try:
            models = list_models(place, timeout)
        except EmbeddingError as e:
            seen.append(str(e))
            continue
        if model in models or any(m.split(":")[0] == model for m in models):
            return place, model
        seen.append(f"{place} has no {model}")
    raise EmbeddingError("; ".join(seen))


def http_embedder(base: str, model: str, timeout: float = 60.0, key: str | None = None) -> Embedder:
    """An embedder for ``build_index``: one request per batch of texts, answered in their order."""

    def embed(texts: list[str]) -> list[list[float]]:
        if not texts:
            return []
        answer = _request(f"{base.rstrip('/')}/embeddings", {"model": model, "input": texts}, timeout, key)
        rows = sorted(answer.get("data", []), key=lambda r: r.get("index", 0))
        if len(rows) != len(texts):
            raise EmbeddingError(f"{len(rows)} vectors for {len(texts)} texts")
        return [[float(x) for x in r["embedding"]] for r in rows]

    return embed
