"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1 entries, drawn by a hash of its
lower-case code point. A letter trigram is bound
from its letters' vectors, permuted (rotated) by their places, as an entrywise
product; a text bundles its trigrams by addition. A language's prototype
bundles its training texts, each scaled to unit length. A text gets the
language of the prototype with the largest cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as t

DIMENSIONS = 512
#: Fixed-point scale of bundled training vectors, so that their sums don't depend on order.
SCALE = 1 << 20
#: Bits of a code point, of which a trigram packs three.
POINT = 21
#: Characters of a text read at once, and trigrams bound at once.
SEGMENT, BLOCK = 1 << 18, 1 << 13

_code: np.ndarray | None = None


def _codes() -> np.ndarray:
    """For each code point of the first four planes (no letters lie above) its lower case, or 0, a gap, for what is no letter."""
    global _code
    if _code is None:
        _code = np.array([ord(chr(p).lower()[0]) if chr(p).isalpha() else 0 for p in range(0x40000)], dtype=np.int64)
    return _code


def letter_vectors(codes: np.ndarray) -> np.ndarray:
    """A row of +1 and -1 for each code."""
    words = t.mix(t.mix(codes.astype(t.U64)[:, None] + t.U64(0x5851F42D4C957F2D)) + np.arange(DIMENSIONS // 64, dtype=t.U64)[None, :] * t.U64(0x9E3779B97F4A7C15))
    return np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1).astype(np.int8) * 2 - 1


def _code_parts(text: str) -> Iterator[np.ndarray]:
    """Letter codes with one gap between words and at both ends, a segment at a time; nothing if there is no letter."""
    code, last, gap = _codes(), -1, True
    for at in range(0, len(text), SEGMENT):
        points = np.frombuffer(text[at : at + SEGMENT].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        x = code[np.minimum(points, len(code) - 1)]
        letter = x > 0
        if letter.any():
            keep = letter.copy()
            keep[:-1] |= letter[1:]  # of a gap, its last place
            own = x[keep]
            if gap and own[0] != 0:
                own = np.concatenate([[0], own])
            last = own[-1]
            yield own
        gap = not letter[-1]
    if last > 0:
        yield np.zeros(1, np.int64)


def letter_codes(text: str) -> np.ndarray:
    """The codes of :func:`_code_parts` as one array."""
    parts = list(_code_parts(text))
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Packed letter trigrams of a text and how often each stands in it.

    Texts of any length are read in segments; two codes go along from one to
    the next, so that nothing is lost where they meet.
    """
    found, carry = [], np.zeros(0, np.int64)
    for part in _code_parts(text):
        x = np.concatenate([carry, part])
        if len(x) >= 3:
            found.append(np.unique((x[:-2] << (2 * POINT)) | (x[1:-1] << POINT) | x[2:], return_counts=True))
        carry = x[-2:]
    if len(found) <= 1:
        return found[0] if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    every, place = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
    return every, np.bincount(place, weights=np.concatenate([n for _, n in found])).astype(np.int64)


def bundle(texts: list[str]) -> np.ndarray:
    """A row per text: the sum of its trigrams' vectors (zero without letters)."""
    out = np.zeros((len(texts), DIMENSIONS), dtype=np.float32)
    grams, owner = [], []
    for i, text in enumerate(texts):
        found, counts = gram_counts(text)
        if len(found):
            grams.append((found, counts))
            owner.append(i)
    if not owner:
        return out
    every, inverse = np.unique(np.concatenate([g for g, _ in grams]), return_inverse=True)
    weights = np.zeros((len(owner), len(every)), dtype=np.float32)
    at = 0
    for row, (found, counts) in enumerate(grams):
        weights[row, inverse[at : at + len(found)]] = counts
        at += len(found)
    for first in range(0, len(every), BLOCK):
        some = every[first : first + BLOCK]
        letters, place = np.unique(np.concatenate([some >> (2 * POINT), (some >> POINT) & ((1 << POINT) - 1), some & ((1 << POINT) - 1)]), return_inverse=True)
        a, b, c = letter_vectors(letters)[place].reshape(3, len(some), DIMENSIONS)
        out[owner] += weights[:, first : first + BLOCK] @ (np.roll(a, 2, axis=1) * np.roll(b, 1, axis=1) * c).astype(np.float32)
    return out


def _groups(column: pa.Array, rows: int = 32, size: int = 1 << 18):
    """Texts a few at a time, by rows and by size."""
    held: list[str] = []
    total = first = 0
    for i, x in enumerate(column.to_pylist()):
        held.append(x or "")
        total += len(held[-1])
        if len(held) >= rows or total >= size:
            yield first, held
            held, total, first = [], 0, i + 1
    if held:
        yield first, held


def _train(batches):
    """Per task one fixed-point bundle per language, as rows (lang, place, value)."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for first, texts in _groups(batch.column("text")):
            v = bundle(texts)
            norm = np.sqrt((v.astype(np.float64) ** 2).sum(axis=1))
            for j in np.flatnonzero(norm):
                own = np.rint(v[j] / norm[j] * SCALE).astype(np.int64)
                lang = langs[first + j]
                sums[lang] = sums[lang] + own if lang in sums else own
    for lang, v in sorted(sums.items()):
        yield pa.RecordBatch.from_arrays([pa.array([lang] * DIMENSIONS), pa.array(np.arange(DIMENSIONS, dtype=np.int32)), pa.array(v)], ["lang", "place", "value"])


def train_prototypes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_rows: int = 40_000, most_languages: int = 4096) -> dict[str, np.ndarray]:
    """Unit prototypes by language from rows whose crc32 of the id's text modulo 4 is not 2.

    ``most_rows`` bounds the training rows (about; chosen by a hash of the id).
    What reaches the driver is one vector per language; ValueError if the
    sample has more than ``most_languages``.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.crc32(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")) % 4 != 2))
    share = most_rows / max(rows.select("id").count(), 1)
    if share < 1:
        rows = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    sums = rows.select("text", "lang").mapInArrow(_train, "lang string, place int, value long").groupBy("lang", "place").agg(F.sum("value").alias("value"))
    out: dict[str, np.ndarray] = {}
    found = sums.limit(DIMENSIONS * most_languages + 1).collect()
    if len(found) > DIMENSIONS * most_languages:
        raise ValueError(f"more than {most_languages} languages")
    for lang, place, value in found:
        out.setdefault(lang, np.zeros(DIMENSIONS))[place] = value
    return {lang: v / np.sqrt((v**2).sum()) for lang, v in sorted(out.items()) if v.any()}


def identify_languages(docs: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", unknown: str = "und") -> DataFrame:
    """``id_col``, lang_pred and score (cosine, 0 to 1) of every whole text.

    Null text and text without letters get ``unknown`` and 0, as does every
    text when there are no prototypes. Ties go to the smaller language name.
    Null and repeated ids come back as they are; columns beyond id and text,
    whatever their names, are left out; an empty table gives an empty result.
    Texts of any length are read whole, in segments.
    """
    t.limit_arrow_batches(docs.sparkSession)
    names = sorted(prototypes)
    matrix = np.array([prototypes[x] for x in names]).reshape(len(names), DIMENSIONS)

    def rows(batches):
        for batch in batches:
            langs: list[str] = []
            scores: list[float] = []
            for _, texts in _groups(batch.column("text")):
                v = bundle(texts).astype(np.float64)
                norm = np.sqrt((v**2).sum(axis=1))
                if not len(names):
                    langs += [unknown] * len(texts)
                    scores += [0.0] * len(texts)
                    continue
                cosine = (v @ matrix.T) / np.where(norm > 0, norm, 1)[:, None]
                best = cosine.argmax(axis=1)
                langs += [names[b] if n > 0 else unknown for b, n in zip(best, norm, strict=True)]
                scores += np.clip(cosine[np.arange(len(best)), best], 0, 1).tolist()
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(rows, f"id {kind}, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)
