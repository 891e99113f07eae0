"""Suffix-array dedup of bytes: strings that stand more than once are removed everywhere.

After prefix-free parsing: the smallest rolling hash of each window is its
trigger, so that every 400-byte string holds one that depends on the string
alone; texts are parsed into spans around triggers, and a dictionary holds each
distinct span once. The suffixes of the corpus that begin with a trigger are
sorted, a range of their order per task, and so is what precedes each trigger,
read backwards; equal strings are neighbours in both. See ``repeats``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as t
from .repeats import CHUNK, Spec, covered, keyed_texts, repeated_windows

SCHEMA = "id long, no_id boolean, n_bytes long, n_removed long, spans array<struct<lo:int,hi:int>>, kept binary"


def _cut(width: int):
    def rows(batches):
        for batch in batches:
            data, offsets = t.column_bytes(batch.column("text"))
            sizes, removed, spans, kept = [], [], [], []
            for i, runs in enumerate(batch.column("runs").to_pylist()):
                raw = data[offsets[i] : offsets[i + 1]]
                mask = covered(runs, len(raw), width)
                edge = np.diff(np.pad(mask, 1).astype(np.int8)) if runs else np.zeros(0)
                lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                sizes.append(len(raw))
                removed.append(int(mask.sum()))
                spans.append([{"lo": int(a), "hi": int(b)} for a, b in zip(lo, hi, strict=True)])
                kept.append(raw[~mask].tobytes() if runs else raw.tobytes())
            kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("no_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())],
                ["id", "no_id", "n_bytes", "n_removed", "spans", "kept"],
            )

    return rows


def remove_repeated_strings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 400, gram: int = 64, chunk: int = CHUNK) -> DataFrame:
    """Cuts every byte that lies in a ``width``-byte string standing twice or more.

    Returns a row per input row: ``id_col``, n_bytes, n_removed, spans (maximal
    removed runs as [lo, hi) byte offsets) and kept (the bytes left, as binary,
    since a cut may fall inside a character). Other columns are not looked at.

    Null text counts as empty; texts under ``width`` bytes lose nothing; a
    repeated row is a repeat like any other, so both copies lose their bytes;
    null ids come back as null; an empty table gives an empty result.
    """
    t.limit_arrow_batches(docs.sparkSession)
    texts = keyed_texts(docs, id_col, text_col)
    runs = repeated_windows(texts, Spec(width, min(gram, width), 1, False, t.byte_codes, chunk))
    out = texts.join(runs, ["id", "th"], "left").select("id", "no_id", "text", "runs").mapInArrow(_cut(width), SCHEMA)
    return out.select(F.when(~F.col("no_id"), F.col("id")).alias(id_col), "n_bytes", "n_removed", "spans", "kept")
