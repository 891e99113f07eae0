"""Substring dedup of words by seed and extension: the first document keeps a passage.

Documents meet on winnowed anchors (each 50-word window selects its smallest
hash of ``gram`` words, so that long matches always share one). Matches are
extended both ways from the anchor by common prefix lengths in the two suffix
orders, and maximal repeats of ``width`` words or more are cut from all
documents but the one with the smallest id. See ``repeats``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as t
from .repeats import CHUNK, Spec, covered, keyed_texts, repeated_windows

SCHEMA = "id long, no_id boolean, n_words long, n_removed long, spans array<struct<lo:int,hi:int>>, kept string"


def _cut(width: int):
    def rows(batches):
        for batch in batches:
            data, offsets = t.column_bytes(batch.column("text"))
            counts, removed, spans, kept = [], [], [], []
            for i, runs in enumerate(batch.column("runs").to_pylist()):
                raw = data[offsets[i] : offsets[i + 1]]
                words = raw.tobytes().split()
                lo = hi = np.zeros(0, np.int64)
                gone = 0
                if runs:
                    mask = covered(runs, len(words), width)
                    edge = np.diff(np.pad(mask, 1).astype(np.int8))
                    lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                    gone = int(mask.sum())
                    words = [w for w, cut in zip(words, mask.tolist(), strict=True) if not cut]
                counts.append(len(words) + gone)
                removed.append(gone)
                spans.append([{"lo": int(a), "hi": int(b)} for a, b in zip(lo, hi, strict=True)])
                kept.append(b" ".join(words))
            kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("no_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary()).cast(pa.string())],
                ["id", "no_id", "n_words", "n_removed", "spans", "kept"],
            )

    return rows


def remove_later_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50, gram: int = 12, chunk: int = CHUNK) -> DataFrame:
    """Cuts every word inside a ``width``-word window that also stands under a smaller id.

    Words are maximal runs without ASCII white space, unchanged. Returns a row
    per input row: ``id_col``, n_words, n_removed, spans (maximal removed runs
    as [lo, hi) word offsets) and kept (words left, joined by one space). Other
    columns are not looked at.

    Null text has no words; rows with the same id never cut each other; null
    ids count as one id below all others and come back as null; an empty table
    gives an empty result.
    """
    t.limit_arrow_batches(docs.sparkSession)
    texts = keyed_texts(docs, id_col, text_col)
    runs = repeated_windows(texts, Spec(width, min(gram, width), 8, True, t.text_words, chunk))
    out = texts.join(runs, ["id", "th"], "left").select("id", "no_id", "text", "runs").mapInArrow(_cut(width), SCHEMA)
    return out.select(F.when(~F.col("no_id"), F.col("id")).alias(id_col), "n_words", "n_removed", "spans", "kept")
