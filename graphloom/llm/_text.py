"""Vectorised text primitives shared by the operators of this subpackage.

Everything here works on UTF-8 bytes held in numpy arrays, so that one call
handles a whole Arrow batch. Nothing keeps state between tasks except tables
of constants, which are the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: ASCII white space: space and TAB, LF, VT, FF, CR.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: Bytes of text handled at once by the vectorised code.
SEGMENT = 1 << 20

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE_CODES = np.random.default_rng(20240517).integers(1, 2**63, 256, dtype=np.int64).astype(U64)

_powers = np.ones(1, dtype=U64)
_inverses = np.ones(1, dtype=U64)


def limit_arrow_batches(spark, max_bytes: int = 4 << 20, max_rows: int = 512) -> None:
    """Keep Arrow batches small enough that long texts never fill a worker.

    Plans are lazy, so the session's limits must still hold when they run:
    larger ones are lowered for good, smaller ones are left alone.
    """
    own = spark._jsparkSession.sessionState().conf()
    for name, now, most in (("maxBytesPerBatch", own.arrowMaxBytesPerBatch(), max_bytes), ("maxRecordsPerBatch", own.arrowMaxRecordsPerBatch(), max_rows)):
        if not 0 < now <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the hash base modulo 2**64, and their inverses."""
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), 1 << 16)
        step, back = np.full(size, _BASE, dtype=U64), np.full(size, pow(_BASE, -1, 1 << 64), dtype=U64)
        step[0] = back[0] = 1
        _powers, _inverses = np.cumprod(step, dtype=U64), np.cumprod(back, dtype=U64)
    return _powers[:n], _inverses[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def prefix_hash(symbols: np.ndarray) -> np.ndarray:
    """Running polynomial sums; see :func:`span_hash`."""
    power, _ = powers(len(symbols))
    out = np.zeros(len(symbols) + 1, dtype=U64)
    np.cumsum(symbols * power, out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end), alike wherever the span stands."""
    _, inverse = powers(len(sums))
    return mix((sums[end] - sums[start]) * inverse[start])


def byte_codes(data: np.ndarray) -> np.ndarray:
    return _BYTE_CODES[data]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z become a-z; every other byte stays."""
    return _LOWER[data]


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its n + 1 offsets; null is empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if len(at) == 0:
        at = np.zeros(1, np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def row_groups(offsets: np.ndarray, size: int = SEGMENT) -> Iterator[tuple[int, int]]:
    """Runs of rows [first, last) of about ``size`` bytes each, one row at least."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of non-space bytes.

    ``bounds`` are the rows' n + 1 offsets into ``data``; words end with their row.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = ~_IS_SPACE[data]
    first, last = np.zeros(len(data) + 1, dtype=bool), np.zeros(len(data) + 1, dtype=bool)
    first[1:-1] = ~solid[:-1]
    last[:-2] = ~solid[1:]
    inner = bounds[(bounds >= 0) & (bounds <= len(data))]
    first[inner] = True
    last[inner[inner > 0] - 1] = True
    start = np.flatnonzero(first[:-1] & solid)
    end = np.flatnonzero(last[:-1] & solid) + 1
    return start, end, np.searchsorted(bounds, start, side="right") - 1


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, from its bytes alone."""
    if not len(start):
        return np.zeros(0, U64)
    return span_hash(prefix_hash(byte_codes(data)), start, end) + (end - start).astype(U64)


def text_words(data: np.ndarray) -> np.ndarray:
    """Word hashes of one text, however long: cut at white space into segments."""
    if len(data) <= 4 * SEGMENT:
        start, end, _ = word_spans(data, np.array([0, len(data)]))
        return word_hashes(data, start, end)
    out, at = [], 0
    while at < len(data):
        stop = min(at + 4 * SEGMENT, len(data))
        while stop < len(data):
            blank = np.flatnonzero(_IS_SPACE[data[stop : stop + SEGMENT]])
            if len(blank):
                stop += int(blank[0])
                break
            stop = min(stop + SEGMENT, len(data))
        out.append(text_words(data[at:stop]) if stop - at <= 4 * SEGMENT else word_hashes(data[at:stop], *word_spans(data[at:stop], np.array([0, stop - at]))[:2]))
        at = stop
    return np.concatenate(out) if out else np.zeros(0, U64)


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column whose rows take ``counts`` values each, in order."""
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def signed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark's longs."""
    return x.view(np.int64) if x.dtype == U64 else x
