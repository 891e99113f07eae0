"""Quality classifier: a generalised additive model with pairwise interactions.

Features are read off the bytes and words of a text. Each gets quantile bins;
shallow trees, boosted feature after feature in cycles, add up to one lookup
table per feature, and then to one per chosen pair of features. A score is the
logistic of the tables' sum, so scoring is one vectorised addition per table.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _text as t

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "upper", "digits", "symbols", "marks", "bars", "non_ascii", "spaces",
    "distinct_words", "repeated_words", "top_word", "distinct_lines", "repeated_line_bytes", "line_words", "long_words",
)
#: Bytes from which a text is read in segments.
LONG = t.SEGMENT
FEATURE_SCHEMA = "id long, y int, x array<double>"

#: Byte classes: upper-case, digit, symbol, closing mark, bar, non-ASCII, space; 0 is the rest.
_CLASS = np.zeros(256, dtype=np.int64)
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[ord(c) for c in "#$%&*+/<=>@[]\\^_`{}~"]] = 3
_CLASS[[ord(c) for c in "!?;:"]] = 4
_CLASS[ord("|")] = 5
_CLASS[128:] = 6
_CLASS[list(t.SPACES)] = 7


def _runs(sorted_values: np.ndarray) -> np.ndarray:
    """Lengths of the runs of equal values."""
    edge = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1], [True]]))
    return np.diff(edge)


def text_features(data: np.ndarray) -> list[float]:
    """The features of one text's bytes; an empty text has defined ones too."""
    size = len(data)
    if not size:
        return [0.0] * len(FEATURES)
    if size > LONG:
        return _long_features(data)
    kinds = np.bincount(_CLASS[data], minlength=8) / size
    start, end, _ = t.word_spans(data, np.array([0, size]))
    n = len(start)
    sums = t.prefix_hash(t.byte_codes(data))
    if n:
        words = t.span_hash(sums, start, end)
        runs = _runs(np.sort(words))
        distinct, repeated, top = len(runs) / n, float((words[1:] == words[:-1]).sum()) / n, float(runs.max()) / n
        long = float((end - start > 24).sum()) / n
    else:
        distinct, repeated, top, long = 1.0, 0.0, 0.0, 0.0
    breaks = np.flatnonzero(data == 10)
    lo, hi = np.concatenate([[0], breaks + 1]), np.concatenate([breaks, [size]])
    lines, lengths = t.span_hash(sums, lo, hi), hi - lo
    _, first, counts = np.unique(lines, return_index=True, return_counts=True)
    again = float((lengths[first] * (counts - 1)).sum()) / size
    return [
        np.log1p(size), np.log1p(n), size / max(n, 1), kinds[1], kinds[2], kinds[3], kinds[4], kinds[5], kinds[6], kinds[7],
        distinct, repeated, top, len(first) / len(lines), again, n / len(lines), long,
    ]


def _long_words(data: np.ndarray) -> tuple[np.ndarray, int]:
    """A hash of each word of a long text, and how many have over 24 bytes; read in segments cut at white space."""
    hashes, long, at, size = [], 0, 0, len(data)
    while at < size:
        stop = min(at + LONG, size)
        while stop < size:
            blank = np.flatnonzero(_CLASS[data[stop : stop + LONG]] == 7)
            stop = stop + int(blank[0]) if len(blank) else min(stop + LONG, size)
            if len(blank):
                break
        start, end, _ = t.word_spans(data[at:stop], np.array([0, stop - at]))
        long += int((end - start > 24).sum())
        huge = end - start > LONG  # the last one at most
        own = data[at:stop]
        if (~huge).any():
            last = int(end[~huge][-1])
            hashes.append(t.word_hashes(own[:last], start[~huge], end[~huge]))
        for a, b in zip(start[huge].tolist(), end[huge].tolist(), strict=True):
            hashes.append(np.frombuffer(hashlib.blake2b(own[a:b].tobytes(), digest_size=8).digest(), dtype=t.U64))
        at = stop
    return (np.concatenate(hashes) if hashes else np.zeros(0, t.U64)), long


def _long_features(data: np.ndarray) -> list[float]:
    """:func:`text_features` of a text too long for running sums over all of it."""
    size = len(data)
    kinds = sum(np.bincount(_CLASS[data[a : a + LONG]], minlength=8) for a in range(0, size, LONG)) / size
    words, long = _long_words(data)
    n = len(words)
    distinct, repeated, top = 1.0, 0.0, 0.0
    if n:
        repeated = float((words[1:] == words[:-1]).sum()) / n
        words.sort()
        runs = _runs(words)
        distinct, top = len(runs) / n, float(runs.max()) / n
    lines = Counter(data.tobytes().split(b"\n"))
    again = float(sum(len(line) * (k - 1) for line, k in lines.items())) / size
    total = lines.total()
    return [
        np.log1p(size), np.log1p(n), size / max(n, 1), kinds[1], kinds[2], kinds[3], kinds[4], kinds[5], kinds[6], kinds[7],
        distinct, repeated, top, len(lines) / total, again, n / total, long / max(n, 1),
    ]


def _features(batches):
    for batch in batches:
        data, offsets = t.column_bytes(batch.column("text"))
        x = np.array([text_features(data[a:b]) for a, b in zip(offsets, offsets[1:], strict=False)], dtype=np.float64).reshape(-1, len(FEATURES))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), t.list_array(x.ravel(), np.full(len(x), x.shape[1]), pa.float64())], ["id", "y", "x"])


@dataclass
class AdditiveModel:
    """Bin edges per feature, a table per feature, a table per chosen pair."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def decision(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        bins = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)]
        for j, table in enumerate(self.tables):
            out += table[bins[j]]
        for i, j, table in self.pairs:
            out += table[self.coarse[i][bins[i]], self.coarse[j][bins[j]]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.decision(x), -40, 40)))


def _leaf(g: float, h: float) -> float:
    return g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, least: float) -> np.ndarray:
    """A tree of up to ``leaves`` leaves over ordered bins, as one value per bin."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = None
        for at, (a, b) in enumerate(parts):
            if b - a < 2:
                continue
            cg, ch = np.cumsum(g[a:b]), np.cumsum(h[a:b])
            left_g, left_h = cg[:-1], ch[:-1]
            right_g, right_h = cg[-1] - left_g, ch[-1] - left_h
            gain = left_g**2 / (left_h + 1) + right_g**2 / (right_h + 1) - cg[-1] ** 2 / (ch[-1] + 1)
            gain[(left_h < least) | (right_h < least)] = 0
            k = int(gain.argmax())
            if gain[k] > 1e-9 and (best is None or gain[k] > best[0]):
                best = (gain[k], at, a + k + 1)
        if best is None:
            break
        _, at, cut = best
        a, b = parts[at]
        parts[at : at + 1] = [(a, cut), (cut, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = _leaf(g[a:b].sum(), h[a:b].sum())
    return out


def _quarter(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best pair of cuts of a grid into four leaves: gain and table."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    tg, th = cg[-1, -1], ch[-1, -1]
    a, ah = cg[:-1, :-1], ch[:-1, :-1]
    b, bh = cg[:-1, -1:] - a, ch[:-1, -1:] - ah
    c, c_h = cg[-1:, :-1] - a, ch[-1:, :-1] - ah
    d, dh = tg - a - b - c, th - ah - bh - c_h
    gain = a**2 / (ah + 1) + b**2 / (bh + 1) + c**2 / (c_h + 1) + d**2 / (dh + 1)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :] = _leaf(a[i, j], ah[i, j]), _leaf(b[i, j], bh[i, j])
    out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = _leaf(c[i, j], c_h[i, j]), _leaf(d[i, j], dh[i, j])
    return float(gain[i, j] - tg**2 / (th + 1)), out


def fit_additive(x: np.ndarray, y: np.ndarray, bins: int = 64, grid: int = 8, rounds: int = 60, pair_rounds: int = 30, pairs: int = 6, rate: float = 0.2, leaves: int = 3) -> AdditiveModel:
    """Fit by cyclic boosting; with no rows, or rows of one label only, the base decides."""
    n, width = x.shape
    ones = float(y.sum())
    base = float(np.log((ones + 0.5) / (n - ones + 0.5)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for j in range(width)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    coarse = [np.arange(len(e) + 1) * min(grid, len(e) + 1) // (len(e) + 1) for e in edges]
    model = AdditiveModel(base, edges, tables, coarse, [])
    if not 0 < ones < n:
        return model
    at = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)]
    f = np.full(n, base)
    least = max(1.0, n / 2000)

    def gradients():
        p = 1.0 / (1.0 + np.exp(-np.clip(f, -40, 40)))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for j in range(width):
            if len(tables[j]) < 2:
                continue
            g, h = gradients()
            size = len(tables[j])
            step = rate * np.clip(_tree(np.bincount(at[j], g, size), np.bincount(at[j], h, size), leaves, least / 8), -4, 4)
            tables[j] += step
            f += step[at[j]]
    cells = [c[a] for c, a in zip(coarse, at, strict=True)]
    sizes = [int(c[-1]) + 1 for c in coarse]

    def grids(i, j, g, h):
        flat, total = cells[i] * sizes[j] + cells[j], sizes[i] * sizes[j]
        return np.bincount(flat, g, total).reshape(sizes[i], sizes[j]), np.bincount(flat, h, total).reshape(sizes[i], sizes[j])

    g, h = gradients()
    ranked = sorted(((_quarter(*grids(i, j, g, h))[0], i, j) for i, j in combinations(range(width), 2) if min(sizes[i], sizes[j]) > 1), reverse=True)[:pairs]
    model.pairs = [(i, j, np.zeros((sizes[i], sizes[j]))) for _, i, j in ranked]
    for _ in range(pair_rounds):
        for i, j, table in model.pairs:
            g, h = gradients()
            step = rate * np.clip(_quarter(*grids(i, j, g, h))[1], -2, 2)
            table += step
            f += step[cells[i], cells[j]]
    return model


def train_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", most_rows: int = 20_000) -> AdditiveModel:
    """Fit on labelled rows whose crc32 of the id's text modulo 3 is not 1.

    ``most_rows`` bounds the sample (about; chosen by a hash of the id), whose
    labels are broadcast and whose features reach the driver, one row per id.
    Null labels and ids don't count; an id with several labels takes the
    smallest, one with several texts that of the smallest features.
    """
    t.limit_arrow_batches(docs.sparkSession)
    own = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y"))
    own = own.filter(F.crc32(F.col("id").cast("string").cast("binary")) % 3 != 1).groupBy("id").agg(F.min("y").alias("y"))
    share = most_rows / max(own.count(), 1)
    if share < 1:
        own = own.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id is not null")
    seen = texts.join(F.broadcast(own), "id").mapInArrow(_features, FEATURE_SCHEMA)
    rows = seen.groupBy("id").agg(F.min(F.struct("x", "y")).alias("r")).select("id", "r.x", "r.y").orderBy("id").toPandas()
    x = np.array(rows["x"].tolist(), dtype=np.float64).reshape(-1, len(FEATURES))
    return fit_additive(x, rows["y"].to_numpy(np.float64))


def with_quality(docs: DataFrame, model: AdditiveModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with each whole text's score; ``score_col`` replaces a column of that name."""
    t.limit_arrow_batches(docs.sparkSession)
    source = docs.drop(score_col) if score_col != text_col else docs
    schema = T.StructType([*source.schema.fields, T.StructField(score_col, T.DoubleType())])

    def rows(batches):
        for batch in batches:
            data, offsets = t.column_bytes(batch.column(text_col))
            x = np.array([text_features(data[a:b]) for a, b in zip(offsets, offsets[1:], strict=False)], dtype=np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(x))], [*batch.schema.names, score_col])

    return source.mapInArrow(rows, schema)


def classify_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_rows: int = 20_000) -> DataFrame:
    """Score every text; ``id_col``, held_out, score (0 to 1, higher is better), predicted.

    Only the text enters a score. Null text is scored as an empty one; equal
    texts score alike; with no usable labels every score is 0.5. Null and
    repeated ids come back as they are, a null one held out like the text ''.
    An empty table gives an empty result.
    """
    model = train_quality(docs, labels, id_col=id_col, text_col=text_col, most_rows=most_rows)
    held = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1
    return with_quality(docs.select(id_col, text_col), model, text_col).select(id_col, held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
