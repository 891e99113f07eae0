"""Exact detection of repeated windows, the engine of the two substring operators.

A *window* is ``width`` consecutive symbols (bytes, or words) of one text. Two
windows are equal when their symbols are. The engine finds every window that
has a qualifying equal elsewhere, without ever shuffling a row per window:

1. *Triggers.* Each window is represented by its smallest rolling hash of
   ``gram`` symbols (leftmost of ties). Equal windows have equal triggers at
   equal offsets. Windows that share a trigger form one run; the run with its
   windows' text is a *span*. About two rows per ``width - gram`` symbols come
   out, and repeats of a span inside a text are one row with many positions.
2. *Dictionary.* Distinct spans, told by 128 bits, with how often they stand
   and where first. Triggers that stand once are dropped. A span that stands
   in a qualifying place as a whole needs no order.
3. *Corpus order.* Where a trigger has several different spans, one
   representative of each is read again with its text. All suffixes that begin
   with a trigger are put in one order by a range-partitioned sort, so that a
   task holds a range of that order, and a common trigger simply takes several
   ranges. Common prefix lengths of neighbours there, and of neighbours in the
   order of what precedes the trigger (read backwards), tell for each distance
   from the trigger which windows are equal.
4. *Edges.* A window whose equals may lie behind an edge of its range, since
   what follows its trigger agrees with the row at the edge as far as the
   window reaches, is counted over all ranges by 128 bits.
5. *Cover.* Repeated windows meet their text once more.

A text is matched by (id, hash of text), so that repeated ids do not mix.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as t
from ._spark import drop_table, shared_table

#: Turns symbols into those of a second, independent hash.
SECOND = t.U64(0x6A09E667F3BCC909)
#: Windows handled at once in a very long text.
PART = 1 << 21
#: Symbols before a trigger by which spans are told apart beforehand, at least.
LEFT = 8
#: Bytes of span text that a range holds at most.
CHUNK = 24 << 20

ANCHOR_SCHEMA = "k long, sp long, sv long, id long, th long, da int, ln int, n int, at array<int>"
SPAN_SCHEMA = "k long, sp long, sv long, id long, n long, da int, ln int, body binary"
RUN_SCHEMA = "k long, sp long, sv long, id long, lo int, hi int, n long, w long, v long"


@dataclass(frozen=True)
class Spec:
    """``width`` symbols a window, ``gram`` symbols an anchor; ``item`` bytes a symbol.

    ``first_wins``: a window counts if an equal one stands under a smaller id;
    else if an equal one stands anywhere else.
    """

    width: int
    gram: int
    item: int
    first_wins: bool
    symbols: Callable[[np.ndarray], np.ndarray]
    chunk: int = CHUNK

    @property
    def lefts(self) -> list[int]:
        """How many symbols before a trigger are compared to tell spans apart beforehand."""
        step = max(self.width // 10, 1)
        return sorted({*range(step, self.width, step), min(LEFT, self.width)})


def anchors(codes: np.ndarray, spec: Spec) -> Iterator[tuple[np.ndarray, ...]]:
    """Trigger hash, span hashes, window-run start, trigger distance, run length less 1."""
    n, take = len(codes), spec.width - spec.gram + 1
    for base in range(0, n - spec.width + 1, PART):
        x = codes[base : base + PART + spec.width - 1]
        count = len(x) - spec.width + 1
        sums, again = t.prefix_hash(x), t.prefix_hash(t.mix(x ^ SECOND))
        grams = np.arange(len(x) - spec.gram + 1)
        full = t.span_hash(sums, grams, grams + spec.gram)
        keyed = (full & t.U64(0xFFFFFFFFFF000000)) | grams.astype(t.U64)
        rows = -(-len(keyed) // take)
        padded = np.full(rows * take, 0xFFFFFFFFFFFFFFFF, dtype=t.U64)
        padded[: len(keyed)] = keyed
        block = padded.reshape(rows, take)
        ahead = np.minimum.accumulate(block, axis=1).ravel()
        behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
        best = (np.minimum(behind[:count], ahead[take - 1 : take - 1 + count]) & t.U64(0xFFFFFF)).astype(np.int64)
        cut = np.flatnonzero(best[1:] != best[:-1]) + 1
        s, e = np.concatenate([[0], cut]), np.concatenate([cut - 1, [count - 1]])
        a = best[s]
        inside = t.mix(((a - s) * 1_000_003 + (e - s)).astype(t.U64))
        yield full[a], t.mix(t.span_hash(sums, s, e + spec.width) ^ inside), t.mix(t.span_hash(again, s, e + spec.width) + inside), s + base, a - s, e - s


def _anchor_rows(spec: Spec):
    def rows(batches):
        for batch in batches:
            data, offsets = t.column_bytes(batch.column("text"))
            ids, hashes = batch.column("id").to_numpy(zero_copy_only=False), batch.column("th").to_numpy(zero_copy_only=False)
            out: list[list[np.ndarray]] = [[] for _ in range(8)]
            spots: list[np.ndarray] = []
            for i in range(len(ids)):
                if offsets[i + 1] - offsets[i] < spec.width:
                    continue
                codes = spec.symbols(data[offsets[i] : offsets[i + 1]])
                for k, sp, sv, s, da, ln in anchors(codes, spec):
                    order = np.lexsort((s, sv, sp, k))
                    k, sp, sv, s, da, ln = (x[order] for x in (k, sp, sv, s, da, ln))
                    head = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (sp[1:] != sp[:-1]) | (sv[1:] != sv[:-1])]))
                    n = np.diff(np.append(head, len(k)))
                    for j, v in enumerate((t.signed(k[head]), t.signed(sp[head]), t.signed(sv[head]), np.full(len(head), ids[i]), np.full(len(head), hashes[i]), da[head].astype(np.int32), ln[head].astype(np.int32), n.astype(np.int32))):
                        out[j].append(v)
                    spots.append(s.astype(np.int32))
            if spots:
                columns = [np.concatenate(v) for v in out]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), t.list_array(np.concatenate(spots), columns[7], pa.int32())], ["k", "sp", "sv", "id", "th", "da", "ln", "n", "at"])

    return rows


def _span_rows(spec: Spec):
    """Cuts the asked spans out of their texts."""

    def rows(batches):
        for batch in batches:
            data, offsets = t.column_bytes(batch.column("text"))
            out: list[tuple] = []
            for i, (key, asked) in enumerate(zip(batch.column("id").to_pylist(), batch.column("asked").to_pylist(), strict=True)):
                if not asked:
                    continue
                raw = data[offsets[i] : offsets[i + 1]]
                x = raw if spec.item == 1 else spec.symbols(raw)
                for r in asked:
                    cut = x[r["s"] : r["s"] + r["ln"] + spec.width]
                    out.append((r["k"], r["sp"], r["sv"], key, r["n"], r["da"], r["ln"], (cut if spec.item == 1 else cut.astype(">u8")).tobytes()))
                if len(out) >= 4096:
                    yield _batch(out)
                    out = []
            if out:
                yield _batch(out)

    return rows


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (*[pa.int64()] * 5, pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], ["k", "sp", "sv", "id", "n", "da", "ln", "body"])


def _suffix_order(keys: np.ndarray, texts: list[bytes], item: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of the texts within their triggers, and each rank's common prefix with the one before, in symbols."""
    n = len(texts)
    wide = max(max(map(len, texts), default=0), 1)
    size = np.array([len(x) for x in texts], dtype=np.int64)
    grid = np.zeros((n, wide + 13), dtype=np.uint8)  # anchor, text, its length (a shorter text first), and no zero at the end
    grid[:, :8] = np.frombuffer(keys.astype(">i8").tobytes(), np.uint8).reshape(n, 8)
    for i, x in enumerate(texts):
        grid[i, 8 : 8 + len(x)] = np.frombuffer(x, np.uint8)
    grid[:, -5:-1] = np.frombuffer(size.astype(">i4").tobytes(), np.uint8).reshape(n, 4)
    grid[:, -1] = 1
    order = np.argsort(grid.view(f"S{wide + 13}").ravel(), kind="stable")
    grid = grid[:, : wide + 8]
    near = np.zeros(n, dtype=np.int64)
    for at in range(1, n, 4096):
        a, b = grid[order[at - 1 : min(at + 4095, n - 1)]], grid[order[at : at + 4096]]
        differ = a != b
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), wide + 8)
        near[at : at + 4096] = first - 8
    near[1:] = np.minimum(near[1:], np.minimum(size[order[:-1]], size[order[1:]]))
    near //= item
    near[near < 0] = -1
    if n:
        near[0] = -1
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.arange(n)
    return rank, near


def equal_windows(k, n, ids, da, ln, bodies: list[bytes], spec: Spec) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each span, which of its windows have a qualifying equal: a (spans, longest run) mask.

    Also the spans' ranks by what follows the trigger, and each rank's common prefix with the one before.
    """
    k, n, ids, da, ln = (np.asarray(x, dtype=np.int64) for x in (k, n, ids, da, ln))
    rows, item = len(k), spec.item
    mask = np.zeros((rows, int(ln.max()) + 1 if rows else 1), dtype=bool)
    right = [b[int(d) * item :] for b, d in zip(bodies, da, strict=True)]
    if item == 1:
        left = [b[: int(d)][::-1] for b, d in zip(bodies, da, strict=True)]
    else:
        left = [np.frombuffer(b[: int(d) * item], ">u8")[::-1].tobytes() for b, d in zip(bodies, da, strict=True)]
    rank_r, near_r = _suffix_order(k, right, item)
    rank_l, near_l = _suffix_order(k, left, item)
    for d in range(int((da - ln).min()) if rows else 0, int(da.max()) + 1 if rows else 0):
        live = np.flatnonzero((da - ln <= d) & (d <= da))
        if len(live) < 2:
            continue
        after = np.cumsum(near_r < spec.width - d)[rank_r[live]]
        before = np.cumsum(near_l < d)[rank_l[live]]
        _, group = np.unique(after * (rows + 1) + before, return_inverse=True)
        if spec.first_wins:
            least = np.full(group.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, group, ids[live])
            hit = least[group] < ids[live]
        else:
            hit = np.bincount(group, weights=n[live])[group] > 1
        at = live[hit]
        mask[at, (da[at] - d)] = True
    return mask, rank_r, near_r


def _reach(rank: np.ndarray, near: np.ndarray, rows: np.ndarray, width: int, back: bool) -> np.ndarray:
    """Of rows of one trigger, each one's common prefix with the first of them in order, or with the last."""
    order = rows[np.argsort(rank[rows])]
    step = near[rank[order]][1:]
    common = np.concatenate([[width], np.minimum.accumulate(step)]) if not back else np.concatenate([np.minimum.accumulate(step[::-1])[::-1], [width]])
    out = np.empty(len(rows), dtype=np.int64)
    out[np.argsort(rank[rows])] = common
    return out


def _windows(spec: Spec, body: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each of the windows that start at ``offsets`` of a span."""
    x = spec.symbols(np.frombuffer(body, np.uint8)) if spec.item == 1 else np.frombuffer(body, ">u8").astype(t.U64)
    return tuple(t.signed(t.span_hash(t.prefix_hash(y), offsets, offsets + spec.width)) for y in (x, t.mix(x ^ SECOND)))


def _range(rows: list[tuple], spec: Spec, before: bool, after: bool):
    """Runs of repeated windows of a range of the order; ``before``, ``after``: whether its first, its last trigger may go on outside."""
    k, sp, sv, ids, n, da, ln, lone, bodies = zip(*rows, strict=True)
    mask, rank, near = equal_windows(k, n, ids, da, ln, list(bodies), spec)
    edge = np.diff(np.pad(mask, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    where, lo = np.nonzero(edge == 1)
    _, hi = np.nonzero(edge == -1)
    keys = [np.array(x, dtype=np.int64) for x in (k, sp, sv, ids)]
    n, da, ln = (np.array(x, dtype=np.int64) for x in (n, da, ln))
    none = pa.nulls(len(where), pa.int64())
    yield pa.RecordBatch.from_arrays([*(pa.array(x[where]) for x in keys), pa.array(lo.astype(np.int32)), pa.array((hi - 1).astype(np.int32)), pa.array(n[where]), none, none], ["k", "sp", "sv", "id", "lo", "hi", "n", "w", "v"])
    reach = np.full(len(rows), -1, dtype=np.int64)
    for wanted, at, back in ((before, 0, False), (after, -1, True)):
        if wanted:
            own = np.flatnonzero(keys[0] == keys[0][at])
            reach[own] = np.maximum(reach[own], _reach(rank, near, own, spec.width, back))
    owner, spots, first, second, sure = [], [], [], [], []
    for i in np.flatnonzero(reach >= spec.width - da):
        # Where no other span has the same ``lone`` symbols before the trigger, windows that hold them stand once.
        off = np.arange(max(0, da[i] - lone[i] + 1) if lone[i] else 0, min(ln[i], da[i] - (spec.width - reach[i])) + 1)
        if spec.first_wins:  # of equals the first is not settled here, and speaks for all
            off = off[~mask[i, off]]
        if len(off):
            w, v = _windows(spec, bodies[i], off)
            owner.append(np.full(len(off), i))
            spots.append(off.astype(np.int32))
            first.append(w)
            second.append(v)
            sure.append(mask[i, off])
    if owner:
        own, off, w, v, known = (np.concatenate(x) for x in (owner, spots, first, second, sure))
        # What is settled here only tells the others, once for each window, and asks nothing: its place is -1.
        _, once = np.unique(np.stack([w[known], v[known]]), axis=1, return_index=True)
        some = np.concatenate([np.flatnonzero(~known), np.flatnonzero(known)[once]])
        place = pa.array(np.where(known[some], -1, off[some]).astype(np.int32))
        yield pa.RecordBatch.from_arrays([*(pa.array(x[own[some]]) for x in keys), place, place, pa.array(np.where(known[some], 2, n[own[some]])), pa.array(w[some]), pa.array(v[some])], ["k", "sp", "sv", "id", "lo", "hi", "n", "w", "v"])


def _ordered(spec: Spec):
    """Cuts the sorted spans into ranges of ``spec.chunk`` bytes, between triggers where that is possible."""

    def rows(batches):
        held: list[tuple] = []
        size = begun = 0  # bytes held, and where the last trigger begins
        before = True
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("k", "sp", "sv", "id", "n", "da", "ln", "lone", "body")), strict=True):
                if held and row[:3] == held[-1][:3]:  # a row that stands twice in the table
                    continue
                if held and row[0] != held[-1][0]:
                    begun = len(held)
                if size > spec.chunk:
                    cut = begun or len(held)
                    yield from _range(held[:cut], spec, before, not begun)
                    before = not begun
                    held, begun = held[cut:], 0
                    size = sum(len(x[8]) for x in held)
                held.append(row)
                size += len(row[8])
        if held:
            yield from _range(held, spec, before, True)

    return rows


def _lone(texts: DataFrame, spec: Spec) -> DataFrame:
    """(k, sp, sv, lone): with how many symbols before its trigger a span differs from all others of the trigger, at the least compared."""
    levels = F.explode(F.array(*map(F.lit, spec.lefts))).alias("lone")
    left = F.xxhash64(F.expr(f"substring(body, (da - lone) * {spec.item} + 1, lone * {spec.item})"))
    compared = texts.select("k", "sp", "sv", "da", "body", levels).filter("da >= lone").select("k", "lone", left.alias("left"), F.struct("sp", "sv").alias("span"))
    alone = compared.groupBy("k", "lone", "left").agg(F.min("span").alias("span"), F.max("span").alias("other")).filter("span = other")
    return alone.groupBy("k", "span").agg(F.min("lone").alias("lone")).select("k", "span.sp", "span.sv", "lone")


def repeated_windows(docs: DataFrame, spec: Spec) -> DataFrame:
    """(id, th, runs): windows with a qualifying equal, as inclusive ranges of starts.

    ``docs`` has id, th and text, none of the first two null.
    """
    key = ["k", "sp", "sv"]
    found = shared_table(docs.select("id", "th", "text").mapInArrow(_anchor_rows(spec), ANCHOR_SCHEMA))
    often = shared_table(found.groupBy("k").agg(F.sum("n").alias("all")).filter("all > 1").select("k"))
    live = shared_table(found.join(often, "k"))
    drop_table(found)
    drop_table(often)
    first = F.min(F.struct("id", "th", F.col("at")[0].alias("s"), "da", "ln")).alias("r")
    spans = shared_table(live.groupBy(*key).agg(F.sum("n").alias("copies"), first))
    mixed = spans.groupBy("k").agg((F.count("*") > 1).alias("mixed"))
    dictionary = shared_table(spans.join(mixed, "k"))
    drop_table(spans)
    whole = F.col("r.id") < F.col("id") if spec.first_wins else F.col("copies") > 1
    marked = live.join(dictionary, key).select(*key, "id", "th", live["da"], live["ln"], "at", whole.alias("whole"), "mixed").filter("whole or mixed")
    # One representative of each span where a trigger has several: the smallest id's.
    asked = dictionary.filter("mixed").select(*key, F.col("copies").alias("n"), "r")
    listed = asked.groupBy(F.col("r.id").alias("id"), F.col("r.th").alias("th")).agg(F.collect_list(F.struct(*key, F.col("r.s").alias("s"), F.col("r.da").alias("da"), F.col("r.ln").alias("ln"), "n")).alias("asked"))
    texts = shared_table(docs.select("id", "th", "text").join(listed, ["id", "th"]).select("id", "text", "asked").mapInArrow(_span_rows(spec), SPAN_SCHEMA))
    follows = F.expr(f"substring(body, da * {spec.item} + 1)")
    order = ["k", "follows", "sp", "sv"]
    told = texts.join(_lone(texts, spec), key, "left").withColumn("lone", F.coalesce("lone", F.lit(0)))
    sorted_spans = told.select(*texts.columns[:-1], "lone", "body").withColumn("follows", follows).repartitionByRange(*order).sortWithinPartitions(*order).drop("follows")
    ranges = shared_table(sorted_spans.mapInArrow(_ordered(spec), RUN_SCHEMA))
    drop_table(texts)
    crossing = ranges.filter("w is not null")
    counts = crossing.groupBy("w", "v").agg(F.sum("n").alias("every"), F.min("id").alias("least"), F.max("id").alias("most"))
    counts = counts.filter("least < most" if spec.first_wins else "every > 1")  # windows that stand once meet nothing
    hit = crossing.filter("lo >= 0").join(counts, ["w", "v"]).filter("least < id" if spec.first_wins else "every > 1")
    keys = [*key, "id"] if spec.first_wins else key
    runs = ranges.filter("w is null").select(*keys, "lo", "hi").union(hit.select(*keys, "lo", "hi")).groupBy(*keys).agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))
    partial = marked.filter("not whole and mixed").join(runs, keys)
    moved = F.flatten(F.transform("at", lambda s: F.transform("runs", lambda r: F.struct((s + r.lo).alias("lo"), (s + r.hi).alias("hi")))))
    settled = F.transform("at", lambda s: F.struct(s.alias("lo"), (s + F.col("ln")).alias("hi")))
    covering = marked.filter("whole").select("id", "th", settled.alias("r")).unionByName(partial.select("id", "th", moved.alias("r")))
    return covering.groupBy("id", "th").agg(F.flatten(F.collect_list("r")).alias("runs"))


def keyed_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id (null as the smallest long, told by ``no_id``), th, text (null as empty)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("id"), F.col(id_col).isNull().alias("no_id"), text.alias("text")
    ).withColumn("th", F.xxhash64("text"))


def covered(runs: list[dict] | None, n: int, width: int) -> np.ndarray:
    """Mask of the symbols inside any of the windows."""
    edge = np.zeros(n + 1, dtype=np.int64)
    if runs:
        np.add.at(edge, [r["lo"] for r in runs], 1)
        np.add.at(edge, [r["hi"] + width for r in runs], -1)
    return np.cumsum(edge[:-1]) > 0
