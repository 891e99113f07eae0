"""Exact dedup through content-defined chunk recipes.

A text (A-Z lower-cased) is cut where a rolling hash of its last 48 bytes has
``bits`` zero bits, so that equal stretches get equal chunks. Chunks are told
apart by a 64-bit fingerprint and verified by SHA-256: fingerprints that hold
several contents get one ordinal per content, so that an identifier
(fingerprint, ordinal) names one content. Texts are equal when their ordered
identifier lists are. Texts themselves never leave the scan; the recipes that
move are about a hundredth of a long text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as t
from ._spark import shared_checkpoint

SCHEMA = "id long, no_id boolean, th long, n_bytes long, text_sha256 string, chunks array<struct<fp:long,strong:binary>>"
WINDOW = 48


def cut_points(data: np.ndarray, bits: int, least: int, most: int) -> list[int]:
    """Ends of the chunks; the last is the length. Depends on the bytes alone."""
    n = len(data)
    if n <= least:
        return [n]
    hits: list[int] = []
    for base in range(0, n, t.SEGMENT):
        lo = max(base - WINDOW, 0)
        part = data[lo : min(base + t.SEGMENT, n)]
        if len(part) > WINDOW:
            sums = t.prefix_hash(t.byte_codes(part))
            ends = np.arange(WINDOW, len(part))
            rolled = t.span_hash(sums, ends - WINDOW, ends)
            hits += (np.flatnonzero((rolled >> t.U64(64 - bits)) == 0) + WINDOW + lo).tolist()
    out, last = [], 0
    for at in [*sorted(set(hits)), n]:
        while at - last > most:
            last += most
            out.append(last)
        if at - last >= least or at == n:
            if at > last or not out:
                out.append(at)
            last = at
    return out


def _recipes(bits: int, least: int, most: int):
    def rows(batches):
        for batch in batches:
            data, offsets = t.column_bytes(batch.column("text"))
            digests, fps, strong, counts = [], [], [], []
            for i in range(batch.num_rows):
                raw = t.lower_ascii(data[offsets[i] : offsets[i + 1]])
                whole = memoryview(raw.tobytes())
                digests.append(hashlib.sha256(whole).hexdigest())
                at = 0
                ends = cut_points(raw, bits, least, most)
                for end in ends:
                    digest = hashlib.sha256(whole[at:end]).digest()
                    fps.append(int.from_bytes(hashlib.blake2b(whole[at:end], digest_size=8).digest(), "little", signed=True))
                    strong.append(digest)
                    at = end
                counts.append(len(ends))
            at = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            chunks = pa.ListArray.from_arrays(pa.array(at), pa.StructArray.from_arrays([pa.array(fps, pa.int64()), pa.array(strong, pa.binary())], ["fp", "strong"]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("no_id"), batch.column("th"), pa.array(np.diff(offsets)), pa.array(digests, pa.string()), chunks],
                ["id", "no_id", "th", "n_bytes", "text_sha256", "chunks"],
            )

    return rows


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 11, least: int = 512, most: int = 16384) -> DataFrame:
    """Groups texts that are equal after lower-casing A-Z; the largest id stays.

    Returns a row per input row: ``id_col``, n_bytes, text_sha256, keep_id,
    group_size, kept, and th (Spark's xxhash64 of the text as it was).

    Null text counts as empty, and empty texts form one group. Rows that share
    the largest id are all of a group's copies but the first in scan order, so
    exactly one row of a group is kept. A null id counts below all others and
    comes back as null. An empty table gives an empty result.
    """
    t.limit_arrow_batches(docs.sparkSession)
    source = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("id"), F.col(id_col).isNull().alias("no_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    source = source.withColumn("th", F.xxhash64("text"))
    parsed = shared_checkpoint(source.mapInArrow(_recipes(bits, least, most), SCHEMA).withColumn("row", F.monotonically_increasing_id()))
    chunks = parsed.select("row", F.posexplode("chunks").alias("seq", "chunk")).select("row", "seq", "chunk.fp", "chunk.strong")
    # A content per identifier: distinct contents of a fingerprint, combined before the shuffle.
    # Tables of their own, here and below: a join of two tables may split a common key's rows, one of an aggregate may not.
    names = shared_checkpoint(chunks.groupBy("fp").agg(F.sort_array(F.collect_set("strong")).alias("contents")))
    recipes = (
        chunks.join(names, "fp")
        .select("row", F.struct("seq", "fp", F.array_position("contents", F.col("strong")).alias("ordinal")).alias("c"))
        .groupBy("row")
        .agg(F.transform(F.sort_array(F.collect_list("c")), lambda c: F.struct(c.fp, c.ordinal)).alias("recipe"))
    )
    listed = parsed.select("row", "id", "no_id", "th", "n_bytes", "text_sha256").join(recipes, "row")
    listed = shared_checkpoint(listed)
    groups = shared_checkpoint(listed.groupBy("recipe").agg(F.max(F.struct("id", (-F.col("row")).alias("back"), "no_id")).alias("best"), F.count("*").alias("group_size")))
    out = listed.join(groups, "recipe")
    return out.select(
        F.when(~F.col("no_id"), F.col("id")).alias(id_col),
        "n_bytes",
        "text_sha256",
        F.when(~F.col("best.no_id"), F.col("best.id")).alias("keep_id"),
        "group_size",
        (F.col("row") == -F.col("best.back")).alias("kept"),
        "th",
    )
