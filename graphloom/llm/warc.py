"""WARC archives: a writer, and a reader whose tasks split files by byte ranges.

Every record is a gzip member of its own. A reading task takes a byte range,
looks for gzip's magic number, and accepts a candidate only if it inflates to
a WARC header; it owns the records whose members start inside the range and
reads on past the end to finish the last one.

A range follows its chain of members up to and with the first one that starts
behind its end. So each member is decoded by the range that owns it and, if it
is a range's first, by the range before as well: a member that is cut off,
corrupt or hidden fails one of the two, wherever the splits are.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as t
from ._spark import checkpoint_dir, shared_checkpoint

MAGIC = b"\x1f\x8b\x08"
DIGEST_SCHEMA = "id long, no_id boolean, th long, n_bytes long, digest string, same binary"
FILE_SCHEMA = "path string, records long, bytes long"
RECORD_SCHEMA = "record_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary"
READ = 1 << 20
#: Bytes past its range over which a task sees its chain of members hold. A
#: payload shows members of its own only in stored blocks of deflate, which hold
#: 65,535 bytes at most; no chain inside a payload is longer.
PROOF = 1 << 17


class BrokenChain(Exception):
    """Something else than a member follows a member."""


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _place(path: str):
    """The file system and path of a URI: local files directly, others through Arrow."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if path.startswith("/"):
        return None, path
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _open(path: str):
    system, path = _place(path)
    return open(path, "rb") if system is None else system.open_input_file(path)


def _publish(path: str, chunks: Iterator[bytes]) -> int:
    """Write under another name, then rename: a task that is run twice leaves one whole file."""
    system, path = _place(path)
    hidden, size = f"{os.path.dirname(path)}/.{os.path.basename(path)}.{uuid.uuid4().hex}", 0
    if system is None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
    else:
        system.create_dir(os.path.dirname(path), recursive=True)
    with open(hidden, "wb") if system is None else system.open_output_stream(hidden) as out:
        for chunk in chunks:
            out.write(chunk)
            size += len(chunk)
    os.replace(hidden, path) if system is None else system.move(hidden, path)
    return size


def record(record_id: str, url: str | None, kind: str, payload: bytes, digest: str, length: int, refers_to: str | None, level: int = 6) -> bytes:
    """One WARC record as a gzip member."""
    clean = (url or "").replace("\r", " ").replace("\n", " ")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {length}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    body = b"" if kind == "revisit" else payload
    head.append(f"Content-Length: {len(body)}")
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + packer.flush()


def _digests(batches):
    for batch in batches:
        data, offsets = t.column_bytes(batch.column("payload"))
        raw = [data[a:b].tobytes() for a, b in zip(offsets, offsets[1:], strict=False)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("no_id"), batch.column("th"), pa.array([len(x) for x in raw], pa.int64()), pa.array([sha1_base32(x) for x in raw], pa.string()), pa.array([hashlib.sha256(x).digest() for x in raw], pa.binary())],
            ["id", "no_id", "th", "n_bytes", "digest", "same"],
        )


def _writer(folder: str, level: int):
    def rows(batches):
        path, count = f"{folder}/part-{TaskContext.get().partitionId():06d}.warc.gz", 0

        def members():
            nonlocal count
            for batch in batches:
                data, offsets = t.column_bytes(batch.column("payload"))
                names = ("name", "url", "digest", "n_bytes", "refers")
                for i, (name, url, digest, size, refers) in enumerate(zip(*(batch.column(c).to_pylist() for c in names), strict=True)):
                    count += 1
                    kind = "response" if refers is None else "revisit"
                    yield record(name, url, kind, data[offsets[i] : offsets[i + 1]].tobytes(), digest, size, refers, level)

        size = _publish(path, members())
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([count], pa.int64()), pa.array([size], pa.int64())], ["path", "records", "bytes"])

    return rows


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url", least_bytes: int = 0, level: int = 6) -> dict[str, int]:
    """Write a record per row into ``folder``; return how many files, records and bytes.

    Of rows whose payloads are equal and of ``least_bytes`` or more, the one
    with the smallest id is a response and the others revisit it. Payload
    equality is by SHA-256; rows repeating the smallest id are all responses.
    Null payload is empty; a null id counts below all others and is written as
    ``urn:page:null``; line breaks in a url become spaces. An id that stands
    with different payloads has a record for each. A payload of any size is one
    member, which its task holds whole.
    """
    t.limit_arrow_batches(pages.sparkSession)
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("id"), F.col(id_col).isNull().alias("no_id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn("th", F.xxhash64("payload"))
    digests = shared_checkpoint(rows.select("id", "no_id", "th", "payload").mapInArrow(_digests, DIGEST_SCHEMA))
    firsts = shared_checkpoint(digests.groupBy("same").agg(F.min(F.struct("id", "no_id")).alias("first")))  # a table of its own: the join may then split a common payload's rows
    roles = digests.join(firsts, "same").groupBy("id", "th").agg(*(F.first(c).alias(c) for c in ("n_bytes", "digest", "first")))
    name = F.concat(F.lit("urn:page:"), F.when(F.col("no_id"), "null").otherwise(F.col("id").cast("string")))
    first = F.concat(F.lit("urn:page:"), F.when(F.col("first.no_id"), "null").otherwise(F.col("first.id").cast("string")))
    revisits = (F.col("first.id") < F.col("id")) & (F.col("n_bytes") >= least_bytes)
    out = rows.join(roles, ["id", "th"]).select(name.alias("name"), "url", "payload", "digest", "n_bytes", F.when(revisits, first).alias("refers"))
    files = out.mapInArrow(_writer(folder, level), FILE_SCHEMA)
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("records"), F.lit(0)).alias("records"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first().asDict()


def _member(file, at: int, keep: bool) -> tuple[bytes, int]:
    """The content of the member at ``at`` (its first bytes only, unless ``keep``) and the offset behind it.

    ValueError if there is no whole gzip member that holds a WARC record.
    """
    file.seek(at)
    engine, head, total, read = zlib.decompressobj(31), b"", 0, 0
    kept: list[bytes] = []
    while not engine.eof:
        raw = file.read(READ if read else 1 << 14)
        if not raw:
            raise ValueError("cut off")
        read += len(raw)
        while raw and not engine.eof:
            try:
                out = engine.decompress(raw, READ)
            except zlib.error as e:
                raise ValueError(str(e)) from e
            raw = engine.unconsumed_tail
            total += len(out)
            if b"\r\n\r\n" not in head:
                head += out
                if not head.startswith(b"WARC/1.") and not b"WARC/1.".startswith(head):
                    raise ValueError("no WARC header")
            if keep:
                kept.append(out)
    fields, gap = parse_head(head)
    if total < gap + int(fields["content-length"]):
        raise ValueError("short record")
    return (b"".join(kept) if keep else head), at + read - len(engine.unused_data)


def parse_head(raw: bytes) -> tuple[dict[str, str], int]:
    """The named fields of a record's header, and where its block starts."""
    head, gap, _ = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8").split("\r\n")
    if not gap or not first.startswith("WARC/1."):
        raise ValueError("no WARC header")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    if not fields.get("content-length", "").isdigit():
        raise ValueError("no length")
    return fields, len(head) + 4


def _find(file, at: int, end: int) -> int | None:
    """The first offset in [at, end) where gzip's magic number starts."""
    while at < end:
        file.seek(at)
        window = file.read(min(READ, end - at) + len(MAGIC) - 1)
        hit = window.find(MAGIC)
        if hit >= 0:
            return at + hit
        at += READ
    return None


def _chain(file, at: int, end: int, length: int) -> list[int]:
    """Starts before ``end`` of the members from ``at`` on, each right behind the one before.

    The chain must hold for ``PROOF`` bytes more, and its first member from
    ``end`` on must be whole, unless the file ends before.
    """
    members, first, beyond = [], True, False
    while at < length and not (beyond and at >= end + PROOF):
        try:
            _, after = _member(file, at, False)
        except (ValueError, UnicodeDecodeError) as e:
            if first:
                raise
            raise BrokenChain(f"no member at {at}: {e}") from e
        if at < end:
            members.append(at)
        first, beyond = False, at >= end
        at = after
    return members


def scan_range(file, start: int, end: int, length: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records whose members start in [start, end) of a file of ``length`` bytes.

    The first candidate that inflates to a record starts a chain of members. If
    it breaks, either the candidate was part of a payload or the file is
    damaged: the members are then counted from the file's start, which tells
    one from the other (ValueError). A candidate that is no whole record is
    passed over: if it is a damaged member, the range before finds that out.
    Records are handed out one at a time.
    """
    at, members = start, []
    while (at := _find(file, at, end)) is not None or start == 0:
        try:
            members = _chain(file, 0 if start == 0 else at, end, length)
            break
        except BrokenChain:
            if start == 0:
                raise
            members = [m for m in _chain(file, 0, end, length) if m >= start]
            break
        except (ValueError, UnicodeDecodeError):
            if start == 0:
                raise
            at += 1
    for place in members:
        raw, _ = _member(file, place, True)
        fields, block = parse_head(raw)
        yield fields, raw[block : block + int(fields["content-length"])]


def _ranges(paths: list[str], lengths: np.ndarray, counts: np.ndarray, split: int):
    """The reader of numbered ranges: number n is a place among all files' ranges laid end to end."""
    firsts = np.concatenate([[0], np.cumsum(counts)])

    def rows(batches):
        for batch in batches:
            for n in batch.column("id").to_pylist():
                k = int(np.searchsorted(firsts, n, side="right")) - 1
                start = (n - int(firsts[k])) * split
                yield from _read_range(paths[k], start, min(start + split, int(lengths[k])), int(lengths[k]))

    return rows


def _read_range(path: str, start: int, end: int, length: int) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    held = 0
    with _open(path) as file:
        for fields, payload in scan_range(file, start, end, length):
            kind = fields.get("warc-type", "")
            digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
            if kind == "response" and sha1_base32(payload) != digest:
                raise ValueError(f"damaged payload in {path}: {fields.get('warc-record-id')}")
            refers = fields.get("warc-refers-to")
            size = len(payload) if kind == "response" else int(fields.get("x-payload-length", 0))
            out.append((fields.get("warc-record-id", "").strip("<>"), fields.get("warc-target-uri"), kind, refers and refers.strip("<>"), size, digest, payload))
            held += len(payload) + 256
            if held > 4 << 20:
                yield _record_batch(out)
                out, held = [], 0
    if out:
        yield _record_batch(out)


def _record_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
    names = ("record_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload")
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], list(names))


def read_warc(spark: SparkSession, folder: str, split_bytes: int | None = None) -> DataFrame:
    """Records of all ``*.warc.gz`` files in ``folder``, one task per range of ``split_bytes``.

    The default is the session's spark.sql.files.maxPartitionBytes. Returns
    record_id, url, record_type, refers_to, payload_bytes and payload_digest
    (of the full payload) and payload (empty for revisits). A response whose
    payload doesn't have its digest fails the read, as does any other damage.
    A folder without files is an empty table. What reaches the driver is the
    list of files.
    """
    split = split_bytes or spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("path", "length").filter("length > 0").orderBy("path").collect()
    lengths = np.array([r.length for r in files], dtype=np.int64)
    counts = -(-lengths // split)
    tasks = int(counts.sum())
    return spark.range(0, tasks, 1, max(tasks, 1)).mapInArrow(_ranges([r.path for r in files], lengths, counts, split), RECORD_SCHEMA)


def scratch_folder(spark: SparkSession) -> str:
    """A new folder for archives in the folder that all executors share."""
    return f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
