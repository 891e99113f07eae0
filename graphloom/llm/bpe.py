"""Byte-pair encoding and decoding with a vocabulary of word-end symbols.

A text is composed (NFC) and lower-cased, cut into pieces at white space and at
changes between letters, digits and other signs, and each piece's bytes become
symbols, the last one a word-end symbol. The symbols of a piece form a doubly
linked list; a priority queue gives the adjacent pair of least merge rank, the
leftmost first, and entries whose pair has gone meanwhile are skipped. Decoding
joins the vocabulary's strings with spaces, as files without a decoder have it.

The vocabulary is the file's, a few MB, sent to every task. No text leaves its
row: there is no shuffle. Each Python worker keeps the encodings of recent
stretches between white space and of their pieces, of bounded number and length.
"""

from __future__ import annotations

import functools
import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import _text as t

#: Characters of a text handled at once; it is cut at white space only.
SEGMENT = 1 << 20
#: Stretches and pieces whose encodings a worker keeps, and the longest of them.
KEPT, KEPT_LENGTH = 600_000, 48
#: The bits of a merged symbol.
SYMBOLS = (1 << 24) - 1

# Letters, numbers and lower cases that Unicode 16 and 17 added to what Python's Unicode 15.1 knows.
NEW_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NEW_NUMBERS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
NEW_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
NEW_LOWER |= {p: p + 0x20 for p in range(0x10D50, 0x10D66)} | {p: p + 0x1B for p in range(0x16EA0, 0x16EB9)}
#: What str.split() takes for white space and the vocabulary's pattern does not.
SEPARATORS = "\x1c\x1d\x1e\x1f"

_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PIECE = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def _spans(kind: str, more: tuple[tuple[int, int], ...]) -> str:
    """A regular expression's class body: the code points of a general category's first letter."""
    out, first = [], None
    for p in range(sys.maxunicode + 2):
        inside = p <= sys.maxunicode and unicodedata.category(chr(p))[0] == kind
        if inside and first is None:
            first = p
        elif not inside and first is not None:
            out.append((first, p - 1))
            first = None
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in (*out, *more))


@functools.cache
def piece_pattern() -> tuple[re.Pattern, re.Pattern]:
    """Of a piece, and of white space."""
    letters, numbers = _spans("L", NEW_LETTERS), _spans("N", NEW_NUMBERS)
    spaces = "".join(f"\\u{p:04x}" for p in range(0x3001) if chr(p).isspace() and chr(p) not in SEPARATORS)
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{spaces}{letters}{numbers}]+"), re.compile(f"[{spaces}]+")


def lower(text: str) -> str:
    """Each character's lower case by itself: a final sigma is like any other."""
    if text.isascii():
        return text.lower()
    return text.translate(NEW_LOWER).replace("Σ", "σ").lower()


def byte_letters() -> list[str]:
    """A printable character for each byte: its own where it has one, else the next from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Encoder:
    """A vocabulary file's encoder and decoder."""

    def __init__(self, raw: bytes) -> None:
        file = json.loads(raw)
        model, cut = file["model"], (file.get("pre_tokenizer") or {}).get("pretokenizers") or [{}, {}]
        known = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        if not known or file["normalizer"] != _NORMALIZER or cut[0].get("pattern") != {"Regex": _PIECE} or cut[1].get("add_prefix_space") is not False or file["decoder"]:
            raise ValueError("a vocabulary file of another kind")
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        added = {x["content"]: x["id"] for x in file["added_tokens"]}
        self.strings = [""] * (max([*vocab.values(), *added.values()]) + 1)
        for string, i in (*vocab.items(), *added.items()):
            self.strings[i] = string
        self.table = pa.array([" " + x for x in self.strings], pa.large_string())
        self.added = {x: i.to_bytes(4, "little") for x, i in added.items()}
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")").split if added else None
        letters = byte_letters()
        self.inner, self.last = [vocab[x] for x in letters], [vocab[x + end] for x in letters]
        #: By left symbol, then right symbol: rank and merged symbol in one number.
        self.merges: list[dict[int, int]] = [{} for _ in self.strings]
        for rank, (a, b) in enumerate(model["merges"]):
            self.merges[vocab[a]][vocab[b]] = rank << 24 | vocab[a + b]
        self.back, self.forth = list(range(-1, 63)), list(range(1, 65))
        self.pieces = piece_pattern()[0].findall
        self.blank = piece_pattern()[1]
        self.chunks = _Recent(self)

    def encode_bytes(self, data: bytes) -> list[int]:
        """Symbols of one piece."""
        n, merges = len(data), self.merges
        symbols = [self.inner[b] for b in data]
        symbols[-1] = self.last[data[-1]]
        if n == 1:
            return symbols
        #: A queue's entry is rank, merged symbol and place in one number.
        bits = n.bit_length()
        places = (1 << bits) - 1
        queue = [found << bits | at for at in range(n - 1) if (found := merges[symbols[at]].get(symbols[at + 1])) is not None]
        if not queue:
            return symbols
        heapify(queue)
        before, after = self.links(n)
        while queue:
            entry = heappop(queue)
            at = entry & places
            left_symbol, right = symbols[at], after[at]
            if left_symbol < 0 or right >= n or merges[left_symbol].get(symbols[right]) != entry >> bits:
                continue  # stale: one of the two has been merged meanwhile
            symbol = symbols[at] = entry >> bits & SYMBOLS
            symbols[right] = -1
            right = after[at] = after[right]
            if right < n:
                before[right] = at
                if (found := merges[symbol].get(symbols[right])) is not None:
                    heappush(queue, found << bits | at)
            left = before[at]
            if left >= 0 and (found := merges[symbols[left]].get(symbol)) is not None:
                heappush(queue, found << bits | left)
        return [x for x in symbols if x >= 0]

    def links(self, n: int) -> tuple[list[int] | array, list[int] | array]:
        """The places before and after each of ``n``; long ones packed."""
        if n <= 64:
            return self.back[:n], self.forth[:n]
        return array("q", range(-1, n - 1)), array("q", range(1, n + 1))

    def encode_chunk(self, chunk: str) -> bytes:
        """Packed ids of a normalised stretch without white space."""
        pieces = [chunk] if chunk.isalpha() else self.pieces(chunk)
        if len(pieces) == 1:
            return pack_ids(self.encode_bytes(pieces[0].encode()))
        return b"".join(map(self.chunks.__getitem__, pieces))

    def _packed(self, part: str) -> bytes:
        if not part.isascii():
            part = unicodedata.normalize("NFC", part)
        part = lower(part)
        odd = any(x in part for x in SEPARATORS)
        return b"".join(map(self.chunks.__getitem__, filter(None, self.blank.split(part)) if odd else part.split()))

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, packed as little-endian unsigned 32-bit numbers."""
        out = []
        for part in segments(text, self.blank):
            if self.split_added is None or not any(x in part for x in self.added):
                out.append(self._packed(part))
            else:
                out += [self.added[x] if k % 2 else self._packed(x) for k, x in enumerate(self.split_added(part))]
        return b"".join(out)

    def decode(self, packed: list[bytes | None]) -> pa.Array:
        """A batch's texts: the strings of each row's ids, joined by spaces."""
        ids = np.frombuffer(b"".join(x for x in packed if x), dtype="<u4").astype(np.int64)
        taken = self.table.take(pa.array(ids))
        _, offsets, data = taken.buffers()
        at = np.frombuffer(offsets, dtype=np.int64)[taken.offset : taken.offset + len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
        ends = at[np.cumsum([0, *(0 if x is None else len(x) // 4 for x in packed)])].tolist()
        joined = memoryview(data) if data is not None else b""
        #: Each string has a space before it; the first one's is left out.
        texts = [None if x is None else bytes(joined[a + 1 : b]) for x, a, b in zip(packed, ends, ends[1:], strict=False)]
        return pa.array(texts, pa.binary()).cast(pa.string())


def pack_ids(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<u4").tobytes()


class _Recent(dict):
    """Packed ids by chunk; forgets all when full, so that a worker's memory is bounded."""

    def __init__(self, encoder: Encoder) -> None:
        super().__init__()
        self.encode = encoder.encode_chunk

    def __missing__(self, chunk: str) -> bytes:
        found = self.encode(chunk)
        if len(chunk) <= KEPT_LENGTH:
            if len(self) >= KEPT:
                self.clear()
            self[chunk] = found
        return found


def segments(text: str, blank: re.Pattern, size: int = SEGMENT) -> Iterator[str]:
    """``text`` in stretches of about ``size`` characters that end before white space."""
    at = 0
    while len(text) - at > size:
        found = blank.search(text, at + size)
        if found is None:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


@functools.lru_cache(maxsize=2)
def encoder(raw: bytes) -> Encoder:
    """One per process and vocabulary."""
    return Encoder(raw)


def load_vocabulary(path: str | None = None) -> bytes:
    """A vocabulary file's bytes; by default the public one with word ends."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return Path(path).read_bytes()


def encode_decode(docs: DataFrame, vocabulary: bytes, id_cols: Iterable[str] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """Every whole text's tokens, and the text that they decode to.

    Returns ``id_cols``, n_tokens, token_ids (little-endian unsigned 32-bit
    numbers in one binary value; see :func:`unpack_ids`) and decoded. A row per
    row: null and empty texts have no tokens and decode to the empty text; null
    and repeated ids come back as they are. Ties of rank merge at the leftmost
    place. Long texts are encoded in segments cut at white space, which no piece
    crosses; a stretch without white space is one piece whatever its length.
    Extra columns, whatever their names, are left out. An empty table gives an
    empty result.
    """
    id_cols = tuple(id_cols)
    t.limit_arrow_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    source = docs.select(*id_cols, text_col)
    made = [("n_tokens", T.LongType()), ("token_ids", T.BinaryType()), ("decoded", T.StringType())]
    schema = T.StructType([*source.schema.fields[: len(id_cols)], *(T.StructField(n, k) for n, k in made)])

    def rows(batches):
        own = encoder(shared.value)
        for batch in batches:
            packed = [own.encode(x.as_py() or "") for x in batch.column(len(id_cols))]
            counts = pa.array([len(x) // 4 for x in packed], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(id_cols)], counts, pa.array(packed, pa.binary()), own.decode(packed)], schema.names)

    return source.mapInArrow(rows, schema)


def unpack_ids(docs: DataFrame, ids_col: str = "token_ids") -> DataFrame:
    """``ids_col`` as an array of numbers."""
    t.limit_arrow_batches(docs.sparkSession)
    at = docs.columns.index(ids_col)
    schema = T.StructType([T.StructField(f.name, T.ArrayType(T.LongType())) if k == at else f for k, f in enumerate(docs.schema.fields)])

    def rows(batches):
        for batch in batches:
            lists = pa.array([None if x.as_py() is None else np.frombuffer(x.as_py(), dtype="<u4").astype(np.int64) for x in batch.column(at)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([lists if k == at else c for k, c in enumerate(batch.columns)], schema.names)

    return docs.mapInArrow(rows, schema)


def decode_ids(docs: DataFrame, vocabulary: bytes, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """``docs`` with ``out_col``, the vocabulary's strings of packed ids; null has null."""
    t.limit_arrow_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    at, schema = docs.columns.index(ids_col), T.StructType([*docs.schema.fields, T.StructField(out_col, T.StringType())])

    def rows(batches):
        own = encoder(shared.value)
        for batch in batches:
            texts = own.decode(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], schema.names)

    return docs.mapInArrow(rows, schema)
