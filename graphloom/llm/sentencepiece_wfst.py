"""SentencePiece encoding and decoding as weighted finite-state transduction.

Compiled from a model file, each a table of arcs:

* ``CharacterMap``: the model's character map as a transducer over characters,
  which takes the longest key at each place.
* ``Spaces``: the rest of the normaliser, a transducer that drops and joins
  spaces, writes them as U+2581 and puts one before the text.
* ``Pieces``: a trie whose accepting states emit a piece, weighted by its score;
  a character without a piece has an arc that emits its bytes, one byte piece
  each (or the unknown piece), at a weight beyond every piece's.
* For BPE models an acceptor of piece sequences whose every neighbouring pair is
  what BPE makes of the pair's own text: such a pair weighs nothing, any other
  infinity. A sequence is the BPE encoding of a text exactly if all its
  neighbouring pairs are accepted, since merges on either side of a boundary
  don't see each other until one crosses it.

A text is composed with them lazily, and its encoding is the path of least
weight in the tropical semiring, where weights add along a path and the least
sum wins (the first of equal ones, with longer last pieces before shorter).
Stretches that no piece reaches across are composed apart and kept.
"""

from __future__ import annotations

import math
import re
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _text as t

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Entries that a process keeps of encoded chunks, and of judged pairs.
CHUNKS, PAIRS = 200_000, 500_000
#: Weight of an unknown character beyond the worst piece, as in unigram models.
PENALTY = 10.0


def _fields(raw: bytes):
    """(number, value) of a protocol buffer's fields: ints for varints, bytes for the rest."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}[kind] if kind in (1, 5) else varint()
            yield key >> 3, raw[at : at + size]
            at += size


class PieceModel:
    """What a model file holds: pieces with scores and types, kind, normaliser settings."""

    def __init__(self, raw: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        self.bpe, self.dummy_prefix, self.trim, self.escape, self.charsmap = False, True, True, True, b""
        for number, value in _fields(raw):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for n, v in _fields(value):
                    if n == 1:
                        piece = v.decode()
                    elif n == 2:
                        score = float(np.frombuffer(v, "<f4")[0])
                    elif n == 3:
                        kind = v
                self.pieces.append((piece, score, kind))
            elif number == 2:
                kind = next((v for n, v in _fields(value) if n == 3), 1)
                if kind not in (1, 2):
                    raise ValueError("only unigram and BPE models have a shortest path")
                self.bpe = kind == 2
            elif number == 3:
                for n, v in _fields(value):
                    if n == 2:
                        self.charsmap = v
                    elif n == 3:
                        self.dummy_prefix = bool(v)
                    elif n == 4:
                        self.trim = bool(v)
                    elif n == 5:
                        self.escape = bool(v)


class CharacterMap:
    """A precompiled character map: keys to replacements, the longest key at each place.

    The map is stored as a double-array trie (units of 32 bits: label, offset
    to the children, or a value) and the replacements it points into.
    """

    def __init__(self, raw: bytes):
        size = int(np.frombuffer(raw, "<u4", 1)[0])
        units = np.frombuffer(raw, "<u4", size // 4, 4)
        texts = raw[4 + size :]
        self.trie: dict = {}
        labels = np.arange(1, 256, dtype=np.int64)
        offset = lambda u: (u >> 10) << ((u & (1 << 9)) >> 6)
        todo = [(offset(int(units[0])), b"")]
        while todo:
            at, key = todo.pop()
            places = at ^ labels
            inside = places < len(units)
            own = labels[inside][(units[places[inside]] & np.uint32(0x800000FF)) == labels[inside]]
            for label in own.tolist():
                unit = int(units[at ^ label])
                below, longer = (at ^ label) ^ offset(unit), key + bytes([label])
                if unit >> 8 & 1:
                    start = int(units[below]) & 0x7FFFFFFF
                    self._add(longer.decode(), texts[start : texts.index(b"\0", start)].decode())
                todo.append((below, longer))
        self.begins = re.compile("[" + "".join(map(re.escape, sorted(self.trie))) + "]") if self.trie else None

    def _add(self, key: str, text: str) -> None:
        node = self.trie
        for c in key:
            node = node.setdefault(c, {})
        node[""] = text

    def transduce(self, text: str) -> str:
        """What the map makes of a text; characters without a key stay."""
        if self.begins is None:
            return text
        out, done = [], 0
        while (m := self.begins.search(text, done)) is not None:
            at = m.start()
            out.append(text[done:at])
            node, j, end, best = self.trie, at, at + 1, text[at]
            while j < len(text) and (node := node.get(text[j])) is not None:
                j += 1
                if "" in node:
                    end, best = j, node[""]
            out.append(best)
            done = end
        out.append(text[done:])
        return "".join(out)


class Spaces:
    """The normaliser's other half: arcs from (state, class of character) to (state, what goes before, whether the character goes out).

    States: nothing written yet; within text; spaces held back.
    """

    START, TEXT, HELD = 0, 1, 2

    def __init__(self, trim: bool, prefix: bool, escape: bool):
        mark = SPACE if escape else " "
        first = mark if prefix else ""
        start, text, held = self.START, self.TEXT, self.HELD
        self.mark = mark
        if trim:
            self.arcs = {(start, True): (start, "", False), (text, True): (held, "", False), (held, True): (held, "", False), (start, False): (text, first, True), (text, False): (text, "", True), (held, False): (text, mark, True)}
        else:
            self.arcs = {(start, True): (text, first + mark, False), (text, True): (text, mark, False), (start, False): (text, first, True), (text, False): (text, "", True)}

    def transduce(self, text: str, state: int) -> str:
        out, arcs = [], self.arcs
        for c in text:
            state, before, own = arcs[state, c == " "]
            out.append(before + c if own else before)
        return "".join(out)


class Transducer:
    """The composed machine of one model; see the module's text."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.ids = {p: i for i, (p, _, kind) in enumerate(model.pieces) if kind in (NORMAL, USER)}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(model.pieces) if kind == BYTE}
        self.unknown = next((i for i, (_, _, kind) in enumerate(model.pieces) if kind == UNKNOWN), 0)
        self.cost = [-s for _, s, _ in model.pieces]
        self.worst = max((self.cost[i] for i in self.ids.values()), default=0.0) + PENALTY
        self.trie: dict = {}
        for piece, i in self.ids.items():
            node = self.trie
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = i
        self.known = {p for p in self.ids if len(p) == 1}
        self.rank = {p: self.cost[i] for p, i in self.ids.items()}
        self.fallback: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[int, bool] = {}
        self.map = CharacterMap(model.charsmap) if model.charsmap else None
        self.spaces = Spaces(model.trim, model.dummy_prefix, model.escape)
        self.chunks = re.compile(self._chunk_pattern(), re.S)
        self.output = [p.replace(SPACE, " ").encode() if kind in (NORMAL, USER) else b"" for p, _, kind in model.pieces]
        for byte, i in self.bytes.items():
            self.output[i] = bytes([byte])
        self.output[self.unknown] = self.output[self.unknown] or " ⁇ ".encode()
        self.memo = _Memo(self)

    def _chunk_pattern(self) -> str:
        """Stretches of raw text that no piece reaches across, so that each is a composition of its own.

        Two characters can share a piece only if they are neighbours in one.
        Characters linked so form groups, and a chunk is a run of one group, or
        an unknown character, with the spaces before it; or the spaces at the
        end. Where a piece has a space behind another character, the whole text
        is one chunk.
        """
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            return ".+"
        root = {c: c for p in self.ids for c in p if c != SPACE}

        def find(c):
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        linked = set()
        for p in self.ids:
            for x, y in zip(p, p[1:], strict=False):
                if x in root and y in root:
                    linked |= {x, y}
                    root[find(x)] = find(y)
        groups: dict[str, list[str]] = {}
        for c in sorted(root):
            groups.setdefault(find(c), []).append(c)
        runs = sorted((g for g in groups.values() if linked & set(g)), key=len, reverse=True)
        options = ["[" + "".join(map(re.escape, g)) + "]+" for g in runs] + [f"[^ {SPACE}]"]
        return f"[ {SPACE}]*(?:{'|'.join(options)})|[ {SPACE}]+"

    # The acceptor of BPE pairs.

    def merged(self, text: str) -> list[str]:
        """What merging leaves of a few characters: best pair first, leftmost of ties."""
        parts, rank = list(text), self.rank
        while len(parts) > 1:
            best, at = math.inf, -1
            for k in range(len(parts) - 1):
                cost = rank.get(parts[k] + parts[k + 1], math.inf)
                if cost < best:
                    best, at = cost, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def accepts(self, a: int, b: int) -> bool:
        """Whether the text of two pieces is encoded as just these two; a below 0: of b alone."""
        y = self.model.pieces[b][0]
        if a < 0:
            return self.merged(y) == [y]
        x = self.model.pieces[a][0]
        return self.merged(x + y) == [x, y]

    # Composition with a chunk, and its shortest path.

    def unpieced(self, c: str) -> tuple[int, ...]:
        """What the arc of a character without a piece emits."""
        out = self.fallback.get(c)
        if out is None:
            out = self.fallback[c] = tuple(self.bytes[x] for x in c.encode("utf-8", "replace")) if self.bytes else (self.unknown,)
        return out

    def compose(self, raw: str, state: int) -> list[int]:
        """The ids on the least path of spaces, pieces and acceptor, composed with a chunk from a state of the spaces on."""
        text = self.spaces.transduce(raw, state)
        n = len(text)
        trie, bpe, pairs, cost, known = self.trie, self.model.bpe, self.pairs, self.cost, self.known
        weight = [math.inf] * (n + 1)
        weight[0] = 0.0
        last, back = [-1] * (n + 1), [0] * (n + 1)  # of the least path to each place: its piece (-1: none, so that pairs begin anew), and where that began
        for i in range(n):
            here = weight[i]
            if here == math.inf:
                continue
            a, node, j = (last[i] + 1) << 24, trie, i
            while j < n:
                node = node.get(text[j])
                if node is None:
                    break
                j += 1
                b = node.get("")
                if b is None:
                    continue
                total = here + cost[b]
                if total >= weight[j]:
                    continue
                if bpe:
                    ok = pairs.get(a | b)
                    if ok is None:
                        if len(pairs) > PAIRS:
                            pairs.clear()
                        ok = pairs[a | b] = self.accepts((a >> 24) - 1, b)
                    if not ok:
                        continue
                weight[j], last[j], back[j] = total, b, i
            if text[i] not in known and here + self.worst < weight[i + 1]:
                weight[i + 1], last[i + 1], back[i + 1] = here + self.worst, -1, i
        out, j = [], n
        while j > 0:
            i = back[j]
            out.append((last[j],) if last[j] >= 0 else self.unpieced(text[i]))
            j = i
        return [x for piece in reversed(out) for x in piece]

    def encode_packed(self, text: str) -> bytes:
        """The text's ids as 32-bit integers."""
        if self.map is not None:
            text = self.map.transduce(text)
        if self.model.trim:  # at the end a written space counts as one
            text = text.lstrip(" ").rstrip(" " + SPACE * self.model.escape)
        chunks = self.chunks.findall(text)
        if not chunks:
            return b""
        packed = array("i", self.compose(chunks[0], Spaces.START)).tobytes() + b"".join(map(self.memo.__getitem__, chunks[1:]))
        if self.bytes:
            return packed
        ids = np.frombuffer(packed, dtype=np.int32)  # neighbouring unknown characters are one unknown piece
        again = np.zeros(len(ids), dtype=bool)
        again[1:] = (ids[1:] == self.unknown) & (ids[:-1] == self.unknown)
        return ids[~again].tobytes()

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), dtype=np.int32).tolist()

    def decode(self, ids) -> str:
        """The text of a sequence of ids; bytes that form no character become U+FFFD, ids out of range fail."""
        text = b"".join([self.output[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text


class _Memo(dict):
    """Chunk to packed ids, in two generations: what a full one held is kept until the next is full."""

    def __init__(self, machine: Transducer):
        super().__init__()
        self.machine, self.old = machine, {}

    def __missing__(self, text: str) -> bytes:
        out = self.old.get(text)
        if out is None:
            out = array("i", self.machine.compose(text, Spaces.TEXT)).tobytes()
            if len(text) > 48:
                return out
        if len(self) >= CHUNKS:
            self.old = dict(self)
            self.clear()
        self[text] = out
        return out


_machines: dict[bytes, Transducer] = {}


def machine(raw: bytes) -> Transducer:
    """The transducer of a model, compiled once per process."""
    if raw not in _machines:
        _machines[raw] = Transducer(PieceModel(raw))
    return _machines[raw]


def load_model(path: str = DEFAULT_MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_texts(docs: DataFrame, model: bytes, text_col: str = "text", out_col: str = "token_ids") -> DataFrame:
    """``docs`` with a column of token ids (array of int); an existing column of that name is replaced.

    Null text has null ids; empty text has none; texts are encoded whole.
    """
    t.limit_arrow_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one model file, whatever the input

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        own = machine(shared.value)
        return texts.map(lambda x: None if x is None else np.frombuffer(own.encode_packed(x), dtype=np.int32))

    return docs.withColumn(out_col, ids(F.col(text_col)))


def decode_tokens(docs: DataFrame, model: bytes, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """``docs`` with the text of each row's token ids; null ids have null text."""
    t.limit_arrow_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def text(rows: pd.Series) -> pd.Series:
        own = machine(shared.value)
        return rows.map(lambda x: None if x is None else own.decode(np.asarray(x).tolist()))

    return docs.withColumn(out_col, text(F.col(ids_col)))


def round_trip(docs: DataFrame, model: bytes, id_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """Encode every whole text and decode it again, in one pass.

    Returns ``id_cols``, n_tokens, token_ids, decoded and exact (the decoded
    text is the input; a literal U+2581 comes back as a space). Null text has 0
    tokens and null ids, text and exact; empty text has an empty list. Null and
    repeated ids come back as they are; an empty table gives an empty result.
    """
    t.limit_arrow_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(*id_cols, text_col)
    made = [("n_tokens", T.LongType()), ("token_ids", T.ArrayType(T.IntegerType())), ("decoded", T.StringType()), ("exact", T.BooleanType())]
    schema = T.StructType([*source.schema.fields[:-1], *(T.StructField(n, k) for n, k in made)])

    def rows(batches):
        own = machine(shared.value)
        for batch in batches:
            texts = batch.column(len(id_cols)).to_pylist()
            packed = [None if x is None else own.encode_packed(x) for x in texts]
            counts = np.array([0 if x is None else len(x) // 4 for x in packed], dtype=np.int64)
            flat = np.frombuffer(b"".join(x for x in packed if x), dtype=np.int32)
            listed = t.list_array(flat, counts, pa.int32())
            none = np.array([x is None for x in texts], dtype=bool)
            if none.any():
                listed = pa.ListArray.from_arrays(listed.offsets, listed.values, mask=pa.array(none))
            back = [None if x is None else own.decode(np.frombuffer(x, dtype=np.int32).tolist()) for x in packed]
            exact = [None if x is None else x == y for x, y in zip(texts, back, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(id_cols)], pa.array(counts), listed, pa.array(back, pa.string()), pa.array(exact, pa.bool_())], schema.names)

    return source.mapInArrow(rows, schema)
