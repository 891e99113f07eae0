"""Byte-pair encoding against the tokenizers library, and by its own rules."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import bpe
from graphloom.llm.queries import op12_bpe

from .conftest import ODD, documents

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def own():
    return bpe.Encoder(bpe.load_vocabulary())


def both(library, own, text):
    packed = own.encode(text)
    ids = library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packed, "<u4").tolist() == ids, ascii(text[:200])
    assert own.decode([packed])[0].as_py() == library.decode(ids, skip_special_tokens=False)


def test_every_code_point(library, own):
    points = [chr(p) for p in range(0x110000) if not 0xD800 <= p < 0xE000]
    for k in range(0, len(points), 64):
        both(library, own, "".join(f"a{c}b!{c}" for c in points[k : k + 64]))


def test_odd_strings(library, own):
    rnd = random.Random(5)
    pool = ["<|endoftext|>", "<|startoftext|>", "<|END", "|>", "'s", "'LL", "''re", " ", "\n", "\x1c", "\x1f", " ", " ", "\u0085", "Σ", "İ", "é", "é", "가", "1", "½", "​", "中", "\x00"]
    for _ in range(4000):
        both(library, own, "".join(rnd.choice(pool) if rnd.random() < 0.6 else chr(rnd.randrange(0x20, 0x250)) for _ in range(rnd.randrange(30))))


def test_ties_and_long_words(library, own):
    for text in ("a" * 777, "ab" * 300, "lololololol", "é" * 500, "!" * 999, "hello" * 200, "x" * 65, "x" * 64, "🙂" * 100, "inin inin thth"):
        both(library, own, text)


def test_segments_keep_the_tokens(own, monkeypatch):
    rnd = random.Random(6)
    text = "".join(rnd.choice(["word", " ", "\n\n", "<|endoftext|>", "naïve", "'s", "42", " ", "é", "\x1c"]) for _ in range(20_000))
    whole = own.encode(text)
    monkeypatch.setattr(bpe, "SEGMENT", 100)
    monkeypatch.setattr(bpe.segments, "__defaults__", (100,))
    assert "".join(bpe.segments(text, own.blank)) == text and len(list(bpe.segments(text, own.blank))) > 100
    assert own.encode(text) == whole


def test_recent_encodings_are_bounded(own, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 50)
    own.chunks.clear()
    text = " ".join(f"w{k * 7919 % 1000}" for k in range(3000))
    packed = own.encode(text)
    assert len(own.chunks) <= 50
    monkeypatch.undo()
    own.chunks.clear()
    assert own.encode(text) == packed


def test_other_files_are_refused():
    for name in ("byte_bpe_50k.json",):
        with pytest.raises(ValueError, match="another kind"):
            bpe.Encoder(bpe.load_vocabulary(public_tokenizers.path(name)))


def test_table(spark, library, corpus):
    rows = corpus + ODD
    docs = documents(spark, rows)
    out = bpe.encode_decode(docs, bpe.load_vocabulary())
    assert out.columns == ["doc_id", "n_tokens", "token_ids", "decoded"]
    listed = bpe.unpack_ids(out).collect()
    want = []
    for i, x in rows:
        ids = library.encode(x or "", add_special_tokens=False).ids
        want.append((str(i), len(ids), ids, library.decode(ids, skip_special_tokens=False)))
    assert sorted((str(r.doc_id), r.n_tokens, r.token_ids, r.decoded) for r in listed) == sorted(want)
    again = bpe.decode_ids(out.withColumn("token_ids", F.when(F.col("doc_id") != 900, F.col("token_ids"))), bpe.load_vocabulary(), out_col="again").collect()
    assert all(r.again == (r.decoded if r.token_ids is not None else None) for r in again) and any(r.again is None for r in again)
    assert bpe.encode_decode(documents(spark, []), bpe.load_vocabulary()).collect() == []


def test_query_digests(spark, library, corpus, tmp_path):
    rows = corpus + ODD
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, x in rows:
        ids = library.encode(x or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((str(i), len(ids), hashlib.sha256(b"".join(k.to_bytes(4, "little") for k in ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted((str(r[0]), *r[1:]) for r in op12_bpe(spark, str(tmp_path)).collect()) == sorted(want)


def test_very_long_text(spark, own):
    text = " ".join(f"word{k % 9973}!" for k in range(700_000))
    row = bpe.encode_decode(spark.createDataFrame([(1, text)], "doc_id long, text string"), bpe.load_vocabulary()).first()
    assert row.n_tokens == len(row.token_ids) // 4 == row.decoded.count(" ") + 1 and bytes(row.token_ids) == own.encode(text)
