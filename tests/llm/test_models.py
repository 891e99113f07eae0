import bisect
import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import sentencepiece_wfst as sw
from graphloom.llm.language_id import identify_languages, letter_codes, letter_vectors, train_prototypes
from graphloom.llm.quality import AdditiveModel, classify_quality, fit_additive, text_features, train_quality, with_quality

from .conftest import ODD, documents

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def machine():
    return sw.machine(sw.load_model())


def test_encoding_equals_the_library(machine, corpus):
    sentencepiece = pytest.importorskip("sentencepiece")
    theirs = sentencepiece.SentencePieceProcessor(model_file=sw.DEFAULT_MODEL)
    rnd = random.Random(2)
    parts = ["a", "the", "in", " ", "  ", "ing", "\n", "ﬁ", "é", "中", "😀", "\u0301", "0", "<0x0A>", "<s>", "\x00", "er", "re", "."]
    texts = [x for _, x in corpus] + ["".join(rnd.choice(parts) for _ in range(rnd.randrange(12))) for _ in range(1500)]
    for x in texts:
        ids = machine.encode(x)
        assert ids == theirs.encode(x), x
        assert machine.decode(ids) == theirs.decode(ids) == x


def test_unigram_takes_the_shortest_path():
    model = sw.PieceModel(b"")
    model.pieces = [("<unk>", 0.0, sw.UNKNOWN), ("▁", -1.0, 1), ("a", -2.0, 1), ("b", -2.0, 1), ("ab", -3.5, 1), ("▁a", -1.5, 1), ("▁ab", -9.0, 1)]
    m = sw.Transducer(model)
    assert [model.pieces[i][0] for i in m.encode("ab")] == ["▁a", "b"]
    assert [model.pieces[i][0] for i in m.encode("bab")] == ["▁", "b", "ab"]
    assert m.encode("a?")[-1] == 0


def _field(number, kind, value):
    """One field of a protocol buffer: kind 0 a small int, 2 bytes, 5 a float."""
    key = bytes([number << 3 | kind])
    if kind == 0:
        return key + bytes([value])
    if kind == 5:
        return key + struct.pack("<f", value)
    size, n = b"", len(value)
    while n > 127:
        size, n = size + bytes([n & 127 | 128]), n >> 7
    return key + size + bytes([n]) + value


def _model(pieces, kind, charsmap, flags=(1, 1, 1)):
    body = b"".join(_field(1, 2, _field(1, 2, p.encode()) + _field(2, 5, score) + _field(3, 0, k)) for p, score, k in pieces)
    rules = _field(2, 2, charsmap) if charsmap else b""
    return body + _field(2, 2, _field(3, 0, kind)) + _field(3, 2, _field(1, 2, b"own") + rules + b"".join(_field(n, 0, v) for n, v in zip((3, 4, 5), flags, strict=True)))


@pytest.fixture(scope="session")
def charsmap():
    sentencepiece = pytest.importorskip("sentencepiece")
    proto = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()
    spec = next(v for n, v in sw._fields(proto) if n == 3)
    return next(v for n, v in sw._fields(spec) if n == 2)


ODD_PARTS = ["a", "b", "ab", " ", "  ", "\u3000", "\t", "ﬁ", "①", "e\u0301", "ｶﾞ", "中", "\u00a0", "\u200b", "가", "▁", "\u0308", "Å", "\x00", "😀", "Ａ"]


def test_a_character_map_equals_the_library(charsmap):
    sentencepiece = pytest.importorskip("sentencepiece")
    theirs = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=True)
    own = sw.Transducer(sw.PieceModel(_model([("<unk>", 0.0, sw.UNKNOWN), ("a", -1.0, 1)], 1, charsmap)))
    rnd = random.Random(4)
    for _ in range(2000):
        x = "".join(rnd.choice(ODD_PARTS) for _ in range(rnd.randrange(9)))
        assert own.spaces.transduce(own.map.transduce(x).strip(" "), 0) == theirs.normalize(x).rstrip("▁ ") or "▁" in x, repr(x)


@pytest.mark.parametrize("kind", [1, 2])
@pytest.mark.parametrize("fallback", [False, True])
@pytest.mark.parametrize("mapped", [False, True])
@pytest.mark.parametrize("flags", [(1, 1, 1), (0, 0, 1)])
def test_small_models_equal_the_library(charsmap, kind, fallback, mapped, flags):
    sentencepiece = pytest.importorskip("sentencepiece")
    rnd = random.Random(6)
    letters = ["▁", "a", "b", "c", "f", "i", "1", "é", "中", "A"]
    made = ["▁a", "ab", "bc", "fi", "▁ab", "abc", "▁b", "▁▁", "bcab", "fif", "11", "中é"]
    pieces = [("<unk>", 0.0, sw.UNKNOWN)] + ([(f"<0x{x:02X}>", 0.0, sw.BYTE) for x in range(256)] if fallback else [])
    pieces += [(p, -1.5 - 0.37 * k if kind == 1 else -1.0 - k, 1) for k, p in enumerate(made)] + [(p, -9.25 - 0.11 * k if kind == 1 else -100.0 - k, 1) for k, p in enumerate(letters)]
    raw = _model(pieces, kind, charsmap if mapped else b"", flags)
    if fallback:
        raw = raw.replace(_field(2, 2, _field(3, 0, kind)), _field(2, 2, _field(3, 0, kind) + b"\x98\x02\x01"))
    theirs = sentencepiece.SentencePieceProcessor(model_proto=raw)
    own = sw.Transducer(sw.PieceModel(raw))
    for _ in range(1500):
        x = "".join(rnd.choice(ODD_PARTS + letters + made) for _ in range(rnd.randrange(10)))
        ids, want = own.encode(x), theirs.encode(x)
        if kind == 1:  # paths of one weight: the library's choice hangs on how its 32-bit sums were rounded
            cost, text = (lambda y: sum(own.cost[i] if own.cost[i] else own.worst for i in y)), (lambda y: b"".join(own.output[i] for i in y))
            assert abs(cost(ids) - cost(want)) < 1e-3 and text(ids) == text(want) and len(ids) == len(want), repr(x)
        else:
            assert ids == want, repr(x)


def test_round_trip_rows(spark, corpus):
    rows = corpus[:20] + ODD
    out = sw.round_trip(documents(spark, rows), sw.load_model()).collect()
    assert len(out) == len(rows)
    assert all(r.exact for r in out if r.token_ids is not None)
    assert [r.n_tokens for r in out if r.doc_id in (900, 901)] == [0, 0]
    assert sw.round_trip(documents(spark, []), sw.load_model()).count() == 0
    some = sw.decode_tokens(sw.encode_texts(documents(spark, rows), sw.load_model()), sw.load_model())
    assert some.filter(~F.col("decoded").eqNullSafe(F.col("text"))).count() == 0


def test_languages_of_held_out_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = identify_languages(docs, train_prototypes(docs)).join(docs, "doc_id").filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2)
    right, n, low, high = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*"), F.min("score"), F.max("score")).first()
    assert n > 200 and right > 0.98 and low >= 0 and high <= 1


def test_language_of_odd_rows(spark):
    rows = ODD + [(1, "123 !"), (2, "Das ist")]
    docs = documents(spark, rows).withColumn("lang", F.when(F.col("doc_id") == 2, "de"))
    out = {(r.doc_id, r.lang_pred) for r in identify_languages(docs, train_prototypes(docs)).collect()}
    assert {(900, "und"), (901, "und"), (902, "und"), (1, "und"), (2, "de")} <= out
    assert identify_languages(docs, {}).filter("lang_pred <> 'und' or score <> 0").count() == 0
    assert identify_languages(documents(spark, []), {}).count() == 0


def test_letters_have_gaps_between_words():
    assert (letter_codes("ab  c!") == 0).tolist() == [True, False, False, True, False, True]
    assert len(letter_codes(" 1 ")) == 0


def test_quality_of_held_out_texts(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    out = classify_quality(docs, labels).join(labels, "doc_id").filter("held_out")
    right, n = out.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")), F.count("*")).first()
    assert n > 100 and right > 0.96


def test_quality_of_odd_rows(spark):
    docs = documents(spark, ODD)
    none = spark.createDataFrame([(None, 1), (903, None)], "doc_id long, quality int")
    out = classify_quality(docs, none).collect()
    assert len(out) == len(ODD) and {r.score for r in out} == {0.5}
    one = spark.createDataFrame([(i, 1) for i in range(900, 907)] * 2, "doc_id long, quality int")
    assert all(0.5 < r.score <= 1 and r.predicted == 1 for r in classify_quality(docs, one).collect())
    assert classify_quality(documents(spark, []), one).count() == 0


def test_additive_model_learns_an_interaction():
    rnd = np.random.default_rng(1)
    x = rnd.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = fit_additive(x[:3000], y[:3000])
    assert isinstance(model, AdditiveModel) and ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95


def test_features_of_empty_and_long_texts():
    assert set(text_features(np.zeros(0, np.uint8))) == {0.0}
    assert np.isfinite(text_features(np.full(3_000_000, 65, np.uint8))).all()


def plain_vector(text):
    """The sum of a text's bound trigrams, letter by letter in Python."""
    letters, gap = [], True
    for c in text:
        if c.isalpha():
            letters += [0] * gap + [ord(c.lower()[0])]
            gap = False
        else:
            gap = True
    if not letters:
        return None
    letters.append(0)
    of = {x: letter_vectors(np.array([x]))[0].tolist() for x in set(letters)}
    out = [0] * 512
    for x, y, z in zip(letters, letters[1:], letters[2:], strict=False):
        a, b, c = of[x], of[y], of[z]
        for k in range(512):
            out[k] += a[k - 2] * b[k - 1] * c[k]
    return out


def test_languages_equal_a_plain_scorer(spark):
    texts = ["Ein kurzer Satz.", "the cat sat", "le chat, l'été", "\U00020000\U00020001 \U00030000", "数据 数据", "a", "AA aa", "12 34", "", None, "x\u0301y ß"]
    langs = {"de": "der Satz ist kurz und ein Wort", "en": "the cat sat on the mat", "fr": "le chat est sur la table", "zh": "数据 \U00020000\U00020001"}
    docs = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "doc_id long, text string")
    unit = lambda v: np.array(v) / np.sqrt(np.dot(v, v))
    prototypes = {k: unit(plain_vector(x)) for k, x in langs.items()}
    for r in identify_languages(docs, prototypes).collect():
        v = plain_vector(texts[r.doc_id] or "")
        if v is None:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        cosines = {k: float(np.dot(unit(v), p)) for k, p in prototypes.items()}
        best = max(sorted(cosines), key=cosines.get)
        assert r.lang_pred == best and abs(r.score - min(max(cosines[best], 0), 1)) < 1e-6
    assert len({tuple(x) for x in letter_vectors(np.arange(0x4E00, 0x9FFF)).tolist()}) == 0x9FFF - 0x4E00


def test_language_ties_and_very_long_texts(spark):
    v = np.ones(512) / np.sqrt(512)
    docs = spark.createDataFrame([(1, "abc"), (2, "the cat sat " * 400_000)], "doc_id long, text string")
    out = {r.doc_id: r for r in identify_languages(docs, {"b": v, "a": v}).collect()}
    assert out[1].lang_pred == out[2].lang_pred == "a"
    short = identify_languages(docs.limit(0).union(spark.createDataFrame([(3, "the cat sat " * 50)], docs.schema)), {"a": v}).first()
    assert abs(short.score - out[2].score) < 0.05


def test_too_many_languages(spark):
    docs = spark.createDataFrame([(k, "some text", f"l{k}") for k in range(30)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError):
        train_prototypes(docs, most_languages=5)


def test_quality_equals_a_plain_scorer(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 300")
    model = train_quality(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert len(model.pairs) > 0
    scores = {r.doc_id: r.score for r in with_quality(docs, model).collect()}
    for doc_id, text in docs.select("doc_id", "text").collect():
        x = text_features(np.frombuffer((text or "").encode(), np.uint8))
        total = model.base
        bins = [bisect.bisect_right(e.tolist(), v) for e, v in zip(model.edges, x, strict=True)]
        for j, b in enumerate(bins):
            total += model.tables[j][b]
        for i, j, table in model.pairs:
            total += table[model.coarse[i][bins[i]]][model.coarse[j][bins[j]]]
        assert abs(scores[doc_id] - 1 / (1 + math.exp(-min(max(total, -40), 40)))) < 1e-9


def test_quality_features_equal_plain_ones():
    text = "One line here.\nTwo\nTwo\nan odd 12 line, é中\n"
    x = text_features(np.frombuffer(text.encode(), np.uint8))
    words, size = text.encode().split(), len(text.encode())
    assert abs(x[0] - math.log1p(size)) < 1e-12 and abs(x[1] - math.log1p(len(words))) < 1e-12 and abs(x[2] - size / len(words)) < 1e-12
    lines = text.encode().split(b"\n")
    assert abs(x[13] - len(set(lines)) / len(lines)) < 1e-12 and abs(x[14] - 3 / size) < 1e-12 and abs(x[15] - len(words) / len(lines)) < 1e-12


def test_repeated_rows_do_not_weigh_more(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 200"), spark.read.parquet(f"{SF}/labels.parquet")
    once, thrice = train_quality(docs, labels), train_quality(docs.union(docs).union(docs), labels)
    assert once.base == thrice.base and all(np.array_equal(a, b) for a, b in zip(once.tables, thrice.tables, strict=True))
