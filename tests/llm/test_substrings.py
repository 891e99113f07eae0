import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import repeats
from graphloom.llm._text import text_words
from graphloom.llm.substring_dedup import remove_later_passages
from graphloom.llm.suffix_dedup import remove_repeated_strings

from .conftest import ODD, documents


def brute(rows, width, symbols, join, first_wins):
    seen, least = {}, {}
    for i, x in rows:
        s = symbols(x)
        for p in range(len(s) - width + 1):
            w = s[p : p + width]
            seen[w] = seen.get(w, 0) + 1
            least[w] = min(least.get(w, 1 << 62), -(1 << 62) if i is None else i)
    out = []
    for i, x in rows:
        s = symbols(x)
        mask = [False] * len(s)
        for p in range(len(s) - width + 1):
            w = s[p : p + width]
            if least[w] < (-(1 << 62) if i is None else i) if first_wins else seen[w] > 1:
                mask[p : p + width] = [True] * width
        spans = sum(b and not a for a, b in zip([False, *mask], mask, strict=False))
        out.append((i, len(s), sum(mask), spans, hashlib.sha256(join(v for v, m in zip(s, mask, strict=True) if not m)).hexdigest()))
    return sorted(out, key=str)


def got(df, n):
    return sorted((tuple(r) for r in df.select("doc_id", n, "n_removed", F.size("spans"), F.sha2(F.col("kept").cast("binary"), 256)).collect()), key=str)


@pytest.mark.parametrize(("width", "gram"), [(60, 16), (25, 25)])
def test_bytes_match_brute_force(spark, corpus, width, gram):
    rows = corpus[:60] + ODD
    out = remove_repeated_strings(documents(spark, rows).repartition(5), width=width, gram=gram)
    assert got(out, "n_bytes") == brute(rows, width, lambda x: (x or "").encode(), bytes, False)


@pytest.mark.parametrize(("width", "gram"), [(10, 3), (6, 6)])
def test_words_match_brute_force(spark, corpus, width, gram):
    rows = corpus + ODD
    out = remove_later_passages(documents(spark, rows).repartition(5), width=width, gram=gram)
    assert got(out, "n_words") == brute(rows, width, lambda x: tuple((x or "").encode().split()), lambda v: b" ".join(v), True)


@pytest.mark.parametrize("chunk", [1, 700, 5000])
def test_ranges_that_cut_triggers_match_brute_force(spark, corpus, chunk):
    rows = corpus[:60] + ODD
    out = remove_later_passages(documents(spark, rows).repartition(5), width=10, gram=3, chunk=chunk)
    assert got(out, "n_words") == brute(rows, 10, lambda x: tuple((x or "").encode().split()), lambda v: b" ".join(v), True)
    out = remove_repeated_strings(documents(spark, rows).repartition(5), width=60, gram=16, chunk=chunk)
    assert got(out, "n_bytes") == brute(rows, 60, lambda x: (x or "").encode(), bytes, False)


def test_registered_widths_match_brute_force(spark):
    """Texts long enough for 400 bytes and 50 words: whole copies, edits, shared passages at all distances from an edge."""
    rnd = random.Random(21)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 9))) for _ in range(300)]
    passage = [rnd.choice(words) for _ in range(130)]
    rows = []
    for i in range(60):
        own = [rnd.choice(words) for _ in range(rnd.randrange(50, 300))]
        if i % 3 == 0 and i:
            own = rows[rnd.randrange(i)][1].split(" ")
            for _ in range(rnd.randrange(3)):
                own[rnd.randrange(len(own))] = "edit"
        if i % 3 == 1:
            lo, hi = rnd.randrange(50), 130 - rnd.randrange(50)
            own[rnd.randrange(len(own)) :] = passage[lo:hi] + own[:20]
        rows.append((i, " ".join(own)))
    assert got(remove_repeated_strings(documents(spark, rows)), "n_bytes") == brute(rows, 400, lambda x: x.encode(), bytes, False)
    assert got(remove_later_passages(documents(spark, rows)), "n_words") == brute(rows, 50, lambda x: tuple(x.encode().split()), lambda v: b" ".join(v), True)


def test_a_trigger_of_60000_different_rows(spark):
    """One line of 60 bytes between different ones, in 60,000 rows: windows of 80 bytes repeat in two pairs of rows only."""
    line = "the one line that stands in every document of this small set"
    texts = [f"{i:06d} before {i * 7919 % 1000003:07d} {line} {i * 104729 % 1000003:07d} after {i:06d}" for i in range(60_000)]
    texts[40_000] = "x" + texts[100][3:]
    texts[50_000] = texts[200][:-3] + "y"
    rows = list(enumerate(texts))
    out = remove_repeated_strings(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), width=80, gram=32, chunk=1 << 20)
    want = [r for r in brute(rows, 80, lambda x: x.encode(), bytes, False) if r[2]]
    assert 4 <= len(want) < 10
    assert got(out.filter("n_removed > 0"), "n_bytes") == want


def test_runs_of_one_byte(spark):
    rows = [(1, "a" * 500), (2, "b" * 39), (3, "c" * 40), (4, "ab" * 30), (5, "ab" * 30)]
    assert got(remove_repeated_strings(documents(spark, rows), width=40, gram=8), "n_bytes") == brute(rows, 40, lambda x: x.encode(), bytes, False)


def test_parts_of_long_texts_meet(monkeypatch):
    monkeypatch.setattr(repeats, "PART", 100)
    rnd = random.Random(3)
    codes = np.array([rnd.randrange(1 << 62) for _ in range(1000)], dtype=np.uint64)
    spec = repeats.Spec(20, 5, 8, True, text_words)
    starts = [int(s) + k for _, _, _, ss, _, ln in repeats.anchors(codes, spec) for s, n in zip(ss, ln, strict=True) for k in range(int(n) + 1)]
    assert sorted(starts) == list(range(1000 - 20 + 1))


def test_empty_table(spark):
    empty = documents(spark, [])
    assert remove_repeated_strings(empty).count() == 0
    assert remove_later_passages(empty).count() == 0
