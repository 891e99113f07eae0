"""Spelling variants against brute force."""

import random
import re
import zlib
from bisect import bisect_right
from collections import Counter

import pytest

from graphloom.llm.spelling import ALPHABET, Automaton, _bounds, ranges_of, spelling_forms

from .conftest import ODD, documents

UPPER = {i: i + 32 for i in range(65, 91)}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, least_length=6, least_count=5, ratio=5, noise=199):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % noise == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= least_length and k >= least_count}
    forms, out = {}, {}
    for w in n:
        close = [v for v in n if near(w, v)]
        best = min(close, key=lambda v: (-n[v], v), default=None)
        forms[w] = best if best is not None and n[best] >= ratio * n[w] else None
        out[w] = len(close)
    rows = []
    for w in n:
        root = w
        while forms[root] is not None:
            root = forms[root]
        rows.append((w, forms[w], root, n[w], out[w], n.get(forms[w])))
    return rows


def variants(seed, letters, count, texts):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(5, 11))) for _ in range(count)]
    for _ in range(2 * count):
        w = rnd.choice(words)
        at = rnd.randrange(len(w) + 1)
        words.append(w[:at] + rnd.choice(letters) * rnd.randrange(2) + w[at + rnd.randrange(2) :])
    weights = [rnd.choice((1, 1, 3, 20, 120)) for _ in words]
    out = []
    for i in range(texts):
        picked = rnd.choices(words, weights, k=rnd.randrange(0, 300))
        out.append((i, "".join((w.upper() if rnd.random() < 0.1 else w) + rnd.choice([" ", ", ", "\n", "1", "_"]) for w in picked)))
    return out


def spark_rows(spark, rows, **more):
    out = spelling_forms(documents(spark, rows).repartition(3), **more)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(map(str, (tuple(r) for r in out.collect())))


@pytest.mark.parametrize(("seed", "letters", "count", "more"), [
    (1, "abcde", 120, {}),
    (2, "aéÿ×", 60, {"range_letters": 60}),
    (3, "ab", 40, {"range_letters": 25, "noise": 7}),
    (4, "abcdefghijklmnop", 300, {"range_letters": 400, "least_count": 2, "ratio": 2}),
])
def test_matches_brute_force(spark, seed, letters, count, more):
    rows = variants(seed, letters, count, 40) + ODD * 2
    rules = {k: v for k, v in more.items() if k != "range_letters"}
    want = sorted(map(str, brute(rows, **rules)))
    assert len(want) > 20 and spark_rows(spark, rows, **more) == want


def test_words_of_one_beginning_and_of_one_letter(spark):
    rnd = random.Random(9)
    words = ["contra" + "".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 6))) for _ in range(300)] + ["a" * k for k in range(6, 60)] + ["x" * 20_000, "x" * 20_001]
    rows = [(i, " ".join(words)) for i in range(6)] + [(7, "contraa " * 5000)]
    want = sorted(map(str, brute(rows, noise=10**9)))
    assert spark_rows(spark, rows, noise=10**9, range_letters=200) == want


def test_chains_end_at_the_last_form(spark):
    words = {"aaaaaa": 5, "aaaaab": 25, "aaaabb": 125, "aaabbb": 625, "aabbbb": 3125, "abbbbb": 15625}
    rows = [(i, (w + " ") * n) for i, (w, n) in enumerate(words.items())]
    out = {r.word: r for r in spelling_forms(documents(spark, rows), noise=10**9).collect()}
    assert {r.root for r in out.values()} == {"abbbbb"} and out["aaaaaa"].form == "aaaaab" and out["abbbbb"].form is None


def test_no_words(spark):
    for rows in ([], [(1, None), (2, ""), (3, " \n"), (None, "short words only")]):
        assert spelling_forms(documents(spark, rows)).collect() == []


def test_automata_share_ends_and_number_words():
    words = sorted(a + b + c for a in "abcdefgh" for b in "xyz" for c in ("ing", "ed", "s"))
    made = Automaton(words)
    assert len(made.letters) < 12
    for k, word in enumerate(words):
        state, number = made.follow(made.start, 0, word, 0)
        assert made.final[state] and number == k
    assert made.follow(made.start, 0, "q", 0) == (-1, 0)


def test_ranges_hold_every_candidate():
    rnd = random.Random(4)
    words = sorted({"".join(rnd.choice("abÿ") for _ in range(rnd.randrange(6, 9))) for _ in range(400)})
    bounds = _bounds(words, 40)
    assert len(bounds) == 39
    for word in rnd.sample(words, 60):
        half = len(word) // 2
        asked = ranges_of(word, half, bounds)
        for at in range(half, len(word) + 1):
            for made in {word[:at] + c + word[at + r :] for c in (*ALPHABET, "") for r in (0, 1)}:
                assert bisect_right(bounds, made) in asked or made == word
