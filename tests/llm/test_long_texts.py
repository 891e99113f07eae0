"""Segments give what whole texts give, within bounded memory."""

import random
import subprocess
import sys

import numpy as np
import pytest

from graphloom.llm import language_id, quality


def texts():
    rnd = random.Random(8)
    pool = ["word", "Zwei", " ", "\n", "  ", ".", "é", "漢字", "𠀀", "x" * 30, "\n\n", "42", "|", "a" * 90]
    return ["", " ", "a", "ab", "abc", "\n", *("".join(rnd.choice(pool) for _ in range(rnd.randrange(1, 200))) for _ in range(60))]


@pytest.mark.parametrize("size", [1, 2, 3, 7, 50])
def test_language_segments(monkeypatch, size):
    whole = [language_id.gram_counts(x) for x in texts()]
    vectors = language_id.bundle(texts())
    monkeypatch.setattr(language_id, "SEGMENT", size)
    monkeypatch.setattr(language_id, "BLOCK", 5)
    for x, (grams, counts) in zip(texts(), whole, strict=True):
        again = language_id.gram_counts(x)
        assert again[0].tolist() == grams.tolist() and again[1].tolist() == counts.tolist(), repr(x)
    assert np.array_equal(language_id.bundle(texts()), vectors)


@pytest.mark.parametrize("size", [1, 5, 40])
def test_quality_segments(monkeypatch, size):
    whole = [quality.text_features(np.frombuffer(x.encode(), np.uint8)) for x in texts()]
    monkeypatch.setattr(quality, "LONG", size)
    for x, features in zip(texts(), whole, strict=True):
        assert quality.text_features(np.frombuffer(x.encode(), np.uint8)) == pytest.approx(features, rel=1e-12), repr(x)


@pytest.mark.parametrize("kind", ["words", "one"])
def test_fifty_megabytes_within_a_gigabyte(kind):
    code = f"""
import resource
import numpy as np
from graphloom.llm import language_id, quality
text = ("some words in lines\\n" * 2_500_000) if {kind!r} == "words" else "abcdefg" * 7_000_000
language_id.bundle([text])
quality.text_features(np.frombuffer(text.encode(), np.uint8))
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True)
    assert int(out.stdout) < 1024
