"""Spelling variants of the words of a corpus, by pairs of word automata.

Words are counted over all texts with built-in functions, partial counts before
the shuffle. Two words at distance one agree exactly on one half of either: what
differs lies in the other half. So the vocabulary stands in two sets of minimal
acyclic automata, of the words and of the words read backwards, whose arcs carry
how many words lie before them: a path's sum is a word's number in its automaton
and leads to its count. Each word follows its first half through the forward
automata, or its second half through the backward ones, and completes the rest
with one error. A pair that both directions meet is left to the forward one.

An automaton holds a range of the sorted words, of a bounded number of letters,
so that any number of words takes more tasks and not larger ones, however many
begin alike. The ranges' bounds come from a sample, as in any range partitioning;
they decide where a word is looked up and never whether. A word goes only to the
ranges where a word at distance one may stand.

Null text has no words; empty and blank ones neither. A text of any length is
read whole; letters of one text in repeated rows or under one id are counted in
each row; a null id is as if its digits were missing. Ties of counts go to the
word that is first in code-point order. Extra columns, whatever their names, are
not read. An empty table has no words. A word of any length is a word; a task
holds the letters of its own range.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as t
from ._spark import drop_table, shared_checkpoint, shared_table

#: Letters of runs, and those that lower-cased runs may have.
RUN = r"[A-Za-zÀ-ÿ]+"
ALPHABET = [chr(p) for p in (*range(0x61, 0x7B), *range(0xC0, 0x100))]
#: Letters in an automaton, samples for a range's bound, and letters of a bound.
RANGE_LETTERS, SAMPLES, BOUND_LETTERS = 1 << 18, 40, 64
_LAST = "\U0010ffff"


def count_words(docs: DataFrame, least_length: int = 6, least_count: int = 5, noise: int = 199, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words and their occurrences n: lower-cased runs of letters, of which one in ``noise``, drawn by id and run, lacks one letter."""
    lower = F.translate(F.coalesce(F.col(text_col), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.explode(F.regexp_extract_all(lower, F.lit(RUN), 0)).alias("run"))
    drawn = runs.filter(F.char_length("run") >= least_length).select("run", F.crc32(F.concat("i", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    short = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    words = drawn.select(F.when(F.col("h") % noise == 0, short).otherwise(F.col("run")).alias("word"))
    return words.filter(F.char_length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


class Automaton:
    """The minimal acyclic automaton of sorted words, with their numbers."""

    def __init__(self, words: Iterable[str]) -> None:
        #: By state: its arcs' letters, their ends, the words before each arc, whether a word ends here, and the words from here on.
        self.letters: list[str] = []
        self.ends: list[tuple[int, ...]] = []
        self.before: list[tuple[int, ...]] = []
        self.final: list[bool] = []
        self.size: list[int] = []
        known: dict[tuple, int] = {}
        path: list[list] = [[False, [], []]]
        last = ""

        def close(depth: int) -> int:
            while len(path) > depth:
                final, letters, ends = path.pop()
                key = (final, "".join(letters), tuple(ends))
                state = known.get(key)
                if state is None:
                    state = known[key] = len(self.letters)
                    counts, total = [], int(final)
                    for end in ends:
                        counts.append(total)
                        total += self.size[end]
                    self.letters.append(key[1])
                    self.ends.append(key[2])
                    self.before.append(tuple(counts))
                    self.final.append(final)
                    self.size.append(total)
                if path:
                    path[-1][2].append(state)
            return state

        for word in words:
            same = 0
            for a, b in zip(word, last, strict=False):
                if a != b:
                    break
                same += 1
            if len(path) > same + 1:
                close(same + 1)
            for letter in word[same:]:
                path[-1][1].append(letter)
                path.append([False, [], []])
            path[-1][0] = True
            last = word
        self.start = close(0)

    def follow(self, state: int, number: int, word: str, at: int) -> tuple[int, int]:
        """State and number after ``word`` from ``at`` on; state -1 where it leaves the automaton."""
        letters, ends, before = self.letters, self.ends, self.before
        for k in range(at, len(word)):
            arc = letters[state].find(word[k])
            if arc < 0:
                return -1, 0
            number += before[state][arc]
            state = ends[state][arc]
        return state, number

    def numbers(self, word: str, exact: int) -> list[int]:
        """Numbers of the words at distance one from ``word`` that begin with its first ``exact`` letters, each once."""
        out = []
        state, number = self.follow(self.start, 0, word[:exact], 0)
        n = len(word)
        for at in range(exact, n + 1):
            if state < 0:
                break
            own = word[at] if at < n else ""

            def end(state: int, number: int, rest: int) -> None:
                state, number = self.follow(state, number, word, rest)
                if state >= 0 and self.final[state]:
                    out.append(number)

            if at < n and (at == exact or own != word[at - 1]):  # of a run of one letter, the first is left out
                end(state, number, at + 1)
            for letter, to, skip in zip(self.letters[state], self.ends[state], self.before[state], strict=True):
                if letter != own:  # a letter put before its like is put behind their run instead
                    end(to, number + skip, at)
                    if at < n:
                        end(to, number + skip, at + 1)
            if at < n:
                state, number = self.follow(state, number, own, 0)
        return out


def ranges_of(word: str, exact: int, bounds: list[str]) -> set[int]:
    """The ranges in which a word at distance one that begins with the first ``exact`` letters may stand."""
    found = set()
    for at in range(exact, len(word) + 1):
        head = word[:at]
        first = bisect_right(bounds, head)
        if first == bisect_right(bounds, head + _LAST):
            found.add(first)  # all that begins so stands there
            break
        tails = {word[at:], word[at + 1 :]}
        found.add(bisect_right(bounds, head + word[at + 1 :]))
        found.update(bisect_right(bounds, head + letter + tail) for letter in ALPHABET for tail in tails)
    return found


def _bounds(words: list[str], ranges: int) -> list[str]:
    """Bounds between ``ranges`` ranges of about as many letters."""
    words = sorted(words)
    total, sums, at = sum(map(len, words)), 0, []
    for word in words:
        if sums >= total * (len(at) + 1) / ranges:
            at.append(word)
        sums += len(word)
    return sorted({*at})


def near_pairs(words: DataFrame, letters: int, rows: int, range_letters: int = RANGE_LETTERS) -> DataFrame:
    """Each of ``words`` (word, n) with null, and with every word at distance one (near, near_n).

    ``letters`` and ``rows`` are the table's sums, which set the number of ranges.
    """
    spark = words.sparkSession
    t.limit_arrow_batches(spark)
    wanted = max(1, -(-letters // range_letters))
    share = min(1.0, SAMPLES * wanted / max(rows, 1))
    sample = [] if wanted == 1 else words.filter(F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < math.ceil(share * (1 << 20))).select("word").collect()
    ahead = _bounds([r.word[:BOUND_LETTERS] for r in sample], wanted)
    back = _bounds([r.word[::-1][:BOUND_LETTERS] for r in sample], wanted)
    offset, tasks = len(ahead) + 1, len(ahead) + len(back) + 2

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranges, asks, keys, counts = [], [], [], []
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                half = len(word) // 2
                for key, bounds, exact, base in ((word, ahead, half, 0), (word[::-1], back, len(word) - half, offset)):
                    to = [bisect_right(bounds, key), *ranges_of(key, exact, bounds)]
                    ranges += [base + k for k in to]
                    asks += [False, *[True] * (len(to) - 1)]
                    keys += [key] * len(to)
                    counts += [n] * len(to)
            yield pa.RecordBatch.from_arrays([pa.array(ranges, pa.int32()), pa.array(asks, pa.bool_()), pa.array(keys, pa.string()), pa.array(counts, pa.int64())], ["range", "asks", "key", "n"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known, sizes, automaton = -1, [], [], None
        for batch in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            for place, asks, key, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if place != now:
                    now, known, sizes, automaton = place, [], [], None
                forward = place < offset
                if not asks:
                    known.append(key)
                    sizes.append(n)
                    if forward:
                        for column, value in zip(out, (key, n, None, None), strict=True):
                            column.append(value)
                    continue
                if not known:
                    continue
                if automaton is None:
                    automaton = Automaton(known)
                word, half = (key if forward else key[::-1]), len(key) // 2
                for k in automaton.numbers(key, half if forward else len(key) - half):
                    near = known[k] if forward else known[k][::-1]
                    if forward or not near.startswith(word[:half]):
                        for column, value in zip(out, (word, n, near, sizes[k]), strict=True):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], ["word", "n", "near", "near_n"])

    dealt = words.select("word", "n").mapInArrow(deal, "range int, asks boolean, key string, n long")
    return dealt.repartitionById(tasks, "range").sortWithinPartitions("range", "asks", "key").mapInArrow(search, "word string, n long, near string, near_n long")


def spelling_forms(docs: DataFrame, least_length: int = 6, least_count: int = 5, ratio: int = 5, noise: int = 199, id_col: str = "doc_id", text_col: str = "text", range_letters: int = RANGE_LETTERS) -> DataFrame:
    """Words of the corpus, each with the spelling that it is a variant of.

    Returns word, form (the most frequent word at distance one if it is
    ``ratio`` times as frequent, else null), root (where following forms ends),
    n, n_near (words at distance one) and form_n.
    """
    counted = shared_table(count_words(docs, least_length, least_count, noise, id_col, text_col))
    total = counted.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.char_length("word")), F.lit(0)).alias("letters"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("less"), "near"))).alias("best")
    grouped = near_pairs(counted, total.letters, total.rows, range_letters).groupBy("word").agg(F.max("n").alias("n"), F.count("near").alias("n_near"), best)
    taken = -F.col("best.less") >= ratio * F.col("n")
    words = shared_checkpoint(grouped.select("word", "n", "n_near", F.when(taken, F.col("best.near")).alias("form"), F.when(taken, -F.col("best.less")).alias("form_n")))
    drop_table(counted)
    roots = words.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    #: Each form is ratio times as frequent as its word, so that no way is longer; a round doubles the steps.
    steps = int(math.log(max(total.most / least_count, 1), ratio)) + 1 if ratio > 1 else 0
    for _ in range(math.ceil(math.log2(max(steps, 1)))):
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        roots = shared_checkpoint(roots.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")))
    return words.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
