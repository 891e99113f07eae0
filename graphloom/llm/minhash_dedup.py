"""MinHash near-dedup with tensored banding.

Two collections of ``side`` tuples of minhashes each are drawn; every pair of a
tuple from the one and a tuple from the other keys a table. ``side`` squared
tables so need only ``2 * side`` tuples, about the square root of the
minhashes that independent tables would take. With tuples of 2 and a side of 10, a
pair of similarity 0.75 meets in some table with probability 0.9995, and one of
0.8 with 0.99996. Candidates are confirmed on the full shingle sets.

1. *Classes.* Documents with equal sets, told by the SHA-256 of the sorted set,
   form a class, and only its representative goes on.
2. *Tables.* A document enters a table only if it shares both of its tuples
   with others, so that tuples are counted first, ``2 * side`` rows a document
   instead of ``side`` squared.
3. *Buckets.* All members of a small bucket are compared. In a larger one each
   member is compared with the bucket's lead (the document that shares most
   tuples) and with the lead of those that also share the next tuple: copies of
   one original are often less alike than each is to the original. Buckets are
   never gathered; leads come from aggregates that combine before the shuffle.
4. *The rest, exactly.* A larger bucket whose members are then still in several
   components has pairs left that could link them. The members of all such
   buckets are joined by the prefixes of their shingle sets, rarest shingles
   first: sets of the asked similarity share a shingle of the prefixes, at
   places that leave room for the overlap their sizes need. What a template
   gives to all its pages is common and stays behind the prefixes, unless the
   template alone makes them similar enough. The join leaves out pairs inside
   one component and finds every other similar pair among them.

A candidate from the tables whose minhashes agree in under two fifths is left
out: at a similarity of 0.75 that befalls fewer than one pair in a million. What
the prefix join finds is confirmed whatever its minhashes. Sets are confirmed as
sets of 64-bit hashes of their shingles.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import connected_components
from . import _text as t
from ._spark import shared_checkpoint

TUPLE = 2
#: Buckets up to this many members are compared pair by pair.
SMALL = 6
#: Least share of a pair's minhashes that must agree before its sets are read.
LEAST_AGREEMENT = 0.4
#: Partners that one copy of a document's text is sent for.
FAN = 512
SKETCH_SCHEMA = "id long, no_id boolean, th long, n long, digest binary, mins array<int>"

_WORD_CODES = np.random.default_rng(4001).integers(1, 2**63, 64, dtype=np.int64).astype(t.U64) * t.U64(2) + t.U64(1)


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Distinct hashes of ``width`` words in a row; of a shorter text, of all its words."""
    n = len(words)
    if n == 0:
        return words
    span = min(n, width)
    out = np.zeros(n - span + 1, dtype=t.U64)
    for j in range(span):
        out += words[j : n - span + 1 + j] * _WORD_CODES[j]
    return np.unique(t.mix(out + t.U64(span)))


def _text_shingles(data: np.ndarray, width: int) -> np.ndarray:
    return shingles(t.text_words(t.lower_ascii(data)), width)


def _sketches(width: int, hashes: int):
    def rows(batches):
        seeds = np.random.default_rng(929).integers(1, 2**63, (2, hashes), dtype=np.int64).astype(t.U64)
        times, plus = seeds[0] * t.U64(2) + t.U64(1), seeds[1]
        for batch in batches:
            data, offsets = t.column_bytes(batch.column("text"))
            sets = [_text_shingles(data[a:b], width) for a, b in zip(offsets, offsets[1:], strict=False)]
            n = np.array([len(x) for x in sets], dtype=np.int64)
            mins = np.zeros((len(sets), hashes), dtype=np.int32)
            live = np.flatnonzero(n)
            for first in range(0, len(live), 64):
                own = live[first : first + 64]
                every = np.concatenate([sets[i] for i in own])
                starts = np.concatenate([[0], np.cumsum(n[own])[:-1]])
                for h in range(hashes):
                    least = np.minimum.reduceat((every ^ plus[h]) * times[h], starts)
                    mins[own, h] = (t.mix(least) & t.U64(0x7FFFFFFF)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("no_id"), batch.column("th"), pa.array(n), pa.array([hashlib.sha256(x.tobytes()).digest() for x in sets], pa.binary()), t.list_array(mins.ravel(), np.full(len(sets), hashes), pa.int32())],
                ["id", "no_id", "th", "n", "digest", "mins"],
            )

    return rows


def _confirm(width: int, percent: int):
    """Of rows sorted by (lead, part), the lead's own row (``other`` null) first: the pairs similar enough."""

    def rows(batches):
        held, near = None, np.zeros(0, t.U64)
        for batch in batches:
            data, offsets = t.column_bytes(batch.column("text"))
            leads, others = batch.column("lead").to_numpy(), batch.column("other")
            own, other = others.is_null().to_numpy(zero_copy_only=False), others.fill_null(0).to_numpy()
            good = np.zeros(len(leads), dtype=bool)
            for i in range(len(leads)):
                x = _text_shingles(data[offsets[i] : offsets[i + 1]], width)
                if own[i]:
                    held, near = leads[i], x
                    continue
                if held != leads[i]:
                    raise ValueError("a lead's text is missing")
                both = len(x) + len(near) - len(np.union1d(x, near))
                good[i] = both > 0 and 100 * both >= percent * (len(x) + len(near) - both)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(leads, other)[good]), pa.array(np.maximum(leads, other)[good])], ["a", "b"])

    return rows


def _confirmed(some: DataFrame, read: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (lead, other) of ``some`` whose whole sets are similar enough, as (a, b); ``read`` has their texts.

    A lead's text goes out once per ``FAN`` partners, and theirs once per pair,
    so that no task depends on a lead.
    """
    some = shared_checkpoint(some.select("lead", "other"))
    if some.isEmpty():
        return some.select(F.col("lead").alias("a"), F.col("other").alias("b"))
    many = some.groupBy("lead").agg(F.count("*").alias("k"))
    dealt = shared_checkpoint(some.join(many, "lead").select("lead", "other", F.pmod(F.xxhash64("other"), F.ceil(F.col("k") / FAN)).alias("part")))
    own = dealt.select("lead", "part").distinct().join(read.withColumnRenamed("row", "lead"), "lead").select("lead", "part", F.lit(None).cast("long").alias("other"), "text")
    theirs = dealt.join(read.withColumnRenamed("row", "other"), "other").select("lead", "part", "other", "text")
    met = own.union(theirs).repartition("lead", "part").sortWithinPartitions("lead", "part", F.asc_nulls_first("other"))
    return shared_checkpoint(met.mapInArrow(_confirm(width, percent), "a long, b long"))


def _postings(width: int):
    """A row per document and shingle."""

    def rows(batches):
        for batch in batches:
            c = batch.column("row").to_numpy()
            data, offsets = t.column_bytes(batch.column("text"))
            sets = [_text_shingles(data[a:b], width) for a, b in zip(offsets, offsets[1:], strict=False)]
            if sets:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(c, [len(x) for x in sets])), pa.array(t.signed(np.concatenate(sets)))], ["c", "token"])

    return rows


def _similar_prefixes(open_texts: DataFrame, facts: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) of different components among ``open_texts`` (row, text), with every pair similar enough.

    ``facts`` has c, n and comp. Of sets of x and y shingles, in one order of
    all shingles, the first common one at places i and j (from 0) leaves room
    for an overlap of min(x - i, y - j), and p (x + y) / (100 + p) is needed:
    so y <= (x - i) (100 + p) / p - x, and the same from the other side.
    """
    tokens = shared_checkpoint(open_texts.mapInArrow(_postings(width), "c long, token long"))
    common = tokens.groupBy("token").agg(F.count("*").alias("df"))
    place = F.row_number().over(Window.partitionBy("c").orderBy("df", "token")) - 1
    placed = tokens.join(common, "token").withColumn("i", place).join(facts, "c")
    most = F.floor((F.col("n") - F.col("i")) * (100 + percent) / percent - F.col("n") + 1e-6).cast("long")
    post = placed.withColumn("most", most).filter(F.col("df") > 1).filter(F.col("most") * 100 >= F.col("n") * percent).select("token", "c", "n", "comp", "most")
    post = shared_checkpoint(post)
    # A token's largest component meets only the others, and nothing if there are none.
    held = post.groupBy("token", "comp").agg(F.count("*").alias("k"))
    main = held.groupBy("token").agg(F.count("*").alias("parts"), F.max_by("comp", F.struct("k", "comp")).alias("main")).filter("parts > 1").select("token", "main")
    live = post.join(main, "token")
    minor = live.filter("comp <> main").select("token", F.col("c").alias("l"), F.col("n").alias("ln"), F.col("comp").alias("lc"), F.col("most").alias("lm"))
    met = minor.join(live, "token").filter("lc <> comp and ln <= most and n <= lm and (comp = main or l < c)")
    return met.select(F.least("l", "c").alias("a"), F.greatest("l", "c").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75, side: int = 10) -> DataFrame:
    """Components of texts linked by a Jaccard similarity of ``percent`` hundredths or more.

    Words are runs without ASCII white space, A-Z lower-cased. Returns a row per
    input row: ``id_col``, n_shingles, component_id (smallest id reachable),
    kept (one row per component), and th (Spark's xxhash64 of the text).

    A text of fewer than ``width`` words is one shingle of them all. Texts
    without words, and nulls, are linked with nothing and kept. A very long
    text is hashed in segments, and a task holds two sets of shingles at a
    time. Of rows that repeat the smallest id the first in scan order is kept.
    A null id counts below all others and comes back as null. An empty table
    gives an empty result; other columns are not looked at.
    """
    t.limit_arrow_batches(docs.sparkSession)
    hashes = 2 * side * TUPLE
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("id"), F.col(id_col).isNull().alias("no_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    sketches = shared_checkpoint(texts.mapInArrow(_sketches(width, hashes), SKETCH_SCHEMA).withColumn("row", F.monotonically_increasing_id()))
    # Equal sets: one class, represented by its first row.
    same = shared_checkpoint(sketches.filter("n > 0").groupBy("digest").agg(F.min("row").alias("c")))
    classed = sketches.filter("n > 0").select("row", "digest").join(same, "digest").select("row", "c")
    nodes = shared_checkpoint(sketches.join(same.select(F.col("c").alias("row")), "row").select(F.col("row").alias("c"), "n", "mins"))
    # Tuples, and how many share each.
    tuples = F.array(*(F.xxhash64(F.lit(k), *(F.col("mins")[k * TUPLE + j] for j in range(TUPLE))) for k in range(2 * side)))
    held = nodes.select("c", F.posexplode(tuples).alias("slot", "x"))
    common = shared_checkpoint(held.groupBy("x").agg(F.count("*").alias("k")).filter("k > 1"))
    shared = held.join(common, "x").groupBy("c").agg(F.sum("k").alias("met"), F.map_from_entries(F.collect_list(F.struct("slot", "x"))).alias("m"))
    crossed = shared.select("c", "met", "m", F.explode(F.map_keys("m")).alias("i")).filter(F.col("i") < side).select("c", "met", "m", "i", F.explode(F.map_keys("m")).alias("j")).filter(F.col("j") >= side)
    beside = F.coalesce(F.try_element_at("m", (F.col("i") + 1) % side), F.col("c"))
    tables = shared_checkpoint(crossed.select("c", "met", F.xxhash64(F.col("m")[F.col("i")], F.col("m")[F.col("j")]).alias("key"), beside.alias("beside")))
    lead = F.min(F.struct((-F.col("met")).alias("order"), "c"))["c"].alias("lead")
    buckets = shared_checkpoint(tables.groupBy("key").agg(F.count("*").alias("size"), lead).filter("size > 1"))
    live = tables.join(buckets, "key")
    large = live.filter(F.col("size") > SMALL)
    inner = shared_checkpoint(large.groupBy("key", "beside").agg(F.count("*").alias("k"), lead).filter("k > 1").drop("k"))
    members = live.filter(F.col("size").between(3, SMALL)).groupBy("key").agg(F.collect_list("c").alias("cs"))
    every = members.select(F.explode("cs").alias("c"), F.col("cs").alias("others")).select("c", F.explode("others").alias("lead")).filter("c < lead")
    met = live.select("c", "lead").union(large.drop("lead").join(inner, ["key", "beside"]).select("c", "lead")).filter("c <> lead").union(every)
    pairs = met.select(F.least("c", "lead").alias("a"), F.greatest("c", "lead").alias("b")).distinct()
    agree = F.aggregate(F.zip_with("ma", "mb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)

    def agreeing(some: DataFrame) -> DataFrame:
        return shared_checkpoint(
            some.join(nodes.select(F.col("c").alias("a"), F.col("n").alias("na"), F.col("mins").alias("ma")), "a")
            .join(nodes.select(F.col("c").alias("b"), F.col("n").alias("nb"), F.col("mins").alias("mb")), "b")
            .filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
            .select("a", "b", agree.alias("agree"))
            .filter(F.col("agree") >= int(hashes * LEAST_AGREEMENT))
        )

    def texts_of(some: DataFrame) -> DataFrame:
        wanted = some.join(sketches.select("row", "id", "th"), "row")
        return shared_checkpoint(wanted.join(texts.select("id", "th", "text"), ["id", "th"]).select("row", "text").dropDuplicates(["row"]))

    ends = lambda some: some.select(F.col("a").alias("row")).union(some.select("b")).distinct()
    candidates = agreeing(pairs)
    read = texts_of(ends(candidates).union(large.select("c")).distinct())  # the one time that texts move to their rows
    # Each document's likeliest partner first; then only what joins two components.
    seen = candidates.select(F.col("a").alias("c"), F.col("b").alias("o"), "agree").union(candidates.select("b", "a", "agree"))
    likely = seen.groupBy("c").agg(F.max_by("o", F.struct("agree", -F.col("o"))).alias("o"))
    likely = likely.groupBy(F.least("c", "o").alias("a"), F.greatest("c", "o").alias("b")).agg(F.max("o").alias("lead"))
    likely = shared_checkpoint(likely.select("a", "b", "lead", F.when(F.col("lead") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("other")))
    parts = connected_components(_confirmed(likely, read, width, percent))
    facts = shared_checkpoint(nodes.select("c", "n").join(parts.select(F.col("node").alias("c"), "component"), "c", "left").select("c", "n", F.coalesce("component", "c").alias("comp")))

    def across(some: DataFrame, facts: DataFrame) -> DataFrame:
        """Pairs (a, b) of different components, which come along as ca and cb."""
        of = lambda end: facts.select(F.col("c").alias(end), F.col("comp").alias(f"c{end}"))
        return some.join(of("a"), "a").join(of("b"), "b").filter("ca <> cb")

    def joined(facts: DataFrame, links: DataFrame) -> DataFrame:
        """``facts`` with the components that links join made one: a graph of components, mostly a small one."""
        links = shared_checkpoint(across(links, facts).select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct())
        if links.isEmpty():
            return facts
        top = connected_components(links).select(F.col("node").alias("comp"), F.col("component").alias("top"))
        return shared_checkpoint(facts.join(top, "comp", "left").select("c", "n", F.coalesce("top", "comp").alias("comp")))

    rest = across(candidates.select("a", "b").join(likely, ["a", "b"], "left_anti"), facts)
    facts = joined(facts, _confirmed(rest.select(F.col("a").alias("lead"), F.col("b").alias("other")), read, width, percent))
    # Larger buckets whose members are still in several components.
    placed = large.select("key", "c").join(facts.select("c", "comp"), "c")
    mixed = shared_checkpoint(placed.groupBy("key").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).filter("least <> most").select("key"))
    if not mixed.isEmpty():
        open_rows = large.select("key", "c").join(mixed, "key", "left_semi").select(F.col("c").alias("row")).distinct()
        open_texts = shared_checkpoint(read.join(open_rows, "row", "left_semi"))
        late = shared_checkpoint(_similar_prefixes(open_texts, facts, width, percent))
        facts = joined(facts, _confirmed(late.select(F.col("a").alias("lead"), F.col("b").alias("other")), open_texts, width, percent))
    labelled = classed.join(facts.select("c", F.col("comp").alias("part")), "c").select("row", "part")
    final = sketches.select("row", "id", "no_id", "th", "n").join(labelled, "row", "left").select("row", "id", "no_id", "th", "n", F.coalesce("part", "row").alias("part"))
    first = shared_checkpoint(final.groupBy("part").agg(F.min(F.struct("id", "row", "no_id")).alias("first")))
    return final.join(first, "part").select(
        F.when(~F.col("no_id"), F.col("id")).alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(~F.col("first.no_id"), F.col("first.id")).alias("component_id"),
        (F.col("row") == F.col("first.row")).alias("kept"),
        "th",
    )
