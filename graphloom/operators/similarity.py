"""Similarity joins over labelled vectors and names.

Pairs are only formed inside a type (an equi-join key), never by a cross join.
A type's rows are dealt into blocks of about ``BLOCK`` rows, of wide vectors
fewer, and a pair of blocks meets in a task of its own, so that work spreads
however few types there are and however unevenly they are filled. Vectors that
lie in groups meet by the cells of :mod:`vector_join` instead, which leaves out
pairs of cells that cannot match. The result is exact either way.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors as vx
from ..session import shared_checkpoint
from . import vector_join


#: Rows of a block, and numbers of its vectors (about); with fewer a key is one block and nothing is sent twice.
BLOCK, NUMBERS = 4096, 1 << 21


def _count(rows: DataFrame) -> Column:
    """How many blocks a key's rows need."""
    blocks = F.ceil(F.count("*") / BLOCK)
    return (F.greatest(blocks, F.ceil(F.sum(F.size("v")) / NUMBERS)) if "v" in rows.columns else blocks).cast("int")


def _blocks(rows: DataFrame, key: str, id_col: str, name: str) -> DataFrame:
    """``rows`` with a block number and how many blocks their key has."""
    sizes = rows.groupBy(key).agg(_count(rows).alias(f"{name}_all"))
    return rows.join(sizes, key).withColumn(name, F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.col(f"{name}_all")).cast("int"))


def within(rows: DataFrame, key: str, least: float, id_col: str = "a") -> DataFrame:
    """Unordered pairs of rows (v, others) of one key with a cosine of ``least`` or more, each once: ``key``, the others of either row under 1 and 2, cosine."""
    own = _blocks(rows, key, id_col, "_b")
    names = [c for c in rows.columns if c not in (key, "v")]
    one = own.select(key, "v", *(F.col(c).alias(f"{c}1") for c in names), F.col("_b").alias("_lo"), F.explode(F.sequence("_b", F.col("_b_all") - 1)).alias("_hi"))
    two = own.select(key, "v", *(F.col(c).alias(f"{c}2") for c in names), F.explode(F.sequence(F.lit(0), "_b")).alias("_lo"), F.col("_b").alias("_hi"))
    met = vector_join.meet(one, two, [key, "_lo", "_hi"], least)
    return met.filter((F.col("_lo") < F.col("_hi")) | (F.col(f"{id_col}1") < F.col(f"{id_col}2"))).drop("_lo", "_hi")


def _dealt(left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str) -> tuple[DataFrame, DataFrame]:
    """Both tables by blocks (_l, _r), each row as often as it meets a block of the other one."""
    sizes = left.groupBy(key).agg(_count(left).alias("_l_all")).join(right.groupBy(key).agg(_count(right).alias("_r_all")), key)
    deal = lambda df, own, n, to, m: df.join(sizes, key).withColumn(own, F.pmod(F.xxhash64(F.col(n).cast("string")), F.col(f"{own}_all")).cast("int")).withColumn(to, F.explode(F.sequence(F.lit(0), F.col(m) - 1))).drop("_l_all", "_r_all")
    return deal(left, "_l", left_id, "_r", "_r_all"), deal(right, "_r", right_id, "_l", "_l_all")


def between(left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str) -> DataFrame:
    """Pairs of a left and a right row of one key; other columns must have different names."""
    one, two = _dealt(left, right, key, left_id, right_id)
    return one.join(two, [key, "_l", "_r"]).drop("_l", "_r")


def between_alike(left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str, least: float, top: int | None = None) -> DataFrame:
    """Pairs of a left and a right row (v, others) of one key with a cosine of ``least`` or more: ``key``, the others, cosine.

    With ``top``, a left row's best so many of other ids in each pair of blocks.
    """
    one, two = _dealt(left, right, key, left_id, right_id)
    return vector_join.meet(one, two, [key, "_l", "_r"], least, None if top is None else (left_id, right_id, top)).drop("_l", "_r")


def _alike(rows: DataFrame, key: str, least: float) -> DataFrame:
    """Pairs of rows (a, v) of one key with cosine of ``least`` or more."""
    pivots = vector_join.useful_pivots(rows, "a", least)
    if pivots is not None:
        return vector_join.pairs_within(rows, key, least, pivots)
    return within(rows, key, least)


def vector_pairs(rows: DataFrame, least: float, below: float | None = None, key: str = "type", id_col: str = "id") -> DataFrame:
    """Pairs a < b of one key with cosine in [least, below): a, b, key, similarity (4 places).

    Thresholds test the unrounded cosine.
    """
    own = rows.select(F.col(id_col).alias("a"), F.col(key).alias("key"), F.col("vector").alias("v"))
    pairs = _alike(own, "key", least).filter("a1 <> a2")
    if below is not None:
        pairs = pairs.filter(F.col("cosine") < below)
    return pairs.select(F.least("a1", "a2").alias("a"), F.greatest("a1", "a2").alias("b"), F.col("key").alias(key), F.round("cosine", 4).alias("similarity"))


def cross_type_pairs(rows: DataFrame, groups: DataFrame, least: float, id_col: str = "id") -> DataFrame:
    """Pairs a < b of different types of one group: ``groups`` has (type, family)."""
    own = rows.join(groups, "type").select(F.col(id_col).alias("a"), F.col("type").alias("type"), "family", F.col("vector").alias("v"))
    pairs = _alike(own, "family", least).filter("a1 <> a2 and type1 <> type2")
    first = F.col("a1") < F.col("a2")
    types = [F.when(first, F.col("type1")).otherwise(F.col("type2")).alias("type_a"), F.when(first, F.col("type2")).otherwise(F.col("type1")).alias("type_b")]
    return pairs.select(F.least("a1", "a2").alias("a"), F.greatest("a1", "a2").alias("b"), *types, F.round("cosine", 4).alias("similarity"))


def top_matches(left: DataFrame, right: DataFrame, key: str, least: float, top: int) -> DataFrame:
    """For each left (id, vector) its ``top`` most similar right rows of the same key: id, match, similarity, rank.

    A task gives a left row's ``top`` best of its block at most, so that what is
    ranked in the end grows with the rows and not with the matches.
    """
    a = left.select(F.col("id"), F.col(key), F.col("vector").alias("v"))
    b = right.select(F.col("id").alias("match"), F.col(key), F.col("vector").alias("v"))
    pivots = vector_join.useful_pivots(a, "id", least)
    if pivots is not None:
        pairs = vector_join.pairs_between(a, b, key, "id", "match", least, pivots, top)
    else:
        pairs = between_alike(a, b, key, "id", "match", least, top)
    order = Window.partitionBy("id").orderBy(F.desc("cosine"), "match")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("id", "match", F.round("cosine", 4).alias("similarity"), "rank")


def lexical_duplicates(rows: DataFrame, names: str = "names") -> DataFrame:
    """Pairs a < b of one type and system that share a normalised name: a, b, type, name (the smallest).

    A name that many nodes share is linked from its smallest node to each
    other one, so that n holders give n - 1 pairs.
    """
    own = rows.select("id", "type", "system", F.explode(F.array_distinct(F.transform(names, lambda x: tx.normalize_text(x)))).alias("name")).filter("name <> ''")
    least = own.groupBy("type", "system", "name").agg(F.min("id").alias("a"), F.count("*").alias("n")).filter("n > 1")
    pairs = own.join(least, ["type", "system", "name"]).filter("id <> a")
    return pairs.groupBy("a", F.col("id").alias("b"), "type").agg(F.min("name").alias("name"))


def nearest_rank(values: DataFrame, column: str, shares: dict[str, float]) -> DataFrame:
    """Quantiles by floor(n * q) of the sorted values, as one row."""
    numbered = values.filter(F.col(column).isNotNull()).agg(F.sort_array(F.collect_list(column)).alias("v"))
    at = {name: F.get("v", F.least(F.size("v") - 1, F.floor(F.size("v") * F.lit(q)).cast("int"))) for name, q in shares.items()}
    return numbered.select(*(c.alias(name) for name, c in at.items()), F.size("v").cast("long").alias("n"))


def sampled_pairs(n: int, pairs: int = 400, seed: int = 0xC0FFEE) -> list[tuple[int, int]]:
    """A fixed sample of index pairs i <> j, by a linear congruential sequence."""
    out: list[tuple[int, int]] = []
    x = seed & 0xFFFFFFFF
    while n > 1 and len(out) < min(pairs, n * (n - 1) // 2):
        ends = []
        for _ in range(2):
            x = (1664525 * x + 1013904223) & 0xFFFFFFFF
            drawn = x >> 8
            if n > 1 << 20:  # 24 bits would not reach all rows evenly
                x = (1664525 * x + 1013904223) & 0xFFFFFFFF
                drawn = drawn << 24 | x >> 8
            ends.append(drawn % n)
        if ends[0] != ends[1]:
            out.append((ends[0], ends[1]))
    return out


def noise_baseline(vectors: DataFrame, pairs: int = 400, id_col: str = "vec_id") -> DataFrame:
    """median_cosine, p90_cosine and n over a sample of ``pairs`` pairs of all rows with a vector.

    Rows are numbered in the order of their ids, which are taken to be unique.
    Only the parts' row counts are collected; the ids are sorted in parts.
    """
    spark = vectors.sparkSession
    usable = vectors.filter(F.col(id_col).isNotNull() & (F.size("vector") > 0)).select(F.col(id_col).alias("i"), "vector")
    # A place is the part's number, shifted by 33 bits, and the row's number in it.
    placed = shared_checkpoint(usable.select("i").repartitionByRange("i").sortWithinPartitions("i").withColumn("place", F.monotonically_increasing_id()))
    parts = sorted(placed.groupBy(F.shiftright("place", 33).alias("part")).count().collect())
    ends = list(accumulate(k for _, k in parts))

    def place(index: int) -> int:
        at = bisect_right(ends, index)
        return (parts[at][0] << 33) + index - (ends[at - 1] if at else 0)

    drawn = sampled_pairs(ends[-1] if ends else 0, pairs)
    asked = spark.createDataFrame([(place(a), place(b)) for a, b in drawn], "a long, b long")
    wanted = F.broadcast(asked.select(F.col("a").alias("place")).union(asked.select("b")).distinct())
    some = usable.join(F.broadcast(placed.join(wanted, "place")), "i").select("place", "vector")
    left, right = some.select(F.col("place").alias("a"), F.col("vector").alias("va")), some.select(F.col("place").alias("b"), F.col("vector").alias("vb"))
    cosines = F.broadcast(asked).join(left, "a").join(right, "b").select(F.round(vx.cosine(F.col("va"), F.col("vb")), 6).alias("c"))
    return nearest_rank(cosines, "c", {"median_cosine": 0.5, "p90_cosine": 0.9})
