"""Benchmark decontamination by a prefix-filtered set join. DataFrame functions only.

A benchmark item's windows (``width`` words in a row; a shorter item is one
window) are sets of word shingles. Shingles are ordered by how rare they are
over all documents. Containment of a whole window leaves a prefix of one
shingle: only a window's rarest is joined. Candidates must start and end inside
the document, and are verified word by word at their own place alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import shared_checkpoint, shared_table

#: Words after lower-casing A-Z: ASCII letters and digits, and all beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Shingles and windows of a benchmark up to this many rows are broadcast to the joins; beyond, the same joins shuffle.
BROADCAST_ROWS = 1_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(WORD), F.lit(0))


def _steps(count: Column) -> Column:
    """0 to count - 1; empty if count is 0 or less."""
    return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))


def _grams(words: str, span: int) -> Column:
    """The shingles of ``span`` words that start at each place.

    The column is named twice, so that the optimiser keeps it as one: set into
    the function, its expression would be computed once for each place.
    """
    return F.transform(_steps(F.size(words) - span + 1), lambda i: F.concat_ws(" ", *(F.get(F.col(words), i + k) for k in range(span))))


def item_windows(items: DataFrame, item_col: str, text_col: str, width: int, span: int) -> DataFrame:
    """Distinct windows: own (the words), size, span of its shingles, grams in order, items (distinct ids)."""
    parsed = items.select(F.col(item_col).alias("item"), words_of(F.col(text_col)).alias("words")).filter(F.size("words") > 0)
    sized = parsed.select("item", "words", F.least(F.size("words"), F.lit(width)).alias("size"))
    cut = sized.select("item", F.explode(F.transform(_steps(F.size("words") - F.col("size") + 1), lambda i: F.slice("words", i + 1, F.col("size")))).alias("own"))
    grouped = cut.groupBy("own").agg(F.collect_set("item").alias("items"))
    shaped = grouped.select("own", "items", F.size("own").alias("size"), F.least(F.size("own"), F.lit(span)).alias("span"))
    return shaped.select("own", "items", "size", "span", F.transform(_steps(F.col("size") - F.col("span") + 1), lambda i: F.array_join(F.slice("own", i + 1, F.col("span")), " ")).alias("grams"))


def find_contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 13, span: int = 3, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Where benchmark windows occur in each document.

    Returns a row per input row: ``id_col``, n_words, n_hit (words inside any
    occurrence of a window), item_ids (ids of the items with occurring windows,
    as strings, sorted), spans (occurrences as [lo, hi) word offsets), and
    th (Spark's xxhash64 of the text).

    The work grows in proportion to the words, however long or repetitive a
    document is. Null texts have no words on either side; an item without words
    has no window; items with a null id count for hits but are not listed;
    items that repeat are one; rows that repeat, and ids with several texts,
    come back as they are; an empty benchmark finds nothing, and an empty table
    gives an empty result. Names of other columns don't matter.
    """
    windows = shared_table(item_windows(items, item_col, item_text_col, width, span).withColumn("w", F.monotonically_increasing_id()))
    shingles = shared_table(windows.select("span", F.explode("grams").alias("g")).distinct().withColumn("s", F.monotonically_increasing_id()))
    sizes = {r["span"]: r["count"] for r in shingles.groupBy("span").count().collect()}
    bounded = F.broadcast if sum(sizes.values()) + windows.count() <= broadcast_rows else (lambda df: df)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    parsed = source.select("id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), words_of(F.col("text")).alias("words"))
    base = shared_table(parsed.select("id", "th", F.size("words").alias("n"), F.array_join("words", " ").alias("joined")).withColumn("row", F.monotonically_increasing_id()))
    words = F.split("joined", " ")
    met = base.select("row", F.lit(0).alias("pos"), F.col("row").alias("s")).limit(0)
    for k in sorted(sizes):
        some = base.filter(F.col("n") >= k).select("row", words.alias("words")).select("row", F.posexplode(_grams("words", k)).alias("pos", "g"))
        met = met.unionByName(some.join(bounded(shingles.filter(F.col("span") == k).select("g", "s")), "g").select("row", "pos", "s"))
    hits = shared_checkpoint(met)
    # Rarity over all documents orders a window's shingles; the rarest is its prefix.
    counts = hits.groupBy("s").agg(F.count("*").alias("often"))
    prefix = (
        windows.select("w", "span", F.posexplode("grams").alias("offset", "g"))
        .join(shingles, ["span", "g"])
        .join(counts, "s", "left")
        .groupBy("w")
        .agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "s", "offset")).alias("p"))
        .filter("p.often > 0")
        .select("w", "p.s", "p.offset")
    )
    begun = hits.join(bounded(prefix), "s").select("row", "w", (F.col("pos") - F.col("offset")).alias("at")).filter("at >= 0")
    # The words of a document with candidates are split once, and each candidate looks at its own places only.
    wanted = base.join(begun.select("row").distinct(), "row", "left_semi").select("row", "n", words.alias("words"))
    asked = begun.join(bounded(windows.select("w", "own", "size")), "w")
    verified = asked.join(wanted, "row").filter(F.col("at") + F.col("size") <= F.col("n")).filter(F.slice("words", F.col("at") + 1, F.col("size")) == F.col("own")).select("row", "w", "at", "size")
    merged = verified.join(bounded(windows.select("w", "items")), "w").groupBy("row").agg(
        F.sort_array(F.collect_set(F.struct(F.col("at").alias("lo"), (F.col("at") + F.col("size")).alias("hi")))).alias("spans"),
        F.array_sort(F.array_distinct(F.transform(F.flatten(F.collect_set("items")), lambda x: x.cast("string")))).alias("item_ids"),
    )
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("total"))
    step = lambda acc, x: F.struct(F.greatest(acc.end, x.hi).alias("end"), (acc.total + F.greatest(F.lit(0), x.hi - F.greatest(acc.end, x.lo))).alias("total"))
    hit = F.aggregate("spans", start, step, lambda acc: acc.total)
    return base.select("row", "id", "th", "n").join(merged, "row", "left").select(
        F.col("id").alias(id_col),
        F.col("n").cast("long").alias("n_words"),
        F.coalesce(hit, F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        F.coalesce("spans", F.array().cast("array<struct<lo:int,hi:int>>")).alias("spans"),
        "th",
    )
