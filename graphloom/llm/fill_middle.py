"""Fill-in-the-middle arrangement of texts, in Spark SQL throughout.

``regexp_extract_all`` cuts a text into units (a word with the white space
before it, or white space that ends the text). Digits of a SHA-256 over a seed
and the row's id give two cuts and the form; ``slice`` and ``array_join`` build
prefix, middle and suffix; sentinels join them in the order of the form. A text
that holds a sentinel itself stays plain, so that the sentinels of an
arrangement stand where they were put, and :func:`restore_text` rebuilds the
text from the arrangement alone.

Null text counts as empty: no units, plain. An empty table gives an empty
result. Rows are arranged one by one: repeated rows alike, a null id as if its
digits were missing, ties of the two cuts with an empty middle. Extra columns,
whatever their names, are left out. Texts of any length are arranged whole; a
task holds the units of one text at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentinels before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"


def _draw(digest: Column, k: int) -> Column:
    """The k-th group of eight hexadecimal digits as a number."""
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def _joined(units: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(units, start, length), "")


def arrange(docs: DataFrame, seed: int = 42, rate: int = 50, spm_rate: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``rate`` percent of the texts arranged for infilling, ``spm_rate`` percent of these with the suffix first.

    Returns ``id_col``, n (units), form (plain, psm or spm), prefix, middle and
    suffix (null if plain), and output.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    drawn = docs.select(F.col(id_col), text.alias("text"), F.sha2(key.cast("binary"), 256).alias("digest"))
    clash = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    form = (
        F.when((F.col("text") == "") | clash | (_draw(F.col("digest"), 2) % 100 >= rate), "plain")
        .when(_draw(F.col("digest"), 3) % 100 < spm_rate, "spm")
        .otherwise("psm")
    )
    units = drawn.select(id_col, "text", "digest", form.alias("form"), F.regexp_extract_all("text", F.lit(UNIT), 0).alias("units"))
    ends = [_draw(F.col("digest"), k) % (F.size("units") + 1) for k in (0, 1)]
    cut = units.select(id_col, "text", "form", "units", F.size("units").alias("n"), F.least(*ends).cast("int").alias("a"), F.greatest(*ends).cast("int").alias("b"))
    moved = F.col("form") != "plain"
    parts = cut.select(
        id_col,
        F.col("n").cast("long").alias("n"),
        "form",
        "text",
        F.when(moved, _joined(F.col("units"), F.lit(1), F.col("a"))).alias("prefix"),
        F.when(moved, _joined(F.col("units"), F.col("a") + 1, F.col("b") - F.col("a"))).alias("middle"),
        F.when(moved, _joined(F.col("units"), F.col("b") + 1, F.col("n") - F.col("b"))).alias("suffix"),
    )
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text"))
    return parts.select(id_col, "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restore_text(output: Column, form: Column) -> Column:
    """The text that was arranged, from ``output`` and ``form`` alone: what stands between the sentinels, put in reading order."""
    middle = F.substring_index(output, MIDDLE, -1)
    front = F.substring_index(output, MIDDLE, 1)

    def after(sentinel: str, end: str | None) -> Column:
        tail = F.substring_index(front, sentinel, -1)
        return tail if end is None else F.substring_index(tail, end, 1)

    psm = F.concat(after(PREFIX, SUFFIX), middle, after(SUFFIX, None))
    spm = F.concat(after(PREFIX, None), middle, after(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
