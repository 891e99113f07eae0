"""Queries that are answered from a gram index built over the documents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import diff as df
from ..session import checkpoint_dir, shared_checkpoint
from ..sources.gram_index import GramIndex
from .projection import table, vectors
from .queries_search import _COVER, _NGRAM, HYBRID_SQL, NORM_SQL, QUERY_VEC, QUESTION, _documents, _rounded
from .registry import query

_HYBRID = f"SELECT id, type, score, round(lexical, 6) AS lexical, round(semantic, 6) AS semantic, round(coverage, 6) AS coverage, round(ngram, 6) AS ngram, alias_exact, state_note FROM ({HYBRID_SQL})"


def _index(spark) -> GramIndex:
    return GramIndex(spark, f"{checkpoint_dir(spark)}/grams-{uuid.uuid4().hex}")


def _answer(index: GramIndex, answer):
    """The answer, kept, and the index removed."""
    out = shared_checkpoint(answer)
    index.drop()
    return out


def _vector(spark, sf_dir):
    return vectors(spark, sf_dir).filter(F.col("vec_id") == QUERY_VEC).select("vector").first()["vector"]


@query(_HYBRID)
def index_hybrid(spark, sf_dir):
    """The best documents by words and vector, from postings."""
    index = _index(spark)
    index.build(_documents(spark, sf_dir), hay=tx.normalize_text(F.col("text")))
    return _answer(index, _rounded(index.search(QUESTION, [_vector(spark, sf_dir)], 25)))


@query(f"""
    SELECT 'd:' || doc_id AS id, round({_COVER}, 6) AS coverage, round({_NGRAM}, 6) AS ngram
    FROM (SELECT doc_id, {NORM_SQL.format("text")} AS hay FROM documents) WHERE greatest({_COVER}, {_NGRAM}) > 0.5
""")
def index_lexical(spark, sf_dir):
    """Every document that holds more than half of the question, from postings."""
    index = _index(spark)
    index.build(_documents(spark, sf_dir).drop("vector"), hay=tx.normalize_text(F.col("text")))
    found = index.search(QUESTION, limit=None).filter("lexical > 0.5")
    return _answer(index, found.select("id", F.round("coverage", 6).alias("coverage"), F.round("ngram", 6).alias("ngram")))


@query(_HYBRID)
def index_delta(spark, sf_dir):
    """As index_hybrid, of an index of older documents that took in what changed since."""
    now = _documents(spark, sf_dir)
    number = F.substring("id", 3, 20).cast("long")
    older = now.filter(number % 5 != 0).withColumn("text", F.when(number % 3 == 0, F.reverse("text")).otherwise(F.col("text")))
    gone = now.filter(number % 7 == 0).withColumn("id", F.concat(F.lit("x:"), "id"))
    before = older.unionByName(gone)
    index = _index(spark)
    index.build(before, hay=tx.normalize_text(F.col("text")))
    index.update(df.diff(before, now), hay=tx.normalize_text(F.col("text")))
    return _answer(index, _rounded(index.search(QUESTION, [_vector(spark, sf_dir)], 25)))


@query("""
    SELECT 'p:' || p_partkey AS id, CAST(100 AS DOUBLE) AS score FROM part
    WHERE trim(regexp_replace(lower(p_name), '[^\\p{L}\\p{N}]+', ' ', 'g')) = (SELECT trim(regexp_replace(lower(p_name), '[^\\p{L}\\p{N}]+', ' ', 'g')) FROM part WHERE p_partkey = 7)
""")
def index_alias(spark, sf_dir):
    """Parts of the name of part 7, from the alias's posting list."""
    part = table(spark, sf_dir, "part")
    asked = part.filter("p_partkey = 7").select("p_name").first()["p_name"]
    index = _index(spark)
    index.build(part.select(F.concat(F.lit("p:"), "p_partkey").alias("id"), F.lit("Part").alias("type"), F.col("p_name").alias("title"), F.array("p_name").alias("aliases")))
    return _answer(index, index.search(asked, limit=None).filter("alias_exact").select("id", "score"))
