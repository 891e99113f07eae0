"""Search queries over documents and their embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import search as se
from ..operators import world
from .projection import VECTORS_SQL, edges, nodes, table, vectors
from .registry import query

QUESTION = "heated the thinhe of oration"
QUERY_VEC = 3
NORM_SQL = r"trim(regexp_replace(lower(coalesce({}, '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


def _documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    own = vectors(spark, sf_dir).select(F.col("vec_id").alias("doc_id"), "vector")
    return docs.join(own, "doc_id", "left").select(F.concat(F.lit("d:"), F.col("doc_id").cast("string")).alias("id"), F.lit("Document").alias("type"), "text", "vector")


def _asked(spark, sf_dir):
    return vectors(spark, sf_dir).filter(F.col("vec_id") == QUERY_VEC).select("vector").first()["vector"]


def hybrid(spark, sf_dir, limit=25):
    return se.search(_documents(spark, sf_dir), QUESTION, [_asked(spark, sf_dir)], limit, hay=tx.normalize_text(F.col("text")))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def lexical_sql(question: str) -> tuple[str, str]:
    """SQL of coverage and n-gram ratio over ``hay``, from the query's features."""
    q = se.Query(question)
    cover = [f"({' + '.join(f'CASE WHEN contains(hay, {_quoted(t)}) THEN {w} ELSE 0 END' for t, w in part)}) / {float(sum(w for _, w in part))}" for part in q.parts]
    grams = []
    for g in q.gram_sets:
        hits = [f"CASE WHEN contains(' ' || hay || ' ', {_quoted(f' {x} ')}) THEN 1 ELSE 0 END" if len(x) < 3 else f"CASE WHEN contains(hay, {_quoted(x)}) THEN 1 ELSE 0 END" for x in g]
        grams.append(f"({' + '.join(hits)}) / {float(len(g))}")
    return f"greatest({', '.join(cover)}, 0.0)", f"greatest({', '.join(grams)}, 0.0)"


_COVER, _NGRAM = lexical_sql(QUESTION)
HYBRID_SQL = f"""
    WITH q AS (SELECT v FROM ({VECTORS_SQL}) WHERE vec_id = {QUERY_VEC}),
    d AS (SELECT doc_id, {NORM_SQL.format("text")} AS hay, v FROM documents LEFT JOIN ({VECTORS_SQL}) ON vec_id = doc_id),
    f AS (SELECT doc_id, CAST({_COVER} AS DOUBLE) AS coverage, CAST({_NGRAM} AS DOUBLE) AS ngram, coalesce(list_inner_product(d.v, q.v), 0.0) AS c FROM d, q),
    s AS (SELECT 'd:' || doc_id AS id, 'Document' AS type, coverage, ngram, greatest(coverage, ngram) AS lexical, CASE WHEN c > 0.05 THEN least(c, 1.0) ELSE 0.0 END AS semantic, false AS alias_exact, NULL::VARCHAR AS state_note FROM f)
    SELECT id, type, round(100 * lexical + 100 * semantic, 3) AS score, lexical, semantic, coverage, ngram, alias_exact, state_note FROM s
    WHERE round(100 * lexical + 100 * semantic, 3) > 0 ORDER BY score DESC, id LIMIT 25
"""


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in ("lexical", "semantic", "coverage", "ngram")})


@query(f"SELECT id, type, score, round(lexical, 6) AS lexical, round(semantic, 6) AS semantic, round(coverage, 6) AS coverage, round(ngram, 6) AS ngram, alias_exact, state_note FROM ({HYBRID_SQL})")
def search_hybrid(spark, sf_dir):
    return _rounded(hybrid(spark, sf_dir))


@query(f"SELECT doc_id, round({_COVER}, 6) AS coverage FROM (SELECT doc_id, {NORM_SQL.format('text')} AS hay FROM documents) WHERE {_COVER} > 0.5")
def search_coverage(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select("doc_id", tx.normalize_text(F.col("text")).alias("hay"))
    return own.select("doc_id", se.coverage(F.col("hay"), se.Query(QUESTION)).alias("c")).filter("c > 0.5").select("doc_id", F.round("c", 6).alias("coverage"))


@query(f"SELECT doc_id, round({_NGRAM}, 6) AS ngram FROM (SELECT doc_id, {NORM_SQL.format('text')} AS hay FROM documents) WHERE {_NGRAM} > 0.5")
def search_ngram(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select("doc_id", tx.normalize_text(F.col("text")).alias("hay"))
    return own.select("doc_id", se.ngram_ratio(F.col("hay"), se.Query(QUESTION)).alias("c")).filter("c > 0.5").select("doc_id", F.round("c", 6).alias("ngram"))


@query("""
    SELECT 'p:' || p_partkey AS id, 'Part' AS type, CAST(100 AS DOUBLE) AS score FROM part
    WHERE trim(regexp_replace(lower(p_name), '[^\\p{L}\\p{N}]+', ' ', 'g')) = (SELECT trim(regexp_replace(lower(p_name), '[^\\p{L}\\p{N}]+', ' ', 'g')) FROM part WHERE p_partkey = 7)
""")
def search_alias_exact(spark, sf_dir):
    asked = table(spark, sf_dir, "part").filter("p_partkey = 7").select("p_name").first()["p_name"]
    own = nodes(spark, sf_dir).filter("type = 'Part'").withColumn("aliases", F.array("title")).select("id", "type", "title", "aliases")
    return se.search(own, asked, limit=None).filter("alias_exact").select("id", "type", "score")


def _band_sql(x: str, high: float, low: float) -> str:
    return f"CASE WHEN round({x}, 2) >= {high} THEN 2 WHEN round({x}, 2) >= {low} THEN 1 ELSE 0 END"


@query(f"""
    WITH m AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS r, lead(score) OVER (ORDER BY score DESC, id) AS nxt FROM ({HYBRID_SQL})),
    g AS (SELECT id, score, nxt, (score - nxt) / greatest(score, 1) AS gap, greatest(CASE WHEN semantic > 0 THEN {_band_sql("semantic", 0.65, 0.5)} ELSE 0 END, {_band_sql("ngram", 0.65, 0.45)}, {_band_sql("coverage", 0.65, 0.45)}) AS grade FROM m WHERE r = 1),
    c AS (SELECT *, least(grade + CASE WHEN coalesce(gap >= 0.3, false) THEN 1 ELSE 0 END, 2) AS raised FROM g)
    SELECT id, score, CASE raised WHEN 2 THEN 'high' WHEN 1 THEN 'low' ELSE 'none' END AS confidence,
           CASE WHEN nxt IS NULL THEN 'single' WHEN gap >= 0.3 THEN 'clear' ELSE 'none' END AS standout, round(gap, 3) AS gap_above_next FROM c
""")
def search_confidence(spark, sf_dir):
    return se.confidence(hybrid(spark, sf_dir))


@query(f"""
    SELECT id, score, round(score - lead(score) OVER (ORDER BY score DESC, id), 3) AS gap, CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS rank FROM ({HYBRID_SQL})
""")
def search_standout_gap(spark, sf_dir):
    from pyspark.sql import Window

    order = Window.orderBy(F.desc("score"), "id")  # over the 25 best only
    return hybrid(spark, sf_dir).select("id", "score", F.round(F.col("score") - F.lead("score").over(order), 3).alias("gap"), F.row_number().over(order).alias("rank"))


_LINKS_SQL = "SELECT 'd:' || doc_id AS src, 'd:' || (doc_id + 20) AS dst FROM documents"


@query(f"""
    WITH t AS (SELECT id, score FROM ({HYBRID_SQL}) ORDER BY score DESC, id LIMIT 24),
    e AS (SELECT src, dst FROM ({_LINKS_SQL}) WHERE src IN (SELECT id FROM t) AND dst IN (SELECT id FROM t)),
    v AS (SELECT id, count(*) AS votes FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY id)
    SELECT id, round(score * (1 + 0.06 * least(coalesce(votes, 0), 5)), 3) AS score, coalesce(votes, 0) AS votes FROM t LEFT JOIN v USING (id) ORDER BY 2 DESC, id LIMIT 10
""")
def graph_rerank(spark, sf_dir):
    links = table(spark, sf_dir, "documents").select(F.concat(F.lit("d:"), F.col("doc_id")).alias("src"), F.concat(F.lit("d:"), F.col("doc_id") + 20).alias("dst"))
    return se.graph_rerank(hybrid(spark, sf_dir), links).select("id", "score", "votes")


@query(f"""
    SELECT m.id, m.score, e.type, e.src, e.dst FROM (SELECT id, score FROM ({HYBRID_SQL}) ORDER BY score DESC, id LIMIT 5) m
    JOIN (SELECT 'd:' || doc_id AS src, 'in_source' AS type, 'v:' || source AS dst FROM documents) e ON e.src = m.id
""")
def evidence_context(spark, sf_dir):
    top = hybrid(spark, sf_dir, 5).select("id", "score")
    around = table(spark, sf_dir, "documents").select(F.concat(F.lit("d:"), F.col("doc_id")).alias("src"), F.lit("in_source").alias("type"), F.concat(F.lit("v:"), F.col("source")).alias("dst"))
    return around.join(F.broadcast(top), F.col("src") == F.col("id")).select("id", "score", "type", "src", "dst")


_HINTS = f"""
    WITH p AS (SELECT source, first(text ORDER BY doc_id) AS text FROM documents WHERE source IS NOT NULL GROUP BY source),
    h AS (SELECT source AS slug, trim({NORM_SQL.format("source")} || ' ' || {NORM_SQL.format("text")}) AS hay FROM p),
    s AS (SELECT slug, round(100 * greatest({_COVER}, {_NGRAM}), 3) AS score FROM h),
    r AS (SELECT slug, score, row_number() OVER (ORDER BY score DESC, slug) AS rank, round(score - lead(score) OVER (ORDER BY score DESC, slug), 3) AS gap FROM s WHERE score > 0)
    SELECT slug, score, rank::INTEGER AS rank, gap AS gap_above_next, CASE WHEN rank = 1 AND score >= 40 AND coalesce(gap, score) >= 15 THEN 'high' ELSE 'low' END AS confidence FROM r WHERE rank <= 3
"""


@query(_HINTS)
def world_hints(spark, sf_dir):
    """Each source as a graph of its own, told by its first document."""
    first = table(spark, sf_dir, "documents").filter("source is not null").groupBy("source").agg(F.min_by("text", "doc_id").alias("text"))
    profiles = first.select(F.col("source").alias("slug"), F.col("source").alias("name"), F.col("text").alias("description"))
    return world.world_hints(profiles, QUESTION)


@query("""
    WITH t AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r, count(*) OVER (PARTITION BY conv_id) AS turns FROM conversations)
    SELECT conv_id, turn, role, turns, CASE WHEN length(text) <= 120 THEN text ELSE substr(text, 1, 119) || '…' END AS headline FROM t WHERE r = 1 ORDER BY turns DESC, conv_id LIMIT 20
""")
def resume_brief(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max_by(F.struct("turn", "role", "text"), "turn").alias("last"), F.count("*").alias("turns"))
    return rows.select("conv_id", "last.turn", "last.role", "turns", tx.truncate(F.col("last.text"), 120).alias("headline")).orderBy(F.desc("turns"), "conv_id").limit(20)
