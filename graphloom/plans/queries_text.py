"""Text and source queries: normalising, terms, markers, history, roles, URL and HTML facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import code
from ..functions import text as tx
from ..operators import similarity as sim
from ..sources import history
from .projection import NODES_SQL, nodes, table
from .registry import query

NORM_SQL = r"trim(regexp_replace(lower(coalesce({}, '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


@query(f"SELECT doc_id, md5({NORM_SQL.format('text')}) AS digest, CAST(length({NORM_SQL.format('text')}) AS INTEGER) AS n FROM documents")
def text_normalize(spark, sf_dir):
    norm = tx.normalize_text(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", norm.alias("t")).select("doc_id", F.md5(F.col("t").cast("binary")).alias("digest"), F.length("t").alias("n"))


@query(f"""
    SELECT doc_id, CAST(len(t) AS INTEGER) AS terms, CAST(len(list_distinct(t)) AS INTEGER) AS distinct_terms FROM (
        SELECT doc_id, list_filter(string_split({NORM_SQL.format('text')}, ' '), lambda x: x <> '') AS t FROM documents)
""")
def text_terms(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select("doc_id", tx.terms(tx.normalize_text(F.col("text"))).alias("t"))
    return own.select("doc_id", F.size("t").alias("terms"), F.size(F.array_distinct("t")).alias("distinct_terms"))


@query(f"""
    WITH t AS (SELECT doc_id, unnest(list_distinct(string_split({NORM_SQL.format('text')}, ' '))) AS w FROM documents),
    g AS (SELECT DISTINCT doc_id, CASE WHEN length(w) < 3 THEN w ELSE substr(w, i, 3) END AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(length(w) - 1, 2))) AS i FROM t WHERE w <> ''))
    SELECT doc_id, count(*) AS grams, min(g) AS low, max(g) AS high FROM g GROUP BY doc_id
""")
def text_ngrams(spark, sf_dir):
    grams = tx.token_trigrams(F.array_distinct(tx.terms(tx.normalize_text(F.col("text")))))
    own = table(spark, sf_dir, "documents").select("doc_id", grams.alias("g")).filter("size(g) > 0")
    return own.select("doc_id", F.size("g").cast("long").alias("grams"), F.array_min("g").alias("low"), F.array_max("g").alias("high"))


@query(f"""
    WITH t AS (SELECT DISTINCT doc_id, source, unnest(string_split({NORM_SQL.format('text')}, ' ')) AS w FROM documents),
    d AS (SELECT source, w AS word, count(*) AS df FROM t WHERE length(w) > 4 GROUP BY ALL HAVING count(*) >= 2)
    SELECT source, word, df, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY df DESC, word) AS rank FROM d) WHERE rank <= 8
""")
def theme_words(spark, sf_dir):
    from pyspark.sql import Window

    own = table(spark, sf_dir, "documents").select("source", F.explode(F.array_distinct(tx.terms(tx.normalize_text(F.col("text"))))).alias("word")).filter("length(word) > 4")
    df = own.groupBy("source", "word").agg(F.count("*").alias("df")).filter("df >= 2")
    order = Window.partitionBy("source").orderBy(F.desc("df"), "word")
    return df.withColumn("rank", F.row_number().over(order)).filter("rank <= 8")


@query("SELECT doc_id, CASE WHEN length(text) <= 140 THEN text ELSE substr(text, 1, 139) || '…' END AS headline FROM documents")
def truncate_headline(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.truncate(F.col("text"), 140).alias("headline"))


@query(f"SELECT id, coalesce(nullif(summary, ''), nullif(title, ''), id) AS label FROM ({NODES_SQL})")
def null_coalesce_label(spark, sf_dir):
    return nodes(spark, sf_dir).select("id", tx.first_filled(F.col("summary"), F.col("title"), F.col("id")).alias("label"))


@query("SELECT p_partkey, p_name, p_type, p_size FROM part WHERE p_brand IN ('Brand#11', 'Brand#12', 'Brand#23') AND p_size <= 25")
def type_filter_project(spark, sf_dir):
    return table(spark, sf_dir, "part").filter(F.col("p_brand").isin("Brand#11", "Brand#12", "Brand#23") & (F.col("p_size") <= 25)).select("p_partkey", "p_name", "p_type", "p_size")


@query(f"""
    WITH n AS (SELECT doc_id AS id, lang AS type, source AS system, {NORM_SQL.format("string_split(text, chr(10))[1]")} AS name FROM documents),
    m AS (SELECT type, system, name, min(id) AS a FROM n WHERE name <> '' GROUP BY ALL HAVING count(*) > 1)
    SELECT a, id AS b, type, min(name) AS name FROM n JOIN m USING (type, system, name) WHERE id <> a GROUP BY ALL
""")
def dup_lexical(spark, sf_dir):
    first = F.split("text", "\n")[0]
    own = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("type"), F.col("source").alias("system"), F.array(first).alias("names"))
    return sim.lexical_duplicates(own)


@query(r"""
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)
    SELECT doc_id, pos::INTEGER AS line_no, m AS marker FROM (SELECT doc_id, pos, unnest(regexp_extract_all(line, '[a-z]+ = "([0-9a-f]{8})', 1)) AS m FROM l)
""")
def marker_scan(spark, sf_dir):
    return history.scan_markers(table(spark, sf_dir, "documents"), "doc_id", "text", r'[a-z]+ = "([0-9a-f]{8})')


@query(r"""
    WITH i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_$]+')) AS token FROM benchmark), l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
    w AS (SELECT DISTINCT doc_id, pos, unnest(regexp_extract_all(line, '[A-Za-z0-9_$]+')) AS token FROM l)
    SELECT doc_id, item_id, min(pos)::INTEGER AS first_line, count(*) AS echoes FROM w JOIN i USING (token) WHERE length(token) >= 12 GROUP BY doc_id, item_id
""")
def authority_echo(spark, sf_dir):
    """Lines that hold an item's long words as whole tokens: an equi-join on tokens, not a join of lines and words."""
    tokens = lambda text: F.filter(F.array_distinct(F.regexp_extract_all(text, F.lit("[A-Za-z0-9_$]+"), F.lit(0))), lambda x: F.length(x) >= 12)
    aliases = table(spark, sf_dir, "benchmark").select("item_id", F.explode(tokens(F.col("text"))).alias("token"))
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    words = lines.select("doc_id", "pos", F.explode(tokens(F.col("line"))).alias("token"))
    return words.join(aliases, "token").groupBy("doc_id", "item_id").agg((F.min("pos") + 1).alias("first_line"), F.count("*").alias("echoes"))


@query(r"""
    SELECT conv_id, pos::INTEGER AS line_no, upper(t) AS tag, left(line, 200) AS line FROM (
        SELECT conv_id, pos, line, regexp_extract(line, '(?i)\b(the|with|from|that)\b', 1) AS t FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM conversations)
    ) WHERE t <> ''
""")
def line_tags(spark, sf_dir):
    return history.tagged_lines(table(spark, sf_dir, "conversations"), "conv_id", "text", ("the", "with", "from", "that"))


@query(r"""
    WITH c AS (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'Revert "Revert "' || event_type || '""' WHEN event_id % 3 = 0 THEN 'Revert "' || event_type || '"' ELSE event_type END AS subject FROM events)
    SELECT regexp_replace(regexp_replace(subject, '^(Revert ")+', ''), '"+$', '') AS reverted, count(*) AS reverts, min(event_id) AS first_commit, max(event_id) AS last_commit FROM c WHERE subject LIKE 'Revert %' GROUP BY 1
""")
def revert_groups(spark, sf_dir):
    kind = F.col("event_type")
    subject = F.when(F.col("event_id") % 9 == 0, F.concat(F.lit('Revert "Revert "'), kind, F.lit('""'))).when(F.col("event_id") % 3 == 0, F.concat(F.lit('Revert "'), kind, F.lit('"'))).otherwise(kind)
    commits = table(spark, sf_dir, "events").select(F.col("event_id").alias("hash"), subject.alias("subject"), F.lit("").alias("body"))
    return history.revert_groups(commits).select("reverted", "reverts", F.col("first_hash").alias("first_commit"), F.col("last_hash").alias("last_commit"))


_PATH_SQL = "regexp_replace(regexp_extract(url, '://[^/]*/([^?#]*)', 1), '/$', '/index.html')"


@query(f"""
    SELECT page_id, {_PATH_SQL} AS path, CASE WHEN regexp_matches(lower({_PATH_SQL}), '(^|/)(test|tests|__tests__|spec)/|\\.(test|spec)\\.[a-z]+$') THEN 'test'
        WHEN regexp_matches(lower({_PATH_SQL}), '(^|/)(main|index|cli)\\.[a-z]+$') THEN 'entrypoint' ELSE 'source' END AS role FROM pages
""")
def role_classify(spark, sf_dir):
    path = F.regexp_replace(F.regexp_extract("url", "://[^/]*/([^?#]*)", 1), "/$", "/index.html")
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path"), code.role(path).alias("role"))


@query(r"""
    SELECT page_id, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host, regexp_extract(url, '://[^/]*(/[^?#]*)', 1) AS path, regexp_extract(url, '\?([^#]*)', 1) AS query, url LIKE 'https:%' AS secure FROM pages
""")
def url_facts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.lower(F.regexp_extract("url", "://([^/?#]*)", 1)).alias("host"),
        F.regexp_extract("url", "://[^/]*(/[^?#]*)", 1).alias("path"),
        F.regexp_extract("url", r"\?([^#]*)", 1).alias("query"),
        F.col("url").startswith("https:").alias("secure"),
    )


@query(r"""
    SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, CAST(len(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS INTEGER) AS links,
           CAST(len(regexp_extract_all(html, '(?i)<h[1-3][^>]*>', 0)) AS INTEGER) AS headings FROM pages
""")
def html_headings(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", code.html_title(F.col("html")).alias("title"), F.size(code.links(F.col("html"))).alias("links"), F.size(F.regexp_extract_all("html", F.lit("(?i)<h[1-3][^>]*>"), F.lit(0))).alias("headings"))
