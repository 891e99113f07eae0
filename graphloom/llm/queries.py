"""The registered queries of this subpackage and their SQL, where SQL can express them.

Each query applies its operator to the whole of its table with production
parameters and derives digest columns from the operator's output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import drop_folder, shared_checkpoint
from .bpe import encode_decode, load_vocabulary
from .decontaminate import find_contamination
from .exact_dedup import exact_duplicates
from .fill_middle import arrange, restore_text
from .language_id import identify_languages, train_prototypes
from .minhash_dedup import near_duplicates
from .quality import classify_quality
from .sentencepiece_wfst import load_model, round_trip
from .spelling import spelling_forms
from .substring_dedup import remove_later_passages
from .suffix_dedup import remove_repeated_strings
from .url_filters import UrlFilter, host_rule, judge_urls, word_rule
from .warc import read_warc, scratch_folder, write_warc

#: Host and path rules, and the host words that the method itself blocks.
URL_FILTER = UrlFilter(
    (
        host_rule("com", "/en/", "block"),
        host_rule("example.com", "/en/7", "allow"),
        host_rule("net", "/de/", "allow"),
        host_rule("example.net", "/de/8", "block"),
        host_rule("org", "/es/", "block"),
        word_rule("spam-farm"),
        word_rule("cheap-pills"),
        word_rule("casino"),
        word_rule("free-money"),
    )
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_strings(_table(spark, sf_dir, "documents"), width=400)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_later_passages(_table(spark, sf_dir, "documents"), width=50)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = round_trip(_table(spark, sf_dir, "documents"), load_model())
    return out.select("doc_id", "n_tokens", "token_ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), F.col("exact").alias("round_trip"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = identify_languages(docs, train_prototypes(docs))
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), width=5, percent=75).select("doc_id", "n_shingles", "component_id", "kept")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages"), URL_FILTER)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_folder(spark)
    write_warc(_table(spark, sf_dir, "pages"), folder, least_bytes=0)
    records = read_warc(spark, folder)

    def number(name: str):
        return F.expr(f"try_cast(substring_index({name}, ':', -1) AS BIGINT)")

    out = shared_checkpoint(records.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to")))
    drop_folder(spark, folder)
    return out


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), width=13)
    listed = F.array_join("item_ids", ",")
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(listed.cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = arrange(_table(spark, sf_dir, "documents"), seed=42, rate=50, spm_rate=80)
    return out.select(
        "doc_id",
        "n",
        "form",
        F.char_length("prefix").cast("long").alias("prefix_chars"),
        F.char_length("middle").cast("long").alias("middle_chars"),
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restore_text(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"),
    )


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_decode(_table(spark, sf_dir, "documents"), load_vocabulary())
    return out.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_forms(_table(spark, sf_dir, "documents"), least_length=6, least_count=5, ratio=5, noise=199)


QUERIES = {
    "op13_spelling_variants": op13_spelling_variants,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_bpe": op12_bpe,
    "op1_sentencepiece": op1_sentencepiece,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op2_language_id": op2_language_id,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_url_filters": op6_url_filters,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_warc": op8_warc,
    "op3_suffix_array_dedup": op3_suffix_array_dedup,
    "op10_substring_dedup": op10_substring_dedup,
}

_LOWER_SQL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_WORDS_SQL = "regexp_extract_all(" + _LOWER_SQL.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES: dict[str, str] = {
    "op11_fill_in_middle": r"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x,
                   regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents
        ), h AS (
            SELECT *, len(u) AS n, CAST('0x' || x[1:8] AS BIGINT) % (len(u) + 1) AS h1, CAST('0x' || x[9:16] AS BIGINT) % (len(u) + 1) AS h2,
                   t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || x[17:24] AS BIGINT) % 100 >= 50 AS plain,
                   CAST('0x' || x[25:32] AS BIGINT) % 100 < 80 AS spm FROM d
        ), p AS (
            SELECT doc_id, n, t, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form,
                   array_to_string(u[1:least(h1, h2)], '') AS p, array_to_string(u[least(h1, h2) + 1:greatest(h1, h2)], '') AS m, array_to_string(u[greatest(h1, h2) + 1:n], '') AS s FROM h
        )
        SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
               sha256(t) AS restored_sha256
        FROM p
    """,
    "op9_benchmark_decontamination": f"""
        WITH d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
        i AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark),
        s AS (SELECT item_id, w, least(len(w), 13) AS n FROM i WHERE len(w) > 0),
        iw AS (SELECT DISTINCT item_id, n, array_to_string(w[p : p + n - 1], ' ') AS g FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM s)),
        dp AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM s) WHERE len(w) >= n),
        dw AS (SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS g FROM dp),
        hits AS (SELECT dw.doc_id, dw.n, dw.p, iw.item_id FROM dw JOIN iw USING (n, g)),
        cover AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(v, ',' ORDER BY v) AS l FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS v FROM hits) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(l, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
    "op7_exact_dedup": f"""
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
        FROM (SELECT doc_id, {_LOWER_SQL.format("coalesce(text, '')")} AS t FROM documents)
        WINDOW g AS (PARTITION BY t)
    """,
    "op6_url_filters": f"""
        WITH cut AS (
            SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
        ), split AS (
            SELECT page_id, {_LOWER_SQL.format("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
        ), rules(rule_host, rule_path, rule_verdict) AS (
            VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
        ), hits AS (
            SELECT page_id, first(rule_host || rule_path ORDER BY length(rule_host || rule_path) DESC) AS rule,
                   first(rule_verdict ORDER BY length(rule_host || rule_path) DESC) AS verdict
            FROM split JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
            GROUP BY page_id
        )
        SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN regexp_matches(host, '(^|[.-])(spam-farm|cheap-pills|casino|free-money)([.-]|$)') THEN 'block' ELSE 'allow' END) AS verdict
        FROM split LEFT JOIN hits USING (page_id)
    """,
}
