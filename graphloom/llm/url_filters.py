"""URL filters: pattern rules that are only tried where their rarest token occurs.

Every rule is a regular expression over host and path with the literal tokens
that any matching URL must hold. A rule is indexed by the one of its tokens
that is rarest over all URLs; a URL's tokens fetch candidate rules, and only
those run their expressions. DataFrame functions only.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rule sets up to this many rules are broadcast; larger ones are joined by a shuffle.
BROADCAST_RULES = 100_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    """``pattern`` is searched in host and path together; ``tokens`` must all be tokens of a matching URL.

    ``weight``: of the matching rules the heaviest decides. Rules of weight 0
    are the method's own: they block or allow only where no other rule does,
    and their name is not reported.
    """

    name: str
    pattern: str
    verdict: str
    tokens: tuple[str, ...]
    weight: int = 0


def tokens_of(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def host_rule(host: str, path: str, verdict: str) -> UrlRule:
    """A rule for a host with its subdomains and a path prefix; the longest such rule wins."""
    # The prefix may stop inside a token, which is then no token of the URL.
    whole = path if not path or not path[-1].isalnum() else re.sub(r"[A-Za-z0-9]+$", "", path)
    name = host + path
    return UrlRule(name, r"^([^/]*\.)?" + re.escape(name).replace("/", r"\/"), verdict, tuple(dict.fromkeys(tokens_of(host) + tokens_of(whole))), len(name))


def word_rule(word: str, verdict: str = "block") -> UrlRule:
    """A rule of the method: the host has ``word`` (tokens joined by hyphens) as a label or part of one."""
    return UrlRule(word, r"^([^/]*[.-])?" + re.escape(word) + r"([.-][^/]*)?(\/|$)", verdict, tuple(tokens_of(word)))


@dataclass(frozen=True)
class UrlFilter:
    rules: tuple[UrlRule, ...]
    default: str = "allow"
    broadcast_rules: int = field(default=BROADCAST_RULES)


def split_url(url) -> tuple:
    """Host and path columns: null or a URL without ``://`` has both empty."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def judge_urls(pages: DataFrame, filters: UrlFilter, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Host, path, deciding rule and verdict of each row's URL.

    Returns a row per input row: ``id_col``, host, path, rule (null where the
    method or the default decides) and verdict. Null URLs and URLs without
    ``://`` get empty host and path and the default verdict. Equal URLs are
    judged once. Ties between rules of equal weight go to the smaller name. An
    empty table gives an empty result.
    """
    spark = pages.sparkSession
    source = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    host, path = split_url(F.col("url"))
    parts = source.filter("url is not null").select("url").distinct().select("url", F.concat(host, path).alias("target"))
    found = parts.select("url", "target", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("target"), F.lit("[a-z0-9]+"), F.lit(0)))).alias("token"))
    schema = T.StructType([T.StructField(n, k) for n, k in (("name", T.StringType()), ("pattern", T.StringType()), ("verdict", T.StringType()), ("tokens", T.ArrayType(T.StringType())), ("weight", T.IntegerType()))])
    rules = spark.createDataFrame([(r.name, r.pattern, r.verdict, list(r.tokens), r.weight) for r in filters.rules], schema)
    small = len(filters.rules) <= filters.broadcast_rules
    hint = F.broadcast if small else (lambda df: df)
    # How often the rules' tokens occur over all URLs; then each rule keeps its rarest.
    wanted = rules.select(F.explode("tokens").alias("token")).distinct()
    counts = found.select("token").join(hint(wanted), "token").groupBy("token").agg(F.count("*").alias("n"))
    index = (
        rules.select("*", F.explode("tokens").alias("token"))
        .join(counts, "token", "left")
        .groupBy("name", "pattern", "verdict", "weight")
        .agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))
    )
    hits = found.join(hint(index), "token").filter("target rlike pattern")
    best = hits.groupBy("url").agg(F.min_by(F.struct("weight", "name", "verdict"), F.struct(-F.col("weight"), "name", "verdict")).alias("r"))
    known = source.filter("url is not null").join(best, "url", "left")
    judged = known.select("id", "url", "r").unionByName(source.filter("url is null").select("id", "url"), allowMissingColumns=True)
    return judged.select(
        F.col("id").alias(id_col), host.alias("host"), path.alias("path"), F.when(F.col("r.weight") > 0, F.col("r.name")).alias("rule"), F.coalesce("r.verdict", F.lit(filters.default)).alias("verdict")
    )
