"""Hybrid search: lexical coverage, n-grams, aliases and vectors in one score."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors as vx

# How node types, file roles and end states move a score.
TYPE_BOOST = {"Decision": 1.05, "Constraint": 1.05, "OperationalKnowledge": 1.05}
ROLE_WEIGHTS = {"source": 1.0, "api_route": 0.85, "entrypoint": 0.9, "ui_component": 0.85, "config": 0.62, "test": 0.55, "documentation": 0.6}
TERMINAL_STATES = ("superseded", "closed", "abandoned", "achieved")
TERMINAL_WEIGHT = 0.6
SEMANTIC_FLOOR = 0.05
RERANK_TOP, RERANK_STEP, RERANK_VOTES = 24, 0.06, 5
# Where confidence is high and low.
BANDS = {"vector": (0.65, 0.50), "ngram": (0.65, 0.45), "coverage": (0.65, 0.45)}
MARGIN_HIGH, MARGIN_LOW, SPREAD_FLOOR, STANDOUT_GAP = 0.0, -1.0, 0.01, 0.30

OPTIONAL = {"title": "string", "summary": "string", "path": "string", "aliases": "array<string>", "tags": "array<string>", "display": "array<string>", "role": "string", "state": "string", "vector": "array<double>"}


@dataclass(frozen=True)
class Query:
    """What the driver works out of a question once."""

    text: str
    normalized: str = field(init=False)
    parts: tuple[tuple[tuple[str, int], ...], ...] = field(init=False)
    gram_sets: tuple[tuple[str, ...], ...] = field(init=False)

    def __post_init__(self):
        norm = tx.normalize(self.text)
        tokens = norm.split()
        content = [t for t in tokens if tx.is_content_term(t)]
        latin = [t for t in content if re.fullmatch(r"[\x21-\x7e]+", t)]
        other = [t for t in content if t not in latin]
        total = sum(map(tx.weight, content))
        scripts = [p for p in (latin, other) if latin and other and sum(map(tx.weight, p)) * 3 >= total]
        wholes = [tokens and content or [], *scripts]
        object.__setattr__(self, "normalized", norm)
        object.__setattr__(self, "parts", tuple(tuple((t, tx.weight(t)) for t in p) for p in wholes if p))
        object.__setattr__(self, "gram_sets", tuple(tuple(dict.fromkeys(g for t in p for g in tx.grams_of(t))) for p in [tokens, *scripts] if p))


def haystack(nodes: DataFrame) -> Column:
    """Searched fields, one a line; null and empty ones left out."""
    fields = [tx.first_filled(F.col(c)) for c in ("title", "summary", "path")] + [F.array_join(F.filter(F.col(c), lambda x: x != ""), "\n") for c in ("aliases", "tags", "display")]
    lines = [tx.normalize_text(f) for f in fields]
    return F.concat_ws("\n", *(F.when(x != "", x) for x in lines))


def coverage(hay: Column, query: Query) -> Column:
    """Weight of the query's terms that the text contains, over all; the best of whole query and scripts."""
    best = [F.lit(0.0)]
    for part in query.parts:
        total = sum(w for _, w in part)
        best.append(sum((F.when(F.contains(hay, F.lit(t)), w).otherwise(0) for t, w in part), F.lit(0)) / F.lit(float(total)))
    return F.greatest(*best, F.lit(0.0))


def ngram_ratio(hay: Column, query: Query) -> Column:
    """Share of the query's grams among the text's.

    A gram of three stands inside a token of the text exactly if the text
    contains it; a Latin token under three letters only counts as a token.
    """
    best = [F.lit(0.0)]
    padded = F.concat(F.lit(" "), F.translate(hay, "\n", " "), F.lit(" "))
    for grams in query.gram_sets:
        hits = F.lit(0)
        for g in grams:
            short = len(g) < 3 and re.fullmatch(r"[\x21-\x7e]+", g)
            hits = hits + F.when(F.contains(padded, F.lit(f" {g} ")) if short else F.contains(hay, F.lit(g)), 1).otherwise(0)
        best.append(hits / F.lit(float(len(grams))))
    return F.greatest(*best, F.lit(0.0))


def with_fields(nodes: DataFrame) -> DataFrame:
    missing = {c: F.lit(None).cast(kind) for c, kind in OPTIONAL.items() if c not in nodes.columns}
    return nodes.withColumns(missing) if missing else nodes


def search(
    nodes: DataFrame,
    question: str,
    query_vectors: list[list[float]] | None = None,
    limit: int | None = 10,
    types: list[str] | None = None,
    role_weights: dict[str, float] | None = ROLE_WEIGHTS,
    hay: Column | None = None,
) -> DataFrame:
    """The best matches: id, score (3 places), lexical, semantic, coverage, ngram, alias_exact, state_note.

    Query features and vectors are literals, so the plan is one scan with a
    top-k. ``types`` empty or None: all. Ties go to the smaller id.
    """
    query = Query(question)
    rows = with_fields(nodes)
    if types:
        rows = rows.filter(F.col("type").isin(types))
    rows = rows.withColumn("hay", hay if hay is not None else haystack(rows))
    exact = F.coalesce(F.array_contains(F.transform("aliases", lambda x: tx.normalize_text(x)), query.normalized), F.lit(False))
    semantic = F.lit(0.0)
    if query_vectors:
        own = vx.as_doubles(F.col("vector"))
        cosines = [vx.dot(own, vx.literal(q)) for q in query_vectors]
        best = F.coalesce(cosines[0] if len(cosines) == 1 else F.greatest(*cosines), F.lit(0.0))
        semantic = F.when(best > SEMANTIC_FLOOR, F.least(best, F.lit(1.0))).otherwise(F.lit(0.0))
    rows = rows.withColumns({"coverage": coverage(F.col("hay"), query), "ngram": ngram_ratio(F.col("hay"), query), "alias_exact": exact, "semantic": semantic})
    rows = rows.withColumn("lexical", F.greatest(F.when(F.col("alias_exact"), 1.0).otherwise(0.0), "coverage", "ngram"))
    boost = F.lit(1.0)
    for name, by in TYPE_BOOST.items():
        boost = F.when(F.col("type") == name, by).otherwise(boost)
    role = F.lit(1.0)
    for name, by in (role_weights or {}).items():
        role = F.when((F.col("type") == "File") & (F.col("role") == name), by).otherwise(role)
    ended = F.coalesce(F.col("state").isin(*TERMINAL_STATES), F.lit(False))
    score = (F.col("lexical") * 100 + F.col("semantic") * 100) * boost * role * F.when(ended, TERMINAL_WEIGHT).otherwise(1.0)
    rows = rows.withColumn("score", F.round(score, 3)).filter("score > 0")
    out = rows.select("id", "type", "score", "lexical", "semantic", "coverage", "ngram", "alias_exact", F.when(ended, F.col("state")).alias("state_note"))
    return out.orderBy(F.desc("score"), "id").limit(limit) if limit is not None else out


def graph_rerank(matches: DataFrame, edges: DataFrame, limit: int = 10) -> DataFrame:
    """Matches with a bonus for each edge to another of the top ones.

    Both ends of an edge inside the top ``RERANK_TOP`` get a vote; up to
    ``RERANK_VOTES`` count. The top is bounded, so it is broadcast.
    """
    top = matches.orderBy(F.desc("score"), "id").limit(RERANK_TOP)
    near = edges.filter("src <> dst").join(F.broadcast(top.select(F.col("id").alias("src"))), "src", "left_semi").join(F.broadcast(top.select(F.col("id").alias("dst"))), "dst", "left_semi")
    votes = near.select(F.col("src").alias("id")).union(near.select("dst")).groupBy("id").agg(F.count("*").alias("votes"))
    raised = top.join(votes, "id", "left").withColumn("votes", F.coalesce("votes", F.lit(0)))
    return raised.withColumn("score", F.round(F.col("score") * (1 + RERANK_STEP * F.least("votes", F.lit(RERANK_VOTES))), 3)).orderBy(F.desc("score"), "id").limit(limit)


def _band(value: Column, high: float, low: float) -> Column:
    return F.when(value >= high, 2).when(value >= low, 1).otherwise(0)


def confidence(matches: DataFrame, baseline: tuple[float, float] | None = None) -> DataFrame:
    """Of the best match: confidence (high, low, none), standout and gap_above_next; no row without matches.

    Grades read values rounded to 2 places. ``baseline``: median and 90 %
    cosine of unrelated pairs; without it absolute bands hold.
    """
    order = Window.orderBy(F.desc("score"), "id")
    top = matches.orderBy(F.desc("score"), "id").limit(2).withColumns({"rank": F.row_number().over(order), "next": F.lead("score").over(order)}).filter("rank = 1")
    two = {c: F.round(c, 2) for c in ("semantic", "ngram", "coverage")}
    if baseline is None:
        vector = _band(two["semantic"], *BANDS["vector"])
    else:
        margin = (two["semantic"] - baseline[0]) / max(baseline[1] - baseline[0], SPREAD_FLOOR)
        vector = _band(margin, MARGIN_HIGH, MARGIN_LOW)
    vector = F.when(F.col("semantic") > 0, vector).otherwise(0)
    grade = F.greatest(vector, F.when(F.col("alias_exact"), 2).otherwise(0), _band(two["ngram"], *BANDS["ngram"]), _band(two["coverage"], *BANDS["coverage"]))
    gap = (F.col("score") - F.col("next")) / F.greatest("score", F.lit(1.0))
    clear = F.coalesce(gap >= STANDOUT_GAP, F.lit(False))
    raised = F.least(grade + F.when(clear, 1).otherwise(0), F.lit(2))
    name = F.when(raised == 2, "high").when(raised == 1, "low").otherwise("none")
    state = F.when(F.col("next").isNull(), "single").when(clear, "clear").otherwise("none")
    return top.select("id", "score", name.alias("confidence"), state.alias("standout"), F.round(gap, 3).alias("gap_above_next"))
