"""Integrity and quality rules: each is a query that gives the same frame.

finding(rule, severity, subject_id, detail, n); a report is a union of rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import Preset

FINDING = ("rule", "severity", "subject_id", "detail", "n")
# States that end a premise, a goal, a search result.
ENDED_PREMISE = ("superseded", "closed", "abandoned")
PROGRESS = r"(?i)\b(wip|todo|in progress|pending|not yet|remaining)\b"


def finding(rows: DataFrame, rule: str, subject: str | Column, severity: str = "error", detail: Column | None = None, n: str | None = None) -> DataFrame:
    own = F.col(subject) if isinstance(subject, str) else subject
    return rows.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), own.cast("string").alias("subject_id"), (detail if detail is not None else F.lit("")).alias("detail"), (F.col(n) if n else F.lit(1)).cast("long").alias("n"))


def report(*rules: DataFrame) -> DataFrame:
    out = rules[0]
    for r in rules[1:]:
        out = out.unionByName(r)
    return out


# Schema.


def repeated_ids(rows: DataFrame, kind: str = "node") -> DataFrame:
    return finding(rows.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1"), f"duplicate-{kind}-id", "id", n="n")


def unknown_types(nodes: DataFrame, preset: Preset) -> DataFrame:
    known = preset.types(nodes.sparkSession).select("type")
    return finding(nodes.join(F.broadcast(known), "type", "left_anti"), "unknown-node-type", "id", detail=F.coalesce("type", F.lit("")))


def bad_states(nodes: DataFrame, preset: Preset) -> DataFrame:
    """States that a type doesn't have, or has none of."""
    vocab = preset.state_vocab(nodes.sparkSession)
    stated = nodes.filter("state is not null").join(F.broadcast(vocab), ["type", "state"], "left_anti")
    return finding(stated, "bad-state", "id", detail=F.concat_ws(":", "type", "state"))


def missing_required(nodes: DataFrame, preset: Preset) -> DataFrame:
    out = None
    for kind, fields in preset.required.items():
        for name, values in fields.items():
            own = nodes.filter(F.col("type") == kind)
            value = F.col(name) if name in nodes.columns else F.lit(None).cast("string")
            rows = own.filter(value.isNull() | ~value.isin(*values))
            one = finding(rows, "required-field", "id", detail=F.lit(name))
            out = one if out is None else out.unionByName(one)
    return out if out is not None else finding(nodes.limit(0), "required-field", "id")


def dangling_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with an end that is no node; other graphs' nodes (vault:slug/id) are not judged."""
    ids = nodes.select("id").distinct()
    out = None
    for end in ("src", "dst"):
        lost = edges.filter(~F.col(end).startswith("vault:")).join(ids.select(F.col("id").alias(end)), end, "left_anti")
        one = finding(lost, f"missing-{end}", "id", detail=F.col(end))
        out = one if out is None else out.unionByName(one)
    return out


def edge_rule_violations(nodes: DataFrame, edges: DataFrame, preset: Preset) -> DataFrame:
    """Edges whose type is unknown, or doesn't join the types of its ends."""
    spark = nodes.sparkSession
    kinds = spark.createDataFrame([(e,) for e in preset.edge_types], "type string")
    unknown = finding(edges.join(F.broadcast(kinds), "type", "left_anti"), "unknown-edge-type", "id", detail=F.col("type"))
    types = nodes.select("id", "type")
    typed = edges.join(F.broadcast(kinds), "type", "left_semi").join(types.select(F.col("id").alias("src"), F.col("type").alias("from_type")), "src").join(types.select(F.col("id").alias("dst"), F.col("type").alias("to_type")), "dst")
    rules = preset.edge_rules(spark).withColumnRenamed("edge_type", "type")
    wrong = typed.join(F.broadcast(rules), ["type", "from_type", "to_type"], "left_anti")
    return unknown.unionByName(finding(wrong, "edge-rule", "id", detail=F.concat_ws(":", "from_type", "type", "to_type")))


def edge_findings(nodes: DataFrame, edges: DataFrame, preset: Preset) -> DataFrame:
    """:func:`dangling_edges` and :func:`edge_rule_violations` in one pass, in which each end's node is looked up once."""
    spark = nodes.sparkSession
    known = spark.createDataFrame([(e, True) for e in dict.fromkeys(preset.edge_types)], "type string, known boolean")
    allowed = preset.edge_rules(spark).select(F.col("edge_type").alias("type"), "from_type", "to_type").distinct().withColumn("ok", F.lit(True))
    types = nodes.filter("id is not null").groupBy("id").agg(F.collect_list(F.struct("type")).alias("types"))
    met = edges.select("id", "type", "src", "dst").join(F.broadcast(known), "type", "left")
    for end, name in (("src", "a"), ("dst", "b")):
        met = met.join(types.select(F.col("id").alias(end), F.col("types").alias(name)).hint("shuffle_hash"), end, "left")
    # An edge is one row for each pair of its ends' types, and one if an end is missing.
    pairs = F.flatten(F.transform("a", lambda x: F.transform("b", lambda y: F.struct(x["type"].alias("f"), y["type"].alias("t")))))
    met = met.select("id", "type", "src", "dst", "known", F.col("a").isNull().alias("no_src"), F.col("b").isNull().alias("no_dst"), F.posexplode_outer(pairs).alias("pos", "pair"))
    met = met.select("*", F.col("pair.f").alias("from_type"), F.col("pair.t").alias("to_type")).join(F.broadcast(allowed), ["type", "from_type", "to_type"], "left")
    wrong = F.col("known") & F.col("pos").isNotNull() & F.col("ok").isNull()
    said = [
        F.when(F.col("no_src") & ~F.col("src").startswith("vault:"), F.struct(F.lit("missing-src").alias("rule"), F.col("src").alias("detail"))),
        F.when(F.col("no_dst") & ~F.col("dst").startswith("vault:"), F.struct(F.lit("missing-dst").alias("rule"), F.col("dst").alias("detail"))),
        F.when(F.col("known").isNull() & (F.coalesce("pos", F.lit(0)) == 0), F.struct(F.lit("unknown-edge-type").alias("rule"), F.col("type").alias("detail"))),
        F.when(wrong, F.struct(F.lit("edge-rule").alias("rule"), F.concat_ws(":", "from_type", "type", "to_type").alias("detail"))),
    ]
    found = met.select(F.col("id").cast("string").alias("subject_id"), F.explode(F.array_compact(F.array(*said))).alias("f"))
    return found.select("f.rule", F.lit("error").alias("severity"), "subject_id", "f.detail", F.lit(1).cast("long").alias("n"))


def validate(nodes: DataFrame, edges: DataFrame, preset: Preset) -> DataFrame:
    missing = finding(nodes.filter("id is null or id = ''"), "id-required", F.lit(""))
    return report(missing, repeated_ids(nodes), repeated_ids(edges, "edge"), unknown_types(nodes, preset), bad_states(nodes, preset), missing_required(nodes, preset), dangling_edges(nodes, edges), edge_rule_violations(nodes, edges, preset))


# Patterns.


def without_edge(nodes: DataFrame, edges: DataFrame, rule: str, edge_type: str | list[str], end: str = "src", severity: str = "warn") -> DataFrame:
    """Nodes that have no edge of the types at that end."""
    types = [edge_type] if isinstance(edge_type, str) else edge_type
    at = edges.filter(F.col("type").isin(types)).select(F.col(end).alias("id"))
    return finding(nodes.join(at, "id", "left_anti"), rule, "id", severity)


def ended_premises(nodes: DataFrame, edges: DataFrame, edge_type: str = "has_premise", ended: tuple[str, ...] = ENDED_PREMISE) -> DataFrame:
    """Edges whose premise has ended."""
    gone = nodes.filter(F.col("state").isin(*ended)).select(F.col("id").alias("dst"), "state")
    return finding(edges.filter(F.col("type") == edge_type).join(gone, "dst"), "superseded-premise", "src", "warn", F.concat_ws(":", "dst", "state"))


def settled_premises(nodes: DataFrame, edges: DataFrame, edge_type: str, ended: tuple[str, ...]) -> DataFrame:
    """Nodes all of whose premises have ended."""
    states = nodes.select(F.col("id").alias("dst"), "state")
    grouped = edges.filter(F.col("type") == edge_type).join(states, "dst").groupBy("src").agg(F.count("*").alias("n"), F.count_if(F.col("state").isin(*ended)).alias("k"))
    return finding(grouped.filter("n = k"), "settled-premise", "src", "warn", n="n")


def overloaded(edges: DataFrame, rule: str, edge_type: str, least: int, end: str = "src", severity: str = "warn") -> DataFrame:
    """Nodes with ``least`` or more distinct partners over one edge type."""
    other = "dst" if end == "src" else "src"
    return finding(edges.filter(F.col("type") == edge_type).groupBy(end).agg(F.count_distinct(other).alias("n")).filter(F.col("n") >= least), rule, end, severity, n="n")


def stale_nodes(nodes: DataFrame, rule: str, state: str, days: int, now) -> DataFrame:
    """Nodes in a state for more than ``days`` days; those without a readable time are told apart."""
    age = F.date_diff(F.lit(now).cast("date"), F.col("generated_at").cast("date"))
    own = nodes.filter(F.col("state") == state)
    return finding(own.filter(age > days), rule, "id", "warn", age.cast("string")).unionByName(finding(own.filter("generated_at is null"), "no-generated-at", "id", "info"))


def overlapping_groups(members: DataFrame, least: float) -> DataFrame:
    """Pairs of groups (a < b) of (grp, member) with Jaccard similarity ``least`` or more."""
    own = members.select("grp", "member").distinct()
    sizes = own.groupBy("grp").agg(F.count("*").alias("n"))
    both = own.select(F.col("grp").alias("a"), "member").join(own.select(F.col("grp").alias("b"), "member"), "member").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("k"))
    sized = both.join(sizes.select(F.col("grp").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("grp").alias("b"), F.col("n").alias("nb")), "b")
    ratio = F.col("k") / (F.col("na") + F.col("nb") - F.col("k"))
    return sized.filter(ratio >= least).select("a", "b", "k", F.round(ratio, 4).alias("jaccard"))


def dominance(members: DataFrame, least: int, above: float) -> DataFrame:
    """Groups of (grp, part) with ``least`` or more rows of which one part has more than a share ``above``."""
    counts = members.groupBy("grp", "part").agg(F.count("*").alias("k"))
    top = counts.groupBy("grp").agg(F.sum("k").alias("n"), F.max("k").alias("most"), F.min_by("part", F.struct(-F.col("k"), "part")).alias("part"))
    return top.filter((F.col("n") >= least) & (F.col("most") / F.col("n") > above)).select("grp", "part", "n", F.round(F.col("most") / F.col("n"), 4).alias("share"))
