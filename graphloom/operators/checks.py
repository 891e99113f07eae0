"""Checks of a graph against its sources: enforcement, markers, frames, deltas, lifecycles, storage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.code import basename, dirname
from ..functions.text import contains_token, truncate
from ..graph import KnowledgeGraph
from .carving import builtin_exemption, members, with_columns
from .rules import PROGRESS, finding, report

# Fixed values.
FILE_EDGES = ("documented_by", "sets_policy_for", "constrains", "risks_in", "enforced_by")
TYPE_PRIORITY = {"Constraint": 0, "Decision": 1, "OperationalKnowledge": 2, "Risk": 3, "Goal": 4}
IMPL_EXTENSIONS = ("ts", "tsx", "mts", "cts", "js", "jsx", "mjs", "cjs", "py", "go", "rs", "java", "kt", "rb", "php", "cs", "swift", "c", "h", "cc", "cpp", "cxx", "hpp", "sh", "sql", "vue", "svelte")
SKIPS = {
    "test-skip": r"\b(it|test|describe)\.(skip|todo)\b", "x-prefix": r"\bx(it|describe|test)\s*\(", "pytest-skip": r"@pytest\.mark\.(skip|skipif|xfail)\b", "unittest-skip": r"@unittest\.skip",
    "go-skip": r"\bt\.Skip(f|Now)?\s*\(", "rust-ignore": r"#\[ignore", "junit-disabled": r"@(Disabled|Ignore)\b", "rspec-pending": r"^\s*(pending|xit)\b", "node-skip": r"\bskip\s*:\s*true\b",
}
IMPORT_LINE = r"^\s*(import\b|from\s+\S+\s+import\b|(const|let|var)\s+.*=\s*require\(|use\s|#include|require\b|export\s+.*\bfrom\b)"
#: What a marker comment begins with: ``kg:see <id>`` or ``kg:enforces <id>``; a caller may use another word.
NAMESPACE = "kg"


def marker_pattern(namespace: str = NAMESPACE) -> str:
    return rf"\b{namespace}:(see|enforces)\s+([A-Za-z][A-Za-z0-9_]*:[A-Za-z0-9._-]+:[A-Za-z0-9._/-]+)"


def file_path(node_path: Column, node_id: Column) -> Column:
    """A File's path, else what its id tells."""
    derived = F.regexp_extract(node_id, r"^file:[^:]*:(.+)$", 1)
    return F.coalesce(node_path, F.when(derived != "", derived))


def is_impl_path(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(basename(path), r"\.([^.]+)$", 1))
    return ext.isin(*IMPL_EXTENSIONS) & ~F.lower(path).endswith(".d.ts")


def file_lines(files: DataFrame) -> DataFrame:
    """(path, line_no, line) of (path, content)."""
    return files.select("path", F.posexplode(F.split("content", "\r?\n")).alias("pos", "line")).select("path", (F.col("pos") + 1).alias("line_no"), "line")


def marker_hits(files: DataFrame, kind: str | None = None, namespace: str = NAMESPACE) -> DataFrame:
    """(path, line_no, kind, target) of markers in other than Markdown files; quoted ones don't count."""
    lines = file_lines(files.filter(~F.col("path").endswith(".md") & F.col("content").contains(f"{namespace}:")))
    pattern = F.lit(marker_pattern(namespace))
    bare = F.regexp_replace("line", "\"[^\"]*\"|'[^']*'|`[^`]*`", "")
    found = lines.withColumn("bare", bare).select("path", "line_no", F.explode(F.arrays_zip(F.regexp_extract_all("bare", pattern, F.lit(1)).alias("kind"), F.regexp_extract_all("bare", pattern, F.lit(2)).alias("target"))).alias("m")).select("path", "line_no", "m.kind", "m.target")
    return found if kind is None else found.filter(F.col("kind") == kind)


def marker_findings(hits: DataFrame, graph: KnowledgeGraph, tombstones: DataFrame) -> DataFrame:
    """Markers whose target is gone, never was, or was superseded; ``tombstones`` is (id, final)."""
    nodes = with_columns(graph.nodes, state="string").select(F.col("id").alias("target"), F.coalesce("state", F.lit("")).alias("state"))
    lost = hits.join(nodes, "target", "left_anti").join(tombstones.select(F.col("id").alias("target"), "final", F.lit(True).alias("dead")), "target", "left")
    heirs = graph.edges.filter("type in ('refines', 'supersedes')").groupBy(F.col("dst").alias("target")).agg(F.array_join(F.array_sort(F.collect_set("src")), ",").alias("heirs"))
    old = hits.join(nodes.filter("state = 'superseded'"), "target").join(heirs, "target", "left")
    where = F.concat_ws(":", "path", "line_no")
    return report(
        finding(lost.filter("dead is null"), "marker-broken-ref", where, "warn", F.col("target")),
        finding(lost.filter("dead"), "marker-tombstoned-ref", where, "warn", F.concat_ws(">", "target", "final")),
        finding(old, "marker-superseded-ref", where, "warn", F.concat_ws(">", "target", "heirs")),
    )


def constraint_findings(graph: KnowledgeGraph, files: DataFrame, namespace: str = NAMESPACE) -> DataFrame:
    """Whether each Constraint is enforced by a file (path, content) that exists, runs and says so."""
    nodes = with_columns(graph.nodes, path="string", enforcement="string", enforcement_reason="string")
    rules = nodes.filter("type = 'Constraint'").select("id", (F.coalesce("enforcement", F.lit("")) == "none").alias("none"), F.trim(F.coalesce("enforcement_reason", F.lit(""))).alias("reason"))
    wired = graph.edges.filter("type = 'enforced_by'").join(nodes.select(F.col("id").alias("dst"), "path"), "dst", "left").select(F.col("src").alias("id"), "dst", file_path(F.col("path"), F.col("dst")).alias("path"))
    own = rules.join(wired, "id")
    bare = rules.join(wired.select("id"), "id", "left_anti")
    there = files.select("path", "content")
    missing = own.filter("path is null").unionByName(own.filter("path is not null").join(there, "path", "left_anti").select(*own.columns))
    read = own.join(there, "path")
    skip = F.coalesce(*(F.when(F.col("line").rlike(p), name) for name, p in SKIPS.items()))
    skipped = file_lines(read.select("path", "content").distinct()).withColumn("label", skip).filter("label is not null").groupBy("path").agg(F.min(F.struct("line_no", "label")).alias("first"), F.count("*").alias("n"))
    hits = marker_hits(files, "enforces", namespace).select("path", "line_no", F.col("target").alias("id"))
    kinds = nodes.select("id", "type")
    known = hits.join(kinds, "id", "left")
    return report(
        finding(own.filter("none").select("id").distinct(), "contradictory-enforcement", "id", "warn"),
        finding(bare.filter("none and reason = ''"), "unenforceable-no-reason", "id", "warn"),
        finding(bare.filter("not none"), "unguarded", "id", "warn"),
        finding(missing, "enforcer-missing", "id", "error", F.col("dst")),
        finding(read.join(skipped, "path"), "enforcer-skipped", "id", "warn", F.concat_ws(":", "path", "first.line_no", "first.label"), "n"),
        finding(read.join(hits.select("path", "id"), ["path", "id"], "left_anti"), "marker-missing", "id", "warn", F.col("path")),
        finding(known.filter("type is null or type <> 'Constraint'"), "orphan-marker", "id", "warn", F.concat_ws(":", "path", "line_no")),
        finding(known.filter("type = 'Constraint'").join(wired.select("id", "path"), ["id", "path"], "left_anti"), "unregistered-enforcer", "id", "warn", F.concat_ws(":", "path", "line_no")),
    )


def enforcement_debt(graph: KnowledgeGraph) -> DataFrame:
    """One row: total, unguarded."""
    rules = with_columns(graph.nodes, enforcement="string").filter("type = 'Constraint'")
    wired = graph.edges.filter("type = 'enforced_by'").select(F.col("src").alias("id")).distinct().withColumn("wired", F.lit(True))
    return rules.join(wired, "id", "left").agg(F.count("*").alias("total"), F.count_if(F.col("wired").isNull() & ~F.col("enforcement").eqNullSafe("none")).alias("unguarded"))


def claimants(graph: KnowledgeGraph) -> DataFrame:
    """(dir, component, n): components with members in a directory."""
    files = with_columns(graph.nodes, path="string").filter("type = 'File'").select(F.col("id").alias("member"), file_path(F.col("path"), F.col("id")).alias("path"))
    return members(graph.nodes, graph.edges, "Component").join(files, "member").groupBy(dirname(F.col("path")).alias("dir"), F.col("grp").alias("component")).agg(F.count("*").alias("n"))


def frame_entries(graph: KnowledgeGraph, paths: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """(path, dir, status, component): how each path stands to the frames."""
    own = paths.select(F.regexp_replace("path", r"^\./", "").alias("path")).distinct().withColumn("dir", dirname(F.col("path")))
    files = with_columns(graph.nodes, path="string").filter("type = 'File'").select("id", "path")
    framed = graph.edges.filter("type = 'evidenced_by'").select(F.col("dst").alias("id")).distinct().withColumn("framed", F.lit(True))
    known = files.join(framed, "id", "left").groupBy("path").agg(F.max(F.coalesce("framed", F.lit(False))).alias("framed"))
    claim = claimants(graph).groupBy("dir").agg(F.min("component").alias("component"), F.count("*").alias("claims"))
    listed = (allowed.select("path") if allowed is not None else paths.select("path").limit(0)).distinct().withColumn("listed", F.lit(True))
    status = (
        F.when(~is_impl_path(F.col("path")), "non-impl")
        .when(builtin_exemption(F.col("path")).isNotNull() | F.coalesce("listed", F.lit(False)), "exempt")
        .when(F.col("framed"), "registered")
        .when(F.col("framed").isNotNull(), "known-unframed")
        .when(F.col("claims") == 1, "unwired")
        .otherwise("unclaimed")
    )
    return own.join(known, "path", "left").join(claim, "dir", "left").join(listed, "path", "left").select("path", "dir", status.alias("status"), F.when(F.col("claims") == 1, F.col("component")).alias("component"))


def frame_findings(entries: DataFrame, tree: DataFrame | None = None, least: int = 5) -> DataFrame:
    """Unwired files, and directories where ``least`` or more files have no frame; ``tree``: entries of all files there."""
    here = entries.filter("status in ('unwired', 'unclaimed', 'known-unframed')").select("dir").distinct()
    every = (tree if tree is not None else entries).filter("status in ('unwired', 'unclaimed', 'known-unframed')").join(here, "dir", "left_semi")
    many = every.groupBy("dir").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return report(finding(entries.filter("status = 'unwired'"), "in-footprint-unwired", "path", "warn", F.col("component")), finding(many, "component-candidate", "dir", "warn", n="n"))


def knowledge_files(graph: KnowledgeGraph) -> DataFrame:
    """(id, edge, path): files that knowledge is wired to."""
    nodes = with_columns(graph.nodes, path="string").select(F.col("id").alias("dst"), "path")
    wired = graph.edges.filter(F.col("type").isin(*FILE_EDGES)).join(nodes, "dst", "left")
    return wired.select(F.col("src").alias("id"), F.col("type").alias("edge"), file_path(F.col("path"), F.col("dst")).alias("path")).filter("path is not null")


def connected_knowledge(graph: KnowledgeGraph, paths: DataFrame, cap: int | None = 20) -> DataFrame:
    """Knowledge wired to changed paths: id, type, title, headline, via, n; most important first."""
    nodes = with_columns(graph.nodes, title="string", summary="string").select("id", "type", F.coalesce("title", "id").alias("title"), truncate(F.coalesce("summary", F.lit("")), 140).alias("headline"))
    via = knowledge_files(graph).join(paths.select("path").distinct(), "path", "left_semi").groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("path", "edge"))), 1, 5).alias("via"), F.count("*").alias("n"))
    rank = F.lit(9)
    for name, k in TYPE_PRIORITY.items():
        rank = F.when(F.col("type") == name, k).otherwise(rank)
    out = nodes.join(via, "id").orderBy(rank, F.desc("n"), "id")
    return out.limit(cap) if cap is not None else out


def is_echo_alias(alias: Column) -> Column:
    """Shaped like an identifier, and not a plain lower-case word."""
    return alias.rlike(r"^[A-Za-z_$][A-Za-z0-9_$]{2,}$") & ~alias.rlike("^[a-z]+$")


def authority_echoes(graph: KnowledgeGraph, added: DataFrame) -> DataFrame:
    """(id, alias, path, line_no, line): a node's alias in lines (path, line_no, line) added outside its files.

    Aliases are identifiers, so lines are split into those and joined by
    equality; the token boundary is then checked on the line.
    """
    homes = knowledge_files(graph).select("id", "path").distinct()
    aliases = with_columns(graph.nodes, aliases="array<string>").select("id", F.explode("aliases").alias("alias")).filter(is_echo_alias(F.col("alias"))).join(homes.select("id"), "id", "left_semi").distinct()
    lines = added.filter(~F.col("path").endswith(".md") & ~F.col("line").rlike(IMPORT_LINE))
    words = lines.select("path", "line_no", "line", F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(r"[A-Za-z_$][A-Za-z0-9_$]*"), F.lit(0)))).alias("alias"))
    found = words.join(aliases, "alias").filter(contains_token(F.col("line"), F.col("alias"))).join(homes, ["id", "path"], "left_anti")
    return found.select("id", "alias", "path", "line_no", truncate(F.trim("line"), 120).alias("line"))


def lifecycle_suspects(graph: KnowledgeGraph, now, stale_days: int = 14, goal_days: int = 90) -> DataFrame:
    """(id, type, signals): Investigations, Goals and Constraints whose state may be out of date."""
    nodes = with_columns(graph.nodes, state="string", generated_at="timestamp", title="string", summary="string")
    own = nodes.select("id", "type", F.trim(F.coalesce("state", F.lit(""))).alias("state"), F.col("generated_at").cast("timestamp").alias("at"), F.concat_ws("\n", "title", "summary").alias("text"))
    moment = F.lit(now).cast("timestamp")

    def age(name, days):
        old = F.col("at") < moment - F.make_dt_interval(F.lit(days))
        return F.when(F.col("at").isNull(), F.array(F.lit(name), F.lit("no-generated-at"))).when(old, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))

    none = F.array().cast("array<string>")
    claims = F.when(F.col("text").rlike(PROGRESS), F.array(F.lit("progress-claim"))).otherwise(none)
    inquiry = own.filter("type = 'Investigation' and state in ('', 'active')").withColumn("signals", F.concat(F.when(F.col("state") == "", F.array(F.lit("stateless"))).otherwise(age("stale-active", stale_days)), claims))
    goal = own.filter("type = 'Goal' and state in ('planned', 'active')").withColumn("signals", F.when(F.col("state") == "planned", age("stale-planned-goal", stale_days)).otherwise(age("stale-active-goal", goal_days)))
    goals = own.filter("type = 'Goal'").select(F.col("id").alias("dst"), "state")
    bound = graph.edges.filter("type = 'has_premise'").join(own.filter("type = 'Constraint'").select(F.col("id").alias("src")), "src", "left_semi").join(goals, "dst")
    over = bound.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"), F.count_if(F.col("state").isin("achieved", "abandoned")).alias("k"), F.max(F.col("state") == "abandoned").alias("gone")).filter("n = k")
    settled = over.select("id", F.lit("Constraint").alias("type"), F.when(F.col("gone"), F.array(F.lit("settled-premise"), F.lit("abandoned-premise"))).otherwise(F.array(F.lit("settled-premise"))).alias("signals"))
    rows = inquiry.select("id", "type", "signals").unionByName(goal.select("id", "type", "signals")).filter("size(signals) > 0")
    return rows.unionByName(settled)


def storage_findings(parsed: DataFrame, tombstones: DataFrame | None = None) -> DataFrame:
    """Of parsed files (path, id, type, edges, error): unreadable ones, repeated ids, ids in the wrong place, loose ends, buried ids."""
    good = parsed.filter("error is null")
    folder = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    ends = good.select("path", F.explode("edges").alias("e")).select("path", "e.id", "e.dst").filter(~F.col("dst").startswith("vault:"))
    order = Window.partitionBy("id")
    repeated = good.withColumn("n", F.count("*").over(order)).filter("n > 1")
    parts = [
        finding(parsed.filter("error is not null"), "import-parse", "path", detail=F.col("error")),
        finding(repeated, "duplicate-node-ids", "path", detail=F.col("id"), n="n"),
        finding(good.filter(folder != F.col("type")), "id-path-consistency", "path", detail=F.col("type")),
        finding(ends.join(good.select(F.col("id").alias("dst")), "dst", "left_anti"), "edge-endpoints", "path", detail=F.col("dst")),
    ]
    if tombstones is not None:
        parts.append(finding(good.join(tombstones.select("id"), "id", "left_semi"), "tombstone-resurrected", "id", "warn"))
    return report(*parts)
