"""Carving rules: whether a code base's files are framed by components, concerns and layers, and knowledge is bound.

Each rule takes a graph's nodes and edges and gives findings per subject; node
columns that a graph lacks count as null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import KnowledgeGraph
from .rules import dominance, finding, overlapping_groups, report
from .similarity import vector_pairs

# Paths that need no component, by the name of the pattern; and patterns of old.
BUILTIN_EXEMPT = {
    "composition-root-services": r"/services\.ts$", "composition-root-app": r"/App\.tsx$", "composition-root-main": r"/main\.tsx$", "composition-root-server-index": r"/server/index\.ts$",
    "logger": r"/logger\.ts$", "utils": r"/utils\.ts$", "shared-types": r"/shared/types\.ts$", "shared-constants": r"/shared/constants\.ts$", "ambient-types": r"/vite-env\.d\.ts$",
    "eslint-config": r"/eslint\.config\.(mjs|js|cjs)$", "vite-config": r"/vite\.config\.[mc]?[jt]s$", "vitest-config": r"/vitest\.config\.[mc]?[jt]s$", "playwright-config": r"/playwright\.config\.[mc]?[jt]s$",
    "prisma-config": r"/prisma\.config\.[mc]?[jt]s$", "tsconfig": r"(^|/)tsconfig(\.[a-z]+)?\.json$", "package-manifest": r"(^|/)package\.json$", "lockfile": r"(^|/)(pnpm-lock\.ya?ml|package-lock\.json|yarn\.lock)$",
    "workspace-manifest": r"(^|/)pnpm-workspace\.ya?ml$", "env-file": r"(?i)(^|/)[^/]*\.env(\.(example|sample|local|development|production|test|staging|template|defaults?))?$",
    "config-example": r"\.example\.(json|ya?ml|toml)$", "claude-settings": r"(^|/)\.claude/settings(\.[a-z]+)?\.json$", "dockerfile": r"/Dockerfile$", "dockerignore": r"\.dockerignore$",
    "gitignore": r"\.gitignore$", "gitattributes": r"\.gitattributes$", "generated": r"/generated/", "public-assets": r"/public/.*\.(svg|png|jpg|ico|webp)$", "prisma-migrations": r"/prisma/migrations/", "prisma-schema": r"/prisma/schema\.prisma$",
}
REMOVED_EXEMPT = {
    "ui-utils-browser": r"/ui/utils/browser\.ts$", "theme-entry-css": r"/ui/index\.css$", "windows-shell-script": r"^[^/]+\.(bat|sh)$", "utf8-bat": r"^[^/]+\.utf8\.bat$",
    "plans-html": r"^plans/.*\.html$", "winsw-service-xml": r"/winsw/[^/]+\.xml$", "tests-setup": r"/tests/setup-[^/]+\.ts$",
}
ROLE_EXEMPT = ("documentation", "generated")
PLACEHOLDER = r"(?i)(band\s*\d+\s*/\s*\d+)|(\(\s*\d+\s*(files?|ファイル)\s*\))|(candidate\s+c\d+)"
ENDED = ("superseded", "abandoned", "closed")
DESCRIBED = ("Decision", "RejectedOption", "Constraint", "Goal", "Risk", "OperationalKnowledge")
BOUND = ("Decision", "OperationalKnowledge", "Risk")
CROSSCUT = ("Component", "Concern", "Layer")


def with_columns(nodes: DataFrame, **kinds: str) -> DataFrame:
    missing = {c: F.lit(None).cast(k) for c, k in kinds.items() if c not in nodes.columns}
    return nodes.withColumns(missing) if missing else nodes


def builtin_exemption(path: Column, patterns: dict[str, str] = BUILTIN_EXEMPT) -> Column:
    """Name of the first pattern that a path matches, or null."""
    return F.coalesce(*(F.when(path.rlike(p), name) for name, p in patterns.items()), F.lit(None).cast("string"))


def exemption(role: Column, path: Column, configured: Column) -> Column:
    """role:, builtin: or config: with its name; null for a path that must be framed."""
    built = builtin_exemption(path)
    return F.when(role.isin(*ROLE_EXEMPT), F.concat(F.lit("role:"), role)).when(built.isNotNull(), F.concat(F.lit("builtin:"), built)).when(configured, F.concat(F.lit("config:"), path))


def is_impl_binding(file_id: Column) -> Column:
    return file_id.startswith("file:") & ~file_id.rlike(r"^file:[^:]*:docs/(knowhow|plans|design-decisions)/")


def files_with_exemptions(nodes: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """File nodes with basis, null for one that must be framed; ``allowed`` is (path)."""
    files = with_columns(nodes, role="string", path="string").filter("type = 'File'")
    if allowed is None:
        return files.withColumn("basis", exemption(F.col("role"), F.col("path"), F.lit(False)))
    marked = files.join(allowed.select("path").distinct().withColumn("_allowed", F.lit(True)), "path", "left")
    return marked.withColumn("basis", exemption(F.col("role"), F.col("path"), F.coalesce("_allowed", F.lit(False)))).drop("_allowed")


def members(nodes: DataFrame, edges: DataFrame, kind: str) -> DataFrame:
    """(grp, member): files that evidence nodes of a kind."""
    frames = nodes.filter(F.col("type") == kind).select(F.col("id").alias("src"))
    return edges.filter("type = 'evidenced_by'").join(frames, "src", "left_semi").select(F.col("src").alias("grp"), F.col("dst").alias("member")).distinct()


def config_rules(nodes: DataFrame, allowed: DataFrame) -> DataFrame:
    """Exemptions for paths that no File has, or that a built-in pattern covers."""
    paths = with_columns(nodes, path="string").filter("type = 'File'").select("path")
    built = builtin_exemption(F.col("path"))
    return report(
        finding(allowed.join(paths, "path", "left_anti"), "carving-config-stale", "path"),
        finding(allowed.filter(built.isNotNull()), "config-duplicates-builtin", "path", "warn", built),
    )


def text_rules(nodes: DataFrame) -> DataFrame:
    own = with_columns(nodes, role="string", path="string", title="string", description="string", summary_provisional="boolean", candidate="boolean")
    exempt = (F.col("type") == "File") & F.coalesce(F.col("role").isin(*ROLE_EXEMPT) | builtin_exemption(F.col("path")).isNotNull(), F.lit(False))
    provisional = own.filter("summary_provisional")
    crosscut = own.filter(F.col("type").isin(*CROSSCUT))
    name = F.substring_index("id", ":", -1)
    return report(
        finding(provisional.filter(~exempt), "summary-provisional", "id"),
        finding(provisional.filter(exempt), "summary-provisional-exempt", "id", "info"),
        finding(crosscut.filter("candidate"), "candidate-uncarved", "id"),
        finding(crosscut.filter(F.col("title").rlike(PLACEHOLDER)), "placeholder-title", "id", "error", F.col("title")),
        finding(crosscut.filter(((F.col("type") == "Layer") & name.rlike(r"^band\d+$")) | ((F.col("type") == "Component") & name.rlike(r"^c\d+$"))), "meaningful-slug", "id", "warn", name),
        finding(own.filter(F.col("type").isin(*DESCRIBED) & (F.trim(F.coalesce("description", F.lit(""))) == "")), "knowledge-description-missing", "id", "warn"),
    )


def structure_rules(nodes: DataFrame, edges: DataFrame, allowed: DataFrame | None = None, jaccard: float = 0.4, share: float = 0.7, exempt_share: float = 0.15) -> DataFrame:
    files = files_with_exemptions(nodes, allowed)
    by = {kind: members(nodes, edges, kind) for kind in CROSSCUT}

    def outside(kind):
        return files.join(by[kind].select(F.col("member").alias("id")), "id", "left_anti")

    docs = by["Layer"].join(files.filter("role = 'documentation'").select(F.col("id").alias("member")), "member", "left_semi")
    built = by["Concern"].unionByName(by["Component"]).join(files.filter("role is null or role <> 'test'").select(F.col("id").alias("member")), "member", "left_semi")
    kinds = nodes.select("id", "type")
    alike = overlapping_groups(built, jaccard).join(kinds.select(F.col("id").alias("a"), F.col("type").alias("ka")), "a").join(kinds.select(F.col("id").alias("b"), F.col("type").alias("kb")), "b").filter("ka <> kb")
    concern, component = F.when(F.col("ka") == "Concern", F.col("a")).otherwise(F.col("b")), F.when(F.col("ka") == "Concern", F.col("b")).otherwise(F.col("a"))
    large = by["Concern"].groupBy("grp").agg(F.count("*").alias("size")).filter("size >= 3").select("grp")
    # A file in several components counts for the last of them.
    home = by["Component"].groupBy("member").agg(F.max("grp").alias("part"))
    placed = by["Concern"].join(large, "grp", "left_semi").join(home, "member").select("grp", "part")
    top = dominance(placed, 1, share)
    many = by["Concern"].groupBy("member").agg(F.count("*").alias("n")).filter("n >= 3")
    unframed = outside("Component").filter("basis is not null and basis not like 'role:%'").agg(F.count("*").alias("k"))
    total = files.filter(F.col("role").isNull() | ~F.col("role").isin(*ROLE_EXEMPT)).agg(F.count("*").alias("n"))
    ratio = unframed.join(total, F.lit(True)).filter((F.col("n") > 0) & (F.col("k") / F.col("n") > exempt_share))
    signal = with_columns(nodes, cross_component_in_degree="long").filter("type = 'File'").agg(F.count("cross_component_in_degree").alias("k"), F.count("*").alias("n")).filter("k = 0")
    return report(
        finding(docs, "layer-no-doc", "member", "warn", F.col("grp")),
        finding(outside("Component").filter("basis is null"), "component-coverage", "id"),
        finding(outside("Layer").filter("basis is null").filter(F.coalesce(~F.col("path").rlike("/(dist|node_modules)/"), F.lit(True))), "layer-coverage", "id", "warn"),
        finding(alike, "concern-component-duplicate", concern, "warn", component, "k"),
        finding(top, "concern-component-dominance", "grp", "warn", F.col("part"), "n"),
        finding(many, "multi-concern-membership", "member", "warn", n="n"),
        finding(ratio, "exemption-ratio-high", F.lit("exemptions"), "warn", n="k"),
        finding(signal, "indexer-signal-missing", F.lit("files"), "info", n="n"),
    )


def knowledge_rules(nodes: DataFrame, edges: DataFrame, hub: int = 8) -> DataFrame:
    own = with_columns(nodes, state="string")

    def none_of(rows, types, end):
        at = edges.filter(F.col("type").isin(*types)).select(F.col(end).alias("id"))
        return rows.join(at, "id", "left_anti")

    some_file = own.filter("type = 'File'").agg(F.count("*").alias("files")).filter("files > 0")
    bound = edges.filter(F.col("type").isin("sets_policy_for", "documented_by") & is_impl_binding(F.col("dst"))).select(F.col("src").alias("id"))
    unbound = own.filter(F.col("type").isin(*BOUND)).join(bound, "id", "left_anti").join(some_file, F.lit(True))
    crosscut = own.filter(F.col("type").isin(*CROSSCUT)).select(F.col("id").alias("dst"))
    hubs = edges.filter(F.col("type").isin("sets_policy_for", "risks_in")).join(crosscut, "dst", "left_semi").groupBy("dst").agg(F.count("*").alias("n")).filter(F.col("n") >= hub)
    floor = own.agg(F.count_if(F.col("type") == "Goal").alias("goals"), F.count_if(F.col("type") == "Constraint").alias("constraints"))
    states = own.select("id", F.coalesce("state", F.lit("")).alias("state"))
    premises = edges.filter("type = 'has_premise'").join(states.select(F.col("id").alias("src"), F.col("state").alias("from_state")), "src").join(states.select(F.col("id").alias("dst"), F.col("state").alias("to_state")), "dst")
    dead = premises.filter(~F.col("from_state").isin(*ENDED) & F.col("to_state").isin(*ENDED))
    return report(
        finding(unbound, "knowledge-impl-binding-missing", "id", "warn"),
        finding(hubs, "crosscut-policy-hub", "dst", "warn", n="n"),
        finding(floor.filter("goals = 0"), "knowledge-floor-goal-missing", F.lit("graph"), "warn"),
        finding(floor.filter("constraints = 0"), "knowledge-floor-constraint-missing", F.lit("graph"), "warn"),
        finding(none_of(own.filter("type = 'Goal'"), ["has_premise"], "dst"), "goal-island", "id", "warn"),
        finding(dead, "superseded-premise", "src", "warn", F.concat_ws(":", "dst", "to_state")),
        finding(none_of(own.filter("state = 'superseded'"), ["refines"], "dst"), "superseded-no-successor", "id", "warn"),
        finding(none_of(own.filter("type = 'Constraint'"), ["constrains"], "src"), "constraint-binding-missing", "id", "warn"),
        finding(edges.filter("type = 'temporary_relation_candidate'"), "temporary-relation-remaining", "id", "warn"),
    )


def vector_rules(nodes: DataFrame, vectors: DataFrame | None, types: tuple[str, ...], least: float = 0.92) -> DataFrame:
    if vectors is None:
        return finding(nodes.sparkSession.range(1), "vector-index-not-provided", F.lit("graph"), "info")
    rows = nodes.filter(F.col("type").isin(*types)).select("id", "type").join(vectors.select(F.col("node_id").alias("id"), "vector"), "id")
    return finding(vector_pairs(rows, least), "node-duplicate-suspect", "a", "warn", F.concat_ws(":", "b", F.col("similarity").cast("string")))


def project_rules(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    own = with_columns(nodes, state="string")

    def lacking(rows, edge_type, end):
        return rows.join(edges.filter(F.col("type") == edge_type).select(F.col(end).alias("id")), "id", "left_anti")

    ownerless = lacking(own.filter("type = 'Agreement' and state = 'exploring'"), "responsible_for", "dst")
    several = ownerless.join(F.broadcast(ownerless.agg(F.count("*").alias("n")).filter("n >= 2")), F.lit(True))
    active = own.filter("type = 'Agreement' and state = 'active'").select(F.col("id").alias("dst"))
    holders = own.filter("type = 'Stakeholder'").select(F.col("id").alias("src"))
    busy = edges.filter("type = 'party_to'").join(active, "dst", "left_semi").join(holders, "src", "left_semi").groupBy("src").agg(F.count("*").alias("n")).filter("n >= 3")
    return report(
        finding(several, "agreement-exploring-concentration", "id", "warn", n="n"),
        finding(own.filter("type = 'Agreement' and state = 'negotiating'"), "agreement-negotiating-stagnation", "id", "warn"),
        finding(busy, "stakeholder-overload", "src", "warn", n="n"),
        finding(lacking(own.filter("type = 'Task' and coalesce(state, '') not in ('completed', 'cancelled')"), "requires", "src"), "task-resource-gap", "id", "warn"),
        finding(lacking(own.filter("type = 'Assumption'"), "has_premise", "dst"), "assumption-orphan", "id", "warn"),
        finding(lacking(own.filter("type = 'Goal' and state = 'active'"), "achieves", "dst"), "goal-no-task", "id", "warn"),
        finding(lacking(own.filter("type = 'Theme'"), "encompasses", "src"), "theme-empty", "id", "warn"),
    )


def carving_report(graph: KnowledgeGraph, allowed: DataFrame | None = None, duplicate_types: tuple[str, ...] = (), project: bool = False) -> DataFrame:
    parts = [text_rules(graph.nodes), structure_rules(graph.nodes, graph.edges, allowed), knowledge_rules(graph.nodes, graph.edges), vector_rules(graph.nodes, graph.vectors, duplicate_types)]
    if allowed is not None:
        parts.append(config_rules(graph.nodes, allowed))
    if project:
        parts.append(project_rules(graph.nodes, graph.edges))
    return report(*parts)
