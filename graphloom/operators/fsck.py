"""Consistency of a vault of files and of its vector index, as one report of findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import KnowledgeGraph
from ..schema import Preset
from ..sources import vault
from ..sources.vector_index import IndexInfo, node_text
from .rules import finding, report, validate

#: Fields of a file in the order in which they are written; others follow by name.
FIRST_FIELDS = ("title", "summary", "description", "state", "path")
_REF = r"^vault:[^/\s]+/\S+$"


def _place(path):
    """Folder and name of a file, whatever lies above."""
    return F.regexp_extract(path, r"([^/]+/[^/]+)$", 1)


def _text(content):
    """A file's text with line feeds only."""
    return F.regexp_replace(content, r"\r\n?", "\n")


def graph_of(parsed: DataFrame) -> KnowledgeGraph:
    """Nodes with every field that some file has, and edges."""
    known = {r.k for r in parsed.select(F.explode(F.map_keys("fields")).alias("k")).distinct().collect()}  # bounded by the kinds of fields
    names = tuple(c for c in FIRST_FIELDS if c in known) + tuple(sorted(known - set(FIRST_FIELDS)))
    return KnowledgeGraph(vault.nodes_of(parsed, names), vault.edges_of(parsed))


def round_trip(files: DataFrame, graph: KnowledgeGraph, parsed: DataFrame) -> DataFrame:
    """Files that stand elsewhere than their node is written to (an error in another folder), and texts that are written differently."""
    own = parsed.filter("error is null").select(F.col("path").alias("file"), "id").join(files.select(F.col("path").alias("file"), "content"), "file")
    once = own.join(own.groupBy("id").agg(F.count("*").alias("n")).filter("n = 1"), "id", "left_semi")  # repeated ids are told by another rule
    single = KnowledgeGraph(graph.nodes.join(once.select("id"), "id", "left_semi"), graph.edges)
    made = vault.render_files(single).withColumn("id", F.get(vault_id(F.col("content")), F.lit(0)))
    both = once.join(made.select("id", F.col("path").alias("to"), F.col("content").alias("canonical")), "id").withColumn("at", _place(F.col("file")))
    moved = both.filter("at <> to")
    same_folder = F.substring_index("at", "/", 1) == F.substring_index("to", "/", 1)
    return report(
        finding(moved.filter(~same_folder), "id-path-consistency", "file", detail=F.col("to")),
        finding(moved.filter(same_folder), "id-path-consistency", "file", "warn", detail=F.col("to")),
        finding(both.filter((F.col("at") == F.col("to")) & (_text(F.col("content")) != F.col("canonical"))), "round-trip", "file", "warn"),
    )


def vault_id(content):
    """The quoted id in a rendered file's first lines, unquoted."""
    quoted = F.regexp_extract(content, r'^---\nid: ("(?:[^"\\]|\\.)*")', 1)
    return F.from_json(F.concat(F.lit("["), quoted, F.lit("]")), "array<string>")


def vault_report(files: DataFrame, preset: Preset, entries: DataFrame | None = None, bad_lines: DataFrame | None = None, uncommitted: DataFrame | None = None) -> DataFrame:
    """finding(rule, severity, subject_id, detail, n) of the files (path, content) of a vault.

    Unreadable files, repeated ids, misplaced files, loose and malformed ends,
    the schema's rules, and texts that differ from how they are written. Of the
    ledger, ids that live again (``entries``) and lines that are none
    (``bad_lines``: line). ``uncommitted`` (path): files that a version control
    holds for changed, as a write leaves them that broke off.
    """
    parsed = vault.parse_files(files)
    good = parsed.filter("error is null")
    graph = graph_of(parsed)
    ids = good.select("id").distinct()
    ends = graph.edges
    crossing = F.coalesce(F.col("dst").startswith("vault:"), F.lit(False))
    repeated = good.groupBy("id").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("path")), ", ").alias("files")).filter("n > 1")
    parts = [
        finding(parsed.filter("error is not null"), "import-parse", "path", detail=F.col("error")),
        finding(repeated, "duplicate-node-ids", "id", detail=F.col("files"), n="n"),
        round_trip(files, graph, parsed),
        finding(ends.filter(~crossing).join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti"), "edge-endpoints", "id", detail=F.concat(F.lit("to: "), F.coalesce("dst", F.lit("")))),
        finding(ends.filter(crossing & ~F.col("dst").rlike(_REF)), "edge-endpoints", "id", detail=F.concat(F.lit("malformed: "), "dst")),
        validate(graph.nodes.withColumns({c: F.lit(None).cast("string") for c in ("state", "title") if c not in graph.nodes.columns}), graph.edges, preset),
    ]
    if entries is not None:
        parts.append(finding(entries.select("id").distinct().join(ids, "id", "left_semi"), "tombstones", "id", "warn"))
    if bad_lines is not None:
        parts.append(finding(bad_lines, "tombstones", F.substring("line", 1, 200)))
    if uncommitted is not None:
        parts.append(finding(uncommitted, "uncommitted", "path"))
    return report(*parts)


def index_report(nodes: DataFrame, index: DataFrame, info: IndexInfo) -> DataFrame:
    """Of a vector index: nodes without a row, rows without a node, rows of another text, vectors of another size."""
    texts = nodes.select(F.col("id").alias("node_id"), F.sha2(F.concat(F.lit(info.document_prefix), node_text(nodes)).cast("binary"), 256).alias("now"))
    return report(
        finding(texts.join(index.select("node_id"), "node_id", "left_anti"), "index-missing", "node_id"),
        finding(index.join(texts.select("node_id"), "node_id", "left_anti"), "index-orphan", "node_id"),
        finding(index.join(texts, "node_id").filter("text_hash <> now"), "index-stale", "node_id", "warn"),
        finding(index.filter(F.size("vector") != info.dimensions), "index-dimensions", "node_id", detail=F.size("vector").cast("string")),
    )
