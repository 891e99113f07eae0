"""A source tree indexed as a graph: files, their facts, import links, candidate components and layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import code
from .components import connected_components
from .similarity import top_matches
from .traverse import dependency_depth, depth_bands, label_propagation_exact

# Fixed values.
SKIP_DIRS = (".git", "node_modules", "dist", "build", "out", "coverage", ".next", ".turbo", ".cache", "vendor", "target", "__pycache__", ".venv", "venv")
MOST_BYTES = 512 * 1024
EXTENSIONS = ("", ".ts", ".tsx", ".mts", ".js", ".jsx", ".mjs", ".py", "/index.ts", "/index.tsx", "/index.js", "/__init__.py")


def scan_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of text files below ``root``: no large or empty ones, none with a NUL byte, none in skipped folders."""
    base = root.rstrip("/")
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base).filter(F.col("length") < MOST_BYTES)
    tail = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), "^" + "\\Q" + base + "\\E/*", "")
    kept = rows.select(tail.alias("path"), "content").filter(~F.exists(F.split("path", "/"), lambda d: d.isin(*SKIP_DIRS)))
    return kept.filter(~F.contains(F.col("content"), F.lit(bytearray(b"\x00")))).select("path", F.decode("content", "UTF-8").alias("content"))


def file_facts(files: DataFrame, system: str) -> DataFrame:
    """File nodes with language, role, symbols, imports, headings, aliases, hash and a template summary."""
    own = files.withColumn("language", code.language(F.col("path"))).withColumn("role", code.role(F.col("path")))
    lang, text = F.col("language"), F.col("content")
    own = own.select(
        F.concat(F.lit(f"file:{system}:"), file_slug(F.col("path"))).alias("id"), F.lit("File").alias("type"), code.basename(F.col("path")).alias("title"), "path", "language", "role",
        code.symbols(lang, text, "exported").alias("exported_symbols"), code.symbols(lang, text, "local").alias("local_symbols"), code.symbols(lang, text, "imports").alias("imports"),
        F.when(lang == "markdown", code.headings(text)).otherwise(F.array().cast("array<string>")).alias("headings"), F.sha2("content", 256).alias("content_hash"),
    )
    aliases = F.slice(F.array_distinct(F.concat(F.array(code.basename(F.col("path"))), "exported_symbols", "headings")), 1, code.MOST_ALIASES)
    return disambiguated(own.withColumn("aliases", aliases).withColumn("summary", template_summary()).withColumn("summary_provisional", F.lit(True)))


def file_slug(path: Column) -> Column:
    return F.regexp_replace(F.lower(path), r"[^a-z0-9._/-]+", "-")


def disambiguated(nodes: DataFrame) -> DataFrame:
    """Ids that several paths share get ``~`` and eight digits of the path's SHA-1."""
    n = F.count("*").over(Window.partitionBy("id"))
    return nodes.withColumn("_n", n).withColumn("id", F.when(F.col("_n") > 1, F.concat("id", F.lit("~"), F.substring(F.sha1(F.col("path").cast("binary")), 1, 8))).otherwise(F.col("id"))).drop("_n")


def template_summary() -> Column:
    """One line of role, language, and the first symbols, imports and headings."""

    def part(label: str, column: str, most: int) -> Column:
        return F.when(F.size(column) > 0, F.concat(F.lit(f"{label}: "), F.array_join(F.slice(column, 1, most), ", "), F.lit(".")))

    return F.concat_ws(" ", F.concat("path", F.lit(" is "), "role", F.lit(" ("), "language", F.lit(").")), part("API", "exported_symbols", 12), part("Internals", "local_symbols", 10), part("Imports", "imports", 10), part("Headings", "headings", 5))


def change_status(now: DataFrame, before: DataFrame) -> DataFrame:
    """(path, change): new, changed, unchanged or deleted, by content hash."""
    a, b = now.select("path", F.col("content_hash").alias("h")), before.select("path", F.col("content_hash").alias("o"))
    kind = F.when(F.col("o").isNull(), "new").when(F.col("h").isNull(), "deleted").when(F.col("h") == F.col("o"), "unchanged").otherwise("changed")
    return a.join(b, "path", "full_outer").select("path", kind.alias("change"))


def kept_summaries(now: DataFrame, before: DataFrame) -> DataFrame:
    """``now`` with the authored summaries of unchanged files of a trusted earlier index."""
    old = before.filter("not summary_provisional").select("path", F.col("content_hash").alias("_h"), F.col("summary").alias("_s"))
    joined = now.join(old, "path", "left").withColumn("_same", F.coalesce(F.col("content_hash") == F.col("_h"), F.lit(False)))
    return joined.withColumns({"summary": F.when(F.col("_same"), F.col("_s")).otherwise(F.col("summary")), "summary_provisional": F.when(F.col("_same"), False).otherwise(F.col("summary_provisional"))}).drop("_h", "_s", "_same")


def import_links(files: DataFrame) -> DataFrame:
    """(a, b): file paths whose imports lead to another file, by the first extension that exists."""

    def folded(path: Column) -> Column:
        # Folder names as a stack: "." is skipped and ".." takes one away.
        step = lambda acc, x: F.when(x.isin("", "."), acc).when((x == "..") & (F.size(acc) > 0), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, x))
        return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")

    imported = files.select(F.col("path").alias("a"), F.explode("imports").alias("i"))
    target = F.when(F.col("i").startswith("."), folded(F.concat_ws("/", code.dirname(F.col("a")), "i"))).when(F.col("i").rlike("^[@~]/"), F.concat(F.lit("src/"), F.substring("i", 3, 10_000))).otherwise(F.translate("i", ".", "/"))
    stems = F.array(target, F.regexp_replace(target, r"\.[mc]?js$", ""))
    candidates = imported.select("a", "i", F.posexplode(F.flatten(F.transform(stems, lambda s: F.transform(F.array(*map(F.lit, EXTENSIONS)), lambda e: F.concat(s, e))))).alias("rank", "b"))
    there = files.select(F.col("path").alias("b"))
    return candidates.join(there, "b").groupBy("a", "i").agg(F.min_by("b", "rank").alias("b")).filter("a <> b").select("a", "b").distinct()


def component_candidates(files: DataFrame, links: DataFrame, least: int = 3, share: float = 0.7) -> DataFrame:
    """(component, path): import communities; one that no folder has ``share`` of is split by folder."""
    labels = label_propagation_exact(links.withColumn("grp", F.lit(0)), "grp").select(F.col("node").alias("path"), "label")
    own = labels.withColumn("dir", code.dirname(F.col("path")))
    counts = own.groupBy("label", "dir").agg(F.count("*").alias("k"))
    shares = counts.groupBy("label").agg((F.max("k") / F.sum("k")).alias("share"))
    named = own.join(shares, "label").select("path", F.when(F.col("share") >= share, F.col("label")).otherwise(F.concat_ws("#", "label", "dir")).alias("component"))
    size = named.groupBy("component").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return named.join(size, "component", "left_semi").select("component", "path")


def cross_component_in_degree(links: DataFrame, owners: DataFrame) -> DataFrame:
    """(path, n): other components that import a file, two or more; ``owners`` is (component, path)."""
    source, target = owners.select(F.col("path").alias("a"), F.col("component").alias("ca")), owners.select(F.col("path").alias("b"), F.col("component").alias("cb"))
    joined = links.join(source, "a").join(target, "b").filter("ca <> cb")
    return joined.groupBy(F.col("b").alias("path")).agg(F.count_distinct("ca").alias("n")).filter("n >= 2")


def layer_candidates(links: DataFrame, bands: int = 4, least: int = 4) -> DataFrame:
    """(path, band): files by how deep their imports go, those of a cycle alike; small bands are left out."""
    banded = depth_bands(dependency_depth(links.select(F.col("a").alias("src"), F.col("b").alias("dst"))), bands)
    large = banded.groupBy("band").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return banded.join(F.broadcast(large), "band", "left_semi").select(F.col("id").alias("path"), "band")


def concern_hints(vectors: DataFrame, owners: DataFrame, key: str, least: float = 0.85, top: int = 4, size: int = 3) -> DataFrame:
    """(hint, id): groups of similar files of different components; vectors (id, key, vector), owners (id, component)."""
    near = top_matches(vectors, vectors, key, least, top)
    ca, cb = owners.select("id", F.col("component").alias("ca")), owners.select(F.col("id").alias("match"), F.col("component").alias("cb"))
    crossing = near.join(ca, "id").join(cb, "match").filter("ca <> cb")
    groups = connected_components(crossing, "id", "match").select(F.col("node").alias("id"), F.col("component").alias("hint"))
    sizes = groups.join(owners, "id").groupBy("hint").agg(F.count("*").alias("n"), F.count_distinct("component").alias("parts")).filter((F.col("n") >= size) & (F.col("parts") >= 2))
    return groups.join(sizes, "hint", "left_semi").select("hint", "id")
