"""Small configuration files: environment files, worlds, exemptions, profiles, plans."""

from __future__ import annotations

import datetime
import hashlib
import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NODE_CHANGE = "op string, id string, type string, title string, summary string, description string, path string, state string, aliases array<string>, raw_content string, enforcement string, enforcement_reason string, certainty string, nulls array<string>"
EDGE_CHANGE = "op string, id string, type string, src string, dst string"


def parse_env(text: str) -> dict[str, str]:
    """KEY=value lines; ``export`` and quotes are dropped, comments and other lines skipped."""
    out = {}
    for line in text.splitlines():
        m = re.match(r"\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(.*?)\s*$", line)
        if m:
            value = m[2]
            out[m[1]] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value
    return out


def parse_world(raw: str) -> list[dict]:
    """[{path, slug}] of {"vaults": [path or {path, slug}]}; ValueError for anything else."""
    world = json.loads(raw)
    if not isinstance(world, dict) or not isinstance(world.get("vaults"), list):
        raise ValueError("a world is an object with a list of vaults")
    out = []
    for v in world["vaults"]:
        v = {"path": v} if isinstance(v, str) else v
        if not isinstance(v, dict) or not isinstance(v.get("path"), str) or set(v) - {"path", "slug"}:
            raise ValueError(f"not a vault: {v!r}")
        out.append({"path": v["path"], "slug": v.get("slug"), "remote": is_remote(v["path"])})
    if len({v["path"] for v in out}) < len(out):
        raise ValueError("a vault is listed twice")
    return out


def is_remote(path: str) -> bool:
    return bool(re.match(r"[a-z][a-z0-9+.-]*://|git@", path))


@dataclass(frozen=True)
class Exemptions:
    allowed: tuple[tuple[str, str, str], ...] = ()
    errors: tuple[str, ...] = field(default=())

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.allowed), "path string, reason string, date string")

    def add(self, path: str, reason: str, date: str) -> Exemptions:
        return parse_exemptions(json.dumps({"allowed_orphans": [{"path": p, "reason": r, "date": d} for p, r, d in (*self.allowed, (path, reason, date))]}))

    def remove(self, path: str) -> Exemptions:
        return Exemptions(tuple(x for x in self.allowed if x[0] != path), self.errors)


def parse_exemptions(raw: str) -> Exemptions:
    """Literal paths with a reason and a date, each once; what is wrong comes back as errors."""
    try:
        entries = json.loads(raw)["allowed_orphans"]
        assert isinstance(entries, list)
    except (ValueError, KeyError, TypeError, AssertionError):
        return Exemptions(errors=("no list allowed_orphans",))
    good, errors, seen = [], [], set()
    for e in entries:
        path, reason, date = (str(e.get(k) or "").strip() if isinstance(e, dict) else "" for k in ("path", "reason", "date"))
        try:
            datetime.date.fromisoformat(date)
        except ValueError:
            errors.append(f"{path}: no date")
            continue
        wrong = "no path" if not path else "a pattern, not a path" if re.search(r"[*?\[\]{}]", path) else "no reason" if not reason else "listed twice" if path in seen else ""
        if wrong:
            errors.append(f"{path}: {wrong}")
        else:
            seen.add(path)
            good.append((path, reason, date))
    return Exemptions(tuple(good), tuple(errors))


def profile_columns(content: Column) -> dict[str, Column]:
    """name, parent, schema, vault_slug, slug_aliases and description of a profile's text."""
    text = F.regexp_replace(content, "\r\n?", "\n")
    front = F.regexp_extract(text, r"(?s)^---\n(.*?)\n---", 1)

    def value(key: str) -> Column:
        raw = F.regexp_extract(front, rf"(?m)^{key}:[ \t]*\"?([^\"\n]*?)\"?[ \t]*$", 1)
        return F.when(raw != "", raw)

    aliases = F.regexp_extract(front, r"(?m)^vault_slug_aliases:[ \t]*\[([^\]\n]*)\]", 1)
    return {
        "name": value("name"), "parent": value("parent"), "schema": F.coalesce(value("schema"), F.lit("system")), "vault_slug": value("vault_slug"),
        "slug_aliases": F.filter(F.transform(F.split(aliases, ","), lambda x: F.trim(F.translate(x, "\"'", ""))), lambda x: x != ""),
        "description": F.regexp_replace(F.regexp_replace(text, r"(?s)^---\n.*?\n---", ""), r"^\s+|\s+$", ""),
    }


def read_profiles(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, name, parent, schema, vault_slug, slug_aliases, description, modified) of profile files."""
    files = spark.read.text(pattern, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"), "value")
    return files.select("path", *(c.alias(n) for n, c in profile_columns(F.col("value")).items()), "modified")


def load_plan(spark: SparkSession, raw: str) -> dict:
    """reason, node and edge changes and successors of a plan's JSON; ValueError if it is no plan."""
    plan = json.loads(raw)
    if not isinstance(plan, dict) or not isinstance(plan.get("reason", ""), str):
        raise ValueError("a plan is an object with a reason")
    nodes, edges = [], []
    names = [f.split()[0] for f in NODE_CHANGE.split(", ")]
    for item in plan.get("nodes", []):
        own = {**item, **item.get("updates", {})}
        op = own.get("op", "create")
        if op not in ("create", "update", "delete") or not own.get("id"):
            raise ValueError(f"not a node change: {item!r}")
        own |= {"op": op, "nulls": [k for k, v in own.items() if v is None]}
        nodes.append(tuple(own.get(k) for k in names))
    for item in plan.get("edges", []):
        op = item.get("op", "create")
        if op not in ("create", "update", "delete") or not item.get("id"):
            raise ValueError(f"not an edge change: {item!r}")
        edges.append((op, item["id"], item.get("type"), item.get("from"), item.get("to")))
    successors = [(s["old"], s["new"]) for s in plan.get("successors", [])]
    return {
        "reason": plan.get("reason", ""),
        "nodes": spark.createDataFrame(nodes, NODE_CHANGE),
        "edges": spark.createDataFrame(edges, EDGE_CHANGE),
        "successors": spark.createDataFrame(successors, "old string, new string"),
        "duplicate_ack": list(plan.get("duplicate_ack", [])),
    }


def vault_mode(local: dict[str, str], inherited: dict[str, str], name: str = "VAULT_MODE") -> tuple[str | None, str]:
    """(mode, whence): readonly or direct, from the folder's own settings (local) or from those above it (inherited).

    Values that aren't known count as unset (none).
    """
    for whence, settings in (("local", local), ("inherited", inherited)):
        if settings.get(name) in ("readonly", "direct"):
            return settings[name], whence
    return None, "none"


def assert_write_allowed(mode: str | None, whence: str, external: bool) -> None:
    """PermissionError where writing to a vault is not wanted: a readonly one, or one outside without a mode decided here."""
    if mode == "readonly":
        raise PermissionError("the vault is set to readonly")
    if external and (mode is None or whence != "local"):
        raise PermissionError("the vault lies outside: set its mode to direct or readonly in this folder first")


def index_paths(vault: str, explicit: str | None, mode: str | None, own_cache: str, exists) -> tuple[str, str]:
    """(read, write) folders of a vault's index.

    An explicit one is both. Else the index is in the vault's cache, or where
    it used to be if only that exists; a readonly vault's is written to the
    reader's own cache and read from there once it exists.
    """
    if explicit:
        return explicit, explicit
    base = vault.rstrip("/")
    now, old = f"{base}/.cache/vectors", f"{base}/.vectors"
    read = now if exists(now) or not exists(old) else old
    if mode != "readonly":
        return read, now
    own = f"{own_cache.rstrip('/')}/{hashlib.sha256(base.encode()).hexdigest()[:16]}/vectors"
    return (own if exists(own) or not exists(read) else read), own
