"""Plans for adding one node of a type with its edges, checked against the preset."""

from __future__ import annotations

import re

from ..schema import Preset, get_preset

# Node types by the first part of an id, and what each builder may link.
ID_TYPES = {
    "file": "File", "decision": "Decision", "rejected": "RejectedOption", "constraint": "Constraint", "goal": "Goal", "risk": "Risk", "ok": "OperationalKnowledge", "operational": "OperationalKnowledge",
    "investigation": "Investigation", "chunk": "ConversationChunk", "conversation": "ConversationChunk", "layer": "Layer", "stratum": "Layer", "concern": "Concern", "vein": "Concern", "component": "Component",
    "pocket": "Component", "deliverable": "Deliverable", "source": "Source", "theme": "Theme", "stakeholder": "Stakeholder", "resource": "Resource", "milestone": "Milestone", "assumption": "Assumption",
    "agreement": "Agreement", "task": "Task",
}
PREFIX = {t: p for p, t in reversed(ID_TYPES.items())}
PROJECT_ONLY = ("Stakeholder", "Resource", "Milestone", "Assumption", "Agreement", "Task", "Source", "Theme")
SEGMENT = r"[a-z0-9][a-z0-9._-]*"


def node_type(node_id: str) -> str | None:
    return ID_TYPES.get(node_id.split(":", 1)[0])


def edge_id(src: str, edge_type: str, dst: str) -> str:
    return f"{src.replace(':', '_')}__{edge_type}__{dst.replace(':', '_')}"


def build_add(kind: str, system: str, slug: str, title: str, summary: str, links: dict[str, list[str]] | None = None, incoming: dict[str, list[str]] | None = None, preset: Preset | None = None, **fields) -> dict:
    """A plan that creates one node with edges to ``links`` and from ``incoming`` (edge type to ids).

    ValueError for a bad id, an edge that the preset doesn't allow, a
    Constraint that is neither enforced nor declared unenforceable (or both), a
    RejectedOption that nothing supersedes, an Assumption without a known
    certainty, and project types in another preset.
    """
    preset = preset or get_preset("project" if kind in PROJECT_ONLY else "system")
    links, incoming = links or {}, incoming or {}
    if kind not in preset.node_types:
        raise ValueError(f"{preset.id} has no {kind}")
    for part in (system, slug):
        if not re.fullmatch(SEGMENT, part):
            raise ValueError(f"not an id segment: {part!r}")
    own = f"{PREFIX[kind]}:{system}:{slug}"
    if kind == "Constraint" and bool(links.get("enforced_by")) == (fields.get("enforcement") == "none"):
        raise ValueError("a Constraint has an enforcer, or says that it can have none")
    if kind == "Constraint" and fields.get("enforcement") == "none" and not fields.get("enforcement_reason"):
        raise ValueError("why it can't be enforced is missing")
    if kind == "RejectedOption" and not incoming.get("supersedes"):
        raise ValueError("a RejectedOption needs what was chosen instead")
    for name, values in preset.required.get(kind, {}).items():
        if fields.get(name) not in values:
            raise ValueError(f"{name} is one of {', '.join(values)}")
    state = fields.get("state")
    if state is not None and state not in preset.states.get(kind, ()):
        raise ValueError(f"{kind} has no state {state}")
    edges = []
    pairs = [(own, e, x) for e, ids in links.items() for x in ids] + [(x, e, own) for e, ids in incoming.items() for x in ids]
    for src, edge_type, dst in dict.fromkeys(pairs):
        a, b = node_type(src), node_type(dst)
        if not dst.startswith("vault:") and (a is None or b is None or not preset.allows(edge_type, a, b)):
            raise ValueError(f"{edge_type} doesn't lead from {a} to {b}")
        edges.append({"op": "create", "id": edge_id(src, edge_type, dst), "type": edge_type, "from": src, "to": dst})
    node = {"op": "create", "id": own, "type": kind, "title": title, "summary": summary, **{k: v for k, v in fields.items() if v is not None}}
    return {"reason": f"add {kind} {slug}", "nodes": [node], "edges": edges}


def missing_evidence(plan: dict, known_ids: set[str], paths: set[str]) -> list[dict]:
    """File nodes that the plan's edges name, whose path exists and that the graph lacks."""
    made = {n["id"] for n in plan["nodes"]}
    out = []
    for e in plan["edges"]:
        for end in (e["from"], e["to"]):
            m = re.match(r"file:[^:]*:(.+)$", end)
            if m and m[1] in paths and end not in known_ids | made:
                made.add(end)
                out.append({"op": "create", "id": end, "type": "File", "path": m[1], "title": m[1].rsplit("/", 1)[-1]})
    return out
