"""Bounded traversal, iterative label propagation, depths and chains over edge DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import drop_table, shared_checkpoint, shared_table

#: Rounds of label propagation in one job, after which labels are kept, and links of a task in it.
TOGETHER, DEALT = 5, 500_000

# Which edge types come first when neighbours are capped; others rank 50.
EDGE_PRIORITY = {"supersedes": 0, "refines": 1, "has_premise": 2, "sets_policy_for": 3, "constrains": 4, "discussed_in": 90, "documented_by": 91}


def edge_priority(edge_type: Column) -> Column:
    out = F.lit(50)
    for name, rank in EDGE_PRIORITY.items():
        out = F.when(edge_type == name, rank).otherwise(out)
    return out


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge from either end: (id, type, node, other)."""
    return edges.select("id", "type", F.col("src").alias("node"), F.col("dst").alias("other")).union(edges.filter("src <> dst").select("id", "type", "dst", "src"))


def khop_distance(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(id, distance): nodes within ``hops`` undirected steps of ``seeds`` (id).

    Each step joins the frontier only, and nodes already reached are dropped
    before the next.
    """
    links = both_ways(edges).select("node", "other").distinct()
    reached = seeds.select("id").distinct().withColumn("distance", F.lit(0))
    frontier = reached
    for step in range(1, hops + 1):
        near = links.join(frontier.select(F.col("id").alias("node")), "node", "left_semi").select(F.col("other").alias("id")).distinct()
        frontier = near.join(reached, "id", "left_anti").withColumn("distance", F.lit(step))
        if step < hops:
            frontier = shared_checkpoint(frontier)
        reached = reached.unionByName(frontier)
    return reached


def neighbors_capped(edges: DataFrame, seeds: DataFrame, depth: int = 1, per_node: int = 10, total: int = 40) -> DataFrame:
    """Edges met from ``seeds`` in ``depth`` rounds: id, type, src, dst, depth.

    Each round every frontier node takes its first ``per_node`` edges by type
    priority and id that were not taken before; an edge counts once, and
    ``total`` edges end the search, in the order of rounds, nodes and ranks.
    """
    around = both_ways(edges)
    frontier, taken = seeds.select(F.col("id").alias("node")).distinct(), None
    for step in range(1, depth + 1):
        open_edges = around if taken is None else around.join(taken.select("id"), "id", "left_anti")
        order = Window.partitionBy("node").orderBy(edge_priority(F.col("type")), "id")
        got = open_edges.join(frontier, "node", "left_semi").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= per_node)
        once = got.groupBy("id", "type").agg(F.min(F.struct("node", "rank", "other")).alias("m")).select("id", "type", F.col("m.node").alias("node"), F.col("m.other").alias("other"), F.col("m.rank").alias("rank"), F.lit(step).alias("depth"))
        taken = once if taken is None else taken.unionByName(once)
        taken = shared_checkpoint(taken.orderBy("depth", "node", "rank", "id").limit(total))
        frontier = taken.filter(F.col("depth") == step).select(F.col("other").alias("node")).distinct()
    return taken.join(edges, ["id", "type"]).select("id", "type", "src", "dst", "depth")


def neighbors_of_each(edges: DataFrame, seeds: DataFrame, depth: int = 1, per_node: int = 10, total: int = 40) -> DataFrame:
    """:func:`neighbors_capped` of every seed alone, in one plan: seed, id, type, src, dst, depth.

    Every seed has its own visited edges and its own ``total``; edge ids are
    unique. A seed takes ``total`` edges at most, so what any seed can take
    from a node is among the node's first ``per_node + total``: hubs are cut to
    these before seeds meet them, and rows stay in proportion to the seeds.
    """
    first = Window.partitionBy("node").orderBy(edge_priority(F.col("type")), "id")
    around = both_ways(edges).withColumn("place", F.row_number().over(first)).filter(F.col("place") <= per_node + total)
    if depth > 1:
        around = shared_checkpoint(around)
    frontier = seeds.filter("id is not null").select(F.col("id").alias("seed"), F.col("id").alias("node")).distinct()
    taken = None
    for step in range(1, depth + 1):
        open_edges = frontier.join(around, "node")
        if taken is not None:
            open_edges = open_edges.join(taken.select("seed", "id"), ["seed", "id"], "left_anti")
        got = open_edges.withColumn("rank", F.row_number().over(Window.partitionBy("seed", "node").orderBy("place"))).filter(F.col("rank") <= per_node)
        once = got.groupBy("seed", "id").agg(F.min(F.struct("node", "rank", "other")).alias("m")).select("seed", "id", "m.node", "m.other", "m.rank", F.lit(step).alias("depth"))
        everything = once if taken is None else taken.unionByName(once)
        order = Window.partitionBy("seed").orderBy("depth", "node", "rank", "id")
        taken = shared_checkpoint(everything.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= total).drop("k"))
        frontier = taken.filter(F.col("depth") == step).select("seed", F.col("other").alias("node")).distinct()
    return taken.select("seed", "id", "depth").join(edges.select("id", "type", "src", "dst"), "id").select("seed", "id", "type", "src", "dst", "depth")


def linked_nodes(edges: DataFrame, nodes: DataFrame, ids: DataFrame, edge_type: str | None = None, node_type: str | None = None, limit: int = 5) -> DataFrame:
    """Up to ``limit`` one-step neighbours of each id: id, other, edge_type."""
    around = both_ways(edges if edge_type is None else edges.filter(F.col("type") == edge_type)).join(ids.select(F.col("id").alias("node")), "node", "left_semi")
    kinds = nodes.select(F.col("id").alias("other"), F.col("type").alias("node_type"))
    found = around.join(kinds, "other") if node_type is None else around.join(kinds.filter(F.col("node_type") == node_type), "other")
    order = Window.partitionBy("node").orderBy(edge_priority(F.col("type")), "other", "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select(F.col("node").alias("id"), "other", F.col("type").alias("edge_type"), "rank")


def label_propagation(links: DataFrame, rounds: int = 10) -> DataFrame:
    """(node, label) after synchronous rounds over undirected (a, b): the most frequent neighbour label, the smallest of ties.

    Links are read once and kept as a table of either direction; several rounds
    are one job, in which that table is dealt once. The distributed variant; see
    :func:`label_propagation_exact` for the order-dependent one.
    """
    ends = F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    table = shared_table(links.filter("a <> b").select(ends).distinct())
    parts = max(links.sparkSession.sparkContext.defaultParallelism, -(-table.count() // DEALT))
    around = table.repartition(parts, "b")
    labels = around.select(F.col("b").alias("node")).distinct().withColumn("label", F.col("node"))
    for done in range(1, rounds + 1):
        heard = around.join(labels, around["b"] == labels["node"]).select(F.col("a").alias("node"), "label").repartition(parts, "node")
        votes = heard.groupBy("node", "label").agg(F.count("*").alias("n")).groupBy("node", "n").agg(F.min("label").alias("label"))
        labels = votes.groupBy("node").agg(F.max_by("label", "n").alias("label"))
        if done % TOGETHER == 0 and done < rounds:
            labels = shared_checkpoint(labels)
    labels = shared_checkpoint(labels)
    drop_table(table)
    return labels


def label_propagation_exact(links: DataFrame, graph_col: str, rounds: int = 30, hub_nodes: int = 25, hub_share: float = 0.12) -> DataFrame:
    """Asynchronous propagation in sorted node order, one graph per task: (graph_col, node, label).

    Rows are (graph_col, a, b); a null end links nothing. In graphs of
    ``hub_nodes`` or more nodes those of degree above both mean + 2 deviations
    and ``hub_share`` of all are left out of the votes. After its first vote a
    node votes again only where a neighbour has moved since, which changes no
    outcome. A graph must fit one worker.
    """

    def solve(pdf):
        import numpy as np
        import pandas as pd

        graph, pdf = pdf[graph_col].iloc[0], pdf[pdf["a"] != pdf["b"]]
        names, ends = np.unique(np.concatenate([pdf["a"].to_numpy(), pdf["b"].to_numpy()]), return_inverse=True)
        count, (a, b) = len(names), ends.reshape(2, -1)
        a, b = np.divmod(np.unique(np.concatenate([a * count + b, b * count + a])), max(count, 1))
        if count >= hub_nodes:
            degrees = np.bincount(a, minlength=count).tolist()
            mean = sum(degrees) / count
            cut = max(mean + 2 * (sum((d - mean) ** 2 for d in degrees) / count) ** 0.5, hub_share * count)
            hub = np.array(degrees) > cut
            a, b = a[kept := ~(hub[a] | hub[b])], b[kept]
        starts, flat = np.searchsorted(a, np.arange(count + 1)).tolist(), b.tolist()
        near = [flat[i:j] for i, j in zip(starts, starts[1:], strict=False)]
        label, due, moved = list(range(count)), bytearray(map(bool, near)), True
        for _ in range(rounds):
            if not moved:
                break
            moved, x = False, due.find(1)
            while x >= 0:
                due[x] = 0
                votes: dict = {}
                for y in near[x]:
                    votes[label[y]] = votes.get(label[y], 0) + 1
                most = max(votes.values())
                best = min(v for v, n in votes.items() if n == most)
                if best != label[x]:
                    label[x], moved = best, True
                    for y in near[x]:
                        due[y] = 1
                x = due.find(1, x + 1)
        return pd.DataFrame({graph_col: graph, "node": names, "label": names[label]})

    kind = links.schema[graph_col].dataType.simpleString()
    node = links.schema["a"].dataType.simpleString()
    # As many partitions as a shuffle has, whatever their sizes: graphs are small, but their work is not.
    dealt = links.select(graph_col, "a", "b").filter("a is not null and b is not null").repartition(int(links.sparkSession.conf.get("spark.sql.shuffle.partitions")), graph_col)
    return dealt.groupBy(graph_col).applyInPandas(solve, f"{graph_col} {kind}, node {node}, label {node}")


def _longest(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of distinct links (src, dst): (id, depth) of the nodes that reach no cycle, and the others (id).

    A round replaces the links to a node whose depth is known by a least depth
    of their source, and leads links to a node with one link left on to that
    one's end, with both lengths. So straight stretches shrink by doubling, and
    rounds grow with the branching layers rather than with the path. On a cycle
    the lengths pass the number of nodes, which no path can.
    """
    links = shared_checkpoint(links.select("src", "dst", F.lit(1).cast("long").alias("w")))
    base = shared_checkpoint(links.select(F.col("src").alias("id")).union(links.select("dst")).distinct().withColumn("base", F.lit(0).cast("long")))
    most = base.count()
    while True:
        ahead = links.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("k"), F.max(F.struct("dst", F.col("w").alias("on"))).alias("way"))
        known = base.join(ahead, "id", "left").select(F.col("id").alias("dst"), "base", F.coalesce("k", F.lit(0)).alias("k"), F.col("way.dst").alias("next"), F.col("way.on").alias("on"))
        leads = (F.col("k") == 1) & (F.col("on") <= most) & (F.col("next") != F.col("dst"))
        met = shared_checkpoint(links.join(known, "dst").withColumn("leads", leads))
        settled = met.filter("k = 0 or leads")
        if settled.isEmpty():
            left = links.select(F.col("src").alias("id")).distinct()
            return base.join(left, "id", "left_anti").select("id", F.col("base").alias("depth")), left
        least = settled.groupBy(F.col("src").alias("id")).agg(F.max(F.col("w") + F.col("base")).alias("least"))
        base = shared_checkpoint(base.join(least, "id", "left").select("id", F.greatest("base", F.coalesce("least", F.lit(0))).alias("base")))
        on = met.filter("k > 0").select("src", F.when(F.col("leads"), F.col("next")).otherwise(F.col("dst")).alias("dst"), (F.col("w") + F.when(F.col("leads"), F.col("on")).otherwise(0)).alias("w"))
        links = shared_checkpoint(on.groupBy("src", "dst").agg(F.max("w").alias("w")))


def _core(links: DataFrame) -> DataFrame:
    """Of links (src, dst) those between nodes that reach a cycle and are reached from one."""
    for here, there in (("src", "dst"), ("dst", "src")):
        left = shared_checkpoint(_longest(links.select(F.col(here).alias("src"), F.col(there).alias("dst")))[1])
        links = shared_checkpoint(links.join(left.withColumnRenamed("id", "src"), "src", "left_semi").join(left.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst"))
    return links


def _spread(start: DataFrame, links: DataFrame, value: str) -> DataFrame:
    """(id, value): the least value that reaches each id of ``start`` along links (src, dst)."""
    own = shared_checkpoint(start)
    while True:
        sent = links.join(own.select(F.col("id").alias("src"), value), "src").groupBy(F.col("dst").alias("id")).agg(F.min(value).alias("sent"))
        moved = shared_checkpoint(own.join(sent, "id").filter(F.col("sent") < F.col(value)).select("id", "sent"))
        if moved.isEmpty():
            return own
        own = shared_checkpoint(own.join(moved, "id", "left").select("id", F.coalesce("sent", value).alias(value)))


def strong_components(edges: DataFrame) -> DataFrame:
    """(id, part) for every node: nodes on common cycles share a part, named by one of them; others are their own.

    Nodes that no cycle can pass are left out first. Of the rest, each node
    takes the least id that reaches it; the nodes that reach back to the one so
    named are its part. Rounds grow with the longest path inside a part.
    """
    links = shared_checkpoint(edges.select("src", "dst").filter("src is not null and dst is not null").distinct())
    nodes = links.select(F.col("src").alias("id")).union(links.select("dst")).distinct()
    found = None
    core = _core(links.filter("src <> dst"))
    while not core.isEmpty():
        ends = core.select(F.col("src").alias("id")).union(core.select("dst")).distinct()
        color = _spread(ends.select("id", F.col("id").alias("color")), core, "color")
        inside = core.join(color.select(F.col("id").alias("src"), "color"), "src").join(color.select(F.col("id").alias("dst"), F.col("color").alias("other")), "dst").filter("color = other")
        back = shared_checkpoint(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        reached = _spread(color.select("id", F.when(F.col("id") == F.col("color"), 0).otherwise(1).alias("far")), back, "far").filter("far = 0").select("id")
        part = shared_checkpoint(color.join(reached, "id", "left_semi").select("id", F.col("color").alias("part")))
        found = part if found is None else found.unionByName(part)
        gone = part.select("id")
        core = _core(core.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst"))
    return nodes.withColumn("part", F.col("id")) if found is None else nodes.join(found, "id", "left").select("id", F.coalesce("part", "id").alias("part"))


def dependency_depth(edges: DataFrame) -> DataFrame:
    """(id, depth): longest path of src-to-dst edges below each node, however long.

    Edges inside a cycle add nothing: its nodes are as deep as what lies below
    any of them. (A depth-first walk that counts an edge back as 0 would give
    depths that hang on where it starts.)
    """
    links = shared_checkpoint(edges.select("src", "dst").filter("src is not null and dst is not null").distinct())
    own, left = _longest(links.filter("src <> dst"))
    alone = links.select(F.col("src").alias("id")).union(links.select("dst")).distinct()
    if left.isEmpty():
        return alone.join(own, "id", "left").select("id", F.coalesce("depth", F.lit(0)).cast("int").alias("depth"))
    part = shared_checkpoint(strong_components(links))
    named = links.join(part.select(F.col("id").alias("src"), F.col("part").alias("a")), "src").join(part.select(F.col("id").alias("dst"), F.col("part").alias("b")), "dst")
    depths, _ = _longest(named.filter("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct())
    return part.join(depths.withColumnRenamed("id", "part"), "part", "left").select("id", F.coalesce("depth", F.lit(0)).cast("int").alias("depth"))


def depth_bands(depths: DataFrame, bands: int = 4) -> DataFrame:
    """(id, depth, band): equal bands from 0 over the depths met."""
    most = F.broadcast(depths.agg(F.max("depth").alias("most")))
    return depths.join(most, F.lit(True)).select("id", "depth", F.least(F.floor(F.col("depth") * bands / (F.col("most") + 1)), F.lit(bands - 1)).cast("int").alias("band"))


def successor_chain(successors: DataFrame) -> DataFrame:
    """(id, final, steps, cyclic) of (id, successor): where following successors ends, however far.

    A null or unlisted successor ends a chain. Pointers double their reach each
    round until none of them comes to an end any more: those that are still
    under way then go round in circles. So rounds are logarithmic in the longest
    chain. Only pointers under way take part in a round's join.
    """
    base = successors.select("id", "successor").filter("id is not null")
    last = F.col("successor").isNull()
    at = shared_checkpoint(base.select("id", F.coalesce("successor", "id").alias("final"), F.when(last, 0).otherwise(1).cast("long").alias("steps"), (~last).alias("going")))
    going, before = at.filter("going").count(), None
    while going and going != before:
        jump = at.select(F.col("id").alias("final"), F.col("final").alias("next"), F.col("steps").alias("more"), F.col("going").alias("further"))
        moved = at.filter("going").join(jump, "final", "left").select(
            "id", F.coalesce("next", "final").alias("final"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.coalesce("further", F.lit(False)).alias("going")
        )
        at = shared_checkpoint(at.filter("not going").unionByName(moved))
        before, going = going, at.filter("going").count()
    return at.select("id", F.when(~F.col("going"), F.col("final")).alias("final"), F.when(~F.col("going"), F.col("steps")).alias("steps"), F.col("going").alias("cyclic"))
