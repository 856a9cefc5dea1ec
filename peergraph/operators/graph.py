"""Cycles and layers of directed graphs given as edge tables (a, b) of text.

Weakly connected components split a graph over tasks in a logarithmic number of rounds; what can't lie on a cycle is
trimmed before that, set by set. A component of at most ``most_edges`` edges is searched in one task by an iterative
depth-first search in integer arrays; a larger one by rounds of joins over all tasks, as many as its paths are long, with
the same result. Results don't depend on how rows are dealt.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import set_key
from ..session import cut
from .components import connected_components

#: Edges of one component that a task may hold (as text, some 200 MB); components above it are searched by joins.
MOST_EDGES = 1 << 20
TRIM_ROUNDS = 3


def strong_labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0 to n - 1 the smallest node of each one's strongly connected component."""
    order = np.argsort(a, kind="stable")
    to, at = b[order].tolist(), np.searchsorted(a[order], np.arange(n + 1)).tolist()
    index, low, label = [-1] * n, [0] * n, [-1] * n
    open_, path, count = [], [], 0
    for root in range(n):
        if index[root] >= 0:
            continue
        path.append((root, at[root]))
        index[root] = low[root] = count
        count += 1
        open_.append(root)
        while path:
            node, i = path[-1]
            if i < at[node + 1]:
                path[-1] = (node, i + 1)
                near = to[i]
                if index[near] < 0:
                    index[near] = low[near] = count
                    count += 1
                    open_.append(near)
                    path.append((near, at[near]))
                elif label[near] < 0:
                    low[node] = min(low[node], index[near])
                continue
            path.pop()
            if path:
                low[path[-1][0]] = min(low[path[-1][0]], low[node])
            if low[node] == index[node]:
                begin = len(open_) - 1
                while open_[begin] != node:
                    begin -= 1
                least = min(open_[begin:])
                for member in open_[begin:]:
                    label[member] = least
                del open_[begin:]
    return np.array(label)


def shortest_cycle(a: np.ndarray, b: np.ndarray, n: int, seed: int) -> list[int]:
    """A shortest cycle through seed, neighbours in ascending order; self loops don't count; empty if there is none."""
    keep = a != b
    pairs = np.unique(np.stack([a[keep], b[keep]]), axis=1)
    to, at = pairs[1].tolist(), np.searchsorted(pairs[0], np.arange(n + 1)).tolist()
    came = {seed: -1}
    queue = deque([seed])
    while queue:
        node = queue.popleft()
        for near in to[at[node] : at[node + 1]]:
            if near == seed:
                path = [node]
                while came[path[-1]] >= 0:
                    path.append(came[path[-1]])
                return path[::-1]
            if near not in came:
                came[near] = node
                queue.append(near)
    return []


def trim(edges: DataFrame, rounds: int = TRIM_ROUNDS) -> DataFrame:
    """Edges without those at nodes that nothing enters or that nothing leaves."""
    now = edges
    for _ in range(rounds):
        now = now.join(now.select(F.col("b").alias("a")), "a", "left_semi").join(now.select(F.col("a").alias("b")), "b", "left_semi")
        now = cut(now.select("a", "b"))
    return now


def _least_reaching(edges: DataFrame) -> DataFrame:
    """(node, colour): the smallest node from which each node of an edge can be reached, itself included."""
    front = label = cut(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("colour", F.col("node")))
    while front.limit(1).count():
        offers = front.join(edges.select(F.col("a").alias("node"), "b"), "node").groupBy(F.col("b").alias("node")).agg(F.min("colour").alias("offer"))
        front = cut(offers.join(label, "node").where("offer < colour").select("node", F.col("offer").alias("colour")))
        label = cut(label.join(front.select("node", F.col("colour").alias("better")), "node", "left").select("node", F.coalesce("better", "colour").alias("colour")))
    return label


def _reaching_back(inner: DataFrame) -> DataFrame:
    """(node, component): the nodes of each colour that reach the colour's own node along edges of the colour (a, b, colour)."""
    front = found = cut(inner.select(F.col("colour").alias("node"), F.col("colour").alias("component")).distinct())
    while front.limit(1).count():
        into = front.join(inner.select(F.col("b").alias("node"), "a"), "node").select(F.col("a").alias("node"), "component").distinct()
        front = cut(into.join(found, "node", "left_anti"))
        found = cut(found.unionByName(front))
    return found


def strong_by_joins(edges: DataFrame) -> DataFrame:
    """(node, component) for edges of any number: colours of least reaching nodes, then what reaches back, until no edge is left.

    A component's nodes have one colour, and the node of that name is in the component: its least.
    """
    left, found = edges, []
    while left.limit(1).count():
        colours = _least_reaching(left)
        both = left.join(colours.select(F.col("node").alias("a"), "colour"), "a").join(colours.select(F.col("node").alias("b"), F.col("colour").alias("other")), "b")
        inner = cut(both.where("colour = other").select("a", "b", "colour"))
        done = _reaching_back(inner)
        found.append(done)
        gone = done.select("node")
        rest = inner.join(gone.withColumnRenamed("node", "a"), "a", "left_anti").join(gone.withColumnRenamed("node", "b"), "b", "left_anti")
        left = trim(rest.select("a", "b"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _split(rows: DataFrame, key: str, most: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of keys with at most ``most`` rows, and the others (None if there are none). The keys above are at most rows / most in number."""
    above = cut(rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > most).select(key))
    if not above.limit(1).count():
        return rows, None
    return rows.join(above, key, "left_anti"), rows.join(above, key, "left_semi")


def strongly_connected(edges: DataFrame, least: int = 2, most_edges: int | None = None) -> DataFrame:
    """(node, component): components of at least ``least`` nodes, named by their smallest node.

    Null ends are no edges and self loops make no cycle. With least = 1 every node of an edge is in a component. Weak
    components of more than ``most_edges`` edges (MOST_EDGES) are searched by joins.
    """
    clean = cut(edges.select("a", "b").where("a is not null and b is not null and a <> b").distinct())
    core = trim(clean)
    parts = connected_components(core)
    dealt = cut(core.join(parts.select(F.col("node").alias("a"), "root"), "a"))
    dealt, large = _split(dealt, "root", MOST_EDGES if most_edges is None else most_edges)

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        nodes, codes = np.unique(np.concatenate([rows["a"].to_numpy(object), rows["b"].to_numpy(object)]), return_inverse=True)
        label = strong_labels(codes[: len(rows)], codes[len(rows) :], len(nodes))
        return pd.DataFrame({"node": nodes, "component": nodes[label]})

    found = dealt.groupBy("root").applyInPandas(search, "node string, component string")
    if large is not None:
        found = found.unionByName(strong_by_joins(large.select("a", "b")))
    if least == 1:
        every = edges.select(F.explode(F.array("a", "b")).alias("node")).where("node is not null").distinct()
        return every.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    big = found.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return found.join(big, "component").select("node", "component")


def paths_by_joins(inner: DataFrame) -> DataFrame:
    """(component, members, path) of strong components of any size, given as (component, a, b): see shortest_cycle.

    Level by level; of several ways to a node the one that comes first in order stays, which is the one that a queue
    with ascending neighbours would take. A component is named by its first member.
    """
    nodes = inner.select("component", F.explode(F.array("a", "b")).alias("node")).distinct()
    members = nodes.groupBy("component").agg(F.array_sort(F.collect_list("node")).alias("members"))
    front = cut(members.select("component", F.col("component").alias("node"), F.array("component").alias("path")))
    seen, found = front.select("component", "node"), []
    while front.limit(1).count():
        steps = cut(inner.join(front.withColumnRenamed("node", "a"), ["component", "a"]))
        closed = cut(steps.where("b = component").groupBy("component").agg(F.min("path").alias("path")))
        found.append(closed)
        ahead = steps.join(closed.select("component"), "component", "left_anti").join(seen.withColumnRenamed("node", "b"), ["component", "b"], "left_anti")
        front = cut(ahead.groupBy("component", F.col("b").alias("node")).agg(F.min("path").alias("way")).select("component", "node", F.concat("way", F.array("node")).alias("path")))
        seen = cut(seen.unionByName(front.select("component", "node")))
    walks = found[0]
    for f in found[1:]:
        walks = walks.unionByName(f)
    return members.join(walks, "component").select("component", "members", "path")


def cycles(edges: DataFrame, prefix: str, least: int = 2, most_edges: int | None = None) -> DataFrame:
    """(id, size, members, path, path_covers_every_member), largest first: ``rank``.

    Members are in order; the path is a shortest cycle through the first member, among members only.
    """
    most_edges = MOST_EDGES if most_edges is None else most_edges
    found = cut(strongly_connected(edges, least, most_edges))
    ends = edges.select("a", "b").where("a <> b").distinct()
    inner = ends.join(found.select(F.col("node").alias("a"), "component"), "a").join(found.select(F.col("node").alias("b"), F.col("component").alias("other")), "b").where("component = other")
    inner, large = _split(cut(inner.select("component", "a", "b")), "component", most_edges)

    def path(rows: pd.DataFrame) -> pd.DataFrame:
        nodes, codes = np.unique(np.concatenate([rows["a"].to_numpy(object), rows["b"].to_numpy(object)]), return_inverse=True)
        walk = shortest_cycle(codes[: len(rows)], codes[len(rows) :], len(nodes), 0)
        return pd.DataFrame({"component": [rows["component"].iloc[0]], "members": [nodes.tolist()], "path": [nodes[walk].tolist()]})

    rows = inner.groupBy("component").applyInPandas(path, "component string, members array<string>, path array<string>")
    if large is not None:
        rows = rows.unionByName(paths_by_joins(large))
    keys = F.transform("members", lambda m: F.concat(F.lit(f"{prefix}|"), m)) if prefix else F.col("members")
    return rows.select(set_key(keys).alias("id"), F.size("members").alias("size"), "members", "path", (F.size("path") == F.size("members")).alias("path_covers_every_member"))


def layers(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component, layer) of each of nodes (column node): the longest way to a sink; members of a cycle share a layer."""
    found = strongly_connected(edges, 1)
    every = cut(nodes.select("node").distinct().join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component")))
    ends = edges.join(every.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a").join(every.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b")
    above = cut(ends.where("ca <> cb").select("ca", "cb").distinct())
    # peel sinks: a component's layer is the round in which all it depends on are gone
    left, settled, depth = above, None, 0
    names = cut(every.select("component").distinct())
    while True:
        waiting = left.select(F.col("ca").alias("component")).distinct()
        level = cut(names.join(waiting, "component", "left_anti").withColumn("layer", F.lit(depth)))
        settled = level if settled is None else settled.unionByName(level)
        names = cut(names.join(waiting, "component", "left_semi"))
        if not names.limit(1).count():
            break
        left = cut(left.join(level.select(F.col("component").alias("cb")), "cb", "left_anti"))
        depth += 1
        if depth % 32 == 0:
            settled = cut(settled)
    return every.join(settled, "component").select("node", "component", "layer")


def fold(layered: DataFrame, edges: DataFrame) -> DataFrame:
    """Boxes: nodes of a layer with the same dependencies and dependents, and each cycle as one. (projects, depends_on, layer, is_cycle)."""
    sized = layered.join(layered.groupBy("component").agg(F.count("*").alias("n")), "component")
    known = sized.select("node")
    inner = edges.where("a <> b").join(known.withColumnRenamed("node", "a"), "a", "left_semi").join(known.withColumnRenamed("node", "b"), "b", "left_semi").distinct()
    out = inner.groupBy(F.col("a").alias("node")).agg(F.array_sort(F.collect_set("b")).alias("outs"))
    into = inner.groupBy(F.col("b").alias("node")).agg(F.array_sort(F.collect_set("a")).alias("ins"))
    none = F.array().cast("array<string>")
    shaped = sized.join(out, "node", "left").join(into, "node", "left").withColumns({"outs": F.coalesce("outs", none), "ins": F.coalesce("ins", none)})
    cyclic = F.col("n") > 1
    boxed = shaped.groupBy("layer", F.when(cyclic, F.col("component")).alias("cycle"), F.when(~cyclic, F.col("outs")).alias("o"), F.when(~cyclic, F.col("ins")).alias("i")).agg(
        F.array_sort(F.collect_list("node")).alias("projects"), F.array_distinct(F.flatten(F.collect_list("outs"))).alias("all_outs")
    )
    return boxed.select("projects", F.array_sort(F.array_except("all_outs", "projects")).alias("depends_on"), "layer", F.col("cycle").isNotNull().alias("is_cycle"))
