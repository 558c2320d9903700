"""Connected components by union-find.

Each task contracts the links it holds with a union-find forest of its own, so that every node has one link, to a smaller one. The links are then dealt by their larger end and contracted again, a shuffle a round, until no node is left with two smaller neighbours: what merged at a node becomes a link between its neighbours, so the largest nodes of a component drop out of the work round by round. The links are a forest then, and pointers jump to their targets' targets until all point at roots.

Rows are dealt by their larger end, of which a task hands on one row a node: a node with millions of links costs a receiving task no more than a row for each sending one. Rounds are written to the shared folder; no node's links are ever brought together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete, shared_dir, written

#: Links a task holds before it contracts them; nodes of a forest that it then goes on with, at most, while links are not dealt yet; links dealt to a task, on average.
HELD, KEPT, DEALT = 1_000_000, 500_000, 250_000


def union(a: np.ndarray, b: np.ndarray) -> dict[int, int]:
    """Each node's smallest connected node."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = root(x), root(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
    return {x: root(x) for x in parent}


def _forest(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes of links (x, y), their least connected nodes, and whether that is not just what a node's links said."""
    found = union(x, y)
    nodes, roots = np.fromiter(found, np.int64, len(found)), np.fromiter(found.values(), np.int64, len(found))
    order = np.argsort(nodes)
    nodes, roots = nodes[order], roots[order]
    x, y = x[x != y], y[x != y]
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    least, most, said = np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int64), np.zeros(len(nodes), bool)
    if len(x):
        first = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
        at = np.searchsorted(nodes, x[first])
        said[at], least[at], most[at] = True, np.minimum.reduceat(y, first), np.maximum.reduceat(y, first)
    return nodes, roots, (nodes != roots) & ~(said & (least == roots) & (most == roots))


def _contract(batches, most: float = float("inf")):
    """Links (a, b) as stars: each node with its least connected one, roots with themselves; changed says that a node had another link before. A task with more than most nodes may hand on several links of a node."""
    a, b, held, marks = [], [], 0, [np.zeros(0, np.int64)]
    for batch in batches:
        a.append(batch.column("a").to_numpy())
        b.append(batch.column("b").to_numpy())
        held += batch.num_rows
        if held > HELD:
            nodes, roots, changed = _forest(np.concatenate(a), np.concatenate(b))
            marks.append(nodes[changed])
            a, b, held = [nodes], [roots], len(nodes)
            if held > most:  # no longer shrinking: hand on what there is
                yield _rows(nodes, roots, np.isin(nodes, np.concatenate(marks)))
                a, b, held, marks = [], [], 0, [np.zeros(0, np.int64)]
    if held:
        nodes, roots, changed = _forest(np.concatenate(a), np.concatenate(b))
        yield _rows(nodes, roots, changed | np.isin(nodes, np.concatenate(marks)))


def _rows(nodes: np.ndarray, roots: np.ndarray, changed: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots), pa.array(changed)], ["a", "b", "changed"])


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b: longs, not null); root is the component's smallest node. Links of a node to itself make it a component; an empty table gives an empty one."""
    spark = links.sparkSession
    base, shape = shared_dir(spark), "a long, b long, changed boolean"
    links = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    edges, step = written(links.mapInArrow(lambda batches: _contract(batches, KEPT), shape), f"{base}/0"), 0
    parts = max(1, -(-edges.count() // DEALT))
    while True:
        step += 1
        edges = written(edges.select("a", "b").repartition(parts, "a").mapInArrow(_contract, shape), f"{base}/{step}")
        delete(spark, f"{base}/{step - 1}")
        if edges.where("changed").isEmpty():
            break
    # a forest: one link to a smaller node each, besides roots' links to themselves
    edges = edges.groupBy("a").agg(F.min("b").alias("b"))
    while True:
        above = edges.where("a != b").select(F.col("a").alias("b"), F.col("b").alias("up"))
        step += 1
        edges = written(edges.join(above, "b", "left").select("a", F.coalesce("up", "b").alias("b"), F.col("up").isNotNull().alias("changed")), f"{base}/{step}")
        delete(spark, f"{base}/{step - 1}")
        if edges.where("changed").isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
