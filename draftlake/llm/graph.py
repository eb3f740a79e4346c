"""Connected components: numpy inside a task, joins across tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftlake.llm.common import Scratch


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for the components of a task's edges; the root is the smallest value.

    Rows where node == root are left out, so there are fewer links than nodes.
    """
    nodes, pair = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = pair[: len(u)], pair[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while not np.array_equal(further := label[label], label):
            label = further
        if np.array_equal(label, before):
            break
    apart = label != np.arange(len(nodes))
    return nodes[apart], nodes[label[apart]]


def components(scratch: Scratch, edges: DataFrame, name: str = "links") -> DataFrame:
    """(node, label) for every node that is not the smallest of its component.

    ``edges`` has two columns ``a`` and ``b`` of one comparable type.  Each round hooks
    every node to its smallest neighbour below, follows the hooks to their ends by doubling
    and contracts the edges; only nodes without a smaller neighbour go on, at most half of a
    component.  Minima are combined ahead of the exchange; a node with very many edges is
    never gathered.  Self loops, repeated and reversed edges are allowed; null ends link
    nothing; without edges the result is empty.
    """
    apart = F.col("a") != F.col("b")

    def downward(df: DataFrame) -> DataFrame:
        return df.where(apart).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def hooked(df: DataFrame, end: str, hooks: DataFrame) -> DataFrame:
        hook = hooks.select(F.col("node").alias(end), F.col("label").alias("_label"))
        return df.join(hook, end, "left").withColumn(end, F.coalesce("_label", end)).drop("_label")

    current, rounds, turn = scratch.keep(f"{name}-edges-0", downward(edges)), [], 0
    while not current.isEmpty():
        step, jump = current.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")), 0
        step = scratch.keep(f"{name}-hooks-{turn}-0", step)
        while not step.join(step.select(F.col("node").alias("label")), "label", "left_semi").isEmpty():
            step = scratch.keep(f"{name}-hooks-{turn}-{jump + 1}", hooked(step, "label", step).select("node", "label"))
            scratch.drop(f"{name}-hooks-{turn}-{jump}")
            jump += 1
        rounds.append(step)
        moved = hooked(hooked(current, "a", step), "b", step)
        current = scratch.keep(f"{name}-edges-{turn + 1}", downward(moved))
        scratch.drop(f"{name}-edges-{turn}")
        turn += 1
    if not rounds:
        return current.select(F.col("a").alias("node"), F.col("b").alias("label"))
    # Every node was hooked in one round at most; later rounds say where its label went.
    labels = rounds[-1]
    for step in reversed(rounds[:-1]):
        labels = hooked(step, "label", labels).select("node", "label").unionByName(labels)
    return labels if turn == 1 else scratch.keep(f"{name}-labels", labels)
