"""Connected components of a graph given as an edge table, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store

MAX_ROUNDS = 60


def _ends(pointers: DataFrame) -> DataFrame:
    """(node, label) with each label replaced by the end of its pointers; a node that points to itself is an end."""
    for _ in range(MAX_ROUNDS):
        above = pointers.select(F.col("node").alias("label"), F.col("label").alias("higher"))
        jumped = store(pointers.join(above, "label").select("node", F.col("higher").alias("label"), (F.col("label") != F.col("higher")).alias("moved")), "labels")
        pointers = jumped.drop("moved")
        if not jumped.filter("moved").limit(1).count():
            return pointers
    raise RuntimeError("components did not settle")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for each end of ``edges`` (a, b); the label is the smallest node of the component.

    Each round points a node to the least of itself and its neighbours, follows pointers to their ends (pointer
    jumping), and contracts the graph to these ends: edges lead between them, and those inside one go. An end is less
    than all its neighbours, so at most half of the nodes are left; a round costs what is left of the graph. Minima are pre-aggregated before they are
    shuffled; joins read stored tables on both sides, so adaptive execution can split the rows of a hub. An empty
    edge table gives no rows."""
    left = store(edges.select("a", "b"), "edges")
    steps: list[DataFrame] = []
    for _ in range(MAX_ROUNDS):
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = store(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "least")
        steps.append(_ends(least))
        a, b = (steps[-1].select(F.col("node").alias(x), F.col("label").alias(f"l{x}")) for x in "ab")
        between = left.join(a, "a").join(b, "b").filter("la <> lb")
        left = store(between.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct(), "edges")
        if not left.limit(1).count():
            break
    else:
        raise RuntimeError("components did not settle")
    labels = steps[-1]
    for earlier in reversed(steps[:-1]):  # a label that no edge was left at is final
        later = labels.select(F.col("node").alias("label"), F.col("label").alias("final"))
        labels = store(earlier.join(later, "label", "left").select("node", F.coalesce("final", "label").alias("label")), "labels")
    return labels
