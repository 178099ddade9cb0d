"""Connected components of a link table by repeated hooking and pointer jumping; nothing is gathered on the driver but a count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import cut, release


def components(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """node, label for each node of ``links`` (a, b); label is the smallest node that can be reached.

    Each round offers every node, and the node its label names, the labels of its neighbours, keeps the least offer, then
    replaces each label by its label's label. Label tables are written to the shared folder each round, which ends
    the lineage, and those of the round before are deleted. Joins are on plain tables, so adaptive execution can split a node with very many links.
    """
    edges = cut(links.select("a", "b").union(links.select("b", "a")).distinct(), "cc-edges")
    labels = cut(edges.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("label")), "cc-labels")
    for _ in range(max_rounds):
        of_b = edges.join(labels, edges["b"] == labels["node"]).select("a", F.col("label").alias("offer"))
        mine = labels.select(F.col("node").alias("a"), F.col("label").alias("own"))
        offers = cut(of_b.join(mine, "a").groupBy("a", "own").agg(F.min("offer").alias("offer")), "cc-offers")
        hooked = offers.select(F.col("a").alias("node"), "offer").union(offers.select(F.col("own").alias("node"), "offer")).union(labels.select("node", F.col("label").alias("offer")))
        hooked = cut(hooked.groupBy("node").agg(F.min("offer").alias("label")), "cc-hooked")
        up = hooked.select(F.col("node").alias("up"), F.col("label").alias("up_label"))
        jumped = cut(hooked.join(up, hooked["label"] == F.col("up")).select("node", F.col("up_label").alias("label")), "cc-labels")
        old = labels.select("node", F.col("label").alias("old"))
        changed = jumped.join(old, "node").where("label <> old").limit(1).count()
        release(labels, offers, hooked)
        labels = jumped
        if not changed:
            release(edges)
            return labels
    raise RuntimeError(f"labels still change after {max_rounds} rounds")
