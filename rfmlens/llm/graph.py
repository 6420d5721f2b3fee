"""Connected components of a link table, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rfmlens.llm.common import keep


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is the least node that
    can be reached. Nodes may be of any ordered type.

    Each round takes the least label among a node's neighbours (map-side
    minima, so a hub's links need not meet in one task) and then the label of
    that label, which halves the way to the root; it ends when no label changes. Labels are
    written after each round, so the plan stays short and a lost executor
    costs one round at most.
    """
    both = keep(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
                "links")
    labels = keep(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                  .select("node", F.least("node", "m").alias("root")), "labels0")
    step = 0
    while True:
        step += 1
        near = (both.join(labels, both["b"] == labels["node"]).select(both["a"].alias("node"), "root")
                .unionAll(labels).groupBy("node").agg(F.min("root").alias("root")))
        near = keep(near, f"near{step}")
        up = labels.select(F.col("node").alias("n2"), F.col("root").alias("up"))
        jumped = near.join(up, near["root"] == F.col("n2")).select("node", F.least("root", "up").alias("root"))
        new = keep(jumped, f"labels{step}")
        changed = (new.join(labels.select(F.col("node").alias("n2"), F.col("root").alias("old")),
                            F.col("node") == F.col("n2")).where("root <> old").limit(1).count())
        labels = new
        if not changed:
            return labels
