"""Connected components of links, as DataFrame jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanfusion.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in ``links`` (columns a and b): root is the smallest node of its component.

    Every node hooks to its smallest neighbour, chains of hooks are shortened
    by doubling, and links are then taken between the roots, until none is
    left. Nodes, hooks and links stay in tables; a node with many links is
    counted by partial minima.
    """
    links = stored(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    roots = None
    while True:
        both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("root")))
        while True:
            next_ = hooks.select(F.col("node").alias("mid"), F.col("root").alias("end"))
            hooks = stored(hooks.join(next_, hooks["root"] == next_["mid"]).select("node", F.col("end").alias("root"), (F.col("end") != F.col("root")).alias("moved")))
            moved = hooks.where("moved").limit(1).count()
            hooks = hooks.drop("moved")
            if not moved:
                break
        if roots is None:
            roots = hooks
        else:
            step = hooks.select(F.col("node").alias("mid"), F.col("root").alias("end"))
            roots = roots.join(step, roots["root"] == step["mid"], "left").select("node", F.coalesce("end", "root").alias("root"))
        left = hooks.select(F.col("node").alias("x"), F.col("root").alias("rx"))
        right = hooks.select(F.col("node").alias("y"), F.col("root").alias("ry"))
        moved_links = links.join(left, links["a"] == left["x"]).join(right, F.col("b") == right["y"])
        links = stored(moved_links.select(F.least("rx", "ry").alias("a"), F.greatest("rx", "ry").alias("b")).where("a <> b").distinct())
        roots = stored(roots)
        if not links.limit(1).count():
            return roots
