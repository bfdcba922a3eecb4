"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logquarry.llm.common import saved


def _roots(pointers: DataFrame) -> DataFrame:
    """(node, root): every pointer to a smaller node followed until none leads on."""
    roots = saved(pointers)
    while True:
        above = roots.select(F.col("node").alias("root"), F.col("root").alias("higher"))
        step = saved(roots.join(above, "root", "left").select("node", F.col("higher").isNotNull().alias("moved"), F.coalesce("higher", "root").alias("root")))
        roots = step.select("node", "root")
        if step.where("moved").isEmpty():
            return roots


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of `links`; the component is its smallest node.

    A round looks at each node's links to smaller nodes: the least of them becomes its pointer, and the others become
    links between that least node and themselves. So a group in which every node names many smaller ones leaves as
    many links as there are names, not as there are links, and no join has looked at the links. What is left is
    carried to the roots of the pointers. At least half of the nodes that still have links go in a round. Links are
    best given as stars towards a small node: a node's links to smaller ones are gathered by node. Every round is
    written to the shared folder; only the question whether anything is left comes to the driver.
    """
    pairs = saved(links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct())
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    found = saved(nodes.select("node", F.col("node").alias("component")))
    while not pairs.isEmpty():
        marked = saved(pairs.withColumn("least", F.min("b").over(Window.partitionBy("a"))))
        roots = _roots(marked.where("b = least").select(F.col("a").alias("node"), F.col("least").alias("root")))
        rest = saved(marked.where("b <> least").select("b", "least").distinct())
        up = roots.select(F.col("node").alias("component"), "root")
        found = saved(found.join(up, "component", "left").select("node", F.coalesce("root", "component").alias("component")))
        for end in ("b", "least"):
            to = roots.select(F.col("node").alias(end), F.col("root").alias("to"))
            rest = rest.join(to, end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        pairs = saved(rest.select(F.greatest("b", "least").alias("a"), F.least("b", "least").alias("b")).where("a <> b").distinct())
    return found
