"""Connected components of an edge table, in DataFrame operations."""

from pyspark.sql import DataFrame, functions as F

from cairn.llm import store


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges(a, b), root the same for all nodes of a component.

    Each round points every node at its least neighbour, follows the pointers one step, and contracts the edges;
    components at least halve. Minima are aggregated on the map side, and the tables of a round are written, so
    neither a node with very many edges nor a lost executor holds it up. An empty table gives an empty table.
    """
    left = store.written(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    labels = left.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node"))
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = both.groupBy(F.col("a").alias("v")).agg(F.least(F.first("a"), F.min("b")).alias("m"))
        jump = to.select(F.col("v").alias("m"), F.col("m").alias("mm"))
        to = store.written(to.join(jump, "m").select("v", F.col("mm").alias("m")), "pointers")
        new = left.join(to.select(F.col("v").alias("a"), F.col("m").alias("x")), "a").join(to.select(F.col("v").alias("b"), F.col("m").alias("y")), "b")
        left = store.written(new.select(F.col("x").alias("a"), F.col("y").alias("b")).filter("a <> b").distinct(), "edges")
        moved = labels.join(to.select(F.col("v").alias("root"), "m"), "root", "left")
        labels = store.written(moved.select("node", F.coalesce("m", "root").alias("root")), "roots")
    return labels
