"""Connected components of a table of links."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.shared import discard, join_hot, written


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links(a, b): root is the smallest node reachable.

    Nodes with one link (leaves) hand their label to the node they hang on and are set aside, so the star around a centre with very many links is one
    partial aggregation. Among the others the smallest labels spread to neighbours, then labels take their labels' labels, until nothing changes; rounds
    grow with the logarithm of the longest path. In the end leaves take the labels of their nodes. Joins deal out what a node with many links has. Every
    round is written to the shared folder, and the one before is deleted.
    """
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    single = both.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("b")).where("n = 1")
    # two nodes with one link to each other: the larger one is the leaf
    pairs = single.groupBy(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).agg(F.max("a").alias("leaf"))
    leaves = written(pairs.select("leaf", F.when(F.col("leaf") == F.col("high"), F.col("low")).otherwise(F.col("high")).alias("on")))
    hung = leaves.groupBy(F.col("on").alias("node")).agg(F.min("leaf").alias("m"), F.count("*").alias("c"))
    alone = leaves.select(F.col("leaf").alias("a"))
    rest = written(both.join(alone, "a", "left_anti").join(alone.withColumnRenamed("a", "b"), "b", "left_anti"))
    inner = rest.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"), F.count("*").alias("links"))
    nodes = inner.select("node", "m", "links", F.lit(0).cast("long").alias("c")).unionByName(hung.select("node", "m", F.lit(0).cast("long").alias("links"), "c"))
    kept = written(nodes.groupBy("node").agg(F.min("m").alias("m"), F.sum("links").alias("links"), F.sum("c").alias("leaves")).select("node", F.least("node", "m").alias("root"), "links", "leaves"))
    while True:
        # a label comes to a node from all its neighbours: those of a node with many links are dealt out
        few = kept.where("links > 0").select(F.col("node").alias("b"), "root", F.col("links").alias("c"))
        spread = join_hot(rest, few, ["b"]).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("m"))
        near = kept.join(spread, "node", "left").select("node", F.least("root", F.coalesce("m", "root")).alias("next"), "root", "links", "leaves")
        up = kept.select(F.col("node").alias("next"), F.col("root").alias("top"))
        step = written(near.join(up, "next", "left").select("node", F.least("next", F.coalesce("top", "next")).alias("root"), F.col("root").alias("was"), "links", "leaves"))
        discard(kept)
        kept = step
        if step.where("root <> was").isEmpty():
            discard(both, rest)
            of = step.where("leaves > 0").select(F.col("node").alias("on"), "root", F.col("leaves").alias("c"))
            return step.select("node", "root").unionByName(join_hot(leaves, of, ["on"]).select(F.col("leaf").alias("node"), "root"))
