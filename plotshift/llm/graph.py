"""Connected components by large-star and small-star steps on DataFrames; nothing but two numbers comes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotshift.session import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node ties its larger neighbours to the smallest node it sees."""
    both = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("m", "a").alias("m"))
    return both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node ties its smaller neighbours and itself to the smallest of them; every edge of ``edges`` leads downwards."""
    tied = edges.join(edges.groupBy("a").agg(F.min("b").alias("m")), "a")
    pairs = tied.select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e")).select("e.*")
    return pairs.toDF("a", "b").where("a <> b").distinct()


def contracted(links: DataFrame) -> DataFrame:
    """One large-star and one small-star step: edges (a, b), b smaller, that leave the components as they are."""
    return materialize(_small_star(_large_star(links.where("a <> b").select("a", "b"))), "stars")


def smallest_seen(edges: DataFrame) -> DataFrame:
    """(a, comp): per node the smallest neighbour in contracted ``edges``; equal values mean one component, not the reverse."""
    return edges.groupBy("a").agg(F.min("b").alias("comp"))


def components(links: DataFrame) -> DataFrame:
    """(a, comp) for every node of ``links`` (a, b) that is not the smallest of its component."""
    edges = links
    while True:
        edges = contracted(edges)
        # done when every node has one edge, to a node that has none of its own
        ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("k"), F.lit(1).alias("up")), F.struct(F.col("b").alias("k"), F.lit(0).alias("up")))).alias("e"))
        state = ends.groupBy("e.k").agg(F.sum("e.up").alias("up"), F.count("*").alias("all"))
        if state.where("up > 1 or up = 1 and all > 1").isEmpty():
            return edges.toDF("a", "comp")
