"""Connected components by iterative joins: each node ends with the least label of its component."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import drop_written, written

#: Rows of (node, least neighbour), 32 bytes each or so, up to which they are broadcast.
MOST_BROADCAST = 200_000


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges (a, b) of any ordered type, a != b -> (node, label), one row per node of an edge.

    Alternates large-star and small-star rounds: each node hands its least neighbour to its larger (then its smaller)
    neighbours, until a large-star changes nothing and every node has one smaller neighbour, which a small-star would leave as
    they are. The rounds grow with the logarithm of the longest chain. The least neighbour is an aggregate with partial sums, so
    a node with a third of all edges costs one row per task; it is broadcast while it is small, and else a written table, so
    that adaptive execution can split a node of very many edges in the join back."""

    spark = edges.sparkSession

    def measured(rows: DataFrame) -> tuple[DataFrame, tuple[int, int]]:
        """rows as a written table; their number and the sum of their hashes, taken as they are written."""
        seen = Observation()
        table = written(rows.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.hash("a", "b").cast("long")).alias("h")), "edges")
        return table, (seen.get["n"], seen.get["h"])

    def back(rows: DataFrame, least: DataFrame, n: int) -> DataFrame:
        """rows joined with the least neighbour of a; least has n rows at most."""
        if n <= MOST_BROADCAST:
            return rows.join(F.broadcast(least), "a")
        table = written(least, "least")
        drop.append(table)
        return rows.join(table, "a")

    drop: list[DataFrame] = []
    now, sign = measured(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
    for _ in range(most_rounds):
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large, after = measured(back(both.where("b > a"), least, 2 * sign[0]).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct())
        done = after == sign and large.select("a").distinct().count() == after[0]
        small = None
        if not done:
            small_least = large.groupBy("a").agg(F.min("b").alias("m"))
            small, sign = measured(back(large, small_least, after[0]).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a != b").distinct())
        for table in (now, *drop, *([] if done else [large])):
            drop_written(spark, table)
        drop, now = [], large if done else small
        if done:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
