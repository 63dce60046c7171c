"""Connected components of links by star contraction; no list of neighbours is ever gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import checkpointed


def _falling(edges: DataFrame) -> DataFrame:
    """Each edge once, from its larger end ``hi`` to its smaller end ``lo``; loops go."""
    return edges.select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")).where("hi <> lo").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """``vertex, component`` for every end of a link: the smallest vertex that its links lead to.

    Each round lets every edge point at its lower end's lowest neighbour, then every vertex and its lower neighbours at
    the lowest of them; the distance to the root halves. Minima are aggregated before they are shuffled, and a join's
    hot key is split by adaptive execution, since the other side has one row a key. It ends when a round changes nothing.
    """
    edges = checkpointed(_falling(links.select(F.col(a).alias("hi"), F.col(b).alias("lo"))))
    for _ in range(most_rounds):
        low = edges.groupBy("hi").agg(F.min("lo").alias("low"), F.count("*").alias("n"))
        state = edges.join(low.select(F.col("hi").alias("lo"), F.col("low").alias("up")), "lo", "left")
        # A forest of stars: every vertex has one lower neighbour, and that one has none.
        deep, edge_count = state.agg(F.count("up"), F.count("*")).first()
        if not deep and (not edge_count or low.count() == edge_count):
            break
        jumped = state.select("hi", F.coalesce("up", "lo").alias("lo")).distinct()
        lowest = jumped.groupBy("hi").agg(F.min("lo").alias("low"))
        joined = jumped.join(lowest, "hi")
        edges = checkpointed(_falling(joined.select("hi", F.col("low").alias("lo")).union(joined.where("lo <> low").select(F.col("lo").alias("hi"), F.col("low").alias("lo")))))
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("hi").alias("vertex"), F.col("lo").alias("component")).union(edges.select(F.col("lo").alias("vertex"), F.col("lo").alias("component")).distinct())
