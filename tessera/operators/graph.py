"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.runtime import materialise


def components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, group) of the nodes in links (a, b): the least node each is connected to.

    Labels are passed on until none changes; each round is written to the shared
    folder, so the lineage stays short and a lost executor costs no more than a
    round. A round also jumps from a label to that label's own, so long chains
    take few rounds. Null ends are ignored; an empty table gives an empty result.
    """
    links = links.where("a is not null and b is not null")
    edges = materialise(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    label = materialise(edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("l")), "label")
    for _ in range(rounds):
        near = edges.join(label.select(F.col("a").alias("b"), F.col("l").alias("m")), "b").groupBy("a").agg(F.min("m").alias("m"))
        step = label.join(near, "a").select("a", F.least("l", "m").alias("n"), "l")
        jump = label.select(F.col("a").alias("n"), F.col("l").alias("j"))
        new = materialise(step.join(jump, "n").select("a", F.least("n", "j").alias("l"), (F.least("n", "j") != F.col("l")).alias("moved")), "label")
        label = new.select("a", "l")
        if new.where("moved").limit(1).count() == 0:
            return label.select(F.col("a").alias("node"), F.col("l").alias("group"))
    raise RuntimeError(f"no fixed point after {rounds} rounds")
