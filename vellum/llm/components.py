"""Connected components of a table of links, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, release


def components(edges: DataFrame) -> DataFrame:
    """node and comp (the smallest node reachable) of every node of ``edges`` (a, b); no links: no rows.

    Each round gives every node the first of itself and its neighbours, in an order drawn anew, and then links what the
    two nodes of a link were given.  The last node of a group is given to none, so nodes become fewer each round, most
    often far fewer, and a group that is one node is done.  In the end the rounds are followed from the last to the first.
    Both sides of each join are tables, so AQE may split a hub.
    """
    links = materialise(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    rounds = []
    while not rounds or not links.isEmpty():
        turn = lambda c, k=len(rounds): F.struct(F.xxhash64(F.lit(k), c).alias("turn"), F.col(c).alias("node"))
        ends = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        given = ends.groupBy("a").agg(F.min(turn("b")).alias("first")).select(F.col("a").alias("node"), F.least(turn("a"), "first")["node"].alias("to"))
        rounds.append(given := materialise(given, "cc-labels"))
        left = links.join(given.withColumnsRenamed({"node": "a", "to": "x"}), "a").join(given.withColumnsRenamed({"node": "b", "to": "y"}), "b").where("x <> y")
        left = materialise(left.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "cc-edges")
        release(links)
        links = left
    label = rounds[-1]
    for given in rounds[-2::-1]:
        label = given.join(label.select(F.col("node").alias("to"), F.col("to").alias("last")), "to", "left").select("node", F.coalesce("last", "to").alias("to"))
    label = materialise(label, "cc-labels")
    least = materialise(label.groupBy("to").agg(F.min("node").alias("comp")), "cc-least")
    found = materialise(label.join(least, "to").select("node", "comp"), "cc-labels")
    release(links, *rounds, label, least)
    return found
