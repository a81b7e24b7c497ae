"""What a join of distinct texts or vectors, the nodes, needs to become a join of rows: pairs of ids spelled out, or classes of ids and numbers of their links."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import broadcast_if_small, cut, partitions

#: Ids of a node whose pairs are made in one place; a larger node's are paired chunk by chunk.
CHUNK = 1024


def pairs_within(nodes: DataFrame, a: str, b: str, value: str) -> DataFrame:
    """All pairs of the ids of each node (``ids``: sorted, distinct), with value 1; a large node's are spread over tasks, a chunk of ids against another."""
    piece = lambda k: F.slice("ids", F.col(k) * CHUNK + 1, CHUNK)
    small = nodes.where((F.size("ids") > 1) & (F.size("ids") <= CHUNK)).select(F.col("ids").alias("x"), F.col("ids").alias("y"))
    large = nodes.where(F.size("ids") > CHUNK).select("ids", F.ceil(F.size("ids") / CHUNK).cast("int").alias("n")).select("ids", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    large = large.select("ids", "i", F.explode(F.sequence(F.col("i"), F.col("n") - 1)).alias("j")).select(piece("i").alias("x"), piece("j").alias("y")).repartition(partitions(nodes.sparkSession))
    each = small.unionByName(large).select(F.explode("x").alias(a), "y")
    return each.select(a, F.explode(F.filter("y", lambda other: other > F.col(a))).alias(b), F.lit(1.0).alias(value))


def best_of_each(pairs: DataFrame, members: DataFrame, a: str, b: str, value: str) -> DataFrame:
    """``pairs`` with the greatest value of each pair; ``members`` has (id, node). Only ids of several nodes can have a pair twice, so no others are shuffled."""
    several = cut(members.groupBy("id").count().where("count > 1").select("id"))
    n = several.count()
    if not n:
        return pairs
    pairs = cut(pairs)
    x, y = (broadcast_if_small(several.select(F.col("id").alias(c)), 16, n) for c in (a, b))
    once = pairs.join(x, a, "left_anti")
    again = pairs.join(x, a, "left_semi").unionByName(once.join(y, b, "left_semi"))
    best = again.groupBy(a, b).agg(F.max(value).alias(value))
    return once.join(y, b, "left_anti").select(*best.columns).unionByName(best)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of 0..n-1 that each is connected with by the edges a, b."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def classes_of(ids: DataFrame, members: DataFrame, nodes: DataFrame, found: DataFrame) -> DataFrame:
    """One row an id (of ``ids``, less NULL): class_id, the least id that it is connected with, and links, the number of ids near it; an id near none has its own class and 0 links.

    ``members`` has (id, node), each once.  ``nodes`` has node and ids, two numbers: how many
    of its ids are members of that node only, and how many of several.  ``found`` has
    a (node), b (one that it is connected with) and links (ids near it that are members
    of one node; to be added up), and a, b and NULL for near nodes of which either has
    ids of several.
    """
    several = cut(members.groupBy("id").agg(F.collect_set("node").alias("nodes")).where(F.size("nodes") > 1))
    edges = found.where("links is not null").select("a", "b").unionByName(several.select(F.col("nodes")[0].alias("a"), F.explode("nodes").alias("b")))
    group = components(edges)
    one = members.groupBy("id").agg(F.min("node").alias("node"), F.count("*").alias("texts"))
    tagged = one.join(group, "node", "left").select("id", "node", "texts", F.coalesce("group", "node").alias("group"))
    first = tagged.groupBy("group").agg(F.min("id").alias("class_id"))
    near = found.where("links is not null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("near"))
    own = nodes.select("node", (F.col("ids")[0] - 1).alias("own"))
    # Of an id with several nodes, and of its partners, each pair counts once, by whichever nodes it is near.
    some = several.select("id", F.explode("nodes").alias("x"))
    meet = found.where("links is null").select("a", "b")
    meet = meet.unionByName(meet.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(some.select(F.col("x").alias("a"), F.col("x").alias("b")).distinct())
    twice = some.join(meet, F.col("x") == F.col("a")).select(F.col("id").alias("p"), "b").join(members.select(F.col("id").alias("q"), "node"), F.col("b") == F.col("node")).where("p <> q")
    twice = twice.select(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")).distinct().select(F.explode(F.array("p", "q")).alias("id")).groupBy("id").agg(F.count("*").alias("twice"))
    simple = F.when(F.col("texts") == 1, F.coalesce("near", F.lit(0)) + F.col("own")).otherwise(0)
    found = tagged.join(first, "group").join(near, "node", "left").join(own, "node").join(twice, "id", "left").select("id", "class_id", (simple + F.coalesce("twice", F.lit(0))).alias("links"))
    every = ids.where("id is not null").distinct()
    return every.join(found, "id", "left").select("id", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))


def components(edges: DataFrame) -> DataFrame:
    """node and group (the least node that it is connected with), for the nodes of ``edges`` (a, b).

    Alternating large-star and small-star steps, whose number grows with the
    logarithm of the component size, each cut by a checkpoint.
    """
    e = cut(edges.select("a", "b").where("a <> b").distinct())
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        new = cut(small.where("a <> b").distinct())
        # Done when every node hangs directly on one that hangs on none.
        if new.join(new.select(F.col("b").alias("a")).distinct(), "a", "left_semi").isEmpty() and new.groupBy("a").count().where("count > 1").isEmpty():
            return new.select(F.col("a").alias("node"), F.col("b").alias("group")).unionByName(new.select(F.col("b").alias("node"), F.col("b").alias("group")).distinct())
        e = new
