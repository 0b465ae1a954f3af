"""Connected components of a table of links, by contraction; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import Scratch, join_sized


def components(links: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(id, component) of every id in links (a, b), component being the least id that can be reached.

    Each round points every id to its least neighbour, follows pointers to their ends, and contracts the
    links to those ends; links inside a component vanish, and rounds end when none is left. Side tables are
    broadcast if their count is small, else joined by shuffle from tables, where AQE splits a hot end.
    """
    links = scratch.table(links.select("a", "b").where("a <> b").distinct(), f"{name}_links_0")
    labels = None
    k = 0
    while not links.isEmpty():
        both = links.select(F.col("a").alias("id"), F.col("b").alias("to")).union(links.select(F.col("b").alias("id"), F.col("a").alias("to")))
        up = scratch.table(both.groupBy("id").agg(F.least(F.col("id"), F.min("to")).alias("up")), f"{name}_up_{k}_0")
        rows, jump = up.count(), 0
        while True:
            higher = up.where("up <> id").select(F.col("id").alias("_i"), F.col("up").alias("_u"))
            moved = join_sized(up, higher, F.col("up") == F.col("_i"), "left", rows)
            nxt = scratch.table(moved.select("id", F.coalesce("_u", "up").alias("up"), F.col("_u").isNotNull().alias("moved")), f"{name}_up_{k}_{jump + 1}")
            done = nxt.where("moved").isEmpty()
            up, jump = nxt.select("id", "up"), jump + 1
            if done:
                break
        for end in ("a", "b"):
            links = join_sized(links, up.select(F.col("id").alias("_i"), "up"), F.col(end) == F.col("_i"), "inner", rows).select(*[F.col("up").alias(end) if c == end else c for c in ("a", "b")])
        links = scratch.table(links.where("a <> b").distinct(), f"{name}_links_{k + 1}")
        if labels is None:
            labels = up.select("id", F.col("up").alias("component"))
        else:
            labels = join_sized(labels, up.select(F.col("id").alias("_i"), "up"), F.col("component") == F.col("_i"), "left", rows)
            labels = scratch.table(labels.select("id", F.coalesce("up", "component").alias("component")), f"{name}_labels_{k}")
        k += 1
    if labels is None:
        return links.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return labels
