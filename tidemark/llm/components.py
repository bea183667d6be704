"""Connected components of a graph of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Parts that a group's rows are dealt to.
SALTS = 64


def with_group_value(rows: DataFrame, group: str, member: str, name: str, partly: Column, whole: Column) -> DataFrame:
    """`rows` with a value of their group as column `name`: `partly` sums up some of its rows, `whole` such sums.

    A large group is dealt out by a salt from its members: each part is summed up, the parts' rows, `SALTS` a group
    at most, meet for the whole, and that goes back to each part, so that no task gets all rows of a group.
    """
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(member), F.lit(SALTS)).cast("int"))
    parts = salted.groupBy(group, "__salt").agg(partly.alias(name))
    total = parts.groupBy(group).agg(whole.alias(name), F.collect_list("__salt").alias("__salts")).select(group, name, F.explode("__salts").alias("__salt"))
    # merged, as a broadcast of small `rows` would leave them where `total` lies: all of a group in one task
    return salted.join(total.hint("merge"), [group, "__salt"]).drop("__salt")


def _starred(edges: DataFrame) -> DataFrame:
    """Every edge (u, v) with the least node m around u, which may be u itself."""
    return with_group_value(edges, "u", "v", "m", F.min("v"), F.min("m")).select("u", "v", F.least("u", "m").alias("m"))


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node and root, the least node of its component, for all nodes of `links` (a, b); root nodes are included.

    The number of edges never grows, and the number of rounds is logarithmic in the longest chain.  Links from a node
    to itself count for nothing; links given twice count once; without links there are no rows.
    """
    edges = materialize(links.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _starred(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        small = _starred(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).filter("u != v").distinct()
        edges = materialize(small, "links")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("the components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
