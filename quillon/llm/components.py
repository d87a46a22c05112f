"""Connected components of a graph of which neither edges nor components fit one machine, and joins to groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.spool import Spool


#: Rows of a key from which the key counts as large, and how many large keys there can be at most.
LARGE, MOST_LARGE = 256, 100_000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """rows joined by key with groups, a row a key that has in size how many of the ``total`` rows are its own.

    Large keys are broadcast, so their rows stay where they are; only the others are shuffled, so no task gets more of
    one key than LARGE or total / MOST_LARGE rows. At most MOST_LARGE keys can be that large.
    """
    large = F.col(size) >= max(LARGE, -(-total // MOST_LARGE))
    names = [x for x in groups.columns if x != key]
    hot = F.broadcast(groups.where(large).select(key, *names, F.lit(True).alias("_large")))
    marked = rows.join(hot, key, "left")
    inside = marked.where("_large").drop("_large")
    rest = marked.where("_large IS NULL").drop("_large", *names).join(groups.where(~large), key)
    return inside.unionByName(rest)


def components(edges: DataFrame, spool: Spool, name: str) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b): root is the smallest node reachable.

    Large-star and small-star rounds in turn: each links a node's neighbours to the smallest of
    them, from minima by partial sums and joins that leave the edges of large nodes where they are, so no task gets
    all neighbours of a node. Every round is written, which cuts lineage. Edges from a node to itself count as nodes; an empty table
    gives none.
    """
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    now = spool.table(f"{name}-0", edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    done, k = _mark(now), 0
    while done[0]:
        both = now.union(now.select("b", "a"))
        large = _to_least(both, 2 * done[0]).where("a > m")
        large = large.select("a", F.col("m").alias("b")).distinct()
        k += 1
        large = spool.table(f"{name}-{k}", large)
        small = _to_least(large, 2 * done[0])
        small = small.where("a != m").select("a", F.col("m").alias("b")).union(large.groupBy("a").agg(F.min("b").alias("b")).select("a", "b")).where("a != b").distinct()
        k += 1
        small = spool.table(f"{name}-{k}", small)
        spool.drop(f"{name}-{k - 2}"), spool.drop(f"{name}-{k - 1}")
        now, before, done = small, done, _mark(small)
        if done == before:
            break
    roots = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    return spool.table(name, nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root")))


def _to_least(edges: DataFrame, total: int) -> DataFrame:
    """(a, m): each neighbour a of a node u, with the smallest m of u and its neighbours; total: at least the number of edges."""
    least = edges.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return join_groups(edges.select(F.col("a").alias("u"), F.col("b").alias("a")), least, "u", "n", total).select("a", "m")


def _mark(edges: DataFrame) -> tuple:
    """Changes whenever the set of edges does."""
    r = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 31)))).first()
    return tuple(r)
