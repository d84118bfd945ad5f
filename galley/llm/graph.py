"""Connected components by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galley.llm.common import materialize, release


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, component) for every node of an edge; component is its smallest reachable node.

    Each round hooks every node to its neighbour of least random priority and contracts the graph along the
    hooks. The priorities keep long paths from contracting a node at a time, so that the edges left shrink by a
    constant factor a round. Minima are combined before the shuffle; joins read written tables on both sides, so
    that Spark splits the partition of a node with very many neighbours. Nothing is gathered on the driver.
    Null ends and loops are ignored; repeated edges count once.
    """
    pairs = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    left = materialize(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    chain = []
    for _ in range(100):
        if left.isEmpty():
            break
        rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
        best = left.groupBy("u").agg(F.min(rank("v")).alias("m")).select("u", F.least(rank("u"), F.col("m"))["id"].alias("p"))
        hooks = materialize(best, "hooks")
        chain.append(hooks)
        ends = left.join(hooks, "u").select("v", F.col("p").alias("pu"))
        ends = ends.join(hooks.withColumnRenamed("u", "v"), "v").select(F.col("pu").alias("u"), F.col("p").alias("v"))
        before, left = left, materialize(ends.where("u <> v").distinct(), "edges")
        release(before)
    else:
        raise RuntimeError("the graph did not contract in 100 rounds")
    if not chain:
        return left.select(F.col("u").alias("node"), F.col("v").alias("component"))
    # Hooks of later rounds are fewer, so the roots are found from the last round back to the first.
    named = [h.toDF("node", "root") for h in chain]
    roots = named.pop()
    for hooks in reversed(named):
        roots = hooks.join(roots.toDF("root", "top"), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    roots = materialize(roots, "roots")
    least = materialize(roots.groupBy("root").agg(F.min("node").alias("component")), "least")
    out = materialize(roots.join(least, "root").select("node", "component"), "components")
    release(left, *chain, roots, least)
    return out
