"""Connected components of a link table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spool, unspool


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node it reaches) of every node in ``links`` (long columns a, b; nothing need be ordered or distinct).

    In a round every node takes its least neighbour as parent if that is smaller; parents are followed to their
    roots by doubling; the links are redrawn between roots.  A round at least halves the nodes that still have
    links.  All tables are read back from the shared folder: a hub's rows may be split between tasks.
    """
    edges = spool(links.where("a <> b").select("a", "b").distinct(), "links")
    known: DataFrame | None = None
    while True:
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = spool(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("parent")), "parents")
        while True:
            above = parents.select(F.col("node").alias("parent"), F.col("parent").alias("next"))
            jumped = spool(parents.select("node", "parent").join(above, "parent").select("node", F.col("next").alias("parent"), (F.col("next") != F.col("parent")).alias("moved")), "parents")
            unspool(parents)
            parents = jumped
            if not jumped.where("moved").limit(1).count():
                break
        last = known
        if known is None:
            known = spool(parents.select("node", F.col("parent").alias("component")), "components")
        else:
            up = parents.select(F.col("node").alias("component"), "parent")
            known = spool(known.join(up, "component", "left").select("node", F.coalesce("parent", "component").alias("component")), "components")
        a, b = parents.select("node", "parent").toDF("a", "x"), parents.select("node", "parent").toDF("b", "y")
        left = spool(edges.join(a, "a").join(b, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
        unspool(last, parents, edges)
        edges = left
        if not edges.limit(1).count():
            return known
