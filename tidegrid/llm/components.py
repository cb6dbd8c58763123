"""Connected components of a table of links, by contraction on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import written


def _flat(parents: DataFrame) -> DataFrame:
    """(v, p) with p a root: each pass follows parents of parents, so depth halves."""
    while True:
        up = parents.select(F.col("v").alias("p"), F.col("p").alias("q"))
        after = written(parents.join(up, "p", "left").select("v", F.coalesce("q", "p").alias("p"), F.col("q").isNotNull().alias("moved")), "parents")
        if after.filter("moved").limit(1).count() == 0:
            return after.select("v", "p")
        parents = after.select("v", "p")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least id reachable from each linked id. Ids without links are not listed.

    Every round each root hooks onto its least neighbour and links are redrawn
    between roots, so rounds are logarithmic; links never leave the executors.
    Self links list their node; nulls are dropped; an empty table gives an empty one.
    """
    clean = links.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    edges = written(clean.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("w")).distinct(), "links")
    labels = edges.select(F.explode(F.array("u", "w")).alias("node")).distinct().withColumn("component", F.col("node"))
    edges = edges.filter("u <> w")
    first = True
    while edges.limit(1).count():
        roots = _flat(written(edges.groupBy(F.col("u").alias("v")).agg(F.min("w").alias("p")), "hooks"))
        labels = labels.join(roots, labels.component == roots.v, "left").select("node", F.coalesce("p", "component").alias("component"))
        if not first:
            labels = written(labels, "labels")
        first = False
        x = roots.select(F.col("v").alias("u"), F.col("p").alias("pu"))
        y = roots.select(F.col("v").alias("w"), F.col("p").alias("pw"))
        redrawn = edges.join(x, "u", "left").join(y, "w", "left").select(F.coalesce("pu", "u").alias("x"), F.coalesce("pw", "w").alias("y"))
        edges = written(redrawn.filter("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("w")).distinct(), "links")
    return labels
