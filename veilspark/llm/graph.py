"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import Scratch, Stored, few_parts, store


def _both(links: DataFrame) -> DataFrame:
    turned = links.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return links.select("a", "b").unionAll(turned)


def _nodes(edges: DataFrame, rows: int) -> Stored:
    """Per node: the smallest of its neighbours and itself, and whether it is open: neither a centre,
    with larger neighbours only, nor a ray, with one neighbour."""
    around = _both(edges).groupBy("a").agg(F.min("b").alias("least"), F.max("b").alias("most"))
    found = around.select(
        F.col("a").alias("node"),
        F.least("least", "a").alias("root"),
        (F.col("least") < F.least("a", "most")).alias("open"),
    )
    return store(few_parts(found, 2 * rows), open=F.sum(F.col("open").cast("long")))


def components(links: DataFrame, rows: int) -> Stored:
    """Per node that has a link: node, root (the smallest node of its component).

    Alternates two star steps until every component is a star around its smallest node, which the
    next look at the nodes tells: a node's larger neighbours are linked to its smallest neighbour,
    then its smaller ones are. Each step aggregates and joins by node; nodes that are proven few
    are sent to the links instead. ``rows`` is the number of links, which no step makes larger.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    while True:
        with Scratch() as scratch:
            nodes = _nodes(edges, rows)
            if not nodes.size["open"]:
                scratch.keep(nodes)
                nodes.df = nodes.df.select("node", "root")
                return nodes
            centre = nodes.df.select(F.col("node").alias("b"), F.col("root").alias("m"))
            large = edges.join(F.broadcast(centre) if nodes.small else centre, "b").select("a", F.col("m").alias("b"))
            large = large if nodes.small else store(large.distinct()).df
            small = large.groupBy("a").agg(F.min("b").alias("m"))
            joined = large.join(F.broadcast(small) if nodes.small else small, "a")
            star = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(
                small.select("a", F.col("m").alias("b"))
            )
            edges = scratch.keep(store(few_parts(star.where("a <> b").distinct(), rows))).df
