"""Distributed union-find: connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtriage.llm.common import cut


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of its neighbourhood."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them; edges run from larger to smaller."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame) -> DataFrame:
    """Label the nodes of ``edges`` (a, b) with the smallest node they reach.

    Alternating large-star and small-star steps shrink every component to a
    star around its smallest node.  A step only groups edges by a node and
    takes minima, which combine before the shuffle, and joins the minima back;
    no component is ever gathered.  Each round is checkpointed.  Returns
    (node, component); edges with a null or equal ends only name no link.
    """
    a, b = F.col("a"), F.col("b")
    links = edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    links = cut(links)
    before, now = None, _state(links)
    while now[0] and now != before:
        links = cut(_small_star(_large_star(links)))
        before, now = now, _state(links)
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)


def _across(rest: DataFrame) -> DataFrame:
    """Pairs (a, b) of ``rest`` (bucket, node, component) that share a bucket but no component."""
    one = rest.select("bucket", F.col("node").alias("a"), F.col("component").alias("ca"))
    two = rest.select("bucket", F.col("node").alias("b"), F.col("component").alias("cb"))
    return one.join(two, "bucket").where("a < b AND ca != cb").select("a", "b").distinct()


def bucket_components(
    members: DataFrame, verified, sparing: bool = False, across=_across, verified_across=None, distinct: bool = False
) -> DataFrame:
    """Components of the links that exist within buckets, without listing all pairs.

    ``members`` holds (bucket, node), ``verified`` keeps the true links of
    candidates (a, b).  First every node is held against the smallest node of
    its bucket.  What these links connect needs no further look: the buckets
    that still hold more than one component give the pairs across components,
    and only those.  So every link of a bucket is found or already implied.

    With ``sparing``, a node is first held against a single one, the smallest
    of all its buckets, and against the others only if that did not connect
    them.  It takes another round of components and saves dear verifications.

    ``across`` lists the pairs of what is left; one that knows which pairs
    cannot hold may leave those out.  ``verified_across`` keeps the true ones
    of them, if ``verified`` does more than they need.  With ``distinct``,
    ``members`` is computed already and has no row twice.
    """
    members = members.select("bucket", "node") if distinct else cut(members.select("bucket", "node").distinct())
    least = members.groupBy("bucket").agg(F.min("node").alias("a"))
    stars = members.join(least, "bucket").where("node != a").select("a", F.col("node").alias("b")).distinct()
    if sparing:
        stars = cut(stars)
        some = cut(components(verified(stars.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))))
        one = some.select(F.col("node").alias("a"), F.col("component").alias("ca"))
        two = some.select(F.col("node").alias("b"), F.col("component").alias("cb"))
        apart = stars.join(one, "a", "left").join(two, "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b"))
        held = some.select(F.col("node").alias("a"), F.col("component").alias("b")).where("a != b")
        first = cut(components(held.unionAll(verified(apart.select("a", "b")))))
    else:
        first = cut(components(verified(stars)))
    labelled = members.join(first, "node", "left").select(
        "bucket", "node", F.coalesce("component", "node").alias("component")
    )
    mixed = labelled.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    rest = cut(labelled.join(mixed.select("bucket"), "bucket"))
    links = (verified_across or verified)(across(rest))
    names = first.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    other = first.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    joined = links.join(names, "a", "left").join(other, "b", "left").select(
        F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")
    )
    second = cut(components(joined))
    merged = second.select(F.col("node").alias("component"), F.col("component").alias("root"))
    labels = first.join(merged, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
    return labels.unionAll(second.join(first, "node", "left_anti"))
