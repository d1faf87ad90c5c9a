"""Stored clusters of alias names that are brought up to date where confirmations touch them.

``clusters`` is ``(name, cluster)`` with the least name of each cluster, as ``history.clusters`` gives it for all edges. An update takes added
and removed pairs. Only clusters that lose an edge are taken apart, by their own edges; added edges then join whole clusters, told by
their labels, so that the graph that is searched has as many edges as were added, not as are stored. Denials are kept beside the edges; those
that the closure of the confirmed pairs contradicts are reported, with the pairs that hold their names together.

Tables that grow with the pairs are joined by a shuffle (``merge``): Spark would judge them by the size of their files, which is a small part of
what they take in memory, and send millions of rows through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidloom import shared

#: Rows up to which a table of changed labels is sent to all tasks; it grows with the update.
SENT = 100_000


def undirected(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Pairs of two different names, each once with the lesser first."""
    own = pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.col(a).alias("x"), F.col(b).alias("y"))
    return own.where("x is not null and y is not null and a < b").select("a", "b").distinct()


def relabelled(rows: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    """``rows`` with ``column`` replaced where ``labels (old, new)`` has it; ``labels`` is a written table with one row an old label."""
    if labels.count() <= SENT:
        table = F.broadcast(labels.withColumnRenamed("old", column))
        return rows.join(table, column, "left").withColumn(column, F.coalesce("new", column)).select(*rows.columns)
    counts = shared.cut(rows.groupBy(column).agg(F.count("*").alias("n")).join(labels.withColumnRenamed("old", column).hint("merge"), column), "labels")
    return shared.join_counted(rows, counts, column, "n", "left").withColumn(column, F.coalesce("new", column)).select(*rows.columns)


def changed(edges: DataFrame, added: DataFrame | None = None, removed: DataFrame | None = None) -> DataFrame:
    """The stored pairs after an update; a pair that is added and removed at once is removed."""
    out = undirected(edges)
    if added is not None:
        out = out.unionByName(undirected(added)).distinct()
    return out if removed is None else out.join(undirected(removed).hint("merge"), ["a", "b"], "left_anti")


def updated(clusters: DataFrame, edges: DataFrame, added: DataFrame | None = None, removed: DataFrame | None = None) -> DataFrame:
    """``clusters`` of ``changed(edges, added, removed)``, from those of ``edges``. Names that lose their last pair go, as without one they have no aliases."""
    edges, empty = undirected(edges), edges.limit(0).select(F.col("a"), F.col("b"))
    removed = undirected(removed) if removed is not None else empty
    added = undirected(added).join(removed.hint("merge"), ["a", "b"], "left_anti") if added is not None else empty
    cut_off = shared.cut(edges.join(removed.hint("merge"), ["a", "b"], "left_semi"), "removed")
    whole = clusters
    if not cut_off.isEmpty():
        ends = cut_off.select(F.col("a").alias("name"))
        touched = shared.cut(clusters.join(ends.hint("merge"), "name", "left_semi").select("cluster").distinct(), "touched")
        inside = shared.cut(clusters.join(touched.hint("merge"), "cluster", "left_semi"), "inside")
        own = edges.join(inside.select(F.col("name").alias("a")).hint("merge"), "a", "left_semi").join(removed.hint("merge"), ["a", "b"], "left_anti")
        found = shared.components(own)
        roots = found.select(F.col("root").alias("name"), F.col("root").alias("cluster")).distinct()
        parts = found.select(F.col("node").alias("name"), F.col("root").alias("cluster")).unionByName(roots)
        whole = clusters.join(touched.hint("merge"), "cluster", "left_anti").select("name", "cluster").unionByName(parts)
    whole = shared.cut(whole.select("name", "cluster"), "clusters")
    new = shared.cut(added.join(edges.hint("merge"), ["a", "b"], "left_anti"), "added")
    if new.isEmpty():
        return whole
    names = new.select(F.explode(F.array("a", "b")).alias("name")).distinct()
    labels = shared.cut(names.join(whole.hint("merge"), "name", "left").select(F.col("name").alias("old"), F.coalesce("cluster", "name").alias("new"), F.col("cluster").isNull().alias("fresh")), "labels")
    pairs = relabelled(relabelled(new, labels.select("old", "new"), "a"), labels.select("old", "new"), "b")
    merged = shared.cut(shared.components(pairs).select(F.col("node").alias("old"), F.col("root").alias("new")), "merged")
    fresh = labels.where("fresh").select(F.col("old").alias("name"), F.col("new").alias("cluster"))
    return relabelled(whole.unionByName(fresh), merged, "cluster")


def contradictions(clusters: DataFrame, denied: DataFrame) -> DataFrame:
    """``(a, b, cluster)``: denied pairs whose names the confirmed pairs hold together."""
    side = lambda c: clusters.select(F.col("name").alias(c), F.col("cluster").alias(f"cluster_{c}"))
    own = undirected(denied).join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b")
    return own.where("cluster_a = cluster_b").select("a", "b", F.col("cluster_a").alias("cluster"))


def between(edges: DataFrame, denied: DataFrame, most: int = 6) -> DataFrame:
    """``(a, b, steps)`` for contradicted denials: how many confirmed pairs lead from one name to the other at the least, up to ``most``; null beyond.

    All denials are walked at once, a step of both ends at a time: what is reached within k steps of one end and within k or k - 1 of the other."""
    both = undirected(edges)
    both = shared.cut(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).select(F.col("a").alias("at"), F.col("b").alias("to")), "walk")
    left = undirected(denied).select("a", "b", F.col("a").alias("at"), F.lit(0).alias("k"))
    right = undirected(denied).select("a", "b", F.col("b").alias("at"), F.lit(0).alias("k"))
    sides = [left, right]
    for k in range(1, most + 1):
        side = sides[k % 2]
        last = side.agg(F.max("k")).first()[0]
        step = side.where(F.col("k") == (last or 0)).join(both.hint("merge"), "at").select("a", "b", F.col("to").alias("at"), F.lit((last or 0) + 1).alias("k")).distinct()
        grown = side.unionByName(step.join(side.hint("merge"), ["a", "b", "at"], "left_anti"))
        sides[k % 2] = shared.cut(grown, "reached")
    met = sides[0].join(sides[1].withColumnRenamed("k", "j").hint("merge"), ["a", "b", "at"]).groupBy("a", "b").agg(F.min(F.col("k") + F.col("j")).alias("steps"))
    return undirected(denied).join(met.hint("merge"), ["a", "b"], "left").select("a", "b", "steps")
