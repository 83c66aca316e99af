"""Connected components of an edge table, as repeated Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import materialise, release

#: Edges of a written file, and the files that a round may always write: a round is a table of two numbers a row.
FILE_EDGES, FEW_FILES = 100_000, 6


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``edges`` (a, b): comp is the smallest node reachable.

    Large-star and small-star rounds: each node's neighbours are hung on its smallest
    neighbour, so depth shrinks geometrically; a round is two groupings and is written
    once. A hub of any degree is met as rows of a join, never as one list. No round has more
    edges than the one before, so their number bounds the files of all rounds.
    Null ends are dropped; repeated edges and loops count once; an empty table has no nodes.
    """
    nodes = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u is not null and v is not null")
    now = materialise(nodes.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    files = max(FEW_FILES, -(-(n := now.count()) // FILE_EDGES))
    while n:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u").select("u", "v", "m")
        small = hung.select("u", F.col("m").alias("v")).union(hung.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        new = materialise(small.coalesce(files), "stars")
        release(now)
        # done when no node hangs on a node that itself hangs: every tree is a star
        deep = new.join(new.select(F.col("u").alias("v")).distinct(), "v", "left_semi").limit(1).count()
        many = new.groupBy("u").count().where("count > 1").limit(1).count()
        now = new
        if not deep and not many:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    out = materialise(now.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(roots).coalesce(files), "components")
    release(now)
    return out


def merged(before: DataFrame, edges: DataFrame) -> DataFrame:
    """``before``, components as ``components`` gives them, with further ``edges`` (a, b). Only the components that these
    edges touch are worked on, each as one node; where no edge joins two, ``before`` itself comes back, else it is deleted."""
    ends = edges
    for end in ("a", "b"):
        ends = ends.join(before.select(F.col("node").alias(end), F.col("comp").alias(f"c{end}")), end, "left")
    joined = components(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    if not (n := joined.count()):
        release(joined)
        return before
    old = before.join(joined.select(F.col("node").alias("comp"), F.col("comp").alias("to")), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
    new = joined.join(before, "node", "left_anti").select("node", "comp")
    files = max(FEW_FILES, -(-(n + before.count()) // FILE_EDGES))
    out = materialise(old.union(new).coalesce(files), "components")
    release(before, joined)
    return out
