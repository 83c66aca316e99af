"""Sharding by a hierarchical weighted hash tree.

A topology is a tree of regions, racks and shards with weights. A document descends it: at each
node every child draws -ln(u) / weight from a keyed hash u of the document's key and the child's
name, and the least draw wins, so a child is chosen with probability in proportion to its weight.
The draws of children whose weights stay are as before: a changed weight moves documents only into
or out of the subtree where it changed. ``grown`` therefore adds a shard as a region of its own, and
then a document either stays or goes to the new shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import hash_fraction, hash_long, materialise
from gneiss.llm.mixing import running

#: A topology: for each shard (region, rack, weight), in order of the shards.
Topology = list[tuple[int, int, float]]
#: Most shards a topology may have: it is written into the plan as a literal.
MOST_SHARDS = 10_000


def even_topology(shards: int = 8, per_rack: int = 2, per_region: int = 4) -> Topology:
    """Racks of two shards and regions of two racks, all shards of weight 1."""
    return [(i // per_region, i // per_rack, 1.0) for i in range(shards)]


def grown(topology: Topology, weight: float = 1.0) -> Topology:
    """One more shard, in a new rack of a new region: no other subtree changes its weight."""
    return [*topology, (max((r for r, _, _ in topology), default=-1) + 1, max((k for _, k, _ in topology), default=-1) + 1, weight)]


def shard_of(key: Column, topology: Topology, seed: str = "tree") -> Column:
    """The shard number of ``key``. Only shards of positive weight are drawn; null is a key like any other."""
    if not 0 < len(topology) <= MOST_SHARDS:
        raise ValueError(f"a topology has 1 to {MOST_SHARDS} shards")
    children: dict[str, dict[str, float]] = {}
    for shard, (region, rack, weight) in enumerate(topology):
        if weight > 0:
            for parent, child in (("", f"r{region}"), (f"r{region}", f"r{region}/k{rack}"), (f"r{region}/k{rack}", f"s{shard}")):
                below = children.setdefault(parent, {})
                below[child] = below.get(child, 0.0) + weight
    node = lambda name, weight: F.struct(F.lit(name).alias("name"), F.lit(float(weight)).alias("weight"))
    tree = F.create_map(*[x for parent, below in children.items() for x in (F.lit(parent), F.array(*[node(c, w) for c, w in below.items()]))])
    draw = lambda c: F.struct((-F.log(hash_fraction(F.lit(seed), key, c["name"])) / c["weight"]).alias("draw"), c["name"].alias("name"))
    at = F.lit("")
    for _ in range(3):
        at = F.array_min(F.transform(F.element_at(tree, at), draw))["name"]
    return F.substring(at, 2, 10).cast("int")


def assign_shards(docs: DataFrame, topology: Topology | None = None, seed: str = "tree") -> DataFrame:
    """Where each row of ``docs`` goes: doc_id, size, text_crc32, shard, grown_shard (with one more shard), slot.

    ``size`` is the UTF-8 bytes of the text plus 1 (null text: 1); ``slot`` numbers the rows of a shard
    from 0 without gaps. Needs columns doc_id and text; others are ignored. Rows of null doc_id share
    a shard; repeated rows get slots of their own. An empty table gives an empty table.
    """
    topology = topology or even_topology()
    text = F.coalesce(docs.text.cast("string"), F.lit(""))
    at = docs.select(
        docs.doc_id.cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.monotonically_increasing_id().alias("row")
    )
    at = at.withColumn("shard", shard_of(F.col("doc_id"), topology, seed)).withColumn("grown_shard", shard_of(F.col("doc_id"), grown(topology), seed))
    at = materialise(at.withColumn("h", hash_long(F.lit("slot"), F.col("doc_id"))), "assigned")
    return running(at, ["shard"], F.shiftright("h", 48), ["h", "size", "text_crc32", "row"], F.lit(1)).withColumnRenamed("start", "slot").drop("h", "row")


def write_shards(docs: DataFrame, path: str, topology: Topology | None = None, seed: str = "tree") -> None:
    """Write ``docs`` under ``path``, a folder for each shard; a shard's rows are dealt over several files."""
    out = docs.withColumn("shard", shard_of(F.col("doc_id"), topology or even_topology(), seed))
    out.repartition("shard", F.pmod(F.xxhash64("doc_id"), F.lit(64))).write.partitionBy("shard").mode("overwrite").parquet(path)
