"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents, in a keyed shuffled order, are one stream of words that repeats as
often as its target allows; the stream is cut in blocks of equal length. The schedule is a
row of slots: slot i lies at the golden-ratio point frac(i * phi) and belongs to the source
whose stretch of the cumulative target weights holds that point, so that any run of slots is
near the weights. The slots of a source are ranked, and the k-th takes the k-th block of its
stream. A source ends at its target: surplus slots go, and the few that the discrepancy of
the points left out come at the end.

Ranks and running sums are made in two levels, totals of buckets and then rows inside a
bucket, so that a source with a third of all documents is spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.llm.common import fresh, hash_long, materialise, n_words, small_side

#: Points of the circle, and the one nearest to its golden section that is odd, so that every point has its turn.
POINTS, GOLDEN = 1 << 31, 1327217885
#: Cells of the circle by which slots meet the stretches of sources; slots of one chunk are ranked together.
CELLS, CHUNK = 1024, 65536


def cycled_weights(sources: DataFrame, cycle: tuple[float, ...] = (5, 2, 1)) -> DataFrame:
    """(source, weight): sources by code point, null last, weigh ``cycle`` over and over."""
    at = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (at % len(cycle) + 1).cast("int"))
    return sources.select("source").distinct().select("source", weight.alias("weight"))


def targets(sizes: DataFrame, weights: DataFrame, cap: int = 3) -> DataFrame:
    """(source, source_size, sid, target, quota) from (source, source_size): shares of the total by
    weight, where what a source would get above ``cap`` times its size is shared out by weight again.

    Sources by cap / weight: one is held at its cap exactly if its share of what those before it
    left is above the cap. ``quota`` is the target in whole words, ``sid`` numbers the sources.
    """
    weights = weights.select(F.col("source").alias("ws"), "weight")
    s = sizes.join(weights, F.col("source").eqNullSafe(F.col("ws"))).select("source", "source_size", "weight")
    order = Window.orderBy(F.try_divide(F.col("source_size"), F.col("weight")), F.asc_nulls_last("source"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    s = s.withColumn("top", cap * F.col("source_size")).withColumn("total", F.sum("source_size").over(whole))
    s = s.withColumn("rest", F.col("total") - F.coalesce(F.sum("top").over(before), F.lit(0))).withColumn("weights", F.sum("weight").over(after))
    s = s.withColumn("held", F.col("top") <= F.try_divide(F.col("weight") * F.col("rest"), F.col("weights")))
    free = F.sum(F.when(~F.col("held"), F.col("weight"))).over(whole)
    left = F.col("total") - F.coalesce(F.sum(F.when(F.col("held"), F.col("top"))).over(whole), F.lit(0))
    s = s.withColumn("target", F.when(F.col("held"), F.col("top").cast("double")).otherwise(F.try_divide(F.col("weight") * left, free)))
    s = s.withColumn("sid", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1)
    return s.select("source", "source_size", "sid", "target", F.floor(F.col("target") + 0.5).cast("long").alias("quota"))


def running(df: DataFrame, group: list[str], bucket: Column, order: list[str], value: Column) -> DataFrame:
    """``df`` with ``start``, the sum of ``value`` over the rows of the group before this one.

    Rows lie by ``bucket`` and inside one by ``order``. Buckets are summed first, so that only
    their totals, and never a group's rows, meet in one task.
    """
    rows = df.withColumn("_b", bucket).withColumn("_v", value)
    totals = rows.groupBy(*group, "_b").agg(F.sum("_v").alias("_t"))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*group, "_b", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_o"))
    inside = Window.partitionBy(*group, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.join(totals, [*group, "_b"])
        .withColumn("start", F.col("_o") + F.coalesce(F.sum("_v").over(inside), F.lit(0)))
        .drop("_b", "_v", "_o")
    )


class SourceMix:
    """The mix of ``docs``: ``sources``, ``slots``, ``pieces`` and ``taken``.

    Needs columns ``doc_id``, ``text`` and ``source``; others are ignored. A null source is one
    source, the last. Null or empty texts have size 0 and are never taken. Repeated rows are
    rows of their own. With no words at all every target is 0; an empty table gives empty tables.
    """

    def __init__(self, docs: DataFrame, weights: DataFrame | None = None, cap: int = 3, block: int = 256, key: str = "mix"):
        self.block = block
        sized = docs.select(
            docs.doc_id.cast("long").alias("doc_id"), docs.source.cast("string").alias("source"), n_words(docs.text).alias("size"), F.monotonically_increasing_id().alias("row"),
            F.xxhash64(docs.text.cast("string")).alias("digest"),
        )
        self.docs = materialise(sized.withColumn("h", hash_long(F.lit(key), F.col("doc_id"))), "sized")
        sizes = self.docs.groupBy("source").agg(F.sum("size").alias("source_size"))
        self.sources = materialise(targets(sizes, cycled_weights(sizes) if weights is None else weights, cap), "sources")
        s = self.sources.withColumnRenamed("source", "s")
        placed = self.docs.join(s, F.col("source").eqNullSafe(F.col("s"))).drop("s")
        self.placed = materialise(running(placed, ["sid"], F.shiftright("h", 48), ["h", "size", "row"], F.col("size")), "placed")
        self.slots = self._slots()
        self.pieces = self._pieces()
        self.told = self._taken()
        self.taken = self.told.drop("digest")

    def _slots(self) -> DataFrame:
        """(slot, sid, rank): the schedule in order of ``slot``."""
        spark = self.docs.sparkSession
        total, k = self.sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.count("*")).first()
        n = -(-total // self.block)
        step = self.sources.withColumn("need", F.ceil(F.col("quota") / self.block))
        whole, upto = Window.partitionBy(), Window.orderBy("sid")
        share = F.try_divide(F.sum("quota").over(upto).cast("double"), F.sum("quota").over(whole).cast("double"))
        step = step.withColumn("hi", F.floor(share * POINTS)).withColumn("lo", F.coalesce(F.lag("hi").over(upto), F.lit(0))).where("lo < hi and need > 0")
        width = POINTS // CELLS
        cells = step.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width)))).select("cell", "lo", "hi", "sid", "need")
        points = spark.range(n).select(F.col("id").alias("slot"), ((F.col("id") % POINTS) * GOLDEN % POINTS).alias("u")).withColumn("cell", F.floor(F.col("u") / width))
        drawn = points.join(cells, "cell").where("u >= lo and u < hi").select("slot", "sid", "need")
        ranked = running(drawn, ["sid"], F.floor(F.col("slot") / CHUNK), ["slot"], F.lit(1)).withColumnRenamed("start", "rank")
        ranked = materialise(ranked.where("rank < need").select("slot", "sid", "rank"), "slots")
        got = ranked.groupBy("sid").agg((F.max("rank") + 1).alias("got"))
        late = step.join(got, "sid", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < need")
        late = late.select("sid", F.explode(F.sequence(F.col("got"), F.col("need") - 1)).alias("rank"))
        return ranked.union(late.select((F.lit(n) + F.col("rank") * k + F.col("sid")).alias("slot"), "sid", "rank"))

    def _pieces(self) -> DataFrame:
        """(slot, rank, sid, row, doc_id, first, words): the words of a document that a slot takes."""
        unrolled = self.placed.where("size > 0 and start < quota").withColumn("turn", F.explode(F.sequence(F.lit(0), F.floor((F.col("quota") - 1 - F.col("start")) / F.col("source_size")))))
        at = unrolled.withColumn("a", F.col("turn") * F.col("source_size") + F.col("start"))
        at = at.withColumn("z", F.least(F.col("a") + F.col("size"), F.col("quota")))
        cut = at.withColumn("rank", F.explode(F.sequence(F.floor(F.col("a") / self.block), F.floor((F.col("z") - 1) / self.block))))
        from_, to = F.greatest("a", F.col("rank") * self.block), F.least(F.col("z"), (F.col("rank") + 1) * self.block)
        cut = cut.select("sid", "rank", "row", "doc_id", (from_ - F.col("a")).alias("first"), (to - from_).alias("words"))
        return cut.join(self.slots, ["sid", "rank"])

    def _taken(self) -> DataFrame:
        """(doc_id, size, source_size, target, taken, first_slot, n_slots, digest of the text), a row for each row of ``docs``: the words that the
        mix takes of it, the first slot of the schedule that takes any (null: none), and the number of these slots."""
        taken = self.pieces.groupBy("row").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"), F.count("*").alias("n_slots"))
        zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
        return self.placed.join(taken, "row", "left").select("doc_id", "size", "source_size", "target", zero("taken"), "first_slot", zero("n_slots"), "digest")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as mixed: a document of which the mix takes words stays, as often as it is taken; one of which it takes none goes. Columns as in ``docs``.

    Of a source's stream every document is taken whole, as often as its stretch lies before the target, but for the one in which the
    target falls: that one counts to the nearest whole number, once at least. So a source's words miss its target by less than that
    one document. Documents are known by id and text; repeated rows of both share what they get (to the nearest whole
    number each), null ids are ids as others; null, empty and blank texts are never taken and go; an empty table gives an empty one.
    """
    i, d, n = (fresh(docs.columns, c) for c in ("id_", "digest_", "times_"))
    taken = SourceMix(docs, **options).told.where("taken > 0").groupBy("doc_id", "digest").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
    times = F.greatest(F.lit(1), F.round(F.col("taken") / F.col("size"))).cast("int")
    taken = small_side(taken.select(F.col("doc_id").alias(i), F.col("digest").alias(d), times.alias(n)), "taken")
    names = [f"`{c}`" for c in docs.columns]
    on = docs["doc_id"].cast("long").eqNullSafe(F.col(i)) & (F.xxhash64(docs["text"].cast("string")) == F.col(d))
    turns = F.explode(F.sequence(F.lit(1), F.col(n))).alias(fresh(docs.columns, "turn_"))
    return docs.join(taken, on).select(*names, turns).select(*names)
