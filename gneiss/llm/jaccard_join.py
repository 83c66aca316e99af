"""N-gram Jaccard join: an exact metric-space join on word-shingle sets.

d(A, B) = 1 - |A and B| / |A or B| is a metric; two documents link when d <= r.

* Equal sets are one point: a set is known by a 64-bit fingerprint and its size.
* First regions. Random document pivots give no regions on text: unrelated documents all
  lie at distance 1 from each other, so the window of 2r would copy each document into every
  region. The pivots of the first level are therefore the singletons {s} of all shingles:
  d(A, {s}) = 1 - 1/|A| for s in A and 1 otherwise, a tie that a fixed order of the
  shingles breaks (common shingles last). A belongs to the region of its first shingle,
  and because a linked B lacks at most |A| - ceil((1-r)|A|) shingles of A, A is copied
  into that many further regions of its own shingles. Linked sets meet in a region.
* Inside a region a document becomes pivot p and every member is compared with it: as many
  comparisons as members. It is the one of the fewest uncommon shingles, since the copies of a
  text have more of these than the text itself. Members within r of p are joined through p. Of the rest, x and y
  can link only if |d(x,p) - d(y,p)| <= r, so those outside r and the boundary members in
  their window form the region of the next level, which takes its own pivot. Regions whose
  members are all in one component are done. After ``levels`` levels the members that are
  left meet in salted blocks, across components and inside the windows only. Components are kept
  from level to level; the links of the next level join whole components.
* Before two sets are compared, folded count vectors bound their intersection from above
  (the generalised Jaccard distance of the counts never exceeds d), which rejects nearly
  all chance pairs without moving sets. Pairs that stay are decided on the whole sets.

Bounds: the list of common shingles is of ``COMMON`` at most (8 bytes each); it only
orders shingles and any list gives the same result. Components go through
``components``; nothing of the corpus is collected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gneiss.llm.common import BROADCAST_ROWS, fresh, materialise, release, sliced, small_side
from gneiss.llm.components import components, merged
from gneiss.llm.shingles import mix, shingle_sets

#: Most shingles in the list that is broadcast to order shingles, and the count from which one is listed:
#: tasks put forward what they meet twice in some ``COMMON_SEEN`` shingles, and these counts are added up.
COMMON, COMMON_LEAST, COMMON_SEEN = 1_000_000, 8, 2_000_000


def _fold_width(n: int) -> int:
    """Counters in the count vector of a set of ``n`` shingles: a power of two near n / 8."""
    return 1 << min(12, max(4, (max(n, 1) - 1).bit_length() - 3))


def _fingerprint(s: np.ndarray) -> np.int64:
    return mix(np.array([mix(s).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64)).view(np.int64)[0]


def _profiles(width: int):
    """One row a document (id, n, sig, counts, digest), and rows without counts: (sig: a shingle that is common here, n: how often)."""

    def run(batches):
        seen = []
        for batch in sliced(batches):
            ids, ns, sigs, counts = batch.column(0), [], [], []
            for s in shingle_sets(batch.column(1), width):
                ns.append(len(s))
                sigs.append(_fingerprint(s))
                counts.append(np.minimum(np.bincount((s & np.uint64(_fold_width(len(s)) - 1)).astype(np.int64), minlength=_fold_width(len(s))), 255).astype(np.uint8).tobytes())
                seen.append(s)
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(ns, pa.int64()), pa.array(sigs, pa.int64()), pa.array(counts, pa.binary()), batch.column(2)], ["id", "n", "sig", "counts", "digest"])
            if sum(map(len, seen)) > COMMON_SEEN:
                yield from _often(seen)
                seen = []
        if seen:
            yield from _often(seen)

    return run


def _often(sets: list[np.ndarray]):
    values, often = np.unique(np.concatenate(sets), return_counts=True)
    keep = often > 1
    n = int(keep.sum())
    yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.array(often[keep], pa.int64()), pa.array(values[keep].view(np.int64)), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64())], ["id", "n", "sig", "counts", "digest"])


def _regions(width: int, percent: int, common):
    """(s, sig, n, pos, rare, hot): each distinct set of a task in the regions of its first shingles; ``rare``
    is how many in a thousand of its shingles are not common, ``hot`` whether the region's shingle is common."""

    def run(batches):
        often, done = common.value, set()
        for batch in sliced(batches):
            out = [[], [], [], [], [], []]
            for s in shingle_sets(batch.column(0), width):
                n = len(s)
                if not n or (sig := int(_fingerprint(s))) in done:
                    continue
                done.add(sig)
                if len(done) > 200_000:
                    done.clear()
                last = often[np.minimum(np.searchsorted(often, s), len(often) - 1)] == s if len(often) else np.zeros(n, bool)
                k = n - -(-percent * n // 100) + 1
                first = np.concatenate([s[~last], s[last]])[:k]
                out[0].append(first.view(np.int64))
                out[1].append(np.full(k, sig, np.int64))
                out[2].append(np.full(k, n, np.int32))
                out[3].append(np.arange(k, dtype=np.int32))
                out[4].append(np.full(k, 1000 * (n - int(last.sum())) // n, np.int32))
                out[5].append(np.arange(k) >= n - int(last.sum()))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["s", "sig", "n", "pos", "rare", "hot"])

    return run


def _bounded(percent: int):
    """(ra, rb, na, nb, ca, cb, a, b) -> (ra, rb, dlo, far, a, b): ``dlo`` is the least distance that the count vectors
    allow; pairs beyond the threshold by that are ``far``."""

    def run(batches):
        for batch in sliced(batches, 4096):
            lo, far = [], []
            for n, m, x, y in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True):
                x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                width = min(len(x), len(y))
                if max(x.max(), y.max()) == 255:
                    both = min(n, m)
                else:
                    both = int(np.minimum(x.reshape(-1, width).sum(0), y.reshape(-1, width).sum(0)).sum())
                lo.append(1 - both / (n + m - both))
                far.append(100 * both < percent * (n + m - both))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(lo, pa.float64()), pa.array(far, pa.bool_()), batch.column(6), batch.column(7)], ["ra", "rb", "dlo", "far", "a", "b"]
            )

    return run


def _sets(width: int):
    """(sig, items) of each text."""

    def run(batches):
        for batch in sliced(batches):
            sets = [s.view(np.int64) for s in shingle_sets(batch.column(0), width)]
            offsets = np.cumsum([0, *map(len, sets)])
            sigs = pa.array([_fingerprint(s.view(np.uint64)) for s in sets], pa.int64())
            values = np.concatenate(sets) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([sigs, pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), pa.array(values)).cast(pa.list_(pa.int64()))], ["sig", "items"])

    return run


class JaccardJoin:
    """The join of ``docs``; ``profiles``, ``joined`` and ``members`` are its tables.

    ``docs`` needs an integer ``id`` column and a ``text`` column; others are ignored.
    Null or empty texts and texts without words have an empty set and no links. Null ids
    keep their row and link with nothing. Repeated rows are one set; rows of one id with several
    texts are documents of their own, each in its text's component. An empty table gives empty tables.
    """

    def __init__(self, docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, levels: int = 3, small: int = 64, block: int = 1024):
        self.width, self.percent, self.levels, self.small, self.block = width, percent, levels, small, block
        self.r = 1 - percent / 100
        self.texts = docs.select(docs[id].cast("long").alias("id"), docs[text].cast("string").alias("text"))
        self.profiles = self._profile()
        self.points = materialise(
            self.profiles.where("n > 0 and id is not null").groupBy("sig", "n").agg(F.min("id").alias("rep"), F.first("counts").alias("counts")), "points"
        )
        self.joined = self._join()

    def _profile(self) -> DataFrame:
        texts = self.texts.withColumn("digest", F.xxhash64("text"))
        made = materialise(texts.mapInArrow(_profiles(self.width), "id long, n long, sig long, counts binary, digest long"), "profiles")
        often = made.where("counts is null").groupBy("sig").agg(F.sum("n").alias("n")).where(f"n >= {COMMON_LEAST}").orderBy(F.desc("n"), "sig").limit(COMMON)
        at = np.sort(np.array([x.sig for x in often.select("sig").toLocalIterator()], np.int64).view(np.uint64))
        self.common = self.texts.sparkSession.sparkContext.broadcast(at)
        return made.where("counts is not null")

    def _near(self, x: str, y: str, first: bool = False) -> str:
        """Sizes and places of a shared shingle that a linked pair can have. ``first``: of its first shared
        shingle, before which it shares none; every linked pair meets in the region of that one too."""
        both = f"least({x}.n - {x}.pos, {y}.n - {y}.pos)" + ("" if first else f" + least({x}.pos, {y}.pos)")
        both = f"({both})"
        return f"100 * {both} >= {self.percent} * ({x}.n + {y}.n - {both})"

    def _measure(self, pairs: DataFrame) -> DataFrame:
        """(a, b, dlo, dhi, linked) of distinct pairs of fingerprints: exact, or only a bound beyond r from below."""
        point = self.points
        with_counts = (
            pairs.select("a", "b")
            .distinct()
            .join(point.select(F.col("sig").alias("a"), F.col("n").alias("na"), F.col("rep").alias("ra"), F.col("counts").alias("ca")), "a")
            .join(point.select(F.col("sig").alias("b"), F.col("n").alias("nb"), F.col("rep").alias("rb"), F.col("counts").alias("cb")), "b")
        )
        kinds = "ra long, rb long, dlo double, far boolean, a long, b long"
        bound = materialise(with_counts.select("ra", "rb", "na", "nb", "ca", "cb", "a", "b").mapInArrow(_bounded(self.percent), kinds), "bounds")
        near = bound.where("not far")
        need = materialise(near.select(F.col("ra").alias("id")).union(near.select(F.col("rb").alias("id"))).distinct(), "need")
        few = F.broadcast(need) if need.count() <= BROADCAST_ROWS else need
        # rows of one id may have several texts: each is read once, and its set goes by its fingerprint
        texts = self.texts.join(few, "id", "left_semi").withColumn("of", F.xxhash64("text")).dropDuplicates(["id", "of"])
        sets = materialise(texts.select("text").mapInArrow(_sets(self.width), "sig long, items array<long>"), "sets")
        exact = (
            near.select("a", "b")
            .join(sets.select(F.col("sig").alias("a"), F.col("items").alias("x")), "a")
            .join(sets.select(F.col("sig").alias("b"), F.col("items").alias("y")), "b")
            .withColumn("both", F.size(F.array_intersect("x", "y")))
            .withColumn("either", F.size("x") + F.size("y") - F.col("both"))
            .select("a", "b", (1 - F.col("both") / F.col("either")).alias("d"), (100 * F.col("both") >= self.percent * F.col("either")).alias("linked"))
            # an exchange between the joins and the grouping: a pivot of many members is split as a skewed join
            .repartition("a", "b")
            .distinct()
        )
        beyond = bound.where("far").select("a", "b", F.col("dlo"), F.lit(1.0).alias("dhi"), F.lit(False).alias("linked"))
        out = materialise(exact.select("a", "b", F.col("d").alias("dlo"), F.col("d").alias("dhi"), "linked").union(beyond), "measured")
        release(bound, need, sets)
        return out

    def _regions(self) -> DataFrame:
        """Entries of the regions that two sets share, each once. Entries meet by shingle; those of a common shingle, which is
        known to be shared, by shingle and set, so that no task holds all sets of a shingle that many have."""
        entries = self.texts.select("text").mapInArrow(_regions(self.width, self.percent, self.common), "s long, sig long, n int, pos int, rare int, hot boolean")
        entries = entries.withColumn("apart", F.when(F.col("hot"), F.col("sig")).otherwise(0))
        order = Window.partitionBy("s", "apart").orderBy("sig")
        region = (
            entries.withColumn("again", F.lag("sig").over(order).eqNullSafe(F.col("sig")))
            .where("not again")
            .withColumn("next", F.lead("sig").over(order))
            .withColumn("place", F.row_number().over(order))
            .where("hot or place > 1 or next is not null")
        )
        return materialise(region.select("s", "sig", "n", "pos", "rare"), "regions")

    def _join(self) -> DataFrame:
        """(node, comp): the components that the links make, over all levels."""
        region, joined = self._regions(), None
        for level in range(self.levels):
            pivot = region.groupBy("s").agg(F.min(F.struct("rare", "sig", "n", "pos")).alias("p")).select("s", "p.*")
            star = region.alias("x").join(pivot.withColumnRenamed("s", "ps").alias("p"), F.expr("x.s = p.ps")).where("x.sig <> p.sig")
            star = star.select("x.s", "x.sig", "x.n", "x.pos", "x.rare", F.col("p.sig").alias("pivot"), F.expr(self._near("x", "p")).alias("near"))
            measured = self._measure(star.where("near").select(F.col("sig").alias("a"), F.col("pivot").alias("b")))
            joined = components(measured.where("linked").select("a", "b")) if joined is None else merged(joined, measured.where("linked").select("a", "b"))
            # those that the pivot rejected without measure are beyond r, and no more is known of them
            spread = star.join(measured.select(F.col("a").alias("sig"), F.col("b").alias("pivot"), "dlo", "dhi", "linked"), ["sig", "pivot"], "left").select(
                "s", "sig", "n", "pos", "rare", F.coalesce("dlo", F.lit(self.r)).alias("dlo"), F.coalesce("dhi", F.lit(1.0)).alias("dhi"), F.coalesce("linked", F.lit(False)).alias("home")
            )
            spread = spread.join(joined, spread.sig == joined.node, "left").select("s", "sig", "n", "pos", "rare", "dlo", "dhi", "home", F.coalesce("comp", "sig").alias("comp"))
            stats = spread.groupBy("s").agg(F.count("*").alias("size"), F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.min(F.when(~F.col("home"), F.col("dlo"))).alias("edge"))
            # one component: done. Otherwise a home member stays where its window reaches someone outside
            left = spread.join(stats.where("size > 1 and c0 <> c1"), "s").where(f"not home or dhi + {self.r} + 1e-9 >= edge")
            left = materialise(left.select("s", "sig", "n", "pos", "rare", "dlo", "dhi", "comp", "size"), "left")
            release(measured, region)
            small = left.where(f"size <= {self.small}") if level + 1 < self.levels else left
            found = self._measure(self._across(small))
            joined = merged(joined, found.where("linked").select("a", "b"))
            release(found)
            region = left.where(f"size > {self.small}").select("s", "sig", "n", "pos", "rare")
            if level + 1 == self.levels or not region.limit(1).count():
                release(left)
                break
            region = materialise(region, "regions")
            release(left)
        return joined

    def _across(self, members: DataFrame) -> DataFrame:
        """Pairs of a region across components whose windows meet; a large region is dealt in blocks of ``block`` members."""
        sides = F.greatest(F.lit(1), F.ceil(F.col("size") / self.block)).cast("int")
        dealt = members.withColumn("sides", sides).withColumn("mine", F.pmod(F.hash("sig"), F.col("sides")))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
        dealt = dealt.withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other")).drop("other")
        x, y = dealt.alias("x"), dealt.alias("y")
        on = "x.s = y.s and x.i = y.i and x.j = y.j and x.sig < y.sig and x.comp <> y.comp"
        ours = "(x.mine <> y.mine or x.i = x.j)"
        window = f"x.dlo - y.dhi <= {self.r} + 1e-9 and y.dlo - x.dhi <= {self.r} + 1e-9"
        return x.join(y, F.expr(f"{on} and {ours} and {window} and {self._near('x', 'y', first=True)}")).select(F.col("x.sig").alias("a"), F.col("y.sig").alias("b"))

    def members(self) -> DataFrame:
        """(id, n, sig, digest, comp): every row of ``docs`` with the hash of its text and the component of its set, the smallest id in it.

        A set without links is a component with its copies; a document without words is one by itself.
        """
        joined = self.joined
        rep = self.points.join(joined, self.points.sig == joined.node, "left").select("sig", "n", F.coalesce("comp", "sig").alias("root"), "rep")
        least = rep.groupBy("root").agg(F.min("rep").alias("comp"))
        named = rep.join(least, "root").select("sig", "n", "comp")
        return self.profiles.join(named, ["sig", "n"], "left").select("id", "n", "sig", "digest", F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("comp")).otherwise(F.col("id")).alias("comp"))


def jaccard_components(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document; see ``JaccardJoin``."""
    return JaccardJoin(docs, **options).members().select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"))


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each group of near copies: the smallest id and, of several texts of it in the group, the smallest hash.

    A row goes by id and text, so that another text of the same id stays in its own group; of repeated rows (same id and text) any one stays.
    Rows of null id, and those without words (null, empty or blank texts), link with nothing and all stay. An empty table gives an
    empty one; columns are those of ``docs``, whatever their names.
    """
    join = JaccardJoin(docs, id=id, text=text, **options)
    at = materialise(join.members().where("n > 0 and id is not null").groupBy("comp", "id", "digest").agg(F.count("*").alias("rows")), "members")
    kept = at.groupBy("comp").agg(F.min(F.struct("id", "digest")).alias("k")).select("comp", F.col("k.id").alias("id"), F.col("k.digest").alias("digest"))
    gone = at.join(kept, ["comp", "id", "digest"], "left_anti").select("id", "digest", F.lit(True).alias("gone"))
    again = at.where("rows > 1").join(kept, ["comp", "id", "digest"], "left_semi").select("id", "digest", F.lit(False).alias("gone"))
    i, d, g = (fresh(docs.columns, c) for c in ("id_", "digest_", "gone_"))
    fate = small_side(gone.union(again).select(F.col("id").alias(i), F.col("digest").alias(d), F.col("gone").alias(g)), "fate")
    names = [f"`{c}`" for c in docs.columns]
    judged = docs.withColumns({i: docs[id].cast("long"), d: F.xxhash64(docs[text].cast("string"))}).join(fate, [i, d], "left")
    once = judged.where(f"not {g}").dropDuplicates([i, d])
    return judged.where(f"{g} is null").select(*names).union(once.select(*names))
