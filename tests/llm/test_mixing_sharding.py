import hashlib
import math
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from gneiss.llm.mixing import GOLDEN, POINTS, SourceMix, mixed_documents, targets
from gneiss.llm.sharding import assign_shards, even_topology, grown, shard_of, write_shards


def test_targets_stop_at_the_cap(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 0)], "source string, source_size long")
    w = spark.createDataFrame([("a", 5.0), ("b", 2.0), ("c", 1.0), (None, 5.0)], "source string, weight double")
    t = {r.source: r.target for r in targets(sizes, w).collect()}
    assert t[None] == 0 and t["a"] == 30 and math.isclose(t["b"], 1980 * 2 / 3) and math.isclose(sum(t.values()), 2010)


def test_odd_rows(odd, none):
    m = SourceMix(odd, block=64)
    got = m.taken.collect()
    assert len(got) == odd.count()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r.doc_id, len((r.text or "").encode().split())) for r in odd.collect())
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    assert sum(r.taken for r in got) == sum(r.quota for r in m.sources.collect())
    assert SourceMix(none).taken.count() == 0
    assert mixed_documents(odd).columns == odd.columns
    assert mixed_documents(none).count() == 0
    clash = odd.selectExpr("*", "1 as _id", "2 as id_", "3 as times_", "4 as turn_", "5 as _taken", "6 as digest")
    assert mixed_documents(clash).columns == clash.columns and mixed_documents(clash).count() == mixed_documents(odd).count()
    assert sorted(map(str, m.taken.collect())) == sorted(map(str, SourceMix(odd, block=64).taken.collect()))


def test_mixed_documents_meet_their_targets_but_for_one_document(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for r in mixed_documents(docs).collect():
        sizes[r.source] += words(r.text)
    longest = {}
    for r in docs.collect():
        longest[r.source] = max(longest.get(r.source, 0), words(r.text))
    sources = SourceMix(docs).sources.collect()
    assert all(abs(sizes[r.source] - r.quota) < max(1, longest[r.source]) for r in sources)


def test_schedule_is_even(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    m = SourceMix(docs, block=16)
    slots = [r.sid for r in m.slots.orderBy("slot").collect()]
    share = {r.sid: r.target for r in m.sources.collect()}
    total = sum(share.values())
    for n in (100, 500, len(slots)):
        got = Counter(slots[:n])
        assert all(abs(got[s] - n * t / total) < 6 for s, t in share.items())
    words = {r.sid: r.w for r in m.pieces.groupBy("sid").agg(F.sum("words").alias("w")).collect()}
    assert words == {r.sid: r.quota for r in m.sources.collect() if r.quota}


def test_slots_are_those_of_the_golden_points(spark, sf):
    """Every slot's source by the point's place among the cumulative quotas; ranks without gaps; documents in the slots of their words."""
    m = SourceMix(spark.read.parquet(f"{sf}/documents.parquet"), block=16)
    sources = m.sources.orderBy("sid").collect()
    total, n, upto, ends = sum(r.quota for r in sources), -(-sum(r.source_size for r in sources) // 16), 0, []
    for r in sources:
        upto += r.quota
        ends.append(math.floor(upto / total * POINTS))
    want, ranks = {}, Counter()
    for i in range(n):
        sid = next(k for k, e in enumerate(ends) if i * GOLDEN % POINTS < e)
        if ranks[sid] < -(-sources[sid].quota // 16):
            want[i] = (sid, ranks[sid])
            ranks[sid] += 1
    got = {r.slot: (r.sid, r["rank"]) for r in m.slots.collect()}
    assert {k: v for k, v in got.items() if k < n} == want
    assert Counter(s for s, _ in got.values()) == Counter({r.sid: -(-r.quota // 16) for r in sources if r.quota})


def test_only_empty_texts(spark):
    d = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [r.taken for r in SourceMix(d).taken.collect()] == [0, 0]


def draw(*parts):
    return (int(hashlib.md5(":".join(parts).encode()).hexdigest()[:13], 16) + 0.5) / 2**52


def brute_shard(key, topology):
    at, kids = "", {}
    for i, (r, k, w) in enumerate(topology):
        for p, c in (("", f"r{r}"), (f"r{r}", f"r{r}/k{k}"), (f"r{r}/k{k}", f"s{i}")):
            kids.setdefault(p, Counter())[c] += w
    while at in kids:
        at = min(kids[at], key=lambda c: (-math.log(draw("tree", key, c)) / kids[at][c], c))
    return int(at[1:])


def test_shards(spark, sf, odd, none):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs = docs.union(odd.select("doc_id", "text"))
    rows, got = docs.collect(), assign_shards(docs).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    for r in got:
        key = "" if r.doc_id is None else str(r.doc_id)
        assert r.shard == brute_shard(key, even_topology()) and r.grown_shard == brute_shard(key, grown(even_topology()))
        assert r.grown_shard in (r.shard, 8)
    for s in range(8):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert assign_shards(none).count() == 0


def test_weights_hold_and_moves_stay_inside(spark):
    t = [(0, 0, 1.0), (0, 0, 3.0), (0, 1, 2.0), (1, 2, 2.0)]
    more = [(0, 0, 1.0), (0, 0, 6.0), (0, 1, 2.0), (1, 2, 2.0)]
    ids = spark.range(20000)
    at = ids.select(shard_of(F.col("id"), t).alias("a"), shard_of(F.col("id"), more).alias("b")).groupBy("a", "b").count().collect()
    n = Counter()
    for r in at:
        n[r.a] += r["count"]
    assert all(abs(n[i] / 20000 - w / 8) < 0.02 for i, (_, _, w) in enumerate(t))
    # only rack 0 of region 0 grew: no row goes from rack 1 or region 1 to anything else that did not
    assert not [r for r in at if r.a != r.b and r.b == 3]


def test_write(spark, odd, tmp_path):
    write_shards(odd.select("doc_id", "text"), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == odd.count()
    assert all(re.match("shard=[0-7]$|_SUCCESS|\\.", p.name) for p in (tmp_path / "s").iterdir())
