import random
from collections import Counter

import pytest

from gneiss.llm.common import materialise
from gneiss.llm.components import components, merged
from gneiss.llm.jaccard_join import JaccardJoin, jaccard_components, keep_one


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in sets.items():
        for j, t in sets.items():
            if j < i and s and t and 100 * len(s & t) >= 80 * len(s | t):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def check(df, **options):
    want = brute([(r.doc_id, r.text) for r in df.collect()])
    got = jaccard_components(df, **options).collect()
    assert len(got) == df.count()
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]
        else:
            assert r.component_id is None


def test_odd_rows(odd, none):
    check(odd)
    assert jaccard_components(none).count() == 0
    kept = {r.doc_id for r in keep_one(odd).collect()}
    assert kept == {None, 1, 4, 5, 6, 7, 8, 10, 11}
    assert keep_one(odd).columns == odd.columns


def test_one_row_of_each_group_and_no_text_is_lost(spark):
    """Rows of one id with several texts, repeated rows, and columns named as those that the operator adds."""
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, a), (1, a), (5, a), (5, b), (5, b.upper()), (6, b), (7, "c d"), (7, "c d"), (8, ""), (8, None), (8, ""), (None, a), (None, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id_", "2 as digest_", "3 as gone_", "4 as id", "5 as n", "6 as rows", "7 as comp")
    got = keep_one(df)
    assert got.columns == df.columns
    kept = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    assert [k for k in kept if k[1] and k[0] is not None and k[0] < 7] in ([(1, a), (5, b)], [(1, a), (5, b.upper())])
    assert Counter(k[0] for k in kept) == {1: 1, 5: 1, 7: 1, 8: 3, None: 2}


def test_near_copies_of_all_distances(spark):
    """Families of edited copies around the threshold, many unrelated documents that share passages, in small blocks and few levels."""
    rnd, rows = random.Random(5), []
    passage = [f"p{i}" for i in range(30)]
    for f in range(12):
        text = [f"f{f}w{rnd.randrange(400)}" for _ in range(120)]
        for _ in range(14):
            copy = text[:]
            for _ in range(rnd.randrange(9)):
                copy[rnd.randrange(len(copy))] = f"e{rnd.randrange(10**6)}"
            rows.append(copy)
    for _ in range(80):
        own = [f"u{rnd.randrange(10**6)}" for _ in range(rnd.choice([3, 6, 10, 60]))]
        rows.append(own[: len(own) // 2] + passage + own[len(own) // 2 :])
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    check(df)
    check(df, levels=1, small=2, block=4)
    check(df, levels=2, small=4, block=8)


def test_rows_of_one_id_with_several_texts_keep_their_links(spark):
    """Each row is a document of its own: which of an id's texts is compared is no matter of chance."""
    base = " ".join(f"b{i}" for i in range(60))
    other = " ".join(f"o{i}" for i in range(60))
    rows = [(1, other), (1, base), (2, base + " tail"), (3, base + " other tail"), (4, other + " x"), (1, other)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id long, text string")
        got = sorted((r.id, r.n, r.comp) for r in JaccardJoin(df).members().collect())
        assert got == [(1, 56, 1), (1, 56, 1), (1, 56, 1), (2, 57, 1), (3, 58, 1), (4, 57, 1)]


def test_a_passage_that_all_share(spark):
    """Its shingles are common, so their regions are not gathered by shingle; single and repeated sets stay as they are."""
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, f"{passage} u{i}") for i in range(300)] + [(1000 + i, f"{passage} " + " ".join(f"v{i}x{k}" for k in range(60))) for i in range(300)] + [(2000 + i, f"{passage} u0") for i in range(50)]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 7), (None, 3), (100, 101)]
    got = dict(components(spark.createDataFrame(chain, "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("more", [[], [(1, 2)], [(3, 8), (3, 8)], [(20, 21), (21, 19), (7, 7)], [(2, 6), (8, 30), (None, 4), (30, 0)]])
def test_components_with_further_edges(spark, more):
    first = [(2, 1), (3, 2), (5, 6), (6, 7), (8, 9)]
    frame = lambda edges: spark.createDataFrame(edges, "a long, b long")
    before = materialise(components(frame(first)), "before")
    assert dict(merged(before, frame(more)).collect()) == dict(components(frame(first + more)).collect())
