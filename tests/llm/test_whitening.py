import math

import numpy as np
import pytest

from gneiss.llm import whitening
from gneiss.llm.q_whitening import op11_embedding_whitening
from gneiss.llm.whitening import whitened


def plainly(vectors, most=16):
    """(n, deviations, whitened, explained) by numpy over one array, for vectors that are whole."""
    x = np.floor(64 * np.array(vectors, dtype=np.float64)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = fit - s / n
    values, vecs = np.linalg.eigh(centred.T @ centred / n)
    k = min(most, x.shape[1])
    values, vecs = values[::-1][:k], vecs[:, ::-1][:, :k]
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s, strict=True)) for row in x]
    return n, deviation, (x - s / n) @ vecs / np.sqrt(values), values / (centred**2).sum() * n


def held(rows, ids, vectors, most=16):
    n, deviation, white, explained = plainly(vectors, most)
    at = {(r.vec_id, r.component): r for r in rows}
    k = white.shape[1]
    assert len(at) == len(rows) == len(ids) * k
    for c in range(k):
        got = np.array([at[i, c + 1].whitened for i in ids])
        sign = 1 if got @ white[:, c] > 0 else -1
        assert np.allclose(got, sign * white[:, c], rtol=1e-7, atol=1e-7)
    for j, i in enumerate(ids):
        for c in range(k):
            r = at[i, c + 1]
            assert r.n == n and r.deviation == deviation[j] and math.isclose(r.explained, explained[c], rel_tol=1e-9) and r.identity_error < 1e-9


def test_all_rows(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = df.collect()
    held(op11_embedding_whitening(spark, sf).collect(), [r.vec_id for r in rows], [r.embedding for r in rows])


def test_blocks_and_splits(spark, monkeypatch):
    """Many blocks of rows and of columns, several along the rows in each product."""
    monkeypatch.setattr(whitening, "BLOCK_CELLS", 70)
    monkeypatch.setattr(whitening, "BLOCK_COLUMNS", 4)
    monkeypatch.setattr(whitening, "TASK_BLOCKS", 3)
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(300, 10)) @ rng.normal(size=(10, 10))).astype(np.float32)
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    held(whitened(df.repartition(5), most=7).collect(), range(300), vectors, 7)


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    good = [[float(c) for c in v] for v in rng.normal(size=(12, 3))]
    inf, nan = float("inf"), float("nan")
    rows = [(i, v) for i, v in enumerate(good)] + [(100 + i, good[0]) for i in range(40)]
    bad = [(200, None), (201, [1.0, None, 2.0]), (202, [1.0, nan, 2.0]), (203, [inf, 0.0, 0.0]), (204, [0.0, -inf, 0.0])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").selectExpr("*", "0 as n", "'x' as index", "1 as key", "2 as x", "3 as component")
    held(whitened(df).collect(), [i for i, _ in rows], [v for _, v in rows])
    twice = whitened(df.where("vec_id < 100").union(df.where("vec_id = 3")).selectExpr("nullif(vec_id, 5) as vec_id", "embedding"))
    got = twice.collect()
    assert len(got) == 13 * 3 and sum(r.vec_id is None for r in got) == 3 and len({(r.vec_id, r.component, r.whitened) for r in got}) == 12 * 3
    assert whitened(df.where("vec_id = 200")).count() == 0 and whitened(df.where("false")).columns == twice.columns
    assert whitened(spark.createDataFrame([(1, [])], "vec_id long, embedding array<float>")).count() == 0
    with pytest.raises(ValueError):
        whitened(df.select("vec_id", "embedding").union(spark.createDataFrame([(9, [1.0])], "vec_id long, embedding array<double>")))


def test_no_variance(spark):
    one = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(3)], "vec_id long, embedding array<float>")
    got = whitened(one).collect()
    assert len(got) == 6 and all(r.whitened is None and r.explained == 0 and r.deviation == 0 and r.n == 1 and r.identity_error is None for r in got)
    flat = spark.createDataFrame([(i, [float(i), 2.0]) for i in range(5)], "vec_id long, embedding array<float>")
    got = {(r.vec_id, r.component): r for r in whitened(flat).collect()}
    assert math.isclose(abs(got[0, 1].whitened), 2 / math.sqrt(2)) and got[0, 1].explained == 1 and got[0, 2].whitened is None and got[0, 1].identity_error < 1e-12
