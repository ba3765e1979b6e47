import time

import numpy as np
import pandas as pd
import pytest

from claimspan.llm import neighbours as n

SF = "/root/testdata/sf0.01"


def brute(ids, x, queries, k=20):
    out = {}
    for q in queries:
        score = (x * x[ids == q][0]).sum(axis=1)
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), float(score[i])) for i in order]
    return out


def result(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def recall(got, want):
    return (sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
            / sum(map(len, want.values())))


def test_recall_on_the_given_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = df.collect()
    ids = np.array([r.vec_id for r in rows])
    x = np.array([r.embedding for r in rows], np.float64)
    want = brute(ids, x, [int(i) for i in ids if i % 20 == 0])
    got = result(n.report(df))
    assert got.keys() == want.keys() and recall(got, want) >= 0.95
    exact = {(q, v): s for q in want for v, s in zip(ids.tolist(), (x * x[ids == q][0]).sum(1))}
    assert all(abs(s - exact[q, v]) < 1e-12 for q in got for v, s in got[q])


def test_many_cells_and_one_large_group(spark, monkeypatch):
    """Clusters of unequal lengths, a third of all vectors equal, small cells and blocks."""
    monkeypatch.setattr(n, "CELL_ROWS", 100)
    monkeypatch.setattr(n, "BLOCK", 150)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 24))
    x = np.concatenate([centres[rng.integers(0, 20, 1000)] + rng.normal(size=(1000, 24)) / 3,
                        np.repeat(rng.normal(size=(1, 24)), 500, axis=0)])
    ids = rng.permutation(len(x)) + 5
    df = spark.createDataFrame([(int(i), [float(v) for v in row]) for i, row in zip(ids, x)],
                               "vec_id long, embedding array<double>")
    want = brute(ids, x, [int(i) for i in ids if i % 20 == 0])
    got = result(n.report(df))
    assert recall(got, want) >= 0.95
    same = set(ids[1000:].tolist())
    q = next(i for i in want if i in same)
    assert [v for v, _ in got[q]] == [v for v, _ in want[q]]


@pytest.mark.parametrize("rows,want", [
    ([], {}),
    ([(0, [1.0, 0.0])], {}),
    ([(0, [1.0, 0.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [None, 1.0]),
      (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (None, [1.0, 1.0]),
      (7, [2.0, 1.0]), (8, [2.0, 5.0]), (7, [2.0, 1.0]), (9, [1.0, 1.0, 1.0]), (20, [9.0])],
     {0: [(7, 2.0), (8, 2.0)]}),
])
def test_odd_rows(spark, rows, want):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr(
        "*", "1 as score", "'x' as rank")
    assert result(n.report(df)) == want


def test_chi_square():
    assert abs(n.chi_square(2 * np.log(2), 2) - 0.5) < 1e-12
    assert abs(n.quantile(0.95, 8) - 15.507313) < 1e-5


def test_queries_of_a_block_cost_little_more_together():
    """A whole block of vectors without contrast; most of them must be verified."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(8192, 64))
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    ids, asked, longest = np.arange(len(x)) * 3, np.arange(0, 2048, 4), 1 + 1e-12
    y = n.lengthened(x, longest) @ n.projection(64, n.DIMENSIONS)
    p = n.scaled(x[asked], longest) @ n.projection(64, n.DIMENSIONS)
    queries = pd.DataFrame({"query_id": ids[asked], "vector": list(x[asked]),
                            "projected": list(p), "bound": np.inf})
    begin = time.process_time()
    got = n.search_block(ids, x, y, queries, 20, n.quantile(0.98, n.DIMENSIONS), longest)
    spent = time.process_time() - begin
    begin = time.process_time()
    for _ in range(3):
        rough = x[asked] @ x.T
        np.partition(rough, -20, axis=1)
    assert spent < 3 * (time.process_time() - begin)
    score = x[asked] @ x.T
    score[np.arange(len(asked)), asked] = -np.inf
    want = np.argsort(-score, axis=1)[:, :20] * 3
    have = got.groupby("query_id")["vec_id"].agg(set)
    assert sum(len(have[q] & set(w)) for q, w in zip(ids[asked], want)) >= 0.95 * want.size
