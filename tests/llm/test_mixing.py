import numpy as np
import pytest
from pyspark.sql import functions as F

from claimspan.llm import mixing as m

SF = "/root/testdata/sf0.1"


def soft(seed, size=2000, sharp=0.3, share=(1, 1, 1)):
    rng = np.random.default_rng(seed)
    return rng.dirichlet(sharp * np.array(share), size), rng.integers(0, 500, size)


def least_squares(p, n, target, rounds=200_000):
    """Nonnegative least squares by plain projected gradient, far more steps than it takes."""
    scale, wanted, rate = p @ (n @ p), target * n.sum(), np.ones(len(p))
    for _ in range(rounds):
        then = np.maximum(0, rate - (p @ ((rate * n) @ p - wanted)) / scale)
        if np.abs(then - rate).max() < 1e-12:
            break
        rate = then
    return rate


@pytest.mark.parametrize("seed,sharp,share,target", [
    (1, 0.3, (1, 1, 1), (0.7, 0.25, 0.05)),  # within reach
    (2, 0.1, (8, 1, 1), (0.9, 0.1, 0.0)),
    (3, 3.0, (8, 1, 1), (0.9, 0.1, 0.0)),  # soft posteriors: out of reach
    (4, 5.0, (1, 1, 1), (0.0, 0.0, 1.0)),
])
def test_rates_are_the_least_squares_solution(spark, seed, sharp, share, target):
    p, n = soft(seed, sharp=sharp, share=share)
    target = np.array(target)
    frame = spark.createDataFrame(
        [(int(a), [float(x) for x in b]) for a, b in zip(n, p)],
        "n_tokens long, posteriors array<double>").repartition(4)
    steps = m.fit_rates(frame, target, max_steps=10)
    rate = steps.walk(p)[0]

    def away(r):
        return np.abs((r * n) @ p / n.sum() - target)

    best = least_squares(p, n, target, 20_000)
    assert (rate >= 0).all()
    # What is told of the way to the least is true.
    assert (away(rate) ** 2).sum() <= (away(best) ** 2).sum() + steps.gap + 1e-12
    if seed < 3:
        assert steps.gap <= m.GAP and away(rate).max() < 7.1e-3 and (rate < 0.05).any()
        assert np.abs((rate * n) @ p - (best * n) @ p).max() / n.sum() < 1e-2
    else:
        assert steps.gap > m.GAP and away(best).max() > 0.015


def test_too_few_steps_are_told(spark):
    p, n = soft(5)
    frame = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p)],
                                  "n_tokens long, posteriors array<double>")
    with pytest.warns(UserWarning, match="after 2 steps"):
        assert m.fit_rates(frame, np.array([0.9, 0.1, 0.0]), max_steps=2, gap=1e-15).gap > 1e-15


def test_rows_that_share_an_id_train_alike(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(9)] + [(2, None)],
                                 "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    picked = [sorted(map(tuple, m.training_rows(docs.repartition(n), labels, m.label_domain())
                         .collect()), key=str) for n in (1, 7)]
    assert picked[0] == picked[1] and len(picked[0]) == 2


def test_held_out_labels_and_copies(spark):
    """Trained on labels of even documents, right on those of odd ones."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out = m.mixed(docs, labels.where("doc_id % 2 = 0")).join(
        labels.where("doc_id % 2 = 1"), "doc_id").withColumn("is", m.label_domain()).collect()
    names = list(m.TARGET)
    right = [names[int(np.argmax(r.posteriors))] == r["is"] for r in out]
    assert sum(right) > 0.9 * len(right)
    assert all(r.copies in (int(r.rate), int(r.rate) + 1) for r in out)
    toxic = [r.rate for r in out if r["is"] == "toxic"]
    assert sum(x < 0.5 for x in toxic) > 0.8 * len(toxic)


def test_odd_rows(spark, make):
    docs = make([(1, None), (2, ""), (3, "ok words"), (3, "ok words"), (None, "null id"),
                 (5, "x " * 50_000)]).withColumn("rate", F.lit("clash"))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(3, 1, 0), (3, 0, 0), (5, None, 0), (None, 1, 1)],
                                 none.schema)
    for labels in (none, some):
        rows = m.mixed(docs, labels).collect()
        assert len(rows) == 6
        assert all(np.allclose(r.posteriors, 1 / 3) for r in rows)
        assert [r.n_tokens for r in rows if r.doc_id == 1] == [0]
    assert m.mixed(docs.limit(0), some).collect() == []
    assert m.sampled(docs, some).columns[:3] == ["doc_id", "text", "lang"]


def test_rates_are_worked_out_once(spark, make):
    docs = make([(i, t * 5) for i, t in enumerate(["a b c ", "d e f ", "a c "] * 4)])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(12)],
                                   "doc_id long, quality int, toxic int")
    plan = m.sampled(docs, labels)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
