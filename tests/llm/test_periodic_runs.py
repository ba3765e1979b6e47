import hashlib
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimspan.llm import periodic_runs as p


def brute(w, least=12):
    """All stretches of every period, the smallest of those alike."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = q
        while i < len(w):
            begin = i
            while i < len(w) and w[i] == w[i - q]:
                i += 1
            if i > begin and i - begin + q >= max(least, 2 * q):
                found.setdefault((begin - q, i - begin + q), q)
            i = max(i, begin + 1)
    return by_start((s, n, q) for (s, n), q in found.items())


def by_start(runs):
    return sorted(runs, key=lambda run: (run[0], run[2]))


def texts(count, seed):
    rng = random.Random(seed)
    for _ in range(count):
        letters, n = rng.choice([1, 2, 2, 3, 6]), rng.randint(0, 70)
        w = [rng.randrange(letters) for _ in range(n)]
        for _ in range(rng.randint(0, 3) if n else 0):
            a, q = rng.randrange(n), rng.randint(1, 12)
            for i in range(a + q, min(n, a + q * rng.randint(2, 6))):
                w[i] = w[i - q]
        yield np.array(w, np.int64)


def test_both_ways_equal_brute_force():
    for w in texts(3_000, seed=7):
        expected = brute(w.tolist())
        assert p.find_runs(w) == expected
        if len(w) >= p.LEAST:
            numbers = np.unique(w, return_inverse=True)[1]
            assert by_start(p.lyndon_runs(numbers)) == expected
            assert by_start(p.diagonal_runs(p.contexts(numbers))) == expected
            if expected:
                assert len(p.may_repeat(w, np.zeros(len(w), np.int64)))


def test_documents_at_once_equal_each_alone():
    rows = [[b"w%d" % x for x in w] for w in texts(200, seed=9)]
    assert p.runs_of(rows) == [brute(row) for row in rows]


def test_long_texts_of_one_phrase_end():
    began = time.time()
    for w, expected in (
            (np.zeros(300_000, np.int64), [(0, 300_000, 1)]),
            (np.arange(300_000) % 1_000, [(0, 300_000, 1_000)]),
            (np.arange(300_000), [])):
        assert p.find_runs(w) == expected
    many = np.zeros(200_000, np.int64)
    many[np.cumsum(np.random.default_rng(1).integers(200, 2_000, 150))[:100]] = 1
    assert len(p.find_runs(many)) >= 100
    assert time.time() - began < 60


def expected_row(doc, text):
    w = (text or "").split(" ") if text else []
    w = [x for x in w if x]
    h = None if doc is None else zlib.crc32(str(doc).encode())
    if h is not None and h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        q = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % q] for i, x in enumerate(w)]
    runs = brute(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    top = min(runs, key=lambda run: (-run[1], run[0], run[2]), default=(None, None, None))
    return (doc, len(runs), *top, top[0] if top[0] is None else 1000 * top[1] // top[2],
            hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode())
            .hexdigest())


def test_odd_rows(make):
    looped = [d for d in range(400) if zlib.crc32(str(d).encode()) % 10 == 0]
    rng = random.Random(4)
    prose = " ".join(rng.choice("the of and a tree house river sun".split()) for _ in range(400))
    rows = [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "a b " * 30), (5, "a b " * 30),
            (None, "x y z " * 9), (6, "é " * 12), (7, "é " * 11),
            *[(d, prose) for d in looped], (looped[0], None), (looped[1], "a"),
            (8, "again " * 20_000), (9, prose)]
    out = p.report(make(rows))
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli",
                           "runs_sha256", "collapsed_sha256"]
    plain = [(d, t if t is None else " ".join(t.split())) for d, t in rows if d != 8]
    got = sorted((tuple(r) for r in out.where("doc_id is null or doc_id <> 8").collect()), key=str)
    assert got == sorted((expected_row(d, t) for d, t in plain), key=str)
    assert tuple(out.where("doc_id = 8").first())[1:6] == (1, 0, 20_000, 1, 20_000_000)
    assert p.report(make([])).collect() == []


def test_collapsed_texts(make):
    text = "so it goes " * 6 + "end\nhere"
    rows = {r.doc_id: r for r in p.collapsed(make([(1, text), (2, "as \n it was"), (3, None)])
                                             .withColumn("runs", F.lit("old"))).collect()}
    assert rows[1].text == "so it goes end here" and rows[1].n_words == -1
    assert [tuple(run) for run in rows[1].runs] == [(0, 18, 3)]
    assert (rows[2].text, rows[2].runs, rows[3].text) == ("as \n it was", [], None)


@pytest.mark.parametrize("pairs", [0, 1 << 30])
def test_query_does_not_depend_on_the_way(spark, documents, monkeypatch, pairs):
    from claimspan.llm.queries import QUERIES
    plain = QUERIES["op12_periodic_runs"](spark, "/root/testdata/sf0.001").collect()
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    monkeypatch.setattr(p, "PAIRS_A_WORD", pairs)
    words = [p.looped(text.encode().split(), doc) for doc, text in rows]
    assert {doc: len(runs) for (doc, _), runs in zip(rows, p.runs_of(words))} == {
        r.doc_id: r.n_runs for r in plain}
