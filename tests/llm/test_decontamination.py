import hashlib
import re
from collections import defaultdict

from claimspan.llm import decontamination as d


def brute(docs, items, window=10):
    """Row by row, from the definition."""
    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    of = lambda t: word.findall((t or "").encode().lower())
    windows = defaultdict(set)
    for item, text in items:
        w = of(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows[tuple(w[i:i + window])].add(item)
    out = []
    for doc, text in docs:
        w, hit, found = of(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if owners := windows.get(tuple(w[i:i + n])):
                    hit |= set(range(i, i + n))
                    found |= owners
        ids = ",".join(sorted(map(str, found)))
        out.append((doc, len(w), len(hit), len(found),
                    hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r)[:6] for r in df.collect()), key=str)


def test_whole_tables_equal_brute_force(spark, documents):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    docs = [(r.doc_id, r.text) for r in documents.collect()]
    items = [(r.item_id, r.text) for r in bench.collect()]
    got = rows(d.report(documents, bench))
    assert got == brute(docs, items)
    assert any(r[5] for r in got)


ITEMS = [(1, "Alpha beta, gamma"), (10, "alpha BETA gamma!"), (2, "a b c d e f g h i j k"),
         (3, ""), (4, None), (5, "same same"), (None, "omega"), (2, "a b c d e f g h i j k")]


def test_odd_rows(spark, make):
    docs = [(1, None), (2, ""), (3, " .,!"), (4, "x alpha-beta(GAMMA) y"),
            (4, "x alpha-beta(GAMMA) y"), (None, "same same same"),
            (6, "a b c d e f g h i j x b c d e f g h i j k"), (7, "alpha beta delta gamma"),
            (8, "omega"), (9, "Été same saMe " * 20_000), (10, "alpha"), (11, "beta gamma")]
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = d.report(make(docs), bench)
    assert rows(got) == brute(docs, [i for i in ITEMS if i[0] is not None])
    near = {r.doc_id: r.near_items for r in d.search(make(docs), bench).collect()}
    assert near[7] == [1, 10] and near[10] == []  # one word stands between


def test_blocks_do_not_change_the_result(spark, make):
    docs = make([(1, "alpha beta gamma same same"), (2, "a b c d e f g h i j k"), (3, "q")])
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    whole = d.search(docs, bench).collect()
    assert d.search(docs, bench, block_words=3).select(docs.columns[0], *d._NAMES).collect() \
        == d.search(docs, bench).select(docs.columns[0], *d._NAMES).collect()
    assert [r.items for r in whole] == [[1, 5, 10], [2], []]


def test_empty_tables_and_clean(spark, make):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert d.report(make([]), bench).collect() == []
    got = d.report(make([(1, "alpha beta gamma")]), bench.limit(0)).collect()
    assert [(r.n_words, r.n_hit, r.contaminated) for r in got] == [(3, 0, False)]
    docs = make([(1, "alpha beta gamma"), (2, "fine"), (3, None)])
    kept = d.clean(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3]
