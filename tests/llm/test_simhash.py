import numpy as np
import xxhash

from claimspan.llm import simhash as s


def brute_print(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def brute_groups(prints):
    """doc -> least doc reachable, over all pairs."""
    at = {d: d for d, _ in prints}
    changed = True
    while changed:
        changed = False
        for a, p in prints:
            for b, q in prints:
                if (p ^ q).bit_count() <= 2 and at[b] < at[a]:
                    at[a], changed = at[b], True
    return at


def test_equals_brute_force(documents):
    docs = [(r.doc_id, r.text) for r in documents.collect()]
    prints = [(d, brute_print(t)) for d, t in docs]
    at = brute_groups(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id)
           for r in s.near_duplicates(documents).collect()}
    assert got == {d: (f"{p:016x}", at[d]) for d, p in prints}
    assert len(set(at.values())) < len(at)


def test_odd_rows(make):
    docs = [(5, None), (3, ""), (4, " \n"), (7, "one"), (8, "ONE"), (8, "ONE"),
            (None, "alone here"), (9, "A b C " * 30_000), (2, "a b c " * 30_000), (11, "é É")]
    got = {r.doc_id: (r.fingerprint, r.component_id)
           for r in s.near_duplicates(make(docs)).collect()}
    assert got[5] == got[3] == got[4] == ("0" * 16, 3)
    assert got[7] == got[8] and got[7][1] == 7
    assert got[9] == got[2] and got[9][1] == 2
    assert got[None][1] is None
    for doc, text in docs:
        assert got[doc][0] == f"{brute_print(text):016x}"
    assert s.near_duplicates(make([])).collect() == []


def test_one_of_each(make):
    docs = make([(1, "a b c d"), (2, "A B c d"), (3, "other words here"), (None, "a b c d"),
                 (3, "other words here"), (4, None), (5, "")])
    kept = s.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 3, 4, None]


def test_trees_keep_every_link(spark):
    """Planted chains and a ball of close fingerprints, over many shards and deep trees."""
    rng = np.random.default_rng(7)
    points = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    chain = [points[0]]
    for _ in range(400):
        flip = rng.choice(64, 2, replace=False)
        chain.append(chain[-1] ^ np.uint64(1 << int(flip[0])) ^ np.uint64(1 << int(flip[1])))
    ball = [points[1] ^ np.uint64(1 << int(i)) ^ np.uint64(1 << int(j))
            for i in range(64) for j in range(64)]
    every = np.unique(np.concatenate([points, chain, ball]).astype(np.uint64))
    frame = spark.createDataFrame([(int(x),) for x in every.view(np.int64)], "simhash long")
    edges = s.links(frame, sample=800, per_shard=20)
    at = {r.node: r.root for r in s.components(edges).collect()}
    find = lambda x: at.get(x, x)
    signed = every.view(np.int64).tolist()
    for i in range(0, len(every), 500):
        close = np.bitwise_count(every[i:i + 500, None] ^ every[None, :]) <= 2
        for a, b in zip(*np.nonzero(close)):
            assert find(signed[i + a]) == find(signed[b])
    for node, root in at.items():
        assert root < node and root not in at
