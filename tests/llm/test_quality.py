import glob
import math
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from claimspan.llm import quality as q
from claimspan.llm.common import LEAN, give_back, stored, stored_lean

SF = "/root/testdata/sf0.01"


def plain_model(words, order):
    """P(byte | context) of interpolated modified Kneser-Ney, from its definition."""
    raw = defaultdict(Counter)
    for word, n in words.items():
        line = b" " + word + b" "
        for i in range(1, len(line)):
            raw[min(i + 1, order)][line[max(0, i + 1 - order):i + 1]] += n
    counts = {order: raw[order]}
    for size in range(order - 1, 0, -1):
        counts[size] = Counter(g[1:] for g in counts[size + 1])
        counts[size].update(raw[size])
    off, total, rest = {}, defaultdict(Counter), defaultdict(lambda: defaultdict(float))
    for size in range(1, order + 1):
        seen = Counter(counts[size].values())
        off[size] = q.discounts([seen[i] for i in range(1, 5)])
        for g, n in counts[size].items():
            total[size][g[:-1]] += n
            rest[size][g[:-1]] += off[size][min(n, 3) - 1]

    def p(g):
        size = len(g)
        below = p(g[1:]) if size > 1 else 1 / 257
        if not total[size][g[:-1]]:
            return below
        n = counts[size][g]
        own = (n - off[size][min(n, 3) - 1]) if n else 0
        return (own + rest[size][g[:-1]] * below) / total[size][g[:-1]]

    return lambda word: sum(
        math.log(p(line[max(0, i + 1 - order):i + 1]))
        for line in [b" " + word + b" "] for i in range(1, len(line)))


def test_model_equals_its_definition(spark):
    texts = ["the then other there", "a the b", "bathe baths lathe été the the"]
    frame = spark.createDataFrame([(bytearray(t.encode()),) for t in texts], "text binary")
    model = q.fit(frame, 3)
    words = Counter(w for t in texts for w in t.encode().split())
    plain = plain_model(words, 3)
    probe = [b"the", b"th", b"zzz", b"at", b"hthe", "é".encode(), b"b"]
    got = model.word_scores(probe)
    for word, value in zip(probe, got):
        assert abs(value - plain(word)) < 1e-9, word


def test_keeps_clean_and_rejects_junk(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = q.judged(docs, labels).join(labels, "doc_id").collect()
    clean = [r.accepted for r in rows if r.quality == 1]
    junk = [r.accepted for r in rows if r.quality == 0]
    assert sum(clean) >= 0.99 * len(clean)
    assert sum(junk) < 0.5 * len(junk)
    kept = q.accepted(docs, labels)
    assert kept.columns == docs.columns


def test_odd_rows(spark, make):
    docs = make([(1, None), (2, ""), (3, "some words here"), (3, "some words here"),
                 (None, "x" * 100_000)])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(3, 1, 0), (1, 1, 0), (None, 1, 0), (2, 1, 1)], none.schema)
    assert all(r.accepted for r in q.judged(docs, none).collect())
    rows = {r.doc_id: r for r in q.judged(docs, some).collect()}
    assert rows[1].perplexity is None and rows[1].accepted and rows[2].accepted
    assert rows[3].accepted and not rows[None].accepted
    assert q.judged(docs, some).count() == 5
    assert q.judged(docs.limit(0), some).collect() == []


def kinds_of_junk(text):
    words = text.split()
    if sum(w == "|" for w in words) > len(words) / 10:
        return "pipes"
    if sum(w[-1] in "%$&*#" for w in words) > len(words) / 10:
        return "signs"
    pairs = Counter(zip(words, words[1:]))
    if len(words) >= 20 and pairs.most_common(1)[0][1] > len(words) / 10:
        return "repeated"
    return "other"


def test_each_kind_of_junk_apart(spark):
    """A word or a few said again and again are junk as well, however plausible each word."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 0")
    both = q.judged(docs, spark.read.parquet(f"{SF}/labels.parquet")).join(labels, "doc_id")
    found = defaultdict(list)
    for r in both.collect():
        found[kinds_of_junk(r.text)].append(r.accepted)
    for kind in ("pipes", "signs", "repeated"):
        assert len(found[kind]) >= 5, kind
        assert sum(found[kind]) <= 0.1 * len(found[kind]), (kind, found[kind])


def test_word_order_counts(spark):
    texts = ["red dogs bark at blue cats"] * 3 + ["blue cats run from red dogs"] * 3
    frame = spark.createDataFrame([(bytearray(t.encode()),) for t in texts], "text binary")
    model = q.fit_words(frame, 3)
    _, value, novelty = q.perplexities(
        [b"red dogs bark at blue cats", b"cats red at dogs blue bark", b"red dogs " * 50, None],
        model)
    assert value[0].as_py() < value[1].as_py()
    assert novelty[0].as_py() > 0.9 > 0.7 > novelty[2].as_py() and novelty[3].as_py() is None


def test_trains_on_every_trusted_text(spark):
    """Once each, however many there are; of clashing texts the same one in any order of rows."""
    docs = spark.range(20_100).selectExpr("id as doc_id", "concat('word', id) as text")
    labels = docs.selectExpr("doc_id", "1 as quality", "0 as toxic")
    more = spark.createDataFrame([(3, "word3"), (4, "b"), (4, "a"), (5, None)],
                                 "doc_id long, text string")
    rows = [sorted(bytes(r.text) for r in q.training_texts(d, labels).collect())
            for d in (docs.unionByName(more), more.orderBy("text").unionByName(docs))]
    assert rows[0] == rows[1] and len(rows[0]) == 20_100


def test_models_sent_and_joined_score_alike(spark, make, monkeypatch):
    texts = ["red dogs bark at blue cats", "blue cats run from red dogs", "red dogs " * 50,
             "cats zebra red zebra red zebra", "", None, "été dogs"]
    docs = make([*enumerate(texts), (2, texts[2]), (None, texts[3]), (None, texts[3])])
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, 0), (2, 1, 0)],
                                   "doc_id long, quality int, toxic int")

    def rows():
        return sorted(((r.doc_id, r.text, r.n_words, r.perplexity, r.novelty, r.accepted)
                       for r in q.judged(docs, labels).collect()), key=repr)

    sent = rows()
    monkeypatch.setattr(q, "VOCABULARY", 0)
    monkeypatch.setattr(q, "SHARDS", 3)
    joined = rows()
    assert len(sent) == len(joined) == len(texts) + 3
    for one, other in zip(sent, joined):
        assert one[:3] == other[:3] and one[5] == other[5]
        assert [v is None for v in one[3:5]] == [v is None for v in other[3:5]]
        assert all(v is None or abs(v / w - 1) < 1e-6 for v, w in zip(one[3:5], other[3:5]))


def test_pairs_in_many_shards_and_slices(spark, monkeypatch):
    texts = ["red dogs bark at blue cats", "blue cats run from red dogs " * 3, "", "red dogs run"]
    frame = spark.createDataFrame([(bytearray(t.encode()),) for t in texts], "text binary")
    model = q.fit_words(frame, 3)
    probe = [*(t.encode() for t in texts), b"zebra red dogs", None]
    whole = [c.to_pylist() for c in q.perplexities(probe, model)]
    monkeypatch.setattr(q, "SCORE_BYTES", 10)
    monkeypatch.setattr(q, "LEAST_SHARD_BYTES", 10)
    parts = [c.to_pylist() for c in q.perplexities(probe, model)]
    assert whole[0] == parts[0] == [6, 18, 0, 3, 3, 0]
    for one, other in zip(whole[1] + whole[2], parts[1] + parts[2]):
        assert one is other is None or abs(one / other - 1) < 1e-9


def test_frequent_pairs_are_not_shuffled(spark, monkeypatch):
    """And score as the shards do, whichever pairs are frequent."""
    texts = ["red dogs bark at blue cats", "blue cats run from red dogs " * 3, "", "red dogs run"]
    frame = spark.createDataFrame([(i, bytearray(t.encode())) for i, t in enumerate(texts)],
                                  "id long, text binary")
    probe = [*(t.encode() for t in texts), b"zebra red dogs bark bark", None]
    rows, scores = [], []
    monkeypatch.setattr(q, "LEAST_SHARD_BYTES", 10)
    for most in (0, 3, 1 << 20):
        monkeypatch.setattr(q, "COMMON", most)
        model = q.fit_words(frame.select("text"), 3)
        rows.append(q.sought(frame, model, 2).agg({"rows": "sum"}).first()[0])
        scores.append([c.to_pylist() for c in q.perplexities(probe, model)])
    # Of 6, 7 and 3 different pairs, of which three come most often: blue cats, red dogs, cats run.
    assert rows[0] == 16 > rows[1] > rows[2] == 0
    for other in scores[1:]:
        assert other[0] == scores[0][0]
        for one, two in zip(scores[0][1] + scores[0][2], other[1] + other[2]):
            assert one is two is None or abs(one / two - 1) < 1e-9


def test_packed_pairs_come_back():
    random = np.random.default_rng(1)
    for size in (0, 1, 2, 1000):
        before = random.integers(0, 9, size) * random.choice([1, q.VOCABULARY], size)
        pairs = np.sort(q.pair_names(before, random.integers(1, 2 * q.VOCABULARY, size)))
        assert (q.unpacked_pairs(q.packed_pairs(pairs), size) == pairs).all()
    values = random.standard_normal(1000).astype(np.float32)
    assert (q.unpacked(q.packed(values), 1000, values.dtype.str) == values).all()
    hashes = np.array([-(1 << 63), -5, 7, (1 << 63) - 1])
    assert (np.cumsum(np.diff(hashes, prepend=0)) == hashes).all()


def test_lean_tables_keep_no_shuffle_and_take_long_texts_in_small_batches(spark):
    def shuffled():
        folder = spark.conf.get("spark.local.dir", "/tmp")
        return set(glob.glob(f"{folder}/blockmgr-*/*/shuffle_*"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["size"])

    settings = {key: spark.conf.get(key) for key in LEAN}
    frame = spark.range(50).selectExpr("id", "repeat('x', 1 << 20) as text").coalesce(1)
    found = {}
    for write in (stored, stored_lean):
        before = shuffled()
        write(spark.range(100).groupBy((q.F.col("id") % 7).alias("k")).count(), "counted")
        left = bool(shuffled() - before)
        seen = write(frame.mapInArrow(sizes, "size long"), "sizes").agg({"size": "max"}).first()
        found[write] = left, seen[0]
    assert found[stored][0] and not found[stored_lean][0]
    assert found[stored][1] > 32 << 20 > 12 << 20 > found[stored_lean][1]
    assert {key: spark.conf.get(key) for key in LEAN} == settings


def test_a_worker_holds_what_was_sent_once():
    hashes, numbers = np.array([-(1 << 63), -5, 7, (1 << 63) - 1]), np.arange(1, 5, dtype=np.int32)
    value = {name: (q.packed(a), len(a), a.dtype.str) for name, a in (
        ("steps", np.diff(hashes, prepend=0)), ("numbers", numbers))}
    held = SimpleNamespace(value=value)
    first, second = q.Vocabulary.received(held), q.Vocabulary.received(held)
    assert (first.hashes == hashes).all() and (first.numbers == numbers).all()
    assert second.hashes is first.hashes and second.numbers is first.numbers
    assert all(isinstance(a, np.ndarray) for a in value.values()) and len(value) == 2


def test_a_task_gives_back_what_it_freed():
    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096

    held = [np.ones(12_000) for _ in range(2_000)]
    pins = held[::50]
    del held
    before = resident()
    give_back()
    assert before - resident() > 100 << 20 and len(pins) == 40
