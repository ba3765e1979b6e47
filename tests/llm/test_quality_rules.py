import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimspan.llm import quality_rules as q

SPACE = " \t\n\r\x0b\x0c"


def cut(text):
    out = "".join(" " if c in SPACE else c for c in text or "").split(" ")
    return [w for w in out if w]


def base(text):
    words = cut(text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    many = Counter(windows)
    hit = {i + o for i, w in enumerate(windows) if many[w] > 1 for o in range(3)}
    lines = [x for x in (text or "").split("\n") if cut(x)]
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""),
            len(lines) - len(set(lines)), len(hit), failed)


def kneser_ney(texts, order):
    """P(last byte of a gram | those before it), by definition, recursively."""
    counts = {order: Counter()}
    for text in texts:
        line = b"\0" * (order - 1) + " ".join(cut(text)).encode() + b"\n"
        counts[order].update(line[i:i + order] for i in range(len(line) - order + 1))
    for size in range(order - 1, 0, -1):
        counts[size] = Counter(gram[1:] for gram in counts[size + 1])
    off, total, rest = {}, {}, {}
    for size, table in counts.items():
        n = Counter(table.values())
        d = q.discounts(n[1], n[2], n[3], n[4])
        off[size] = lambda c, d=d: d[min(c, 3) - 1]
        total[size], rest[size] = Counter(), defaultdict(float)
        for gram, c in table.items():
            total[size][gram[:-1]] += c
            rest[size][gram[:-1]] += off[size](c)

    def p(gram):
        if not gram:
            return 1 / 257
        size, context = len(gram), gram[:-1]
        if not total[size][context]:
            return p(gram[1:])
        c = counts[size][gram]
        own = (c - off[size](c)) / total[size][context] if c else 0
        return own + rest[size][context] / total[size][context] * p(gram[1:])
    return p


def test_model_equals_its_definition(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["the", "tree", "été", "a", "on\n", "x" * 9])
                      for _ in range(rng.randint(1, 30))) for _ in range(40)]
    frame = spark.createDataFrame([(t.encode(),) for t in texts + [" ", ""]], "text binary")
    model, p = q.fit(frame.repartition(3)), kneser_ney(texts, q.ORDER)
    for probe in texts[:10] + ["the éléphant zzz", "q"]:
        line = b"\0" * (q.ORDER - 1) + " ".join(cut(probe)).encode() + b"\n"
        grams = [line[i:i + q.ORDER] for i in range(len(line) - q.ORDER + 1)]
        keys = np.array([int.from_bytes(g, "big") for g in grams])
        expected = [math.log(p(g)) for g in grams]
        assert np.allclose(model.scores(keys), expected, atol=1e-5)
        got = q.measures([probe.encode()], model)[5][0].as_py()
        assert got == pytest.approx(math.exp(-sum(expected) / len(expected)), rel=1e-5)


ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "word"), (5, "a b c " * 40), (5, "a b c " * 40),
       (6, "\n".join(["same line", "", " ", "same line", "same line ", "same line"] * 10)),
       (7, "Größe 漢字 <b>|x|</b> 100%\r\n" * 3), (None, " ".join(map(str, range(80)))),
       (8, " ".join(f"w{i}" for i in range(300_000))), (9, "a b c x a b c " + "y z " * 20),
       (10, "x" * 400_000)]


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


def told(df):
    return sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines,
                    r.n_repeat_words, r.base_failed) for r in df.collect()), key=str)


def test_base_rules_of_odd_rows(make, labels):
    docs = make(ODD).withColumns({"kept": F.lit("old"), "low": F.lit("old")})
    out = q.judged(docs, labels)
    assert told(out) == sorted(((i, *base(t)) for i, t in ODD), key=str)
    assert out.where("kept = base_failed or perplexity is not null").isEmpty()
    assert q.report(make([]), labels).collect() == []
    kept = q.accepted(docs, labels)
    assert kept.columns == docs.columns and {r.kept for r in kept.collect()} == {"old"}


def test_base_rules_of_a_whole_table(spark, documents):
    from claimspan.llm.queries import QUERIES
    out = QUERIES["op13_quality_rules"](spark, "/root/testdata/sf0.001")
    rows = documents.select("doc_id", "text").collect()
    assert told(out) == sorted(((r.doc_id, *base(r.text)) for r in rows), key=str)
    assert out.where("base_failed and kept").isEmpty()


def junk(text):
    return F.when(text.rlike(r"[#*$%&]{3}"), "signs").when(text.contains(" | "), "pipes")


def test_held_out_junk_goes_and_clean_documents_stay(spark):
    """Labels of half of the documents; the other half tells how well it works."""
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    out = q.judged(docs, labels.where("doc_id % 2 = 0")).where("doc_id % 2 = 1")
    held = out.join(labels, "doc_id").where("not base_failed").withColumn(
        "kind", F.when(F.col("quality") == 1, "clean").otherwise(junk(F.col("text"))))
    share = {r.kind: r.share for r in held.groupBy("kind").agg(
        F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    assert share["clean"] > 0.98 and share["signs"] < 0.02 and share["pipes"] < 0.02


def test_texts_that_are_too_easy_go(spark, documents):
    """Common words in any order are below the lower band."""
    rng = random.Random(1)
    easy = [(10_000_000 + i, " ".join(rng.choice(["the", "of", "the", "and", "in"])
                                      for _ in range(120)) + f" {i}.", "en") for i in range(5)]
    docs = documents.select("doc_id", "text", "lang").union(
        spark.createDataFrame(easy, "doc_id long, text string, lang string"))
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    out = {r.doc_id: r for r in q.judged(docs, labels).where("doc_id >= 10000000").collect()}
    assert all(r.perplexity < r.low and not r.kept for r in out.values())


def test_clashing_rows_train_alike(spark):
    texts = [(i % 30, f"text {j} of number {i} " * 12, "en") for j in range(3) for i in range(30)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(0, 0, 0), (None, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    ids = q.trusted(labels)
    assert ids.count() == 29
    picked = []
    for n in (1, 5):
        docs = spark.createDataFrame(texts[::-1] if n > 1 else texts,
                                     "doc_id long, text string, lang string").repartition(n)
        picked.append(sorted(map(tuple, q.training_texts(docs, ids).collect())))
    assert picked[0] == picked[1] and len(picked[0]) == 29


def test_all_trusted_texts_are_trained_on(spark):
    """Also long ones, and those beyond some megabytes."""
    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.repeat(
        F.concat(F.lit("word"), F.col("id").cast("string"), F.lit(" ")), 30_000).alias("text"))
    ids = docs.select("doc_id")
    texts = q.training_texts(docs, ids)
    assert texts.count() == 100
    least = texts.agg(F.min(F.octet_length("text"))).first()[0]
    assert least == 6 * 30_000


def test_a_model_left_in_tables_scores_alike(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(
        "doc_id", "text", "lang")
    docs = docs.union(docs.limit(3)).union(spark.createDataFrame(
        [(7_000_000, None, "en"), (7_000_001, " ", "en"), (7_000_002, "Größe 漢字", None)],
        docs.schema))
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    sent = q.judged(docs, labels)
    monkeypatch.setattr(q, "MODEL_ROWS", 0)
    stored = q.judged(docs, labels)
    assert stored.columns == sent.columns or set(stored.columns) == set(sent.columns)
    told = [sorted(((r.doc_id, r.n_words, r.kept, round(r.perplexity or 0, 3),
                     round(r.low, 3), round(r.high, 3)) for r in out.collect()), key=str)
            for out in (sent, stored)]
    assert told[0] == told[1] and len(told[0]) == docs.count()
