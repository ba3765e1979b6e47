"""Quality rules with n-gram perplexity: a modified Kneser-Ney model and bands by language.

The model predicts each byte of a text from the ORDER - 1 bytes before it, across words, with
white space between words as one space. It is trained on all whole texts that the labels call good
and not toxic. Spark counts n-grams, continuation counts, counts of counts and totals of contexts,
in tables sharded by n-gram, and joins each order with the one below for interpolated
probabilities. While there are few n-grams (MODEL_ROWS), the finished orders are read as sorted
arrays of keys with log probabilities and back-off weights and sent to the tasks; a task looks up
the different n-grams of a slice of texts at once. A larger model stays in its tables, with which
the n-grams of all texts are joined.

Rules: a document fails the base rules with fewer than MIN_WORDS words, or if more than
MAX_REPEAT percent of its words stand in three-word windows that occur again in it. What is left
is judged by perplexity: each language has a band, from the QUANTILE of the least to that of the
greatest perplexities of its trusted documents that pass the base rules, widened by MARGIN on
either side; documents outside it are rejected. One trusted document in HELD_OUT, by hash, is
not trained on, and all of those set the bands; with too few trusted documents all do both. The
trained documents, which the model knows by heart, can only lower a band. A language with fewer than MIN_TRUSTED documents to judge by takes the
band of all languages. Without a trusted document only the base rules count.

Defined results: null, empty and wordless texts have zeros, no perplexity, and fail the base rules.
A null language is a language of its own. Rows with equal doc_id are judged each by its text; of
those, the one with the least hash can be trained on. Labels that contradict each other don't
count as trusted. Extra columns pass through; ones named like a result are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimspan.llm.common import slices, stored, with_columns

ORDER = 5
#: N-grams of the full order that may be sent to the tasks: up to 20 bytes each, and lower orders.
MODEL_ROWS = 4 << 20
HELD_OUT = 5
QUANTILE = 0.005
MARGIN = 1.1
MIN_TRUSTED = 20
MIN_WORDS = 50
MAX_REPEAT = 50

BEGIN, END = b"\x00", b"\n"
SYMBOLS = b"#*$%&|<>"
_BYTES = 257  # bytes, and one for all that was never seen

MEASURES = [T.StructField(name, T.LongType(), False) for name in (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [
    T.StructField("perplexity", T.DoubleType(), True)]
JUDGED = (*(field.name for field in MEASURES), "base_failed", "low", "high", "kept")


# ---- texts as arrays ------------------------------------------------------------------------


@dataclass
class Lines:
    """Texts with white space as single spaces, each between BEGINs and an END, in one array."""

    bytes: np.ndarray
    begins: np.ndarray  # first byte of each text, after its BEGINs
    ends: np.ndarray  # place of its END


def laid(texts: list[bytes], order: int = ORDER) -> Lines:
    pad = BEGIN * (order - 1)
    line = np.frombuffer(b"".join(pad + text + END for text in texts), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes + order) - 1
    return Lines(line, ends - sizes, ends)


def grams(lines: Lines, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each byte of the texts and at their ENDs, and its text."""
    key = np.zeros(len(lines.bytes), np.int64)
    for back in range(order):
        key[back:] |= lines.bytes[:len(key) - back].astype(np.int64) << (8 * back)
    sizes = lines.ends - lines.begins + 1
    text = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(text)) + np.repeat(lines.begins - np.cumsum(sizes) + sizes, sizes)
    return key[place], text


def spaced(text: bytes | None) -> bytes:
    return b" ".join(text.split()) if text else b""


# ---- the model ------------------------------------------------------------------------------


@dataclass
class Model:
    """By order, from one: sorted n-grams with log P(last byte | those before it), and sorted
    contexts with the log of the weight they give the order below."""

    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]
    unseen: float  # log P of a byte by the order of none

    def scores(self, keys: np.ndarray) -> np.ndarray:
        """Log probability of the last byte of n-grams of the full order."""
        score, left = np.zeros(len(keys)), np.arange(len(keys))
        for size in range(len(self.grams), 0, -1):
            key = keys[left] & ((1 << (8 * size)) - 1)
            known, value = _found(self.grams[size - 1], key)
            score[left[known]] += value[known]
            left, key = left[~known], key[~known]
            known, value = _found(self.contexts[size - 1], key >> 8)
            score[left[known]] += value[known]
        score[left] += self.unseen
        return score


def _found(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray):
    names, values = table
    if not len(names):
        return np.zeros(len(keys), bool), np.zeros(len(keys))
    at = np.minimum(np.searchsorted(names, keys), len(names) - 1)
    return names[at] == keys, values[at]


def gram_counts(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, n) of the full order, in a column of texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in slices(batch, "text")):
            found = [spaced(text) for text in part.column(0).to_pylist()]
            keys, n = np.unique(grams(laid([t for t in found if t], order), order)[0],
                                return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["gram", "n"])

    return texts.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


@dataclass
class StoredModel:
    """A model too large to send. By order, from one: the table of (gram, context, rest, p)."""

    orders: list[DataFrame]

    def perplexities(self, texts: DataFrame) -> DataFrame:
        """(id, perplexity) of (id, text); texts without words have none."""
        found = stored(text_grams(texts, len(self.orders)), "rules_text_grams")
        keys = found.select("gram").distinct()
        value, sought = F.lit(0.0), F.lit(True)
        for size in range(len(self.orders), 0, -1):
            table = self.orders[size - 1]
            keys = keys.join(table.select(F.col("gram").alias(f"g{size}"),
                                          F.log("p").alias(f"p{size}")),
                             F.col("gram").bitwiseAND(F.lit((1 << (8 * size)) - 1))
                             == F.col(f"g{size}"), "left")
            keys = keys.join(table.groupBy(F.col("context").alias(f"c{size}")).agg(
                F.log(F.first("rest")).alias(f"w{size}")),
                F.shiftright(F.col("gram").bitwiseAND(F.lit((1 << (8 * size)) - 1)), 8)
                == F.col(f"c{size}"), "left")
            here = F.coalesce(f"p{size}", f"w{size}", F.lit(0.0))
            value = value + F.when(sought, here).otherwise(0.0)
            sought = sought & F.col(f"p{size}").isNull()
        value = value + F.when(sought, -math.log(_BYTES)).otherwise(0.0)
        scored = keys.select("gram", value.alias("value"))
        return found.join(scored, "gram").groupBy("id").agg(
            F.exp(-F.sum(F.col("n") * F.col("value")) / F.sum("n")).alias("perplexity"))


def text_grams(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """(id, gram, n) of the full order, of each of (id, text) with a word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in slices(batch, "text")):
            for name, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                if not (text := spaced(text)):
                    continue
                keys, n = np.unique(grams(laid([text], order), order)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(keys), name, np.int64)), pa.array(keys), pa.array(n)],
                    names=["id", "gram", "n"])

    return texts.mapInArrow(run, "id long, gram long, n long")


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """What n-grams counted once, twice, and more often give to the order below, by how many
    there are of each; halves where too few are counted to tell."""
    if not n1 or not n2:
        return [0.5, 0.5, 0.5]
    y = n1 / (n1 + 2 * n2)
    told = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2,
            3 - 4 * y * n4 / n3 if n3 else 2 - 3 * y * n3 / n2]
    return [min(max(d, 0.05), count - 0.05) for count, d in enumerate(told, 1)]


def fit(texts: DataFrame, order: int = ORDER) -> Model | StoredModel:
    counts = {order: stored(gram_counts(texts, order), "rules_counts")}
    for size in range(order - 1, 0, -1):
        # Below the full order what counts is how many different bytes an n-gram follows.
        suffix = F.col("gram").bitwiseAND(F.lit((1 << (8 * size)) - 1))
        counts[size] = counts[size + 1].groupBy(suffix.alias("gram")).agg(
            F.count("*").alias("n"))
    few = counts[order].count() <= MODEL_ROWS
    below, orders, tables, contexts = None, [], [], []
    for size in range(1, order + 1):
        seen = counts[size].agg(*[F.count_if(F.col("n") == i) for i in range(1, 5)]).first()
        d = discounts(*seen)
        off = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        level = counts[size].withColumn("context", F.shiftright("gram", 8))
        totals = level.groupBy("context").agg(
            F.sum("n").alias("total"), (F.sum(off) / F.sum("n")).alias("rest"))
        joined = level.join(totals, "context")
        if below is None:
            lower = F.lit(1 / _BYTES)
        else:
            joined = joined.withColumn("gram_below", F.col("gram").bitwiseAND(
                F.lit((1 << (8 * size - 8)) - 1))).join(below, "gram_below")
            lower = F.col("p_below")
        done = stored(joined.select("gram", "context", "rest", (
            (F.col("n") - off) / F.col("total") + F.col("rest") * lower).alias("p")),
            f"rules_order_{size}")
        below = done.select(F.col("gram").alias("gram_below"), F.col("p").alias("p_below"))
        orders.append(done)
        if few:
            tables.append(_arrays(done.select("gram", F.log("p").alias("value"))))
            contexts.append(_arrays(done.groupBy(F.col("context").alias("gram")).agg(
                F.log(F.first("rest")).alias("value"))))
    return Model(tables, contexts, -math.log(_BYTES)) if few else StoredModel(orders)


def _arrays(table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and their values; bounded by MODEL_ROWS."""
    held = table.toArrow()
    keys, values = held.column(0).to_numpy(), held.column(1).to_numpy()
    order = np.argsort(keys)
    return keys[order], values[order].astype(np.float32)


# ---- measures of texts ----------------------------------------------------------------------


def repeated_words(words: list[list[bytes]]) -> np.ndarray:
    """Of each text, the words in three-word windows that occur twice or more in it."""
    counts = np.fromiter(map(len, words), np.int64, len(words))
    number: dict[bytes, int] = {}
    flat = np.fromiter((number.setdefault(w, len(number)) for text in words for w in text),
                       np.int64, int(counts.sum()))
    if len(flat) < 3:
        return np.zeros(len(words), np.int64)
    text = np.repeat(np.arange(len(words)), counts)
    two = np.unique(flat[:-1] * len(number) + flat[1:], return_inverse=True)[1]
    three = np.unique(two[:-1] * len(number) + flat[2:], return_inverse=True)[1]
    at = np.flatnonzero(text[:-2] == text[2:])
    _, which, n = np.unique(three[at] * len(words) + text[at], return_inverse=True,
                            return_counts=True)
    hit = np.zeros(len(flat), bool)
    for ahead in range(3):
        hit[at[n[which] > 1] + ahead] = True
    return np.bincount(text[hit], minlength=len(words))


def repeated_lines(text: bytes | None) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split(b"\n") if line and not line.isspace()] if text else []
    return len(lines) - len(set(lines))


_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def measures(texts: list[bytes | None], model: Model | None) -> list[pa.Array]:
    words = [text.split() if text else [] for text in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    lines = laid([b" ".join(cut) for cut in words])

    def within(which: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(which)))
        return sums[lines.ends] - sums[lines.begins]

    chars = within((lines.bytes & 0xC0) != 0x80) - np.maximum(counts - 1, 0)
    value = np.ones(len(texts))
    if model and counts.any():
        keys, text = grams(lines)
        known, which = np.unique(keys, return_inverse=True)
        total = np.bincount(text, model.scores(known)[which], len(texts))
        value = np.exp(-total / (lines.ends - lines.begins + 1))
    return [pa.array(counts), pa.array(chars), pa.array(within(_SYMBOL[lines.bytes])),
            pa.array([repeated_lines(text) for text in texts], pa.int64()),
            pa.array(repeated_words(words)),
            pa.array(value, pa.float64(), mask=(counts == 0) | (model is None))]


def measured(docs: DataFrame, model: Model | StoredModel | None) -> DataFrame:
    """docs with MEASURES and base_failed."""
    if isinstance(model, StoredModel):
        # Rows are numbered once and stored, as doc_ids may repeat.
        rows = stored(docs.withColumn("__row", F.monotonically_increasing_id()), "rules_rows")
        values = model.perplexities(rows.select(
            F.col("__row").alias("id"), F.col("text").cast("binary").alias("text")))
        out = with_columns(rows, "text", MEASURES, lambda texts: measures(texts, None)).drop(
            "perplexity").join(values.withColumnRenamed("id", "__row"), "__row", "left").drop(
            "__row")
    else:
        out = with_columns(docs, "text", MEASURES, lambda texts: measures(texts, model))
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT))


# ---- training rows and bands ----------------------------------------------------------------


def trusted(labels: DataFrame) -> DataFrame:
    return labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.min("quality").alias("q"), F.max("toxic").alias("t")).where("q = 1 and t = 0").select(
        "doc_id")


def _held_out() -> Column:
    return F.pmod(F.xxhash64(F.lit("quality rules"), "doc_id"), F.lit(HELD_OUT)) == 0


def training_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id and text to train on, one for each doc_id that has any: that with the least hash."""
    given = docs.where(F.octet_length("text") > 0).join(ids, "doc_id", "left_semi")
    return given.groupBy("doc_id").agg(F.min(F.struct(
        F.xxhash64("text").alias("h"), F.col("text").cast("binary").alias("text"))).alias("one")
    ).select("doc_id", F.col("one.text").alias("text"))


def bands(judged_by: DataFrame) -> DataFrame:
    """(language, low, high) of documents with perplexity and `sets` (whether they set bands, or
    can only lower them); language null for all of them."""
    def cut(which: Column, share: float) -> Column:
        return F.percentile_approx(F.when(which, F.col("perplexity")), share, 10_000)

    sets = F.col("sets")
    cuts = [F.least(cut(sets, QUANTILE), cut(~sets, QUANTILE)).alias("low"),
            cut(sets, 1 - QUANTILE).alias("high"), F.count_if(sets).alias("n")]
    passing = judged_by.where("perplexity is not null and not base_failed")
    own = passing.groupBy(F.coalesce("lang", F.lit("")).alias("language")).agg(*cuts).where(
        F.col("n") >= MIN_TRUSTED)
    every = passing.agg(*cuts).where("n > 0").select(
        F.lit(None).cast("string").alias("language"), "low", "high", "n")
    return own.unionByName(every).select(
        "language", (F.col("low") / MARGIN).alias("low"), (F.col("high") * MARGIN).alias("high"))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with the measures, base_failed, low, high and kept."""
    ids = trusted(labels)
    enough = HELD_OUT * MIN_TRUSTED
    hold_out = ids.limit(enough).count() == enough
    texts = stored(training_texts(docs, ids.where(~_held_out()) if hold_out else ids),
                   "rules_training")
    model = None if texts.isEmpty() else fit(texts.select("text"))
    set_ids = ids.where(_held_out()) if hold_out else ids
    sets = set_ids.withColumn("sets", F.lit(True)).unionByName(
        texts.select("doc_id", F.lit(False).alias("sets"))).groupBy("doc_id").agg(
        F.max("sets").alias("sets"))
    set_by = docs.select("doc_id", "lang", "text").join(sets, "doc_id")
    cuts = stored(bands(measured(set_by, model)), "rules_bands")
    every = cuts.where("language is null").first()
    low, high = (every.low, every.high) if every else (None, None)
    plain = docs.drop(*[c for c in JUDGED if c in docs.columns])
    own = cuts.where("language is not null").select(
        F.col("language").alias("__language"), F.col("low").alias("__low"),
        F.col("high").alias("__high"))
    out = measured(plain, model).join(
        own, F.coalesce("lang", F.lit("")) == F.col("__language"), "left")
    out = out.withColumn("low", F.coalesce("__low", F.lit(low).cast("double"))).withColumn(
        "high", F.coalesce("__high", F.lit(high).cast("double"))).drop(
        "__language", "__low", "__high")
    inside = F.coalesce(F.col("perplexity").between(F.col("low"), F.col("high")), F.lit(True))
    return out.withColumn("kept", ~F.col("base_failed") & inside)


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that a rule rejects, with their own columns."""
    renamed = {c: f"__own_{c}" for c in docs.columns if c in JUDGED}
    out = judged(docs.withColumnsRenamed(renamed), labels).where("kept")
    return out.drop(*JUDGED).withColumnsRenamed({v: k for k, v in renamed.items()}).select(
        *[F.col(f"`{c}`") for c in docs.columns])


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judged(docs.select("doc_id", "lang", "text"), labels).drop("lang", "text")
