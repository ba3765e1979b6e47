"""Quality classifier: an interpolated modified Kneser-Ney model trained on trusted text.

Two models in one. Pairs of words give a word its probability after the word before it; what
they leave goes to single words, by the number of words each follows, and what those leave goes
to a model of the bytes of words, n-grams (ORDER) with a boundary before and after each word.
So word order counts, any word of any language has a probability, and a document's perplexity
is a mean over its bytes. The model is trained on all whole texts that the labels call good and
not toxic; of clashing texts of one doc_id, on that with the least hash.

Repetition is told by the document's own past: a second perplexity lets the pairs seen earlier
in the document take part, as if the model stood for OWN_WEIGHT observations of each context.
`novelty` is that perplexity over the first: 1 if the past is of no use, near 0 if one passage
is said again and again. What the model remembers of trained texts is in both, and cancels.

Counts, continuation counts, discounts and interpolated probabilities are made by Spark: each
order's n-grams are sharded by hash and joined with their contexts' totals and with the next
lower order. The n-grams of bytes, and single words while there are few (VOCABULARY), travel to
the tasks, with the most frequent pairs of words (COMMON). All pairs stay in a table, dealt into
shards. To score, a task cuts texts into words, looks up frequent pairs, and sends the other
different pairs of each document, packed, to the shards, where they are looked up; sums by
document come back. With more words than VOCABULARY, words and pairs
of all documents are joined with the tables of the model instead, with the same results. Words are
told apart by hashes of 64 bits, and numbered by how often they occur; log probabilities of pairs
are kept in single precision.

A document is rejected if its perplexity is over its language's threshold, the QUANTILE of the
trusted documents of that language, times MARGIN; or if its novelty is under the least one, the
1 - QUANTILE of the same documents, over MARGIN. One trusted document in HELD_OUT, by hash, is
not trained on, and only those set thresholds, as trained texts look too good; with fewer than
HELD_OUT * MIN_TRUSTED trusted documents all do both. Languages with fewer than MIN_TRUSTED
documents to judge by share the thresholds over all languages. Without any trusted document
nothing is rejected.

Defined results: a null or wordless text has null perplexity and novelty and is kept. A null
language is a language of its own. Repeated rows are scored alike; labels that contradict each other don't
count as trusted. Extra columns pass through; ones named like a result are replaced.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimspan.llm.common import give_back, slices, stored_lean as stored

ORDER = 5
QUANTILE = 0.995
MARGIN = 1.1
MIN_TRUSTED = 20
HELD_OUT = 5
OWN_WEIGHT = 1.0
#: Words that may be sent to the tasks: 36 bytes each.
VOCABULARY = 8 << 20
#: Text whose pairs of words are counted at once within a task.
COUNT_BYTES = 4 << 20
#: Text scored at once within a task.
SCORE_BYTES = 2 << 20
#: Counted pairs packed at once within a task.
PACK_ROWS = 1 << 20
#: Rows that the driver reads at a time.
PART_ROWS = 1 << 20
#: Text by shard of the pairs, and by shard while there are fewer than SHARDS.
SHARD_BYTES, LEAST_SHARD_BYTES, SHARDS = 256 << 20, 24 << 20, 16
#: The most frequent pairs of words, which are sent to the tasks: 12 bytes each.
COMMON = 1 << 20
BOUNDARY = b" "

SCORES = "id long, n_words long, perplexity double, novelty double"
JUDGED = ("n_words", "perplexity", "novelty", "threshold", "least_novelty", "accepted")


# ---- words as byte arrays -------------------------------------------------------------------


def spelled(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the words, each between boundaries, and each byte's place in its word."""
    line = np.frombuffer(BOUNDARY + (BOUNDARY * 2).join(words) + BOUNDARY, np.uint8)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    begins = np.repeat(np.cumsum(sizes) - sizes, sizes)
    return line, np.arange(len(line)) - begins


def grams(line: np.ndarray, size: int) -> np.ndarray:
    """The last `size` bytes up to each place, as a number."""
    out = np.zeros(len(line), np.int64)
    for back in range(size):
        out[back:] |= line[:len(line) - back].astype(np.int64) << (8 * back)
    return out


# ---- training -------------------------------------------------------------------------------


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.min("quality").alias("q"), F.max("toxic").alias("t")).where(
        "q = 1 and t = 0").select("doc_id")


def _held_out() -> Column:
    return F.pmod(F.xxhash64(F.lit("held out"), "doc_id"), F.lit(HELD_OUT)) == 0


def holds_out(labels: DataFrame) -> bool:
    """Whether there are trusted documents enough to set some apart."""
    enough = HELD_OUT * MIN_TRUSTED
    return trusted_ids(labels).limit(enough).count() == enough


def training_texts(docs: DataFrame, labels: DataFrame, hold_out: bool = False) -> DataFrame:
    """All trusted texts, one for each doc_id. Only where a doc_id is repeated are texts moved to
    choose the one with the least hash."""
    ids = trusted_ids(labels).where(~_held_out() if hold_out else F.lit(True))
    given = docs.where("text is not null").select("doc_id", "text")
    rows = given.select("doc_id").join(ids, "doc_id", "left_semi").groupBy("doc_id").agg(
        F.count("*").alias("rows"))
    rows = stored(rows, "trusted_rows")
    once = given.join(rows.where("rows = 1"), "doc_id", "left_semi").select("text")
    more = given.join(rows.where("rows > 1"), "doc_id", "left_semi").groupBy("doc_id").agg(
        F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("one")).select("one.text")
    return once.unionByName(more).select(F.col("text").cast("binary").alias("text"))


def word_counts(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for text in batch.column(0).to_pylist():
                found.update(text.split())
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())],
                names=["word", "n"])
            del found
            give_back()

    return texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(
        F.sum("n").alias("n"))


def raw_counts(words: DataFrame, order: int = ORDER) -> DataFrame:
    """(size, gram, n): n-grams of full order, and shorter ones from a word's beginning."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            spelling = batch.column(0).to_pylist()
            line, place = spelled(spelling)
            weight = np.repeat(batch.column(1).to_numpy(),
                               np.fromiter(map(len, spelling), np.int64) + 2)
            for size in range(2, order + 1):
                at = place >= order - 1 if size == order else place == size - 1
                keys, inverse = np.unique(grams(line, size)[at], return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(keys), size, np.int32)), pa.array(keys),
                     pa.array(np.bincount(inverse, weight[at], len(keys)).astype(np.int64))],
                    names=["size", "gram", "n"])

    return words.mapInArrow(run, "size int, gram long, n long").groupBy("size", "gram").agg(
        F.sum("n").alias("n"))


def discounts(counts: list[int]) -> list[float]:
    """For n-grams seen once, twice and more often, from how many were seen 1 to 4 times."""
    n1, n2, n3, n4 = counts
    if not (n1 and n2):
        return [0.5, 0.75, 0.75]
    y = n1 / (n1 + 2 * n2)
    found = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(d, 0.1), i - 0.1) for i, d in enumerate(found, 1)]


@dataclass
class Model:
    """By n-gram size: sorted n-grams with log P(last byte | those before it), and sorted
    contexts with the log of the weight that they give the next lower order."""

    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]
    floor: float  # log P of a byte never seen

    def word_scores(self, words: list[bytes]) -> np.ndarray:
        """Log probability of each word with its closing boundary."""
        if not words:
            return np.zeros(0)
        line, place = spelled(words)
        at = np.flatnonzero(place > 0)
        score, open_ = np.zeros(len(at)), np.ones(len(at), bool)
        for size in range(len(self.grams), 0, -1):
            some = np.flatnonzero(open_ & (place[at] >= size - 1))
            key = grams(line, size)[at[some]]
            known, value = _look_up(self.grams[size - 1], key)
            score[some[known]] += value[known]
            open_[some[known]] = False
            if size > 1:
                rest, context = some[~known], key[~known] >> 8
                known, value = _look_up(self.contexts[size - 1], context)
                score[rest[known]] += value[known]
        score[open_] += self.floor
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        return np.add.reduceat(score, np.cumsum(sizes) - sizes)


def _look_up(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray):
    names, values = table
    if not len(names):
        return np.zeros(len(keys), bool), np.zeros(len(keys))
    at = np.minimum(np.searchsorted(names, keys), len(names) - 1)
    return names[at] == keys, values[at]


def fit(texts: DataFrame, order: int = ORDER) -> Model:
    return fit_spelling(word_counts(texts), order)


def fit_spelling(words: DataFrame, order: int = ORDER) -> Model:
    """The model of the bytes of (word, n)."""
    raw = stored(raw_counts(words, order), "kneser_ney_counts")
    levels = {order: raw.where(F.col("size") == order).select("gram", "n")}
    for size in range(order - 1, 0, -1):
        # How many different bytes an n-gram follows; at a word's beginning how often it occurs.
        kept = (1 << (8 * size)) - 1
        follows = levels[size + 1].groupBy(F.col("gram").bitwiseAND(F.lit(kept)).alias("gram"))
        levels[size] = follows.agg(F.count("*").alias("n")).unionByName(
            raw.where(F.col("size") == size).select("gram", "n"))
    floor = 1 / 257
    lower, tables, contexts = None, [], []
    for size in range(1, order + 1):
        counts = levels[size].withColumn("context", F.shiftright("gram", 8))
        seen = counts.agg(*[F.count_if(F.col("n") == i) for i in range(1, 5)]).first()
        d = discounts(list(seen))
        off = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        totals = counts.groupBy("context").agg(
            F.sum("n").alias("total"), (F.sum(off) / F.sum("n")).alias("rest"))
        joined = counts.join(totals, "context")
        if size == 1:
            below = F.lit(floor)
        else:
            kept = (1 << (8 * (size - 1))) - 1
            joined = joined.withColumn("suffix", F.col("gram").bitwiseAND(F.lit(kept))).join(
                lower.select(F.col("gram").alias("suffix"), F.col("p").alias("below")),
                "suffix", "left")
            below = F.coalesce("below", F.lit(floor))
        lower = stored(joined.select(
            "gram", "context", "rest",
            ((F.col("n") - off) / F.col("total") + F.col("rest") * below).alias("p")),
            f"kneser_ney_{size}")
        tables.append(_sorted(lower.select("gram", F.log("p").alias("v"))))
        contexts.append(_sorted(lower.select(F.col("context").alias("gram"),
                                             F.log("rest").alias("v")).distinct()))
    return Model(tables, contexts, math.log(floor) + float(
        contexts[0][1][0] if len(contexts[0][1]) else 0))


def _sorted(table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    held = table.select("gram", "v").toArrow()
    names = held.column(0).to_numpy()
    order = np.argsort(names)
    return names[order], held.column(1).to_numpy()[order]


# ---- words after words ----------------------------------------------------------------------

BEGIN = 0  # the number of the word before a document's first


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(hashlib.blake2b(w, digest_size=8).digest() for w in words),
                         np.int64)


def pair_names(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """One number for the numbers of two words."""
    return before.astype(np.int64) << 32 | word


LOW = (1 << 32) - 1


def packed(values: np.ndarray) -> bytes:
    """Numbers of 8 or 4 bytes, by their first bytes, second bytes and so on, compressed."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, count: int, kind: str = "<i8") -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = pa.decompress(data, decompressed_size=size * count, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, count).T).view(
        kind).reshape(-1)


def packed_pairs(pairs: np.ndarray) -> bytes:
    """Sorted names of pairs, each by how far it is from the one before."""
    before, word = pairs >> 32, pairs & LOW
    again = np.diff(before, prepend=-1) == 0
    return packed(np.diff(before, prepend=0) << 32
                  | np.where(again, np.diff(word, prepend=0), word))


def unpacked_pairs(data: bytes, count: int) -> np.ndarray:
    steps = unpacked(data, count)
    before, word = np.cumsum(steps >> 32), np.cumsum(steps & LOW)
    first = np.flatnonzero(np.diff(before, prepend=-1))
    word -= np.repeat(word[first] - (steps[first] & LOW), np.diff(np.append(first, count)))
    return before << 32 | word


def sent(context: SparkContext, **arrays: np.ndarray) -> Broadcast:
    """Arrays packed, as a task holds them apart from what it makes of them."""
    return context.broadcast({name: (packed(values), len(values), values.dtype.str)
                              for name, values in arrays.items()})


def received(held: Broadcast, *names: str) -> list[np.ndarray]:
    """Arrays that were sent. A worker holds them once: unpacked, in the place of the packed."""
    for name in names:
        if not isinstance(held.value[name], np.ndarray):
            held.value[name] = unpacked(*held.value[name])
    return [held.value[name] for name in names]


def numbered(words: list[list[bytes]]) -> tuple[dict[bytes, int], np.ndarray, np.ndarray]:
    """Numbers of the different words from 1, each word's number, and that of the word before
    it in its document, 0 for none."""
    number: dict[bytes, int] = {}
    flat = np.fromiter((number.setdefault(w, len(number) + 1)
                        for w in itertools.chain.from_iterable(words)), np.int64)
    before = np.concatenate(([0], flat))[:len(flat)]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    before[(np.cumsum(counts) - counts)[counts > 0]] = 0
    return number, flat, before


@dataclass
class Vocabulary:
    """The sorted hashes of trained words, and each one's number, from 1, by how often it occurs."""

    hashes: np.ndarray
    numbers: np.ndarray

    def sent(self, context: SparkContext) -> Broadcast:
        return sent(context, steps=np.diff(self.hashes, prepend=0), numbers=self.numbers)

    @classmethod
    def received(cls, held: Broadcast) -> Vocabulary:
        if "hashes" not in held.value:
            held.value["hashes"] = np.cumsum(*received(held, "steps"))
            del held.value["steps"]
        return cls(*received(held, "hashes", "numbers"))

    def find(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The words' numbers, and whether they have any; the others get the next number."""
        at, known = _places(self.hashes, word_hashes(words))
        out = np.full(len(words), len(self.hashes) + 1, np.int64)
        out[known] = self.numbers[at[known]]
        return out, known


@dataclass
class Singles:
    """By a word's number: log P of the single word; how often it is a context; the log of the
    weight that it, as a context, gives to single words. The discounts of pairs."""

    words: np.ndarray
    totals: np.ndarray
    contexts: np.ndarray
    discounts: np.ndarray

    @classmethod
    def received(cls, held: Broadcast, seen: bool) -> Singles:
        """What `back_off` needs, and what `seen` needs too."""
        words, contexts = received(held, "words", "contexts")
        return cls(words, *(received(held, "totals") if seen else [None]), contexts,
                   *received(held, "discounts"))

    def back_off(self, pairs: np.ndarray) -> np.ndarray:
        """Log P(word | word before) of pairs that were never seen."""
        return self.contexts[pairs >> 32] + self.words[pairs & LOW]

    def seen(self, pairs: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Log P(word | word before) of pairs that were seen n times."""
        own = (n - self.discounts[np.minimum(n, 3) - 1]) / self.totals[pairs >> 32]
        return np.log(own + np.exp(self.back_off(pairs))).astype(np.float32)


@dataclass
class WordModel:
    """The model of bytes, sent, and the log of its weight; with the vocabulary, single words and
    the log P of frequent pairs sent, and (pair, n) in a table."""

    spelling: Broadcast
    rest: float
    vocabulary: Broadcast
    singles: Broadcast
    common: Broadcast
    counts: DataFrame


@dataclass
class StoredModel:
    """The model of bytes, sent, and the log of its weight; tables by the hashes of words:
    (word, p), (before, back) and (before, word, v)."""

    spelling: Broadcast
    rest: float
    words: DataFrame
    contexts: DataFrame
    pairs: DataFrame


def _places(names: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where keys stand among sorted names, and whether they do."""
    if not len(names):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(names, keys), len(names) - 1)
    return at, names[at] == keys


def vocabulary(words: DataFrame) -> Vocabulary:
    """Of (word, n)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array(word_hashes(batch.column(0).to_pylist())), batch.column(1)],
                names=["h", "n"])

    held = words.select("word", "n").mapInArrow(run, "h long, n long").toArrow()
    hashes, at = np.unique(held.column(0).to_numpy(), return_index=True)
    order = np.lexsort((hashes, -held.column(1).to_numpy()[at]))
    numbers = np.empty(len(hashes), np.int32)
    numbers[order] = np.arange(1, len(hashes) + 1)
    return Vocabulary(hashes, numbers)


def _word_names(words: list[bytes], known: Vocabulary | None) -> np.ndarray:
    """The numbers of trained words, or the hashes of any."""
    return known.find(words)[0] if known else word_hashes(words)


def pair_counts(texts: DataFrame, known: Broadcast | None) -> DataFrame:
    """(before, word, n): pairs of words by number; without numbers, by hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (part for batch in batches for part in slices(batch, "text", COUNT_BYTES))
        names = Vocabulary.received(known) if known else None
        for part in parts:
            number, word, before = numbered([t.split() for t in part.column(0).to_pylist()])
            own = np.concatenate(([BEGIN], _word_names(list(number), names)))
            size = len(own)
            pairs, n = np.unique(before * size + word, return_counts=True)
            first, second = own[pairs // size], own[pairs % size]
            n = pa.array(n.astype(np.int64))
            if known:
                pairs = pair_names(first, second)
                order = np.argsort(pairs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pairs[order]), n.take(pa.array(order))], names=["pair", "n"])
            else:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(first), pa.array(second), n], names=["before", "word", "n"])
            del number, word, before, own, pairs, n, first, second
            give_back()

    key = ["pair"] if known else ["before", "word"]
    return texts.mapInArrow(run, "".join(f"{k} long, " for k in key) + "n long").groupBy(
        *key).agg(F.sum("n").alias("n"))


def spellings(words: DataFrame, known: Broadcast | None, model: Broadcast) -> DataFrame:
    """(word, spelled): names of words and their probabilities by their bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Vocabulary.received(known) if known else None
        for batch in batches:
            spelling = batch.column(0).to_pylist()
            own = _word_names(spelling, names)
            scores = Model(**model.value).word_scores(spelling)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.exp(scores))],
                                             names=["word", "spelled"])
        give_back()

    return words.select("word").mapInArrow(run, "word long, spelled double")


def _discounts(counts: DataFrame) -> list[float]:
    seen = counts.agg(*[F.count_if(F.col("n") == i) for i in range(1, 5)]).first()
    return discounts(list(seen))


def _off(d: list[float]) -> Column:
    return F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])


def fit_words(texts: DataFrame, order: int = ORDER) -> WordModel | StoredModel:
    """Broadcasts hold plain data: tasks need no package."""
    context = texts.sparkSession.sparkContext
    words = stored(word_counts(texts), "trusted_words")
    spelling = context.broadcast(vars(fit_spelling(words, order)))
    found = known = None
    if words.count() <= VOCABULARY:
        found = vocabulary(words)
        known = found.sent(context)
    rows = counts = pair_counts(texts, known)
    # Sorted numbers take half the disk.
    rows = counts = stored(rows.sortWithinPartitions("pair") if known else rows,
                           "kneser_ney_pairs")
    if known:
        counts = rows.select(F.shiftright("pair", 32).alias("before"),
                             F.col("pair").bitwiseAND(F.lit(LOW)).alias("word"), "n")
    follows = stored(counts.groupBy("word").agg(F.count("*").alias("n")), "kneser_ney_follows")
    off = _off(_discounts(follows))
    every = follows.agg(F.sum("n").alias("total"), F.sum(off).alias("off")).first()
    rest = every.off / every.total if every.total else 1.0
    single = follows.join(spellings(words, known, spelling), "word").select(
        "word", ((F.col("n") - off) / F.lit(every.total or 1)
                 + F.lit(rest) * F.col("spelled")).alias("p"))
    d = _discounts(counts)
    contexts = counts.groupBy("before").agg(
        F.sum("n").alias("total"), (F.sum(_off(d)) / F.sum("n")).alias("rest"))
    if known:
        size = len(found.hashes) + 2
        del found
        logs = _by_number(stored(single.select("word", F.log("p").alias("p")),
                                 "kneser_ney_words"), size)[0]
        totals, weights = _by_number(stored(contexts.select(
            "before", "total", F.log("rest").alias("rest")), "kneser_ney_contexts"), size)
        singles = Singles(logs, totals, weights, np.array(d))
        return WordModel(spelling, math.log(rest), known, sent(context, **vars(singles)),
                         common_pairs(rows, singles), rows)
    single, contexts = stored(single, "kneser_ney_words"), stored(contexts, "kneser_ney_contexts")
    pairs = stored(counts.join(contexts, "before").join(single, "word").select(
        "before", "word", F.log((F.col("n") - _off(d)) / F.col("total")
                                + F.col("rest") * F.col("p")).cast("float").alias("v")),
        "kneser_ney_logs")
    return StoredModel(spelling, math.log(rest), single,
                       contexts.select("before", F.log("rest").alias("back")), pairs)


def common_pairs(rows: DataFrame, singles: Singles) -> Broadcast:
    """The names of the most frequent pairs, up to COMMON, and their log P."""
    held = rows.groupBy("n").agg(F.count("*").alias("pairs")).orderBy(F.desc("n")).toArrow()
    fits = np.flatnonzero(np.cumsum(held.column(1).to_numpy()) <= COMMON)
    least = held.column(0)[int(fits[-1])].as_py() if len(fits) else None
    held = rows.where(F.col("n") >= F.lit(least)).toArrow()
    pairs, n = held.column(0).to_numpy(), held.column(1).to_numpy()
    order = np.argsort(pairs)
    pairs, n = pairs[order], n[order]
    return sent(rows.sparkSession.sparkContext, pairs=pairs, values=singles.seen(pairs, n))


def _by_number(table: DataFrame, size: int) -> list[np.ndarray]:
    """The further columns as arrays by the first one, nought where there is none; read by
    ranges of PART_ROWS numbers, so that the driver never holds them twice."""
    key, *names = table.columns
    out = [np.zeros(size) for _ in names]
    for low in range(0, size, PART_ROWS):
        held = table.where((F.col(key) >= low) & (F.col(key) < low + PART_ROWS)).toArrow()
        at = held.column(0).to_numpy()
        for values, column in zip(out, held.columns[1:]):
            values[at] = column.to_numpy()
    return out


# ---- scoring --------------------------------------------------------------------------------


def seen_before(keys: np.ndarray) -> np.ndarray:
    """How often each key stands further left."""
    order = np.argsort(keys, kind="stable")
    run, place = keys[order], np.arange(len(keys))
    begins = np.ones(len(keys), bool)
    begins[1:] = run[1:] != run[:-1]
    out = np.empty(len(keys), np.int64)
    out[order] = place - np.maximum.accumulate(np.where(begins, place, 0))
    return out


def told_apart(each: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of pairs with log P `each`, found n times in a document: the sum of log P less the log of
    what the document's past makes of the pair."""
    out = np.full(len(n), -math.log(OWN_WEIGHT))
    more = np.flatnonzero(n > 1)
    if len(more):
        begins = np.cumsum(n[more]) - n[more]
        again = np.arange(n[more].sum()) - np.repeat(begins, n[more])
        value = np.repeat(each[more], n[more])
        out[more] = np.add.reduceat(
            value - np.log(again + OWN_WEIGHT * np.exp(value)), begins)
    return out


@dataclass
class Cut:
    """Texts cut into words: the different words, and by document and pair of words (places in
    `words`, from 1; 0 for none) how often it is found."""

    words: list[bytes]
    document: np.ndarray
    before: np.ndarray
    word: np.ndarray
    n: np.ndarray
    n_words: np.ndarray
    size: np.ndarray  # bytes, with one for the end of each word
    past: np.ndarray  # log of the weight that the contexts' own past has


def cut(texts: list[bytes | None]) -> Cut:
    words = [text.split() if text else [] for text in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    number, flat, before = numbered(words)
    symbols = np.concatenate(([0], np.fromiter(map(len, number), np.int64, len(number)) + 1))
    del words  # of all that a slice is made to, the most
    docs, names = len(texts), len(number) + 1
    document = np.repeat(np.arange(docs), counts)
    context = document * names + before
    keys, n = np.unique(context * names + flat, return_counts=True)
    past = np.log(seen_before(context) + OWN_WEIGHT)
    return Cut(list(number), keys // (names * names), keys // names % names, keys % names, n,
               counts, np.bincount(document, symbols[flat], docs),
               np.bincount(document, past, docs))


def shard_of(pairs: np.ndarray, shards: int) -> np.ndarray:
    mixed = pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(33)).astype(np.int64) % shards


def packed_counts(counts: DataFrame, shards: int) -> DataFrame:
    """(shard, rows, pairs, n) of (pair, n)."""
    def pack(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.concatenate([batch.column(0).to_numpy() for batch in held])
        n = np.concatenate([batch.column(1).to_numpy() for batch in held])
        order = np.argsort(pairs)
        pairs, n = pairs[order], n[order]
        shard = shard_of(pairs, shards)
        at = [np.flatnonzero(shard == k) for k in range(shards)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(shards)), pa.array([len(a) for a in at], pa.int64()),
             pa.array([packed_pairs(pairs[a]) for a in at], pa.binary()),
             pa.array([packed(n[a]) for a in at], pa.binary())],
            names=["shard", "rows", "pairs", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= PACK_ROWS:
                yield from pack(held)
                held = []
        if held:
            yield from pack(held)

    return counts.mapInArrow(run, "shard long, rows long, pairs binary, n binary")


def sought(texts: DataFrame, model: WordModel, shards: int) -> DataFrame:
    """(slice, shard, docs, rows, document, pairs, n, home): of a slice of (id, text), the pairs
    of trained words, but frequent ones, by shard and place of the document in the slice. One
    shard gets what else is known of the documents, `home`: ids, words, sizes, and sums of what
    needs no shard."""
    known, singles, common, spelling, rest = (
        model.vocabulary, model.singles, model.common, model.spelling, model.rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, scores = Vocabulary.received(known), Singles.received(singles, seen=False)
        often = tuple(received(common, "pairs", "values"))
        for batch in batches:
            for part in slices(batch, "text", SCORE_BYTES):
                yield work(part, words, scores, often)
                give_back()

    def work(part: pa.RecordBatch, words: Vocabulary, scores: Singles,
             often: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
        ids, c = part.column(0).to_numpy(), cut(part.column(1).to_pylist())
        docs = len(ids)
        number, have = words.find(c.words)
        single = scores.words[number]
        single[~have] = rest + Model(**spelling.value).word_scores(
            [c.words[k] for k in np.flatnonzero(~have)])
        number, have = np.concatenate(([BEGIN], number)), np.concatenate(([True], have))
        pairs = pair_names(number[c.before], number[c.word])
        order = np.argsort(pairs)
        pairs, document, before, word, n = [
            values[order] for values in (pairs, c.document, c.before, c.word, c.n)]
        both = have[before] & have[word]
        frequent, each = _look_up(often, pairs)
        frequent &= both
        here = frequent | ~both
        each = np.where(frequent, each, scores.contexts[number[before]] + single[word - 1])[here]
        value = np.bincount(document[here], n[here] * each, docs)
        gain = c.past + np.bincount(document[here], told_apart(each, n[here]), docs)
        home = np.concatenate((c.n_words, c.size, value, gain)).astype(np.float64)
        home = ids.astype(np.int64).tobytes() + home.tobytes()
        name = int.from_bytes(hashlib.blake2b(home, digest_size=8).digest(), "little", signed=True)
        document, pairs, n = document[~here], pairs[~here], n[~here]
        shard = shard_of(pairs, shards)
        order = np.argsort(shard, kind="stable")
        ends = np.searchsorted(shard[order], np.arange(shards), "right")
        at = [order[low:high] for low, high in zip([0, *ends[:-1]], ends)]
        to = [k for k in range(shards) if len(at[k]) or k == name % shards]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(to), name)), pa.array(to, pa.int64()),
             pa.array(np.full(len(to), docs)), pa.array([len(at[k]) for k in to], pa.int64()),
             *[pa.array([pack(values[at[k]]) for k in to], pa.binary())
               for values, pack in ((document, packed), (pairs, packed_pairs), (n, packed))],
             pa.array([home if k == name % shards else None for k in to], pa.binary())],
            names=["slice", "shard", "docs", "rows", "document", "pairs", "n", "home"])

    return texts.mapInArrow(run, "slice long, shard long, docs long, rows long, document binary, "
                                 "pairs binary, n binary, home binary")


def looked_up(model: WordModel, texts: DataFrame, shards: int) -> DataFrame:
    """(slice, docs, sums, home): sums by document of pairs of one shard, two of each."""
    singles = model.singles

    def run(counted: pa.Table, asked: pa.Table) -> pa.Table:
        scores, none = Singles.received(singles, seen=True), np.zeros(0, np.int64)
        parts = counted.select(["rows", "pairs", "n"]).to_pylist()
        pairs = np.concatenate([none, *[unpacked_pairs(r["pairs"], r["rows"]) for r in parts]])
        n = np.concatenate([none, *[unpacked(r["n"], r["rows"]) for r in parts]])
        del parts
        order = np.argsort(pairs)
        names = pairs[order]
        model_ = names, scores.seen(names, n[order])
        del pairs, n, order
        give_back()
        sums = []
        for docs, rows, document, pairs, n in zip(*[
                asked.column(c) for c in ("docs", "rows", "document", "pairs", "n")]):
            document, pairs, n = [unpack(c.as_py(), rows.as_py()) for c, unpack in (
                (document, unpacked), (pairs, unpacked_pairs), (n, unpacked))]
            each = scores.back_off(pairs)
            known, value = _look_up(model_, pairs)
            each[known] = value[known]
            sums.append(np.concatenate((
                np.bincount(document, n * each, docs.as_py()),
                np.bincount(document, told_apart(each, n), docs.as_py()))).astype(
                np.float64).tobytes())
        return pa.table([asked.column("slice"), asked.column("docs"),
                         pa.array(sums, pa.binary()), asked.column("home")],
                        names=["slice", "docs", "sums", "home"])

    return packed_counts(model.counts, shards).groupBy("shard").cogroup(
        sought(texts, model, shards).groupBy("shard")).applyInArrow(
        run, "slice long, docs long, sums binary, home binary")


def summed(found: DataFrame) -> DataFrame:
    """SCORES of what `looked_up` found. Slices with equal documents count as often."""
    def run(rows: pa.Table) -> pa.Table:
        docs = rows.column("docs")[0].as_py()
        value, gain = sum(np.frombuffer(r.as_py()).reshape(2, docs) for r in rows.column("sums"))
        homes = [r.as_py() for r in rows.column("home") if r.is_valid]
        times, ids = len(homes), np.frombuffer(homes[0][:8 * docs], np.int64)
        counts, size, own, more = np.frombuffer(homes[0][8 * docs:]).reshape(4, docs)
        with np.errstate(divide="ignore", invalid="ignore"):
            perplexity = np.exp(-(value / times + own) / size)
            novelty = np.exp((gain / times + more) / size)
        return pa.table([pa.array(ids), pa.array(counts.astype(np.int64)),
                         pa.array(perplexity, pa.float64(), mask=counts == 0),
                         pa.array(novelty, pa.float64(), mask=counts == 0)],
                        names=["id", "n_words", "perplexity", "novelty"])

    return found.groupBy("slice").applyInArrow(run, SCORES)


def joined(texts: DataFrame, model: StoredModel) -> DataFrame:
    """SCORES of (id, text) by a model in tables. Texts with equal ids are equal, and count as
    often."""
    spelling, rest = model.spelling, model.rest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SCORE_BYTES):
                yield work(part)

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        c = cut(part.column(1).to_pylist())
        # A row without words for each document has what needs no pair.
        docs = np.arange(part.num_rows)
        rows = np.concatenate((c.document, docs))
        none = np.zeros(len(c.n), np.int64)
        pad = np.zeros(len(docs), np.int64)
        hashes = np.concatenate(([BEGIN], word_hashes(c.words)))
        guess = np.concatenate(([0.0], rest + Model(**spelling.value).word_scores(c.words)))
        place = np.concatenate((c.word, pad))
        return pa.RecordBatch.from_arrays([
            part.column(0).take(pa.array(rows)),
            pa.array(hashes[np.concatenate((c.before, pad))]), pa.array(hashes[place]),
            pa.array(np.concatenate((c.n, pad))), pa.array(guess[place]),
            pa.array(np.concatenate((none, pad + 1))), pa.array(np.concatenate((none, c.n_words))),
            pa.array(np.concatenate((none, c.size)).astype(np.float64)),
            pa.array(np.concatenate((none, c.past)).astype(np.float64))],
            names=["id", "before", "word", "n", "guess", "times", "n_words", "size", "past"])

    pairs = texts.mapInArrow(
        run, "id long, before long, word long, n long, guess double, times long, n_words long, "
             "size double, past double")
    each = pairs.join(model.words, "word", "left").join(model.contexts, "before", "left").join(
        model.pairs, ["before", "word"], "left").withColumn("each", F.coalesce(
            F.col("v").cast("double"), F.coalesce("back", F.lit(0.0))
            + F.coalesce(F.log("p"), F.col("guess"))))

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, value = batch.column("n").to_numpy(), batch.column("each").to_numpy()
            gain = batch.column("past").to_numpy() + np.where(n, told_apart(value, n), 0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-3], pa.array(n * value), pa.array(gain)],
                names=["id", "times", "n_words", "size", "value", "gain"])

    sums = each.select("id", "times", "n_words", "size", "past", "n", "each").mapInArrow(
        tell, "id long, times long, n_words long, size double, value double, gain double").groupBy(
        "id").agg((F.sum("n_words") / F.sum("times")).cast("long").alias("n_words"),
                  *[F.sum(c).alias(c) for c in ("size", "value", "gain")])
    some = F.col("size") > 0
    return sums.select("id", "n_words",
                       F.when(some, F.exp(-F.col("value") / F.col("size"))).alias("perplexity"),
                       F.when(some, F.exp(F.col("gain") / F.col("size"))).alias("novelty"))


def scored(texts: DataFrame, model: WordModel | StoredModel) -> DataFrame:
    """SCORES of (id, text), one row for each id; texts with equal ids are equal."""
    if isinstance(model, StoredModel):
        return joined(texts, model)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES), min(SHARDS, -(-size // LEAST_SHARD_BYTES)))
    return summed(looked_up(model, texts, shards)).groupBy("id").agg(
        *[F.min(c).alias(c) for c in ("n_words", "perplexity", "novelty")])


def perplexities(texts: list[bytes | None], model: WordModel | StoredModel) -> list[pa.Array]:
    spark = SparkSession.active()
    frame = spark.createDataFrame(
        [(i, None if t is None else bytearray(t)) for i, t in enumerate(texts)],
        "id long, text binary")
    found = scored(frame, model).orderBy("id").toArrow()
    return [found.column(c).combine_chunks() for c in ("n_words", "perplexity", "novelty")]


def _row_id() -> Column:
    return F.xxhash64("doc_id", "text")


def thresholds(scored: DataFrame, docs: DataFrame) -> DataFrame:
    """language, threshold, least_novelty: a row for each language of docs; null is ''. They
    are set by `scored`, the trusted documents to judge by."""
    language = F.coalesce("lang", F.lit("")).alias("language")
    trusted = scored.where("perplexity is not null")
    cut = F.percentile_approx("perplexity", QUANTILE, 10_000) * MARGIN
    least = F.percentile_approx("novelty", 1 - QUANTILE, 10_000) / MARGIN
    own = trusted.groupBy(language).agg(cut.alias("own"), least.alias("own_least"),
                                        F.count("*").alias("n"))
    every = trusted.agg(cut.alias("every"), least.alias("every_least"))
    enough = F.col("n") >= MIN_TRUSTED
    return (docs.select(language).distinct().join(own, "language", "left")
            .crossJoin(F.broadcast(every)).select(
                "language", F.when(enough, F.col("own")).otherwise(F.col("every"))
                .alias("threshold"),
                F.when(enough, F.col("own_least")).otherwise(F.col("every_least"))
                .alias("least_novelty")))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with n_words, perplexity, novelty, threshold, least_novelty and accepted."""
    hold_out = holds_out(labels)
    model = fit_words(training_texts(docs, labels, hold_out=hold_out))
    scores = stored(scored(docs.select(_row_id().alias("id"), F.col("text").cast("binary").alias(
        "text")), model).withColumnRenamed("id", "__id"), "perplexities")
    judges = trusted_ids(labels).where(_held_out() if hold_out else F.lit(True))
    judging = docs.select("doc_id", "lang", _row_id().alias("__id")).join(
        judges, "doc_id", "left_semi").join(scores, "__id")
    cuts = stored(thresholds(judging, docs), "quality_thresholds")
    # A row for each language, which the join may broadcast by the size of the stored table.
    plain = docs.drop(*[c for c in (*JUDGED, "language") if c in docs.columns])
    return (plain.withColumn("__id", _row_id()).join(scores, "__id", "left").drop("__id")
            .join(cuts, F.coalesce("lang", F.lit("")) == F.col("language"), "left")
            .withColumn("accepted", F.coalesce(
                (F.col("perplexity") <= F.col("threshold"))
                & (F.col("novelty") >= F.col("least_novelty")), F.lit(True))).drop("language"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rejected ones."""
    return judged(docs.select("doc_id", "text", "lang", *[
        c for c in docs.columns if c not in ("doc_id", "text", "lang", *JUDGED)]),
        labels).where("accepted").select(*[c for c in docs.columns if c not in JUDGED])
