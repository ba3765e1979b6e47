"""LM scoring with a probabilistic suffix tree over the bytes of words.

Symbols are a word's bytes and the boundary that ends it. A context is the last 1 to DEPTH
symbols, back to the boundary before the word at most. A context is retained if it makes up
at least MIN_SHARE of all positions (and MIN_COUNT) and passes a divergence test against its
parent (the context without its oldest byte):

    sum over next symbols of n * ln(P(symbol | context) / P(symbol | parent))
        >= 0.5 * distinct next symbols * ln(n of the context)

A state's next-symbol distribution is smoothed by that of its longest retained suffix, with
as much weight as it has distinct next symbols; the root by a uniform one. A position is
scored by its longest retained suffix. Above the bytes stand whole words: a word's count less
a discount, over all words, smoothed by the tree with the weight that the discounts leave.
The tree goes on over the word before: its symbol there is one of the FREQUENT most frequent
words or else the class of all other words with its first two bytes (or the text's begin).
Retained by the same test, such a state says how much likelier than at the root the next
word's symbol is, smoothed likewise. The text's end is drawn before each word.

The tree is learned from the counts of all distinct words of all training documents. A word's
probability depends on the word alone, so each distinct word is scored once. Counts and
scores come back to the texts by blocks: documents are dealt to blocks of about BLOCK_BYTES
by hash, each block asks for its distinct words, and both meet in one task. The model that
tasks hold has at most DEPTH / MIN_SHARE states.

Defined results: a null or empty text has its end as only token. Rows with a null doc_id
train. Repeated rows count as often as they stand. Without training documents N and V are 0 and
the tree is its root. Extra columns are left out.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspan.llm.common import stored

DEPTH = 5
MIN_SHARE = 1e-6
MIN_COUNT = 16
BLOCK_BYTES = 6 << 20
SYMBOLS = 257
FREQUENT = 1_024
CLASSES = 1 << 16
#: Words are worked through in lots of so many.
LOT = 100_000


def spelled(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the words with a boundary before and after, and their places in the word."""
    line = np.frombuffer(b" " + b"  ".join(words) + b" ", np.uint8)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    return line, np.arange(len(line)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def grams(line: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(len(line), np.int64)
    for back in range(size):
        out[back:] |= line[:len(line) - back].astype(np.int64) << (8 * back)
    return out


def _tokens(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


# ---- the tree -------------------------------------------------------------------------------


@dataclass
class Tree:
    """By context length: sorted contexts with their totals and distinct next symbols, and
    sorted n-grams (context and next symbol) with their counts. Length 0 is the root."""

    contexts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    grams: list[tuple[np.ndarray, np.ndarray]]

    def log10(self, words: list[bytes]) -> np.ndarray:
        """Of each word with its closing boundary."""
        out = [np.zeros(0)]
        for begin in range(0, len(words), LOT):
            some = words[begin:begin + LOT]
            line, place = spelled(some)
            at = np.flatnonzero(place > 0)
            p = np.full(len(at), 1 / SYMBOLS)
            for length, (names, totals, kinds) in enumerate(self.contexts):
                fits = np.flatnonzero(place[at] >= length)
                key = grams(line, length + 1)[at[fits]]
                known, where = _find(names, key >> 8)
                fits, key, where = fits[known], key[known], where[known]
                seen, n_at = _find(self.grams[length][0], key)
                n = np.where(seen, self.grams[length][1][n_at] if len(
                    self.grams[length][0]) else 0, 0)
                p[fits] = (n + kinds[where] * p[fits]) / (totals[where] + kinds[where])
            sizes = np.fromiter(map(len, some), np.int64, len(some)) + 1
            out.append(np.add.reduceat(np.log10(p), np.cumsum(sizes) - sizes))
        return np.concatenate(out)


    def prefixes(self) -> np.ndarray:
        """Probability of each class: of its first byte, times that of its second."""
        byte = np.arange(256)
        out = np.zeros((256, 256))
        first = self._next(np.full(256, 32), 1, byte)
        for b in byte:
            out[b] = first[b] * self._next(np.full(256, (32 << 8) | b), 2, byte)
        return out.ravel()

    def _next(self, history: np.ndarray, depth: int, symbol: np.ndarray) -> np.ndarray:
        p = np.full(len(symbol), 1 / SYMBOLS)
        for length, (names, totals, kinds) in enumerate(self.contexts[:depth + 1]):
            context = history & ((1 << (8 * length)) - 1)
            known, where = _find(names, context)
            seen, at = _find(self.grams[length][0], (context << 8) | symbol)
            n = np.where(seen, self.grams[length][1][at], 0) if seen.any() else 0
            if known.any():
                p = np.where(known, (n + kinds[where] * p) / (totals[where] + kinds[where]), p)
        return p


@dataclass
class Before:
    """What the word before says. share: probability of each symbol at the root; retained
    contexts with totals and distinct next symbols; (context, symbol) pairs with counts."""

    number: dict[bytes, int]
    share: np.ndarray
    contexts: tuple[np.ndarray, np.ndarray, np.ndarray]
    pairs: tuple[np.ndarray, np.ndarray]

    def log10(self, before: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """How much likelier each symbol is after the one before it."""
        known, where = _find(self.contexts[0], before)
        seen, at = _find(self.pairs[0], before * SPAN + symbol)
        n = np.where(seen, self.pairs[1][at], 0) if seen.any() else np.zeros(len(symbol))
        out = np.zeros(len(symbol))
        if known.any():
            total, kinds = self.contexts[1][where], self.contexts[2][where]
            ratio = (n / self.share[symbol] + kinds) / (total + kinds)
            out[known] = np.log10(ratio[known])
        return out


BEGIN = FREQUENT + CLASSES
SPAN = 1 << 20


def symbol_of(word: bytes, number: dict[bytes, int]) -> int:
    at = number.get(word)
    if at is not None:
        return at
    return FREQUENT + 256 * word[0] + (word[1] if len(word) > 1 else 32)


def _after(texts: list[np.ndarray]) -> np.ndarray:
    """The symbol before each one, text by text."""
    return np.concatenate([np.zeros(0, np.int64), *[
        np.concatenate(([BEGIN], text[:-1])) for text in texts if len(text)]])


def fit_before(roles: DataFrame, words: DataFrame, tree: Tree, off: float, spoken: int,
               rest: float, min_count: int) -> Before:
    # Stored first: else every task's best would go to the driver, not to another task.
    top = stored(words.where("n > 0").orderBy(F.desc("n"), "word").limit(FREQUENT),
                 "suffix_frequent").toPandas().sort_values(["n", "word"], ascending=[False, True])
    listed = [bytes(word) for word in top["word"]]
    number = {word: i for i, word in enumerate(listed)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols: dict[bytes, int] = {}
        for batch in batches:
            texts = []
            for text in batch.column(0).to_pylist():
                found = _tokens(text)
                for word in found:
                    if word not in symbols:
                        symbols[word] = symbol_of(word, number)
                texts.append(np.fromiter(map(symbols.__getitem__, found), np.int64, len(found)))
                if len(symbols) > 1_000_000:
                    symbols.clear()
            keys, many = np.unique(_after(texts) * SPAN + np.concatenate(
                [np.zeros(0, np.int64), *texts]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(many)],
                                             names=["pair", "n"])

    pairs = stored(roles.where(~F.col("held_out")).select("text").mapInArrow(
        count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).select(
        "pair", F.shiftright("pair", 20).alias("before"),
        F.col("pair").bitwiseAND(F.lit(SPAN - 1)).alias("symbol"), "n"), "suffix_pairs")
    every = pairs.agg(F.sum("n")).first()[0] or 0
    roots = pairs.groupBy("symbol").agg((F.sum("n") / F.lit(max(every, 1))).alias("root"))
    totals = pairs.groupBy("before").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    gain = F.sum(F.col("n") * F.log(F.col("n") / F.col("total") / F.col("root")))
    kept = stored(pairs.join(totals.where(F.col("total") >= min_count), "before")
                  .join(roots, "symbol").groupBy("before", "total", "kinds")
                  .agg(gain.alias("gain"))
                  .where(F.col("gain") >= 0.5 * F.col("kinds") * F.log("total")),
                  "suffix_before")
    c = kept.toPandas().sort_values("before")
    p = pairs.join(kept, "before", "left_semi").select("pair", "n").toPandas().sort_values(
        "pair")
    # Probability of each symbol at the root: a frequent word's own, a class's without those
    # of its words that are frequent.
    share = np.zeros(BEGIN)
    share[FREQUENT:] = rest * tree.prefixes()
    own = rest * 10 ** tree.log10(listed) if listed else np.zeros(0)
    share[:len(listed)] = np.maximum(top["n"].to_numpy(np.float64) - off, 0) / spoken + own
    np.subtract.at(share, [symbol_of(word, {}) for word in listed], own)
    rare = words.where("n > 0").join(top_words(words, listed), "word", "left_anti").groupBy(
        F.expr(f"{FREQUENT} + 256 * ascii(decode(substring(word, 1, 1), 'ISO-8859-1')) + "
               "if(octet_length(word) > 1, ascii(decode(substring(word, 2, 1), "
               "'ISO-8859-1')), 32)").alias("symbol")).agg(
        F.sum(F.greatest(F.col("n") - off, F.lit(0.0))).alias("n")).toPandas()
    np.add.at(share, rare["symbol"].to_numpy(np.int64), rare["n"].to_numpy() / spoken)
    share = np.maximum(share, 1e-300)
    return Before(number, share, tuple(c[n].to_numpy(np.int64) for n in (
        "before", "total", "kinds")), tuple(p[n].to_numpy(np.int64) for n in ("pair", "n")))


def top_words(words: DataFrame, listed: list[bytes]) -> DataFrame:
    return words.sparkSession.createDataFrame(
        pa.table({"word": pa.array(listed, pa.binary())}), "word binary")


def _find(names: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(names):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(names, keys), len(names) - 1)
    return names[at] == keys, at


def gram_counts(words: DataFrame, depth: int) -> DataFrame:
    """(length, gram, n) of all contexts with their next symbol; words has word and n."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A task's counts are merged lot by lot, so that a common n-gram leaves it once.
        held = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * (depth + 1)
        for batch in batches:
            if not batch.num_rows:
                continue
            spelling = batch.column(0).to_pylist()
            line, place = spelled(spelling)
            weight = np.repeat(batch.column(1).to_numpy(),
                               np.fromiter(map(len, spelling), np.int64) + 2)
            for length in range(depth + 1):
                at = (place > 0) & (place >= length)
                keys = np.concatenate([held[length][0], grams(line, length + 1)[at]])
                many = np.concatenate([held[length][1], weight[at]])
                keys, inverse = np.unique(keys, return_inverse=True)
                held[length] = keys, np.bincount(inverse, many, len(keys)).astype(np.int64)
        for length, (keys, many) in enumerate(held):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(keys), length, np.int32)), pa.array(keys),
                 pa.array(many)], names=["length", "gram", "n"])

    return words.mapInArrow(run, "length int, gram long, n long").groupBy(
        "length", "gram").agg(F.sum("n").alias("n"))


def fit(words: DataFrame, depth: int = DEPTH, min_share: float = MIN_SHARE,
        min_count: int = MIN_COUNT) -> Tree:
    counts = stored(gram_counts(words, depth).withColumn(
        "context", F.shiftright("gram", 8)), "suffix_counts")
    totals = counts.groupBy("length", "context").agg(
        F.sum("n").alias("total"), F.count("*").alias("kinds"))
    positions = counts.where("length = 0").agg(F.sum("n")).first()[0] or 0
    least = max(min_count, math.ceil(min_share * positions))
    frequent = totals.where((F.col("total") >= least) | (F.col("length") == 0))
    held = counts.join(frequent, ["length", "context"])
    # The parent's n-gram lacks the oldest byte of the context.
    kept = F.call_function("shiftleft", F.lit(1).cast("long"),
                           (8 * F.col("length")).cast("int")) - 1
    parent = held.select(
        (F.col("length") + 1).alias("length"), F.col("gram").alias("parent"),
        (F.col("n") / F.col("total")).alias("parent_share"))
    gain = F.sum(F.col("n") * F.log(F.col("n") / F.col("total") / F.col("parent_share")))
    retained = (held.where("length > 0").withColumn("parent", F.col("gram").bitwiseAND(kept))
                .join(parent, ["length", "parent"])
                .groupBy("length", "context", "total", "kinds").agg(gain.alias("gain"))
                .where(F.col("gain") >= 0.5 * F.col("kinds") * F.log("total"))
                .select("length", "context", "total", "kinds"))
    states = stored(retained.unionByName(frequent.where("length = 0").select(
        "length", "context", "total", "kinds")), "suffix_states")
    entries = counts.join(states.select("length", "context"), ["length", "context"],
                          "left_semi")
    s, g = states.toPandas(), entries.select("length", "gram", "n").toPandas()
    contexts, tables = [], []
    for length in range(depth + 1):
        part = s[s["length"] == length].sort_values("context")
        contexts.append(tuple(part[c].to_numpy(np.int64) for c in ("context", "total", "kinds")))
        part = g[g["length"] == length].sort_values("gram")
        tables.append(tuple(part[c].to_numpy(np.int64) for c in ("gram", "n")))
    return Tree(contexts, tables)


# ---- words and texts ------------------------------------------------------------------------


def with_roles(docs: DataFrame) -> DataFrame:
    """doc_id, held_out and the text's bytes."""
    rest = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7
    return docs.select("doc_id", (rest == 2).alias("held_out"),
                       F.coalesce("text", F.lit("")).cast("binary").alias("text"))


def training_counts(roles: DataFrame) -> DataFrame:
    """Every word of the corpus with its count in training documents (0: held out only)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for held_out, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held_out:
                    for word in _tokens(text):
                        found.setdefault(word, 0)
                else:
                    found.update(_tokens(text))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())],
                names=["word", "n"])

    return roles.select("held_out", "text").mapInArrow(run, "word binary, n long").groupBy(
        "word").agg(F.sum("n").alias("n"))


def score(docs: DataFrame, depth: int = DEPTH, min_share: float = MIN_SHARE,
          min_count: int = MIN_COUNT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score."""
    roles = with_roles(docs)
    words = stored(training_counts(roles), "suffix_words")
    total = roles.agg(F.sum(F.octet_length("text")), F.count_if(~F.col("held_out"))).first()
    ends = total[1] or 0
    said = words.agg(F.sum("n"), F.count_if(F.col("n") > 0), F.count_if(F.col("n") == 1),
                     F.count_if(F.col("n") == 2)).first()
    tokens = (said[0] or 0) + ends
    kinds = (said[1] or 0) + (ends > 0)
    tree = fit(words.where("n > 0"), depth, min_share, min_count)
    off = said[2] / (said[2] + 2 * said[3]) if said[2] and said[3] else 0.5
    spoken, rest = max(1, tokens - ends), off * (said[1] or 0) / max(1, tokens - ends)
    before = fit_before(roles, words, tree, off, spoken, rest, min_count) if rest else None
    base_of = lambda n: np.log10((n + 1) / (tokens + kinds + 1))
    end_base = float(base_of(np.float64(ends)))
    p_end = (ends + 1) / (tokens + 2)
    end, more = math.log10(p_end), math.log10(1 - p_end)

    def value(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = tree.log10(batch.column(0).to_pylist())
            if rest:
                own = np.maximum(batch.column(1).to_numpy() - off, 0) / spoken
                each = np.logaddexp(np.log(np.maximum(own, 1e-300)),
                                    math.log(rest) + each * math.log(10)) / math.log(10)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(each)], names=["word", "n", "log10"])

    scored = words.mapInArrow(value, "word binary, n long, log10 double")
    blocks = max(1, math.ceil((total[0] or 0) / block_bytes))
    dealt = roles.withColumn("block", F.pmod(
        F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))

    def ask(held: pa.Table) -> pa.Table:
        found = set(itertools.chain.from_iterable(map(_tokens, held["text"].to_pylist())))
        block = held["block"][0].as_py()
        return pa.table({"block": pa.array([block] * len(found), pa.int32()),
                         "word": pa.array(list(found), pa.binary())})

    asked = dealt.groupBy("block").applyInArrow(ask, "block int, word binary")
    answered = asked.join(scored, "word").select("block", "word", "n", "log10")

    def add_up(held: pa.Table, answers: pa.Table) -> pa.Table:
        texts = [_tokens(text) for text in held["text"].to_pylist()]
        number = {word: i for i, word in enumerate(answers["word"].to_pylist())}
        n, own = answers["n"].to_numpy(), answers["log10"].to_numpy()
        counts = np.fromiter(map(len, texts), np.int64, len(texts))
        flat = np.fromiter(map(number.__getitem__, itertools.chain.from_iterable(texts)),
                           np.int64, int(counts.sum()))
        stops = np.concatenate(([0], np.cumsum(counts)))
        gains = np.zeros(len(flat))
        if before is not None and len(flat):
            symbol = np.array([symbol_of(word, before.number) for word in number], np.int64)[flat]
            gains = before.log10(_after([symbol[a:b] for a, b in zip(stops, stops[1:])]), symbol)

        def sums(values: np.ndarray) -> np.ndarray:
            # Text by text, so that a sum does not depend on the texts beside it.
            return np.array([values[flat[a:b]].sum() for a, b in zip(stops, stops[1:])])

        return pa.table({
            "doc_id": held["doc_id"], "held_out": held["held_out"],
            "n_tokens": pa.array(counts + 1),
            "n_known": pa.array(sums(n > 0).astype(np.int64) + (ends > 0)),
            "train_tokens": pa.array(np.full(len(texts), tokens, np.int64)),
            "base_score": pa.array(sums(base_of(n)).astype(np.float64) + end_base),
            "score": pa.array(sums(own).astype(np.float64) + counts * more + end + np.array(
                [gains[a:b].sum() for a, b in zip(stops, stops[1:])]))})

    return dealt.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(
        add_up, "doc_id long, held_out boolean, n_tokens long, n_known long, "
        "train_tokens long, base_score double, score double")
