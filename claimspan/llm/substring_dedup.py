"""Substring dedup by recompression.

Every text is parsed in rounds. A round names runs of equal symbols, then pairs: each symbol
is left or right by a hash of its name, and a left one followed by a right one merge. A name
depends on what it stands for alone, so names agree in the whole corpus without a dictionary,
and what a round does at a place depends on that place's neighbours alone. Each symbol carries
the range of words that it depends on; wherever the same words stand in that range, the same
symbol stands inside.

So equal windows of WINDOW words hold equal symbols. Each window picks, of the symbols that
depend on nothing outside it, one of the highest round with the least hash, and is sent to
that symbol's shard with a fingerprint of its words; shared symbols reveal repeats, and the
fingerprints verify them: a window goes if its fingerprint also came from a smaller doc_id.
Neighbouring windows mostly share their symbol and travel together. A repeat inside one slice
of texts is told there, and only the first one of a slice travels; a passage that a third of
all documents hold costs a row per slice.

Names and fingerprints are 64-bit hashes of words and positions; a false repeat would need a
collision of both in one shard.

Defined results: null, empty and short texts lose nothing. Documents with a null doc_id have
no order: they neither lose words nor count as earlier. Rows with equal doc_id don't remove
each other's words. Extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspan.llm.common import TEXT, slices

WINDOW = 50
ROUNDS = 3

_MIX = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xD6E8FEB86659FD93)
_BASE = 0x5851F42D4C957F2D


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit numbers, one to one."""
    x = (x ^ (x >> np.uint64(32))) * _ODD
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(mix(a) * _MIX + b)


@dataclass
class Symbols:
    """The symbols of a round, in order: name, begin and end (words), and the words [low, high)
    that they depend on. Texts stand one place apart; beside a text's end that place counts."""

    name: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def neighbours(self) -> np.ndarray:
        """Whether each symbol but the last is followed by one of the same text."""
        return self.end[:-1] == self.begin[1:]


def _reach(s: Symbols) -> tuple[np.ndarray, np.ndarray]:
    """low of each symbol's left neighbour, high of its right one; beside a text's end, the
    empty place."""
    beside = s.neighbours()
    low, high = s.begin - 1, s.end + 1
    low[1:] = np.where(beside, s.low[:-1], low[1:])
    high[:-1] = np.where(beside, s.high[1:], high[:-1])
    return low, high


def name_runs(s: Symbols, number: int) -> Symbols:
    first = np.ones(len(s.name), bool)
    first[1:] = ~s.neighbours() | (s.name[1:] != s.name[:-1])
    at = np.flatnonzero(first)
    last = np.append(at[1:], len(first)) - 1
    size = (last - at + 1).astype(np.uint64)
    named = pair(s.name[at] + np.uint64(2 * number), size)
    low, high = _reach(s)
    return Symbols(np.where(size > 1, named, s.name[at]), s.begin[at], s.end[last],
                   low[at], high[last])


def name_pairs(s: Symbols, number: int) -> Symbols:
    salt = np.uint64(number * int(_MIX) % (1 << 64))
    right = (mix(s.name + salt) & np.uint64(1)).astype(bool)
    merges = np.zeros(len(s.name), bool)
    merges[:-1] = s.neighbours() & ~right[:-1] & right[1:]
    second = np.zeros(len(s.name), bool)
    second[1:] = merges[:-1]
    at = np.flatnonzero(~second)
    after = np.minimum(at + 1, len(s.name) - 1)
    low, high = _reach(s)
    joined = merges[at]
    # A right symbol looks at its left neighbour, a left one at its right neighbour.
    low = np.where(right, low, s.low)[at]
    high = np.where(right, s.high, high)[at]
    return Symbols(
        np.where(joined, pair(s.name[at] + np.uint64(2 * number + 1), s.name[after]),
                 s.name[at]),
        s.begin[at], np.where(joined, s.end[after], s.end[at]),
        low, np.where(joined, s.high[after], high))


def rounds(words: np.ndarray, place: np.ndarray, count: int = ROUNDS) -> list[Symbols]:
    """Symbols after each round, of word names at their places."""
    s = Symbols(words, place, place + 1, place, place + 1)
    out = []
    for number in range(count):
        s = name_pairs(name_runs(s, number), number)
        out.append(s)
    return out


class Fingerprints:
    """Of any range of words, from prefix sums of a polynomial modulo 2^64."""

    def __init__(self, words: np.ndarray, place: np.ndarray):
        size = int(place[-1]) + 3 if len(place) else 1
        inverse = pow(_BASE, -1, 1 << 64)
        self.down = np.ones(size, np.uint64)
        power = np.ones(size, np.uint64)
        power[1:], self.down[1:] = np.uint64(_BASE), np.uint64(inverse)
        np.multiply.accumulate(power, out=power)
        np.multiply.accumulate(self.down, out=self.down)
        self.sums = np.zeros(size, np.uint64)
        self.sums[place + 1] = mix(words) * power[place]
        np.add.accumulate(self.sums, out=self.sums)

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Places begin at 1."""
        return mix((self.sums[end] - self.sums[begin]) * self.down[begin]
                   + (end - begin).astype(np.uint64))


def anchors(levels: list[Symbols], windows: np.ndarray, prints: Fingerprints, window: int,
            own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window (by its first word's place, ascending) the key of its symbol, and a
    number that tells occurrences of symbols apart. own: fingerprints, for windows without."""
    key, which = own.copy(), -1 - np.arange(len(windows))
    left, seen = np.arange(len(windows)), 0
    for level in reversed(levels):
        short = np.flatnonzero(level.high - level.low <= window)
        low, high = level.low[short], level.high[short]
        rank = mix(level.name[short] ^ _ODD)
        at = windows[left]
        top = int(max(windows[-1] + window, high.max(initial=0))) + 2 if len(windows) else 1
        first = np.cumsum(np.bincount(low, minlength=top))[at - 1]
        stop = np.cumsum(np.bincount(high, minlength=top))[at + window]
        has = np.flatnonzero(stop > first)
        if len(has):
            first, stop = first[has], stop[has]
            new = np.ones(len(has), bool)
            new[1:] = (first[1:] != first[:-1]) | (stop[1:] != stop[:-1])
            state = np.cumsum(new) - 1
            f, e = first[new], stop[new]
            best = f.copy()
            for step in range(1, int((e - f).max())):
                some = np.flatnonzero(f + step < e)
                better = rank[f[some] + step] < rank[best[some]]
                best[some[better]] = f[some[better]] + step
            chosen = best[state]
            made = pair(level.name[short], prints.of(low, high))
            key[left[has]] = made[chosen]
            which[left[has]] = seen + chosen
            left = np.delete(left, has)
        seen += len(short)
    return key, which


def _first_docs(prints: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Whether each fingerprint's doc is the least of all with that fingerprint."""
    order = np.lexsort((docs, prints))
    sorted_ = prints[order]
    begins = np.ones(len(order), bool)
    begins[1:] = sorted_[1:] != sorted_[:-1]
    least = docs[order][begins][np.cumsum(begins) - 1]
    out = np.empty(len(order), bool)
    out[order] = docs[order] == least
    return out


def _runs(cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs that start where `cut` holds."""
    begins = np.flatnonzero(cut)
    return begins, np.append(begins[1:], len(cut))


SENT = pa.schema([("key", pa.int64()), ("row", pa.int64()), ("doc_id", pa.int64()),
                  ("begin", pa.int32()), ("end", pa.int32()), ("prints", pa.binary())])
SENT_DDL = "key long, row long, doc_id long, begin int, end int, prints binary"


def emit(texts: list[bytes | None], rows: np.ndarray, docs: np.ndarray, window: int,
         count: int) -> pa.RecordBatch:
    """Runs of windows (by first word, [begin, end)) with their key and fingerprints; those
    already known as repeats have no fingerprints, and their row as key."""
    words = [text.split() if text else [] for text in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    base = np.cumsum(sizes + 1) - sizes  # the place of each text's first word, from 1 on
    digest = xxhash.xxh64_intdigest
    name = np.array([digest(w) for found in words for w in found], np.uint64)
    place = np.repeat(base - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(name))
    many = np.maximum(sizes - window + 1, 0)
    text = np.repeat(np.arange(len(texts)), many)
    start = np.repeat(base - (np.cumsum(many) - many), many) + np.arange(len(text))
    prints = Fingerprints(name, place)
    own = prints.of(start, start + window)
    fresh = _first_docs(own, docs[text]) if len(own) else np.zeros(0, bool)
    cols = []
    # Repeats of this slice: ranges only.
    known = np.flatnonzero(~fresh)
    cut = np.ones(len(known), bool)
    cut[1:] = (np.diff(known) > 1) | (np.diff(text[known]) > 0)
    b, e = _runs(cut)
    if len(known):
        t, local = text[known[b]], start[known[b]] - base[text[known[b]]]
        cols.append((rows[t], rows[t], docs[t], local, local + (e - b),
                     np.zeros(len(b) + 1, np.int32), b""))
    # First ones of this slice.
    at = np.flatnonzero(fresh)
    if len(at):
        key, which = anchors(rounds(name, place, count), start[at], prints, window, own[at])
        cut = np.ones(len(at), bool)
        cut[1:] = (np.diff(at) > 1) | (np.diff(text[at]) > 0) | (which[1:] != which[:-1])
        b, e = _runs(cut)
        t, local = text[at[b]], start[at[b]] - base[text[at[b]]]
        cols.append((key[b].view(np.int64), rows[t], docs[t], local, local + (e - b),
                     np.append(b, len(at)).astype(np.int32) * 8, own[at].tobytes()))
    batches = []
    for k, r, d, first, last, offsets, data in cols:
        held = pa.Array.from_buffers(pa.binary(), len(k), [
            None, pa.py_buffer(offsets), pa.py_buffer(data)])
        batches.append(pa.RecordBatch.from_arrays(
            [pa.array(k), pa.array(r), pa.array(d), pa.array(first.astype(np.int32)),
             pa.array(last.astype(np.int32)), held], schema=SENT))
    return pa.Table.from_batches(batches, SENT).combine_chunks()


def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of repeated windows, of rows sorted by key and doc_id. Of the last key, which may
    go on in the next batch, the fingerprints so far are kept with their least doc_id."""
    held_key, held, held_docs = None, np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        key, row, doc, begin, end = (batch.column(i).to_numpy() for i in range(5))
        prints = batch.column(5)
        told = pc.binary_length(prints).to_numpy() == 0
        out = [np.stack([row[told], doc[told], begin[told], end[told]])]
        sent = np.flatnonzero(~told)
        if len(sent):
            size = (end - begin)[sent].astype(np.int64)
            value = np.frombuffer(b"".join(prints.take(pa.array(sent)).to_pylist()), np.uint64)
            of = np.repeat(sent, size)
            offset = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
            both = pair(value, key[of].view(np.uint64))
            went_on = held_key == key[sent[0]]
            before = (held, held_docs) if went_on else (held[:0], held_docs[:0])
            every = np.concatenate([before[0], both])
            docs = np.concatenate([before[1], doc[of]])
            first = _first_docs(every, docs)
            gone = ~first[len(before[0]):]
            hit = np.flatnonzero(gone)
            cut = np.ones(len(hit), bool)
            cut[1:] = (np.diff(hit) > 1) | (np.diff(of[hit]) > 0)
            b, e = _runs(cut)
            if len(hit):
                r, f = of[hit[b]], begin[of[hit[b]]] + offset[hit[b]]
                out.append(np.stack([row[r], doc[r], f, f + (e - b)]))
            if key[sent[-1]] == key[sent[0]] and went_on:
                same = np.ones(len(every), bool)
            else:
                same = np.concatenate([np.zeros(len(before[0]), bool),
                                       key[of] == key[sent[-1]]])
            kept, index = np.unique(every[same & first], return_index=True)
            held_key, held, held_docs = key[sent[-1]], kept, docs[same & first][index]
        made = np.concatenate(out, axis=1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(made[0]), pa.array(made[1]), pa.array(made[2].astype(np.int32)),
             pa.array(made[3].astype(np.int32))], names=["row", "doc_id", "begin", "end"])


def repeats(keyed: DataFrame, window: int = WINDOW, count: int = ROUNDS) -> DataFrame:
    """row, doc_id, begin, end: ranges of first words of repeated windows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                made = emit(part.column(2).to_pylist(), part.column(0).to_numpy(),
                            part.column(1).to_numpy(), window, count)
                yield from made.to_batches(max_chunksize=65_536)

    known = keyed.where("doc_id is not null and text is not null").select(
        "__row", "doc_id", F.col("text").cast("binary").alias(TEXT))
    sent = known.mapInArrow(run, SENT_DDL).repartition("key").sortWithinPartitions(
        "key", "doc_id")
    return sent.mapInArrow(verify, "row long, doc_id long, begin int, end int")


def keep(texts: list[bytes | None], ranges: list[list[tuple[int, int]] | None],
         window: int) -> tuple[list[int], list[int], list[str]]:
    total, removed, kept = [], [], []
    for text, found in zip(texts, ranges):
        words = text.split() if text else []
        total.append(len(words))
        if found:
            change = np.zeros(len(words) + 1, np.int64)
            for begin, end in found:
                change[begin] += 1
                change[end - 1 + window] -= 1
            stays = np.cumsum(change[:-1]) == 0
            words = [w for w, s in zip(words, stays.tolist()) if s]
        removed.append(total[-1] - len(words))
        kept.append(b" ".join(words).decode("utf-8", "replace"))
    return total, removed, kept


def dedup_substrings(docs: DataFrame, window: int = WINDOW, count: int = ROUNDS) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words left, joined by one space)."""
    if window < 1 or count < 1:
        raise ValueError("window and rounds must be positive")
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("__row"))
    found = repeats(keyed, window, count).groupBy("row", F.col("doc_id").alias("r_doc")).agg(
        F.collect_list(F.struct("begin", "end")).alias("ranges"))
    joined = keyed.join(found.hint("shuffle_hash"), (F.col("__row") == F.col("row"))
                        & (F.col("doc_id") == F.col("r_doc")), "left").select(
        "doc_id", "ranges.begin", "ranges.end", F.col("text").cast("binary").alias(TEXT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                ranges = [b and list(zip(b, e)) for b, e in zip(
                    part.column(1).to_pylist(), part.column(2).to_pylist())]
                total, removed, kept = keep(part.column(3).to_pylist(), ranges, window)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(total, pa.int64()),
                     pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                    names=["doc_id", "n_words", "n_removed", "kept"])

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def report(docs: DataFrame) -> DataFrame:
    """The contract's row for each document."""
    return dedup_substrings(docs).select(
        "doc_id", "n_words", "n_removed",
        F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
