"""Benchmark decontamination with a distributed positional inverted index.

The index is partitioned by document: every task builds, for the documents it holds, one
list of token positions for each test term. A test window is looked up by intersecting its
terms' lists, each shifted by the term's offset in the window, from the rarest term on.
With a slop, a term may stand that many words off its place (proximity match); exact phrase
matches are those of the proximity matches that hold with no slop.

The test windows travel to the tasks in blocks of at most BLOCK_WORDS words, whatever the
size of the benchmark; every block is looked up in the whole corpus. Nothing is shuffled.

Defined results: a null or wordless text has no words, no hits and no items. A null or
wordless item has no window. Repeated documents each get their own row, repeated items with
one id count once, items with a null id are left out. Extra columns pass through, unless
named like a result, which replaces them.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimspan.llm.common import with_columns

WINDOW = 10
SLOP = 2
BLOCK_WORDS = 2_000_000

# Words are runs of digits, lower-cased a to z, and everything beyond ASCII.
_WORDS = bytes(byte + 32 if 65 <= byte <= 90 else byte if byte >= 128 or 48 <= byte <= 57
               or 97 <= byte <= 122 else 32 for byte in range(256))

RESULT = [
    T.StructField("n_words", T.LongType(), False),
    T.StructField("hits", T.ArrayType(T.IntegerType(), False), False),
    T.StructField("items", T.ArrayType(T.LongType(), False), False),
    T.StructField("near_items", T.ArrayType(T.LongType(), False), False),
]


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_WORDS).split() if text else []


@dataclass
class Block:
    """Test windows: terms by their words, each window's terms, and the items that have it."""

    terms: dict[bytes, int]
    windows: list[np.ndarray]
    items: list[list[int]]


def test_blocks(benchmark: DataFrame, window: int = WINDOW,
                block_words: int = BLOCK_WORDS) -> list[Block]:
    """The windows of all items. The benchmark is read row by row, one block at a time."""
    blocks: list[Block] = []
    held: dict[tuple[bytes, ...], set[int]] = {}
    size = 0

    def close() -> None:
        nonlocal held, size
        terms: dict[bytes, int] = {}
        windows = [np.array([terms.setdefault(word, len(terms)) for word in key], np.int32)
                   for key in held]
        blocks.append(Block(terms, windows, [sorted(found) for found in held.values()]))
        held, size = {}, 0

    rows = (benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
            .select("item_id", F.col("text").cast("binary").alias("text")))
    for row in rows.toLocalIterator():
        item = words(bytes(row.text))
        for begin in range(max(1, len(item) - window + 1) if item else 0):
            key = tuple(item[begin:begin + window])
            if key not in held:
                size += len(key)
            held.setdefault(key, set()).add(row.item_id)
            if size >= block_words:
                close()
    if held:
        close()
    return blocks


def _within(sorted_positions: np.ndarray, wanted: np.ndarray, slop: int) -> np.ndarray:
    """Whether a position stands at most slop off each wanted one."""
    at = np.searchsorted(sorted_positions, wanted - slop)
    found = sorted_positions[np.minimum(at, len(sorted_positions) - 1)]
    return (at < len(sorted_positions)) & (found <= wanted + slop)


class PositionalIndex:
    """Positions of every test term in some documents, sorted, one list for each term."""

    def __init__(self, documents: list[list[bytes]], terms: dict[bytes, int], gap: int):
        self.lengths = np.array([len(document) for document in documents], np.int64)
        # Documents stand so far apart that no shifted position falls into the next one.
        self.base = np.concatenate(([0], np.cumsum(self.lengths + gap)))[:-1]
        total = int(self.lengths.sum())
        ids = np.fromiter(map(terms.get, itertools.chain.from_iterable(documents),
                              itertools.repeat(-1)), np.int32, total)
        place = np.arange(total) + np.repeat(
            self.base - np.concatenate(([0], np.cumsum(self.lengths)))[:-1], self.lengths)
        known = np.flatnonzero(ids >= 0)
        order = known[np.argsort(ids[known], kind="stable")]
        self.positions = place[order]
        self.begin = np.searchsorted(ids[order], np.arange(len(terms) + 1))
        self.sizes = np.diff(self.begin)

    def postings(self, term: int) -> np.ndarray:
        return self.positions[self.begin[term]:self.begin[term + 1]]

    def phrase(self, window: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of exact matches, and of proximity matches, told by their rarest term."""
        offsets = np.argsort(self.sizes[window], kind="stable")
        first = offsets[0]
        near = self.postings(window[first]) - first
        for offset in offsets[1:]:
            if not len(near):
                return near, near
            near = near[_within(self.postings(window[offset]), near + offset, slop)]
        exact = near
        for offset in offsets[1:] if slop else ():
            exact = exact[_within(self.postings(window[offset]), exact + offset, 0)]
            if not len(exact):
                break
        return exact, near

    def document(self, starts: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.base, starts, side="right") - 1


def _lists(rows: np.ndarray, values: np.ndarray, count: int, kind: pa.DataType) -> pa.Array:
    """Lists of values by row number; rows ascend."""
    offsets = np.searchsorted(rows, np.arange(count + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def _search(texts: list[bytes | None], blocks: list[Block], slop: int) -> list[pa.Array]:
    documents = [words(text) for text in texts]
    gap = 1 + max([slop + len(w) for block in blocks for w in block.windows], default=0)
    hits, items, near_items = [], [], []
    lengths = np.array([len(document) for document in documents], np.int64)
    for block in blocks:
        index = PositionalIndex(documents, block.terms, gap)
        for window, owners in zip(block.windows, block.items):
            if not index.sizes[window].min():
                continue
            exact, near = index.phrase(window, slop)
            for starts, into in ((exact, items), (near, near_items)):
                for owner in owners if len(starts) else ():
                    found = np.unique(index.document(starts))
                    into.append(np.stack([found, np.full(len(found), owner)]))
            if len(exact):
                found = index.document(exact)
                local = exact - index.base[found]
                hits.append(np.stack([np.repeat(found, len(window)),
                                      (local[:, None] + np.arange(len(window))).ravel()]))
    made = []
    for pairs, kind in ((hits, pa.int32()), (items, pa.int64()), (near_items, pa.int64())):
        pairs = (np.unique(np.concatenate(pairs, axis=1), axis=1) if pairs
                 else np.zeros((2, 0), np.int64))
        made.append(_lists(pairs[0], pairs[1], len(texts), kind))
    return [pa.array(lengths), *made]


def search(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW,
           slop: int = SLOP, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with n_words, hits (positions of words inside an exact match of a test window),
    items (ids of items with such windows, ascending) and near_items (of items with a window
    that matches within the slop, exact ones included).
    """
    if window < 1 or slop < 0:
        raise ValueError("window must be positive and slop not negative")
    blocks = test_blocks(benchmark, window, block_words)
    if len(blocks) <= 1:
        return with_columns(docs, text, RESULT, lambda texts: _search(texts, blocks, slop))
    # Each further block adds to what those before it have found.
    found = search_block(docs, text, blocks[0], slop)
    for block in blocks[1:]:
        before = found.withColumnsRenamed({f.name: f"__{f.name}" for f in RESULT})
        after = search_block(before, text, block, slop)
        found = after.select(
            *[F.col(f"`{name}`") for name in docs.columns if name not in _NAMES], "n_words",
            F.array_sort(F.array_union("__hits", "hits")).alias("hits"),
            F.array_sort(F.array_union("__items", "items")).alias("items"),
            F.array_sort(F.array_union("__near_items", "near_items")).alias("near_items"))
    return found


_NAMES = {field.name for field in RESULT}


def search_block(docs: DataFrame, text: str, block: Block, slop: int) -> DataFrame:
    return with_columns(docs, text, RESULT, lambda texts: _search(texts, [block], slop))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that hold a test window."""
    found = search(docs, benchmark, slop=0)
    return found.where(F.size("hits") == 0).select(*docs.columns)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's row for each document."""
    found = search(docs.select("doc_id", "text"), benchmark, slop=0)
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"))
