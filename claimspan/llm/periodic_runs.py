"""Periodic runs of words by an online sparse diagonal DP.

A run is a stretch of consecutive words with smallest period q, LEAST words and two periods
long at least, that neither neighbour extends. On diagonal q (words q apart) it shows as an
unbroken match of its length less q words. Words are read in order; each word's earlier
occurrences name the diagonals that match here, and raise their lengths by one. A diagonal that
no longer matches ends: if it was long enough, its run is emitted then and there. Of diagonals
that end together and tell the same stretch, only the least is a smallest period.

Sparse: since a run of LEAST words or more matches CONTEXT = LEAST / 2 words in a row, whatever
its period, an occurrence counts only where the last CONTEXT words match, and a diagonal is opened
with all of them. Most documents have no such repeat at all; they are told by a sort of hashes
for many documents at once, and left as they are.

The DP's steps are the pairs of equal contexts, which are few in prose, but grow with the square
of a stretch of one word said n times. A text with more than PAIRS_A_WORD of them for each word
is worked out by Lyndon roots instead, exactly and in n log n steps: every run begins with two
periods of a word that is the longest Lyndon word at its place in one of two orders, so each
place offers two periods, and ranks of stretches of 2^k words tell how far each of them reaches.

Each text is one unit of work within a task, and nothing is shuffled.

Defined results: null, empty and wordless texts have no words and no runs. Rows with a null doc_id
are not changed by `looped`. Repeated rows get equal results. Extra columns are left out by `report`,
and pass through `collapsed`.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from claimspan.llm.common import with_columns

LEAST = 12
CONTEXT = LEAST // 2
PAIRS_A_WORD = 64

Run = tuple[int, int, int]  # first word, number of words, period

_REPORT = [T.StructField(name, T.LongType()) for name in (
    "n_runs", "start", "length", "period", "exponent_milli")] + [
    T.StructField(name, T.StringType()) for name in ("runs_sha256", "collapsed_sha256")]


# ---- contexts -------------------------------------------------------------------------------


def contexts(words: np.ndarray, size: int = CONTEXT) -> np.ndarray:
    """A number for the `size` words that end at each place, from the size-th word on; equal
    numbers for equal words, exactly."""
    number = words
    for back in range(1, size):
        number = number[:-1] * (int(words.max()) + 1) + words[back:]
        number = np.unique(number, return_inverse=True)[1]
    return number


_MIX = np.uint64(0x9E3779B97F4A7C15)


def may_repeat(words: np.ndarray, document: np.ndarray, size: int = CONTEXT) -> np.ndarray:
    """The documents in which a context may occur twice: all that have one, by hash, and
    rarely another. Words are numbers, in order of their documents."""
    if len(words) <= size:
        return np.zeros(0, np.int64)
    key = (document[size - 1:].astype(np.uint64) + np.uint64(1)) * _MIX
    for back in range(size):
        key = (key ^ (key >> np.uint64(31))) * _MIX + words[back:len(words) - size + 1 + back
                                                            ].astype(np.uint64)
    within = document[size - 1:] == document[:len(document) - size + 1]
    key, document = key[within], document[size - 1:][within]
    order = np.argsort(key)
    key, document = key[order], document[order]
    return np.unique(document[1:][key[1:] == key[:-1]])


# ---- runs of one text -----------------------------------------------------------------------


def diagonal_runs(context: np.ndarray, least: int = LEAST) -> list[Run]:
    """Runs, emitted in order of their ends. context: number of the words that end at each
    place, from the CONTEXT-th word on."""
    places: dict[int, list[int]] = defaultdict(list)
    active: dict[int, int] = {}  # lag of a diagonal: first word of its match
    out: list[Run] = []

    def emit(ended: set[int], end: int) -> None:
        told: dict[int, int] = {}
        for lag in ended:
            begin = active[lag] - lag
            told[begin] = min(lag, told.get(begin, lag))
        out.extend((begin, end - begin, lag) for begin, lag in told.items()
                   if end - begin >= max(least, 2 * lag))

    size = least // 2
    end = size - 1
    for end, key in enumerate(context.tolist(), size - 1):
        earlier = places[key]
        opened = end - size + 1
        now = {end - place: active.get(end - place, opened) for place in earlier}
        if ended := active.keys() - now.keys():
            emit(ended, end)
        active = now
        earlier.append(end)
    emit(set(active), end + 1)
    return sorted((run[0], run[1], run[2]) for run in out)


def pair_count(context: np.ndarray) -> int:
    """Steps of the DP: pairs of places with equal contexts."""
    n = np.bincount(context) if len(context) else np.zeros(0, np.int64)
    return int((n * (n - 1) // 2).sum())


def _ranks(words: np.ndarray) -> list[np.ndarray]:
    """ranks[k][i]: rank of the 2^k words from place i on, shorter at the end, in order; a
    text's end comes before any word. The last ranks are all different."""
    n = len(words)
    out = [(np.unique(words, return_inverse=True)[1] + 1).astype(np.int32)]
    while (1 << (len(out) - 1)) < n:
        half = 1 << (len(out) - 1)
        after = np.zeros(n, np.int64)
        after[:n - half] = out[-1][half:]
        key = out[-1].astype(np.int64) * (n + 1) + after
        out.append((np.unique(key, return_inverse=True)[1] + 1).astype(np.int32))
    return out


def _next_smaller(rank: np.ndarray) -> np.ndarray:
    """First place to the right with a smaller rank; the text's end if there is none."""
    out, stack = [0] * len(rank), []
    values = rank.tolist()
    for i in range(len(values) - 1, -1, -1):
        while stack and values[stack[-1]] >= values[i]:
            stack.pop()
        out[i] = stack[-1] if stack else len(values)
        stack.append(i)
    return np.array(out)


def lyndon_runs(words: np.ndarray, least: int = LEAST) -> list[Run]:
    """The same runs, whatever the number of repeats."""
    n = len(words)
    if n < least:
        return []
    ranks = _ranks(words)
    # In the other order of words a text's end still comes first.
    turned = _ranks(int(words.max()) - words)[-1]
    starts = np.concatenate((np.arange(n), np.arange(n)))
    periods = np.concatenate((_next_smaller(ranks[-1]), _next_smaller(turned))) - starts
    inside = starts + periods < n
    i, j = starts[inside], (starts + periods)[inside]
    ahead, back = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        size, rank = 1 << k, ranks[k]
        fits = j + ahead + size <= n
        same = fits.copy()
        same[fits] = rank[(i + ahead)[fits]] == rank[(j + ahead)[fits]]
        ahead += size * same
        fits = i - back - size >= 0
        same = fits.copy()
        same[fits] = rank[(i - back - size)[fits]] == rank[(j - back - size)[fits]]
        back += size * same
    period = j - i
    begin, length = i - back, period + ahead + back
    long = length >= np.maximum(least, 2 * period)
    return sorted(set(zip(begin[long].tolist(), length[long].tolist(), period[long].tolist())))


def find_runs(words: np.ndarray) -> list[Run]:
    """All runs of a text of numbered words, by start, then period."""
    if len(words) < LEAST:
        return []
    numbers = np.unique(words, return_inverse=True)[1]
    context = contexts(numbers)
    if pair_count(context) > PAIRS_A_WORD * len(words):
        found = lyndon_runs(numbers)
    else:
        found = diagonal_runs(context)
    return sorted(found, key=lambda run: (run[0], run[2]))


def repeats(runs: list[Run], size: int) -> np.ndarray:
    """Whether each word stands in a run after its first period."""
    step = np.zeros(size + 1, np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    return np.cumsum(step)[:size] > 0


# ---- texts ----------------------------------------------------------------------------------


def runs_of(texts: list[list[bytes]]) -> list[list[Run]]:
    """The runs of texts that are cut into words."""
    number: dict[bytes, int] = {}
    counts = np.fromiter(map(len, texts), np.int64, len(texts))
    words = np.fromiter((number.setdefault(w, len(number)) for text in texts for w in text),
                        np.int64, int(counts.sum()))
    begins = np.cumsum(counts) - counts
    out: list[list[Run]] = [[] for _ in texts]
    for i in may_repeat(words, np.repeat(np.arange(len(texts)), counts)).tolist():
        out[i] = find_runs(words[begins[i]:begins[i] + counts[i]])
    return out


def looped(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The query's input: one document in ten ends in a loop, laid out by its id alone."""
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def collapsed(docs: DataFrame) -> DataFrame:
    """docs with runs (start, length, period) and, for text, the words that stand in no run
    after its first period, joined by single spaces where a text has runs."""
    fields = [T.StructField("runs", T.ArrayType(T.StructType(
        [T.StructField(name, T.LongType()) for name in ("start", "length", "period")]))),
        T.StructField("text", T.StringType())]

    def work(texts: list[bytes | None]) -> list[pa.Array]:
        words = [text.split() if text else [] for text in texts]
        found = runs_of(words)
        kept = [text if not runs else b" ".join(
            [w for w, gone in zip(cut, repeats(runs, len(cut)).tolist()) if not gone])
            for text, cut, runs in zip(texts, words, found)]
        kind = pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")]))
        return [pa.array([[dict(zip(("start", "length", "period"), run)) for run in runs]
                          for runs in found], kind),
                pa.array([None if k is None else k.decode() for k in kept], pa.string())]

    return with_columns(docs, "text", fields, work).select(
        *[f"`{c}`" for c in docs.columns if c != "runs"], "runs")


def report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_runs, the longest run and digests, of `looped` words."""
    def work(ids: list[int | None], texts: list[bytes | None]) -> list[pa.Array]:
        words = [looped(text.split() if text else [], i) for i, text in zip(ids, texts)]
        rows = []
        for cut, runs in zip(words, runs_of(words)):
            top = min(runs, key=lambda run: (-run[1], run[0], run[2]), default=None)
            told = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
            if runs:
                cut = [w for w, gone in zip(cut, repeats(runs, len(cut)).tolist()) if not gone]
            rows.append((len(runs), *(top or (None,) * 3),
                         None if top is None else 1000 * top[1] // top[2],
                         hashlib.sha256(told.encode()).hexdigest(),
                         hashlib.sha256(b" ".join(cut)).hexdigest()))
        columns = list(zip(*rows)) or [()] * len(_REPORT)
        return [pa.array(column, pa.int64() if i < 5 else pa.string())
                for i, column in enumerate(columns)]

    return with_columns(docs.select("doc_id", "text"), "text", _REPORT, work,
                        beside="doc_id").drop("text")
