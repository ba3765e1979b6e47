"""Cross-tokenizer alignment by inverted pair bitmaps.

Every text, with a space before it, is encoded by two public tokenizers: A, byte-level pairs,
and B, pieces. Where an A token and a B token end at the same byte, they are linked; these
places cut both token sequences into groups. How strongly two ids belong together is how many
links in the corpus hold the pair, in how many documents.

1. Documents are encoded once, in blocks of BLOCK_BYTES of text (at most BLOCK_DOCS documents,
   at least one). A block is an inverted index of its pairs: for each pair of ids the bitmap of
   the documents that hold it, OR-merged over the slices the block is read in, and, for pairs
   linked more than once in a document, a plane for each bit of the further links. A bitmap is
   a list of document numbers or plain bits, whichever is shorter. Blocks are written
   to the shared folder once: encoding is the dear part, and a lost executor repeats one block.
2. Popcounts add up to the counts of a pair: documents from the bitmaps, links from the planes
   by their weights. Each block brings one row for a pair and plane, summed within tasks first,
   so a pair that every document holds costs a row per block.
3. Postings meet their pair's counts in a join by pair, whose large partitions adaptive execution
   splits, and go back to their block, where each bitmap adds its pair's count to the documents
   it names. A block bounds what one task holds.

Defined results: texts that are null, empty, or that a tokenizer does not give back byte by byte
have no tokens, and zeros. Rows with equal doc_id, null included, are documents of their own and
all count. An empty table gives no rows. Extra columns are left out. Texts that name special
tokens are plain text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspan.llm.common import TEXT, slices, stored

#: Folder of the vocabulary files; read on the driver, their content goes to the tasks.
TOKENIZERS = "/opt/tokenizers"
#: The ranks of byte_bpe_50k.json, the same vocabulary and ids, for a faster encoder.
BYTE_RANKS = "byte_bpe_50k.tiktoken"
PIECES = "piece_bpe_32k.model"
#: How the byte-level tokenizer cuts a text before it merges bytes (fixed value).
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

BLOCK_BYTES = 16 << 20
BLOCK_DOCS = 1 << 16

_BLOCKS = ("block long, ordinal int, doc_id long, n_a long, n_b long, n_groups long, "
           "n_links long, groups_sha256 string, a int, b int, plane int, dense boolean, "
           "docs binary, ones long")
_DOCUMENT = ("block", "ordinal", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
_POSTING = ("block", "a", "b", "plane", "dense", "docs", "ones")


@dataclass
class Tokenizers:
    """Both encoders, made in a task from the content of their files."""

    ranks: bytes
    pieces: bytes

    @cached_property
    def _byte_level(self):
        import tiktoken
        ranks = {base64.b64decode(token): int(rank)
                 for token, rank in map(bytes.split, self.ranks.splitlines())}
        return tiktoken.Encoding("byte level", pat_str=PATTERN, mergeable_ranks=ranks,
                                 special_tokens={})

    @cached_property
    def _piece_level(self):
        import sentencepiece
        return sentencepiece.SentencePieceProcessor(model_proto=self.pieces)

    @cached_property
    def bytes_of(self) -> tuple[list[bytes], list[bytes]]:
        """The bytes of every id, of A and of B."""
        a = [b""] * (max(self._byte_level._mergeable_ranks.values()) + 1)
        for token, rank in self._byte_level._mergeable_ranks.items():
            a[rank] = token
        model, b = self._piece_level, []
        for i in range(model.vocab_size()):
            piece = model.id_to_piece(i)
            b.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i)
                     else b"" if model.is_control(i) or model.is_unknown(i)
                     else piece.replace("▁", " ").encode())
        return a, b

    @cached_property
    def sizes(self) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.fromiter(map(len, side), np.int64, len(side)) for side in self.bytes_of)

    @cached_property
    def numerals(self) -> np.ndarray:
        """Each id in decimals with the sign after it: of A with , and |, of B with , and ;."""
        a, b = map(len, self.bytes_of)
        return np.array([f"{i}{end}" for size, ends in ((a, ",|"), (b, ",;"))
                         for end in ends for i in range(size)], dtype=object)

    def encode(self, texts: list[bytes | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of each text by A and by B; none where one doesn't give the bytes back."""
        plain = [(text or b"").decode() for text in texts]
        in_a = [self._byte_level.encode_to_numpy(" " + text).astype(np.int64) if text
                else np.zeros(0, np.int64) for text in plain]
        in_b = self._piece_level.encode(plain, num_threads=1)
        known_a, known_b = self.bytes_of
        for i, text in enumerate(texts):
            whole = b" " + text if text else b""
            if (b"".join(map(known_b.__getitem__, in_b[i])) != whole
                    or b"".join(map(known_a.__getitem__, in_a[i].tolist())) != whole):
                in_a[i], in_b[i] = np.zeros(0, np.int64), []
        return in_a, [np.array(ids, np.int64) for ids in in_b]


def tokenizers(folder: str = TOKENIZERS) -> Tokenizers:
    return Tokenizers(Path(folder, BYTE_RANKS).read_bytes(), Path(folder, PIECES).read_bytes())


# ---- links of documents ---------------------------------------------------------------------


@dataclass
class Links:
    """Of a list of texts: tokens and links by document, links in order of place."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_links: np.ndarray
    document: np.ndarray
    a: np.ndarray
    b: np.ndarray
    groups: list[str]  # SHA-256 of each document's groups


def link(texts: list[bytes | None], use: Tokenizers) -> Links:
    in_a, in_b = use.encode(texts)
    n_a, n_b = (np.fromiter(map(len, ids), np.int64, len(ids)) for ids in (in_a, in_b))
    a, b = (np.concatenate([*ids, np.zeros(0, np.int64)]) for ids in (in_a, in_b))
    # Documents have the same bytes on both sides, so ends in the joined texts compare.
    end_a, end_b = np.cumsum(use.sizes[0][a]), np.cumsum(use.sizes[1][b])
    size = int(end_a[-1]) + 1 if len(a) else 1
    ends = np.zeros((2, size), bool)
    ends[0, end_a], ends[1, end_b] = True, True
    last_a, last_b = ends[1, end_a], ends[0, end_b]
    document = np.repeat(np.arange(len(texts)), n_a)[last_a]
    return Links(n_a, n_b, np.bincount(document, minlength=len(texts)), document,
                 a[last_a], b[last_b], _group_hashes(a, b, last_a, last_b, n_a, n_b, use))


def _group_hashes(a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray,
                  n_a: np.ndarray, n_b: np.ndarray, use: Tokenizers) -> list[str]:
    """Of `a1,a2|b1;a3|b2,b3`; empty without tokens."""
    group_a = np.cumsum(last_a) - last_a
    group_b = np.cumsum(last_b) - last_b
    to_a = np.concatenate(([0], np.cumsum(np.bincount(group_a))))
    to_b = np.concatenate(([0], np.cumsum(np.bincount(group_b))))
    # A group's A tokens come after the B tokens of the groups before it, and so on.
    code = np.empty(len(a) + len(b), np.int64)
    known_a, known_b = map(len, use.bytes_of)
    code[np.arange(len(a)) + to_b[group_a]] = a + last_a * known_a
    code[np.arange(len(b)) + to_a[group_b + 1]] = 2 * known_a + b + last_b * known_b
    shown = use.numerals[code]
    out, begin = [], 0
    for count in (n_a + n_b).tolist():
        text = "".join(shown[begin:begin + count].tolist())
        out.append(hashlib.sha256(text[:-1].encode()).hexdigest() if count else "")
        begin += count
    return out


# ---- blocks ---------------------------------------------------------------------------------


def bitmaps(pair: np.ndarray, member: np.ndarray, documents: int
            ) -> Iterator[tuple[np.ndarray, np.ndarray, bool, pa.Array]]:
    """(pairs, popcounts, dense, bitmaps) of sorted pairs and their documents: short ones as
    lists of 16-bit numbers, then those for which plain bits are shorter."""
    first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else pair
    ones = np.diff(np.append(first, len(pair)))
    width = (documents + 7) // 8
    dense = 2 * ones > width
    listed = np.repeat(~dense, ones)
    offsets = np.concatenate(([0], np.cumsum(2 * ones[~dense]))).astype(np.int32)
    yield pair[first][~dense], ones[~dense], False, pa.Array.from_buffers(
        pa.binary(), len(offsets) - 1,
        [None, pa.py_buffer(offsets), pa.py_buffer(member[listed].astype("<u2"))])
    at = np.flatnonzero(dense)
    for some in np.array_split(at, len(at) * width // (8 << 20) + 1):
        bits = np.zeros((len(some), width * 8), bool)
        for row, i in enumerate(some):
            bits[row, member[first[i]:first[i] + ones[i]]] = True
        packed = np.packbits(bits, axis=1, bitorder="little")
        yield pair[first][some], ones[some], True, pa.array(
            [row.tobytes() for row in packed], pa.binary())


def members(docs: pa.Array, dense: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The documents that bitmaps name, and the row of each."""
    found, rows = [], []
    for row, (bits, plain) in enumerate(zip(docs.to_pylist(), dense.tolist())):
        named = (np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little"))
                 if plain else np.frombuffer(bits, "<u2"))
        found.append(named)
        rows.append(len(named))
    return (np.concatenate([*found, np.zeros(0, np.int64)]).astype(np.int64),
            np.repeat(np.arange(len(rows)), rows))


def _rows(names: tuple[str, ...], columns: list) -> pa.RecordBatch:
    """A batch of the blocks' schema; columns that are not named are null."""
    given = dict(zip(names, columns))
    size = len(columns[0])
    types = {"doc_id": pa.int64(), "block": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(),
             "n_groups": pa.int64(), "n_links": pa.int64(), "groups_sha256": pa.string(),
             "ordinal": pa.int32(), "a": pa.int32(), "b": pa.int32(), "plane": pa.int32(),
             "dense": pa.bool_(), "docs": pa.binary(), "ones": pa.int64()}
    order = [part.split()[0] for part in _BLOCKS.split(", ")]
    return pa.RecordBatch.from_arrays(
        [(value if isinstance(value, pa.Array) else pa.array(value, types[name]))
         if (value := given.get(name)) is not None else pa.nulls(size, types[name])
         for name in order], names=order)


class _Block:
    """What a block's slices add up to."""

    def __init__(self, number: int, use: Tokenizers):
        self.number, self.use = number, use
        self.documents = self.bytes = 0
        self.told: list[pa.RecordBatch] = []
        self.keys: list[np.ndarray] = []
        self.times: list[np.ndarray] = []

    def add(self, ids: pa.Array, texts: list[bytes | None]) -> None:
        links = link(texts, self.use)
        ordinal = np.arange(self.documents, self.documents + len(texts))
        known_b = len(self.use.bytes_of[1])
        keys, times = np.unique(
            (links.a * known_b + links.b) * BLOCK_DOCS + ordinal[links.document],
            return_counts=True)
        self.keys.append(keys)
        self.times.append(times)
        self.told.append(_rows(_DOCUMENT, [
            np.full(len(texts), self.number), ordinal, ids, links.n_a, links.n_b,
            links.n_links, links.n_links, links.groups]))
        self.documents += len(texts)
        self.bytes += sum(len(text or b"") for text in texts)

    def rows(self) -> Iterator[pa.RecordBatch]:
        yield from self.told
        if not self.keys:
            return
        keys, times = np.concatenate(self.keys), np.concatenate(self.times)
        order = np.argsort(keys, kind="stable")
        keys, more = keys[order], times[order] - 1
        known_b = len(self.use.bytes_of[1])
        for plane in range(-1, int(more.max(initial=0)).bit_length()):
            some = keys if plane < 0 else keys[(more >> plane) & 1 == 1]
            for pair, ones, dense, docs in bitmaps(
                    some // BLOCK_DOCS, some % BLOCK_DOCS, self.documents):
                if len(pair):
                    yield _rows(_POSTING, [
                        np.full(len(pair), self.number), pair // known_b, pair % known_b,
                        np.full(len(pair), plane), np.full(len(pair), dense), docs, ones])


def blocks(docs: DataFrame, use: Tokenizers, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents (plane is null) and postings (doc columns are null) of blocks, in one table.

    Plane -1 is the bitmap of the documents that hold a pair; plane k names those in which bit k
    of its further links is set.
    """
    source = docs.select("doc_id", F.spark_partition_id().alias("part"),
                         F.col("text").cast("binary").alias(TEXT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, made = None, 0
        for batch in batches:
            for part in slices(batch):
                for begin in range(0, part.num_rows, BLOCK_DOCS):
                    some = part.slice(begin, BLOCK_DOCS)
                    if block and (block.bytes >= block_bytes
                                  or block.documents + some.num_rows > BLOCK_DOCS):
                        yield from block.rows()
                        block = None
                    if not block:
                        block = _Block((some.column(1)[0].as_py() << 32) + made, use)
                        made += 1
                    block.add(some.column(0).cast(pa.int64()), some.column(2).to_pylist())
        if block:
            yield from block.rows()

    return source.mapInArrow(run, _BLOCKS)


# ---- counts and scores ----------------------------------------------------------------------


def pair_counts(indexed: DataFrame) -> DataFrame:
    """(a, b, n_docs, n_links): popcounts of a pair's bitmaps and planes over all blocks."""
    whole = F.col("plane") < 0
    weight = F.call_function("shiftleft", F.lit(1).cast("long"),
                             F.greatest(F.col("plane"), F.lit(0)))
    return indexed.where("plane is not null").groupBy("a", "b").agg(
        F.sum(F.when(whole, F.col("ones")).otherwise(0)).alias("n_docs"),
        F.sum(F.col("ones") * weight).alias("n_links"))


def aligned_pairs(docs: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """Every pair of ids that is linked: a, b, n_docs, n_links, share (of the links of b) and
    best (no other a has more links with this b)."""
    counts = stored(pair_counts(blocks(docs, tokenizers(folder))), "pair_counts")
    totals = counts.groupBy("b").agg(F.sum("n_links").alias("__all"),
                                     F.max("n_links").alias("__most"))
    return counts.join(totals, "b").select(
        "a", "b", "n_docs", "n_links", (F.col("n_links") / F.col("__all")).alias("share"),
        (F.col("n_links") == F.col("__most")).alias("best"))


def alignment(docs: DataFrame, folder: str = TOKENIZERS,
              block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    indexed = stored(blocks(docs, tokenizers(folder), block_bytes), "pair_bitmaps")
    counts = stored(pair_counts(indexed), "pair_counts")
    most = counts.groupBy("b").agg(F.max("n_links").alias("most"))
    scored = counts.join(most, "b").select(
        F.col("a").alias("s_a"), F.col("b").alias("s_b"), "n_links",
        (F.col("n_links") == F.col("most")).alias("best"))
    postings = indexed.where("plane is not null").select(
        F.col("block").alias("of_block"), "a", "b", "plane", "dense", "docs")
    answers = postings.join(
        scored, (F.col("a") == F.col("s_a")) & (F.col("b") == F.col("s_b"))).select(
        "of_block", F.call_function("shiftleft", F.lit(1).cast("long"),
                                    F.greatest(F.col("plane"), F.lit(0))).alias("weight"),
        "dense", "docs", "n_links", "best")
    documents = indexed.where("plane is null").select(*_DOCUMENT)

    def add_up(told: pa.Table, found: pa.Table) -> pa.Table:
        ordinal = told.column("ordinal").to_numpy()
        total = np.zeros((2, int(ordinal.max(initial=-1)) + 1), np.int64)
        for batch in found.to_batches(max_chunksize=1 << 16):
            dense = batch.column(2).to_numpy(zero_copy_only=False)
            member, row = members(batch.column(3), dense)
            weight = batch.column(1).to_numpy()
            best = batch.column(5).to_numpy(zero_copy_only=False)
            np.add.at(total[0], member, (weight * best)[row])
            np.add.at(total[1], member, (weight * batch.column(4).to_numpy())[row])
        own = told.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
        return (own.append_column("n_best", pa.array(total[0, ordinal]))
                .append_column("count_sum", pa.array(total[1, ordinal]))
                .append_column("groups_sha256", told.column("groups_sha256")))

    return documents.groupBy("block").cogroup(answers.groupBy("of_block")).applyInArrow(
        add_up, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, "
                "count_sum long, groups_sha256 string")


def report(docs: DataFrame) -> DataFrame:
    return alignment(docs.select("doc_id", "text"))
