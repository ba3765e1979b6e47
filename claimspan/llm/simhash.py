"""SimHash near-duplicates, found with vantage-point trees over 64-bit fingerprints.

1. Fingerprints: a bit is set if it is set in over half of a text's shingle hashes.
2. A vantage-point tree is fitted on a bounded sample (SAMPLE fingerprints); it deals all
   fingerprints to shards by their Hamming distances to its vantage points. Of two linked
   fingerprints on either side of a boundary, the triangle bound says that the inner one is
   within the link distance of the boundary; such inner fingerprints go to both sides. So
   every linked pair meets in at least one shard, wherever the tree splits.
3. Each shard goes on splitting its own fingerprints in the same way, down to small leaves,
   which compare all their pairs in blocks of bits. It emits a spanning forest of its links,
   at most one edge for each fingerprint, so a large group of near copies stays linear.
4. The edges' connected components give each fingerprint, then each document, its group.

Copies share one fingerprint and meet nothing but a group-by. Only the sample reaches the
driver; documents, fingerprints, links and components never do.

Defined results: a null or wordless text has fingerprint zero, linked like any other. With
fewer words than a shingle has, the whole word sequence is the one shingle. Ties (a bit set
in exactly half) are 0. Repeated rows stay, in one group. Rows with a null doc_id get a
fingerprint; a group of them alone has a null component. Extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimspan.llm.common import stored, with_columns

SHINGLE = 3
DISTANCE = 2
SEED = 42
#: Fingerprints that the routing tree is fitted on (about so many, picked by hash), and how
#: many of them a shard should get.
SAMPLE = 32_768
SAMPLE_PER_SHARD = 64
#: Leaves inside a shard are compared pair by pair.
LEAF = 1_024


# ---- fingerprints -------------------------------------------------------------------------


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    tokens = text.lower().split() if text else []
    if not tokens:
        return 0
    line, count = b" ".join(tokens), max(1, len(tokens) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    begins = np.concatenate(([0], ends[:count - 1])).tolist()
    stops = (ends[min(shingle, len(tokens)) - 1:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], SEED) for a, b in zip(begins, stops)], np.uint64)
    ones = np.zeros(64, np.int64)
    for part in range(0, count, 65_536):
        piece = hashes[part:part + 65_536]
        ones += np.unpackbits(piece.view(np.uint8).reshape(-1, 8), axis=1,
                              bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > count, bitorder="little")
    return int(bits.view(np.int64)[0])


def with_fingerprint(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """docs and the column simhash, a signed 64-bit number."""
    return with_columns(
        docs, "text", [T.StructField("simhash", T.LongType(), False)],
        lambda texts: [pa.array([fingerprint(t, shingle) for t in texts], pa.int64())])


# ---- vantage-point tree -------------------------------------------------------------------


@dataclass
class Node:
    vantage: np.uint64
    radius: int
    inner: "Node | int"
    outer: "Node | int"


def _distances(points: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ vantage)


def _split(points: np.ndarray, link: int, rng: np.random.Generator):
    """The vantage point and radius that halve the points with the least overlap.

    None if every try leaves one side with all points.
    """
    best = None
    for vantage in points[rng.integers(0, len(points), 8)]:
        counts = np.bincount(_distances(points, vantage), minlength=65)
        inside = np.cumsum(counts)
        for radius in np.flatnonzero((inside >= len(points) // 4)
                                     & (inside <= len(points) - len(points) // 4)):
            overlap = inside[radius] - (inside[radius - link] if radius >= link else 0)
            larger = max(inside[radius], len(points) - inside[radius] + overlap)
            if larger < len(points) and (best is None or larger + overlap < best[0]):
                best = (larger + overlap, vantage, int(radius))
    return best and best[1:]


def fit_tree(sample: np.ndarray, link: int, per_shard: int = SAMPLE_PER_SHARD) -> Node | int:
    """A routing tree; its leaves are numbered shards."""
    rng, shards = np.random.default_rng(0), iter(range(1 << 30))

    def grow(points: np.ndarray) -> Node | int:
        cut = _split(points, link, rng) if len(points) > per_shard else None
        if cut is None:
            return next(shards)
        near = _distances(points, cut[0]) <= cut[1]
        return Node(*cut, grow(points[near]), grow(points[~near]))

    return grow(np.unique(sample))


def route(tree: Node | int, points: np.ndarray, link: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, its points) such that each pair within the link distance shares a shard."""
    todo = [(tree, points)]
    while todo:
        node, held = todo.pop()
        if not len(held):
            continue
        if isinstance(node, int):
            yield node, held
            continue
        far = _distances(held, node.vantage)
        todo.append((node.inner, held[far <= node.radius]))
        todo.append((node.outer, held[far > node.radius - link]))


def _groups(points: np.ndarray, link: int) -> Iterator[np.ndarray]:
    """Positions of the points of each group of two or more, by breadth-first search."""
    linked = []
    for begin in range(0, len(points), 512):
        close = np.bitwise_count(points[begin:begin + 512, None] ^ points[None, :]) <= link
        linked.append(begin + np.flatnonzero(close.sum(axis=1) > 1))
    left = np.concatenate(linked)
    while len(left):
        group, edge, left = [left[:1]], left[:1], left[1:]
        while len(edge):
            reached = np.zeros(len(left), bool)
            for begin in range(0, len(edge), 64):
                some = points[edge[begin:begin + 64]]
                reached |= (np.bitwise_count(points[left][:, None] ^ some[None, :])
                            <= link).any(axis=1)
            edge, left = left[reached], left[~reached]
            group.append(edge)
        yield np.concatenate(group)


def forest(points: np.ndarray, link: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (point, its group's least point) of the links among distinct points."""
    points = np.unique(points)
    parent = np.arange(len(points))
    rng = np.random.default_rng(0)

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(members: np.ndarray) -> None:
        least = min(top(i) for i in members.tolist())
        for i in members.tolist():
            parent[top(i)] = least

    todo = [np.arange(len(points))]
    while todo:
        held = todo.pop()
        cut = _split(points[held], link, rng) if len(held) > LEAF else None
        if cut is not None:
            far = _distances(points[held], cut[0])
            todo += [held[far <= cut[1]], held[far > cut[1] - link]]
            continue
        for members in _groups(points[held], link):
            join(held[members])
    roots = np.array([top(i) for i in range(len(points))], np.int64)
    linked = np.flatnonzero(roots != np.arange(len(points)))
    return points[linked], points[roots[linked]]


def links(prints: DataFrame, link: int = DISTANCE, sample: int = SAMPLE,
          per_shard: int = SAMPLE_PER_SHARD) -> DataFrame:
    """Edges (a, b) that connect all pairs of `simhash` within the link distance."""
    share = min(1.0, sample / max(1, prints.count()))
    picked = prints.where(F.pmod(F.xxhash64("simhash"), F.lit(1 << 40))
                          < int(share * (1 << 40))).select("simhash").toPandas()
    tree = fit_tree(picked["simhash"].to_numpy(np.int64).view(np.uint64), link, per_shard)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(0).to_numpy().view(np.uint64)
            for shard, points in route(tree, held, link):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(points), shard, np.int32)),
                     pa.array(points.view(np.int64))], names=["shard", "simhash"])

    def connect(group: pd.DataFrame) -> pd.DataFrame:
        a, b = forest(group["simhash"].to_numpy(np.int64).view(np.uint64), link)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    dealt = prints.select("simhash").mapInArrow(deal, "shard int, simhash long")
    return dealt.groupBy("shard").applyInPandas(connect, "a long, b long").distinct()


def components(edges: DataFrame, name: str = "edges") -> DataFrame:
    """(node, root) for each node of the edges (a, b): the least node it is connected to.

    Every round points each node's neighbours, and the node, to the least of them, first for
    the greater neighbours, then for the smaller ones; after a number of rounds that grows
    with the logarithm of the path lengths, only stars are left. Each round is stored.
    """
    now, before = stored(edges.select("a", "b").distinct(), name), None
    while True:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(
            "a", F.least("a", "m").alias("m"))
        large = (both.join(least, "a").where(F.col("b") > F.col("a"))
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(down, "a").select(
            F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")),
                              F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))
            .alias("e")).select("e.a", "e.b").where(F.col("a") != F.col("b")).distinct())
        now = stored(small, name)
        # A star forest is what a round leaves as it is.
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


# ---- the operator -------------------------------------------------------------------------


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, link: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (least doc_id of the group)."""
    printed = stored(with_fingerprint(docs.select("doc_id", "text"), shingle)
                     .select("doc_id", "simhash"), "simhash")
    prints = printed.groupBy("simhash").agg(F.min("doc_id").alias("first"))
    groups = components(links(prints, link), "simhash_edges")
    rooted = prints.join(groups, F.col("simhash") == F.col("node"), "left").select(
        "simhash", "first", F.coalesce("root", "simhash").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("simhash", "component_id")
    return printed.join(named, "simhash").select(
        "doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"),
        "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with the one of least doc_id of each group; of several rows with that doc_id one
    stays. Documents without an id are in no group's choice: all stay.
    """
    groups = near_duplicates(docs)
    keep = groups.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    kept = docs.join(keep, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.unionByName(docs.where(F.col("doc_id").isNull())).select(*docs.columns)
