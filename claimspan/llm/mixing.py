"""Mixing to target weights with soft membership of domains.

1. A classifier of the labelled table's domains: words by hash bucket (the FEATURES buckets
   that tell most of the domain) and a few measures of a text's shape, in a multinomial
   logistic regression. It is fitted on at most TRAIN_DOCS labelled documents, picked by hash.
2. It gives every document posteriors p over the domains. With n tokens and rate r, a
   document is expected to bring r * n * p[k] tokens of domain k.
3. Rates minimise the sum over k of (expected tokens of k - target of k)^2, subject to r >= 0,
   by accelerated projected gradient steps from r = 1, in a fixed metric: a document's step is
   divided by the p-weighted tokens of its domains, which bounds the curvature, so that small
   domains move as fast as large ones. A document's steps depend on its posteriors and on one
   residual for each domain and step; so a step is one aggregation over all documents, and only
   the residuals travel. The first steps are taken on a summary of all documents, at most CELLS
   cells of like posteriors with their tokens; the further ones on the documents. They end when
   the sum of squares is proven to be within GAP of the least, in shares of all tokens, by
   convexity: it can fall no more than the slope times the way to the target. After MAX_STEPS
   steps on the documents a warning says how close it is, and `converged` is false: so it is
   with targets far out of reach, whose least squares pile all tokens on a few documents.
4. Rates above one repeat a document, rates below one keep some: copies = floor(rate + u),
   with u by hash of the document, so that the expected number of copies is the rate.

Defined results: null, empty and wordless texts have no tokens; their rate is that of their
posteriors and moves no total. Labels that are null or contradict each other don't train.
Without labels all posteriors are equal. A target for a domain that no document can belong to
stays unmet. Repeated rows get equal results; of rows that share a doc_id, the one with the least hash of
its text trains. Extra columns pass through; ones named like a
result are replaced.
"""

from __future__ import annotations

import itertools
import math
import warnings
import zlib
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimspan.llm.common import stored, with_columns

TRAIN_DOCS = 20_000
BUCKETS = 1 << 16
FEATURES = 256
CELLS = 4096
SUMMARY_STEPS = 300
MAX_STEPS = 40
GAP = 5e-5
#: Share of the tokens by domain.
TARGET = {"clean": 0.9, "low": 0.1, "toxic": 0.0}

SHAPES = 6
RESULT = [T.StructField("n_tokens", T.LongType(), False),
          T.StructField("posteriors", T.ArrayType(T.DoubleType(), False), False)]


def label_domain() -> Column:
    """The domain that a row of `labels` names; null if it names none."""
    return (F.when(F.col("toxic") == 1, "toxic").when(F.col("toxic") == 0, F.when(
        F.col("quality") == 1, "clean").when(F.col("quality") == 0, "low")))


# ---- features -------------------------------------------------------------------------------


def tokens(text: bytes | None) -> list[bytes]:
    return text.split() if text else []


def bucket(word: bytes) -> int:
    return zlib.crc32(word.lower().strip(b".,;:!?\"'()")) % BUCKETS


_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_OTHER = np.zeros(256, bool)
_OTHER[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,"]] = True


def shape(text: bytes | None, words: list[bytes]) -> list[float]:
    """Capitals, digits and signs per byte, word length, repeated words, number of words."""
    if not words:
        return [0.0] * SHAPES
    chars = np.frombuffer(text, np.uint8)
    return [float(_UPPER[chars].mean()), float(_DIGIT[chars].mean()),
            float(_OTHER[chars].mean()), len(text) / len(words) / 10,
            1 - len(set(words)) / len(words), np.log1p(len(words)) / 10]


def matrix(texts: list[bytes | None], wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token counts, and a row of features for each text: has bucket, shape, one."""
    place = np.full(BUCKETS, -1, np.int64)
    place[wanted] = np.arange(len(wanted))
    words = [tokens(text) for text in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    column: dict[bytes, int] = {}
    flat = np.empty(int(counts.sum()), np.int64)
    for i, word in enumerate(itertools.chain.from_iterable(words)):
        at = column.get(word)
        if at is None:
            at = column[word] = place[bucket(word)]
        flat[i] = at
    rows = np.repeat(np.arange(len(words)), counts)
    out = np.zeros((len(texts), len(wanted) + SHAPES + 1))
    out[rows[flat >= 0], flat[flat >= 0]] = 1
    for i, (text, found) in enumerate(zip(texts, words)):
        out[i, len(wanted):-1] = shape(text, found)
    out[:, -1] = 1
    return counts, out


# ---- classifier -----------------------------------------------------------------------------


@dataclass
class Classifier:
    domains: list[str]
    wanted: np.ndarray
    weights: np.ndarray  # features by domains

    def posteriors(self, features: np.ndarray) -> np.ndarray:
        score = features @ self.weights
        score = np.exp(score - score.max(axis=1, keepdims=True))
        return score / score.sum(axis=1, keepdims=True)


def training_rows(docs: DataFrame, labels: DataFrame, domain: Column,
                  limit: int = TRAIN_DOCS) -> DataFrame:
    """text and domain of a bounded sample of labelled documents."""
    named = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.min(domain).alias("domain"), F.max(domain).alias("other")).where(
        "domain = other").select("doc_id", "domain")
    ids = named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    return rows.groupBy("doc_id", "domain").agg(
        F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select(
        F.col("text").cast("binary").alias("text"), "domain")


def fit(rows: DataFrame, domains: list[str], features: int = FEATURES) -> Classifier:
    number = {name: k for k, name in enumerate(domains)}
    rows = stored(rows.where(F.col("domain").isin(domains)), "mixing_training")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = np.zeros((len(domains), BUCKETS + 1), np.int64)
            for text, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held[number[name], list({bucket(w) for w in set(tokens(text))})] += 1
                held[number[name], BUCKETS] += 1
            at = np.nonzero(held)
            yield pa.RecordBatch.from_arrays(
                [pa.array(at[0]), pa.array(at[1]), pa.array(held[at])],
                names=["domain", "bucket", "n"])

    counted = rows.mapInArrow(count, "domain long, bucket long, n long").groupBy(
        "domain", "bucket").agg(F.sum("n").alias("n")).toPandas()  # BUCKETS per domain at most
    seen = np.zeros((len(domains), BUCKETS + 1))
    seen[counted["domain"], counted["bucket"]] = counted["n"]
    total = seen[:, BUCKETS:]
    if not total.any():
        return Classifier(domains, np.arange(0), np.zeros((SHAPES + 1, len(domains))))
    told = _information(seen[:, :BUCKETS], total)
    wanted = np.sort(np.argsort(-told, kind="stable")[:features])

    def row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = matrix(batch.column(0).to_pylist(), wanted)[1].astype(np.float32)
            yield pa.RecordBatch.from_arrays(
                [pa.array([v.tobytes() for v in values], pa.binary()),
                 pa.array([number[n] for n in batch.column(1).to_pylist()], pa.int32())],
                names=["x", "y"])

    held = rows.mapInArrow(row, "x binary, y int").toPandas()
    x = np.stack([np.frombuffer(b, np.float32) for b in held["x"]]).astype(np.float64)
    return Classifier(domains, wanted, _regress(x, held["y"].to_numpy(), len(domains)))


def _information(seen: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Mutual information of each bucket's presence with the domain."""
    every = total.sum()
    out = np.zeros(seen.shape[1])
    for part in (seen, total - seen):
        joint, expected = part / every, (part.sum(axis=0) / every) * (total / every)
        with np.errstate(divide="ignore", invalid="ignore"):
            out += np.nan_to_num(joint * np.log(joint / expected)).sum(axis=0)
    return out


def _regress(x: np.ndarray, y: np.ndarray, classes: int, steps: int = 300) -> np.ndarray:
    """Multinomial logistic regression, lightly regularised, by accelerated gradient steps."""
    hot = np.eye(classes)[y]
    size = len(x)
    bound = 0.5 * np.linalg.eigvalsh(x.T @ x / size)[-1] + 1e-4
    now = ahead = np.zeros((x.shape[1], classes))
    for step in range(steps):
        score = x @ ahead
        score = np.exp(score - score.max(axis=1, keepdims=True))
        gap = score / score.sum(axis=1, keepdims=True) - hot
        then = ahead - (x.T @ gap / size + 1e-4 * ahead) / bound
        ahead, now = then + step / (step + 3) * (then - now), then
    return now


# ---- rates ----------------------------------------------------------------------------------


def score(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """docs with n_tokens and posteriors."""
    def work(texts: list[bytes | None]) -> list[pa.Array]:
        counts, x = matrix(texts, classifier.wanted)
        p = classifier.posteriors(x)
        offsets = np.arange(len(texts) + 1, dtype=np.int32) * p.shape[1]
        return [pa.array(counts), pa.ListArray.from_arrays(offsets, pa.array(p.ravel()))]

    return with_columns(docs, "text", RESULT, work)


@dataclass
class Steps:
    """What leads from r = 1 to the fitted rates: of each step its momentum and residuals."""

    mass: np.ndarray  # tokens by domain at r = 1
    taken: list[tuple[float, np.ndarray]]
    gap: float = 0.0  # what the sum of squares is proven to be from the least, in shares

    def walk(self, p: np.ndarray, momentum: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """Rates after all steps, and the point from which the next one starts."""
        rate = before = np.ones(len(p))
        scale = np.maximum(p @ self.mass, 1e-300)
        for step, residual in self.taken:
            start = rate + step * (rate - before)
            before, rate = rate, np.maximum(0.0, start - (p @ residual) / scale)
        return rate, rate + momentum * (rate - before)

    def totals(self, p: np.ndarray, n: np.ndarray, momentum: float) -> np.ndarray:
        """Expected tokens by domain where the next step starts, and the least slope, by
        posteriors, of the last step's residuals."""
        if not len(p):
            return np.append(np.zeros(len(self.mass)), np.inf)
        slope = (p @ self.taken[-1][1]).min() if self.taken else np.inf
        return np.append((self.walk(p, momentum)[1] * n) @ p, slope)


def descend(totals: Callable[[Steps, float], np.ndarray], wanted: np.ndarray, steps: Steps,
            limit: int, gap: float) -> None:
    """Takes up to `limit` more steps, or until they are within the gap of the least."""
    every, best, since, momentum = steps.mass.sum(), np.inf, 0, 0.0
    now = totals(steps, momentum)[:-1]
    for _ in range(limit):
        residual = now - wanted
        if residual @ residual > best:  # momentum overshot: forget it
            since = 0
        best = residual @ residual
        steps.taken.append((momentum, residual))
        since, slope = since + 1, residual @ now
        # The tokens of the best rates are no more than this.
        most = every + math.sqrt(len(wanted) * best)
        momentum = (since - 1) / (since + 2)
        *now, least = totals(steps, momentum)
        now = np.array(now)
        steps.gap = 2 * max(0.0, slope - most * min(0.0, least)) / every ** 2
        if steps.gap <= gap:
            return


def _posteriors(column: pa.Array, domains: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, domains)


def summary(scored: DataFrame, domains: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean posteriors and tokens of cells of like posteriors, CELLS at most."""
    grid = max(1, int(CELLS ** (1 / max(1, domains - 1))) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, n = _posteriors(batch.column(1), domains), batch.column(0).to_numpy()
            key = np.zeros(len(p), np.int64)
            for k in range(domains - 1):
                key = key * (grid + 1) + np.floor(p[:, k] * grid).astype(np.int64)
            keys, cell = np.unique(key, return_inverse=True)
            parts = np.stack([np.bincount(cell, n * p[:, k], len(keys)) for k in range(domains)],
                             axis=1) if len(p) else np.zeros((0, domains))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(keys, domains)), pa.array(np.tile(np.arange(domains),
                                                                      len(keys))),
                 pa.array(parts.ravel())], names=["cell", "k", "tokens"])

    rows = scored.select("n_tokens", "posteriors").mapInArrow(
        run, "cell long, k long, tokens double").groupBy("cell", "k").agg(
        F.sum("tokens").alias("tokens")).orderBy("cell", "k").toArrow()
    tokens = rows.column("tokens").to_numpy().reshape(-1, domains)
    n = tokens.sum(axis=1)
    return tokens[n > 0] / n[n > 0, None], n[n > 0]


def fit_rates(scored: DataFrame, target: np.ndarray, max_steps: int = MAX_STEPS,
              gap: float = GAP) -> Steps:
    """The steps that lead to the rates. scored has n_tokens and posteriors."""
    domains = len(target)

    def totals(steps: Steps, momentum: float) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [steps.totals(_posteriors(batch.column(1), domains),
                                 batch.column(0).to_numpy(), momentum) for batch in batches]
            held = np.stack(held or [np.append(np.zeros(domains), np.inf)])
            yield pa.RecordBatch.from_arrays(
                [pa.array([x]) for x in (*held[:, :-1].sum(axis=0), held[:, -1].min())],
                names=[*(f"k{k}" for k in range(domains)), "least"])

        names = [f"k{k}" for k in range(domains)]
        row = scored.select("n_tokens", "posteriors").mapInArrow(
            run, ", ".join(f"{name} double" for name in [*names, "least"])).agg(
            *(F.sum(name) for name in names), F.min("least")).first()
        return np.array([0.0 if x is None else x for x in row])

    p, n = summary(scored, domains)
    if not len(p):
        return Steps(np.zeros(domains), [])
    steps = Steps(n @ p, [])
    wanted = target * steps.mass.sum()
    descend(lambda steps, momentum: steps.totals(p, n, momentum), wanted, steps, SUMMARY_STEPS,
            gap / 10)
    descend(totals, wanted, steps, max_steps, gap)
    if steps.gap > gap:
        warnings.warn(f"the sum of squares may be {steps.gap:.2g} over the least after "
                      f"{max_steps} steps", stacklevel=2)
    return steps


def mixed(docs: DataFrame, labels: DataFrame, target: Mapping[str, float] = TARGET,
          domain: Column | None = None, keep_text: bool = True) -> DataFrame:
    """docs with n_tokens, posteriors (domains in the target's order), rate, copies and converged.

    Documents are scored once: what is answered is read from the table that rates are fitted on.
    """
    if min(target.values()) < 0 or abs(sum(target.values()) - 1) > 1e-9:
        raise ValueError("target weights must be shares that add up to one")
    names = list(target)
    domain = label_domain() if domain is None else domain
    classifier = fit(training_rows(docs, labels, domain), names)
    u = F.pmod(F.xxhash64("doc_id", "text", F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)
    plain = docs.drop("rate", "copies", "converged").withColumn("__u", u)
    scored = score(plain, classifier)
    scored = stored(scored if keep_text else scored.drop("text"), "mixing_posteriors")
    steps = fit_rates(scored, np.array([target[name] for name in names]))

    @F.pandas_udf("double")
    def rate(posteriors: pd.Series) -> pd.Series:
        return pd.Series(steps.walk(np.stack(posteriors) if len(posteriors) else
                                    np.zeros((0, len(names))))[0])

    # Else a filter on copies asks for it again, and each executor keeps workers for both.
    out = scored.withColumn("rate", rate.asNondeterministic()("posteriors"))
    return out.withColumn("copies", F.floor(F.col("rate") + F.col("__u")).cast("long")).withColumn(
        "converged", F.lit(steps.gap <= GAP)).drop("__u")


def sampled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs of the mixture, with rate and copies (one or more)."""
    out = mixed(docs, labels).where("copies > 0")
    return out.select(*[c for c in docs.columns if c not in ("rate", "copies")],
                      "rate", "copies")
