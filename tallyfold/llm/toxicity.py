"""Toxicity by a factorization machine over hashed terms.

A text is the set of its words, hashed, without the marks around them.  The
machine adds a weight per term and, through short factor vectors, a weight for each
pair of terms, so two words that are harmless alone can tell together.  It is fitted
on a bounded sample of the labelled rows, of which tasks extract and count the
terms; only chosen terms come to the driver.  Scoring reads every whole text in batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import batched, stash
from .textkit import LOWER, pieces, utf8, words

#: Labelled rows that the fit may read, hash buckets of terms, terms with weights of their own, factors of a term.
SAMPLE, BUCKETS, TERMS, FACTORS = 20_000, 1 << 22, 4096, 6
#: Rows of a table of ids that is sent to all executors, at most.
BROADCAST_ROWS = 1_000_000
#: Most frequent terms that have weights in any case.
FREQUENT = 256
#: Score from which a text is predicted toxic.
THRESHOLD = 0.3
#: Rows whose crc32 of the id has this remainder by 4 are held out from the fit.
HELD_OUT = 2

_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256), 39]] = True


def _terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct term buckets of each text, and where each text's begin. Marks count as blanks, so a word is found whatever surrounds it."""
    data, starts = utf8(texts)
    bare = np.where(_LETTER[data], LOWER[data], np.uint8(32))
    hashes, first = words(bare, starts)
    owner = np.repeat(np.arange(len(texts)), np.diff(first))
    both = np.unique(owner.astype(np.uint64) * np.uint64(BUCKETS) + hashes % np.uint64(BUCKETS))
    owner = (both // np.uint64(BUCKETS)).astype(np.int64)
    return (both % np.uint64(BUCKETS)).astype(np.int64), np.searchsorted(owner, np.arange(len(texts) + 1))


@dataclass
class Machine:
    """A fitted machine: the sorted buckets of its terms, and their weights."""

    terms: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def margins(self, buckets: np.ndarray, first: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.terms, buckets)
        at = np.minimum(at, max(len(self.terms) - 1, 0))
        known = self.terms[at] == buckets if len(self.terms) else np.zeros(len(buckets), bool)
        owner = np.repeat(np.arange(len(first) - 1), np.diff(first))[known]
        at = at[known]
        n = len(first) - 1
        total = self.bias + np.bincount(owner, self.weights[at], n)
        for f in range(self.factors.shape[1]):
            v = self.factors[at, f]
            total += 0.5 * (np.bincount(owner, v, n) ** 2 - np.bincount(owner, v * v, n))
        return total

    def scores(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(*_terms(texts)), -30, 30)))


class _Sums:
    """Sums of rows ``values[item]`` for each key of entries (key, item), which stand by key."""

    def __init__(self, key: np.ndarray, item: np.ndarray, keys: int) -> None:
        self.item = item.astype(np.int32)
        self.there, self.first = np.unique(key, return_index=True)
        self.keys = keys

    def of(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros((self.keys, values.shape[1]))
        # A column at a time: short arrays that stay near.
        for k in range(values.shape[1]):
            out[self.there, k] = np.add.reduceat(values[:, k].astype(np.float32)[self.item], self.first, dtype=np.float64) if len(self.item) else 0.0
        return out


def fit(owner: np.ndarray, column: np.ndarray, names: np.ndarray, toxic: np.ndarray, rounds: int = 150, rate: float = 0.05, decay: float = 2e-3, seed: int = 11) -> Machine:
    """Fits by full-batch Adam on the logistic loss: row ``owner[i]`` has the term ``names[column[i]]``, names are sorted."""
    n, m = len(toxic), len(names)
    share = float(np.clip(toxic.mean() if n else 0.0, 1e-4, 1 - 1e-4))
    bias = float(np.log(share / (1 - share)))
    if n == 0 or m == 0 or toxic.min() == toxic.max():
        return Machine(np.zeros(0, np.int64), bias, np.zeros(0), np.zeros((0, FACTORS)))
    rng = np.random.default_rng(seed)
    w, v = np.zeros(m), rng.normal(0, 0.05, (m, FACTORS))
    b = bias
    flat = [np.zeros(m), np.zeros(m), np.zeros((m, FACTORS)), np.zeros((m, FACTORS)), 0.0, 0.0]
    # The same entries by row and by term, so that all sums are over neighbours.
    order = np.argsort(owner, kind="stable")
    by_row = _Sums(owner[order], column[order], n)
    order = np.argsort(column, kind="stable")
    by_term = _Sums(column[order], owner[order], m)
    for step in range(1, rounds + 1):
        sums = by_row.of(v)
        margin = b + by_row.of((w - 0.5 * (v * v).sum(axis=1))[:, None])[:, 0] + 0.5 * (sums * sums).sum(axis=1)
        error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - toxic) / n
        # A pair's gradient for a term is the row's other factors: all of them less its own.
        both = by_term.of(np.concatenate([error[:, None], error[:, None] * sums], axis=1))
        gw = both[:, 0] + decay / n * w * 100
        gv = both[:, 1:] - both[:, :1] * v + decay / n * v * 2000
        gb = float(error.sum())
        for k, g in ((0, gw), (2, gv)):
            flat[k] = 0.9 * flat[k] + 0.1 * g
            flat[k + 1] = 0.999 * flat[k + 1] + 0.001 * g * g
        flat[4], flat[5] = 0.9 * flat[4] + 0.1 * gb, 0.999 * flat[5] + 0.001 * gb * gb
        move = [flat[k] / (1 - 0.9**step) / (np.sqrt(flat[k + 1] / (1 - 0.999**step)) + 1e-8) for k in (0, 2, 4)]
        w, v, b = w - rate * move[0], v - rate * move[1], b - rate * move[2]
    return Machine(names, float(b), w, v)


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """Fits on labelled rows that are not held out: all of them, or about ``sample`` chosen by a hash of the id.

    An id with several labels is toxic if one says so.  The terms are those whose
    presence tells most of the label in the sample, by chi-square with two rows of
    smoothing, and the most frequent ones: one that tells nothing alone may tell with another.
    """
    batched(docs.sparkSession)
    known = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(F.col("toxic").cast("double")).alias("toxic"))
    known = stash(known, "labels")
    share = min(1.0, sample / max(1, known.count()))
    known = stash(known.where(F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1 << 40)) < F.lit(share * float(1 << 40))), "sample")
    # About ``sample`` rows, which meet the texts where those are; many more of them only for a caller's larger sample.
    known = F.broadcast(known) if known.count() <= BROADCAST_ROWS else known

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                buckets, first = _terms(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("toxic"), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(buckets))], ["doc_id", "toxic", "terms"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(known, "doc_id").mapInArrow(run, "doc_id long, toxic double, terms array<bigint>")
    rows = stash(rows, "terms")
    n, hits = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0.0))).first()
    part = hits / max(n, 1)
    counts = rows.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("seen"), F.sum("toxic").alias("hits"))
    expected = F.col("seen") * part
    tells = F.pow(F.col("hits") - expected, 2) / (expected * (1 - part) * (1 - F.col("seen") / (n + 1.0)) + 1.0)
    counts = stash(counts.withColumn("tells", tells), "counts")
    telling = counts.where("seen >= 3 and tells > 6").orderBy(F.desc("tells"), "term").limit(TERMS)
    chosen = telling.select("term").unionByName(counts.orderBy(F.desc("seen"), "term").limit(FREQUENT).select("term"))
    names = np.unique([r[0] for r in chosen.collect()]).astype(np.int64)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("terms")
            buckets, long = column.flatten().to_numpy(), column.value_lengths().to_numpy()
            at = np.minimum(np.searchsorted(names, buckets), max(len(names) - 1, 0))
            known = names[at] == buckets if len(names) else np.zeros(len(buckets), bool)
            ends = np.concatenate([[0], np.cumsum(np.bincount(np.repeat(np.arange(len(long)), long)[known], minlength=len(long)))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(at[known].astype(np.int32)))], ["doc_id", "toxic", "at"])

    few = rows.mapInArrow(keep, "doc_id long, toxic double, at array<int>").toPandas()
    # Rows with one id stand by their terms, so that sums are in one order.
    few = few.assign(order=[tuple(x) for x in few["at"]]).sort_values(["doc_id", "order"], kind="stable")
    lists = few["at"].tolist()
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    column = np.concatenate([np.zeros(0, np.int64), *lists]).astype(np.int64)
    return fit(owner, column, names, few["toxic"].to_numpy(float))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of ``docs`` (doc_id, text; other columns are ignored).

    A null or empty text gets the score of a text without known terms; very long texts are read whole.  Repeated
    rows are each scored; a null doc_id is not held out.
    """
    batched(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(machine.scores(part.column("text")), pa.float64())], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
