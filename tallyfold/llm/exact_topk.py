"""Exact top-k by inner product with block-at-a-time pruning.

Vectors become whole numbers.  Candidates are renumbered so that like ones stand
together (by the nearest of a few sampled pivots, then by id), and ranges of that
order are blocks of 64; a block keeps its vectors (its forward index) and each
component's greatest and least value, groups of blocks and regions of groups keep
the same.  A query's bound on a range is the sum of what each component can give at most.

Every query first visits the region with its highest bound, which gives it a k-th
score; after that only those pairs of a query and a region whose bound reaches
that score meet.  Inside a group a query visits the blocks in order of their bounds
and stops when the next is below its k-th score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import batched, stash

#: Scale of the components, results per query, and which ids are queries.
SCALE, TOP, EVERY = 256, 5, 50
#: Vectors to a block, to a candidate group, and queries to a chunk.
BLOCK, GROUP, CHUNK = 64, 4096, 2048
#: Vectors sampled as pivots, and regions of candidate groups at most: their bounds (16 bytes a component) go to every task that asks.
PIVOTS, REGIONS = 256, 4096


def whole_numbers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v array<long>): floor(scale * component) of the vectors that take part."""
    fine = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of numbers as rows, padded with 0."""
    lengths = column.value_lengths().fill_null(0).to_numpy()
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = column.flatten().to_numpy()
    return out


def _exact(*parts: np.ndarray) -> type:
    """A kind of number in which inner products of these rows are exact: floating point below 2**53, else whole numbers."""
    most = parts[0].shape[1] * float(np.abs(parts[0]).max(initial=0)) * max(float(np.abs(p).max(initial=0)) for p in parts[1:])
    return np.float64 if most < 2**53 else np.int64


def _near(rows: DataFrame, pivots: np.ndarray, width: int) -> DataFrame:
    """``rows`` (vec_id, v) with the number of the nearest pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pivots.astype(float)
        for batch in batches:
            v = _matrix(batch.column(1), width).astype(float)
            near = np.argmax(v @ p.T - 0.5 * (p * p).sum(axis=1), axis=1) if len(v) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near, pa.int32())], ["vec_id", "v", "near"])

    return rows.select("vec_id", "v").mapInArrow(run, "vec_id long, v array<bigint>, near int")


def _pack(rows: DataFrame, key: str, size: int, width: int) -> DataFrame:
    """Runs of up to ``size`` vectors of a partition with one key, each as one row of bytes, with each component's greatest and least value."""
    more = "least" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        at, many = None, 0

        def flush() -> pa.RecordBatch:
            ids, data, least = (np.concatenate(x) for x in zip(*held))
            columns = [[at], [len(ids)], [ids.tobytes()], [data.tobytes()], [least.tobytes()], [data.max(axis=0).tolist()], [data.min(axis=0).tolist()]]
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["key", "size", "ids", "data", "least", "high", "low"])

        for batch in batches:
            keys, ids, data = batch.column("key").to_numpy(), batch.column("vec_id").to_numpy(), _matrix(batch.column("v"), width)
            least = batch.column("least").to_numpy() if more else np.zeros(len(ids), np.int64)
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                while a < b:
                    if many and (keys[a] != at or many == size):
                        yield flush()
                        held, many = [], 0
                    at, end = int(keys[a]), min(b, a + size - many)
                    held.append((ids[a:end], data[a:end], least[a:end]))
                    many, a = many + end - a, end
        if many:
            yield flush()

    rows = rows.withColumn("key", F.col(key).cast("long")).select("key", "vec_id", "v", *(["least"] if more else []))
    return rows.mapInArrow(run, "key long, size int, ids binary, data binary, least binary, high array<bigint>, low array<bigint>")


def _bounds(q: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T


def _search(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, top: int, block: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The ``top`` best (ids, scores) of each query among the candidates, a mask of those there are, and how many blocks were scored.

    What is below a query's ``least`` may be left out.
    """
    kind = _exact(q, c)
    q, c = q.astype(kind), c.astype(kind)
    cuts = list(range(0, len(c), block))
    bounds = _bounds(q, np.array([c[i : i + block].max(axis=0) for i in cuts]), np.array([c[i : i + block].min(axis=0) for i in cuts]))
    order = np.argsort(-bounds, axis=1, kind="stable")
    floor = -np.inf if kind is np.float64 else np.iinfo(np.int64).min
    best = np.full((len(q), top), floor, dtype=kind)
    best_ids = np.full((len(q), top), np.iinfo(np.int64).max, dtype=np.int64)
    least = np.full(len(q), floor, dtype=kind) if least is None else least
    scored = 0
    active = np.arange(len(q))
    for turn in range(len(cuts)):
        at = order[active, turn]
        # Equal scores go to smaller ids, so a block whose bound equals the k-th score still counts.
        go = bounds[active, at] >= np.maximum(best[active, top - 1], least[active])
        active, at = active[go], at[go]
        if not len(active):
            break
        for b in np.unique(at).tolist():
            rows = active[at == b]
            ids = c_ids[cuts[b] : cuts[b] + block]
            score = q[rows] @ c[cuts[b] : cuts[b] + block].T
            own = q_ids[rows][:, None] == ids[None, :]
            score = np.where(own, floor, score)
            names = np.where(own, np.iinfo(np.int64).max, np.broadcast_to(ids, score.shape))
            score = np.concatenate([best[rows], score], axis=1)
            names = np.concatenate([best_ids[rows], names], axis=1)
            first = np.lexsort((names, -score), axis=1)[:, :top]
            best[rows] = np.take_along_axis(score, first, 1)
            best_ids[rows] = np.take_along_axis(names, first, 1)
            scored += len(rows)
    return best_ids, best, best_ids != np.iinfo(np.int64).max, scored


def _meet(asked: DataFrame, groups: DataFrame, top: int, width: int, scored=None) -> DataFrame:
    """(query_id, vec_id, score) of queries (vec_id, v, region, least) in the groups of their regions.

    Queries of a region are packed in chunks by hash; each chunk and each group of the region meet in one row.
    """
    many = asked.groupBy("region").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    dealt = asked.join(F.broadcast(many), "region").withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.col("chunks")))
    dealt = dealt.repartition("region", "chunk").sortWithinPartitions("region", "chunk", "vec_id")
    chunks = stash(_pack(dealt, "region", CHUNK, width).drop("high", "low").withColumn("c", F.monotonically_increasing_id()), "chunks")
    pairs = chunks.select("c", F.col("key").alias("region")).join(groups.select("g", "region"), "region").select("c", "g")
    met = pairs.join(groups.select("g", *[F.col(x).alias(f"c_{x}") for x in ("size", "ids", "data")]), "g").join(chunks.select("c", "size", "ids", "data", "least"), "c")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def matrix(data: bytes, size: int) -> np.ndarray:
            return np.frombuffer(data, np.int64).reshape(size, width)

        for batch in batches:
            for row in batch.to_pylist():
                q_ids, c_ids = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["c_ids"], np.int64)
                ids, scores, there, blocks = _search(q_ids, matrix(row["data"], row["size"]), c_ids, matrix(row["c_data"], row["c_size"]), top, BLOCK, np.frombuffer(row["least"], np.int64))
                if scored is not None:
                    scored.add(blocks)
                queries = np.broadcast_to(q_ids[:, None], ids.shape)[there]
                yield pa.RecordBatch.from_arrays([pa.array(queries), pa.array(ids[there]), pa.array(scores[there].astype(np.int64))], ["query_id", "vec_id", "score"])

    return met.select("size", "ids", "data", "least", "c_size", "c_ids", "c_data").mapInArrow(run, "query_id long, vec_id long, score long")


def _regions(asked: DataFrame, names: np.ndarray, high: np.ndarray, low: np.ndarray, width: int, first: bool) -> DataFrame:
    """Queries (vec_id, v, least) with each region they are to visit: the ``first`` has the highest bound, the others are those whose bound reaches ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                q, least = _matrix(part.column("v"), width), part.column("least").to_numpy()
                kind = _exact(q, high, low)
                bounds = _bounds(q.astype(kind), high.astype(kind), low.astype(kind))
                best = np.argmax(bounds, axis=1)
                if first:
                    row, at = np.arange(len(q)), best
                else:
                    reach = bounds >= least[:, None]
                    reach[np.arange(len(q)), best] = False
                    row, at = np.nonzero(reach)
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(row)) for c in ("vec_id", "v", "least")), pa.array(names[at], pa.int64())], ["vec_id", "v", "least", "region"])

    return asked.select("vec_id", "v", "least").mapInArrow(run, "vec_id long, v array<bigint>, least long, region long")


def top_products(vectors: DataFrame, top: int = TOP, every: int = EVERY, scored=None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every``, the ``top`` other rows with the greatest inner products.

    Ties go to the smaller vec_id.  Vectors that are null or hold null, NaN or
    infinite components take no part, nor do rows without id; a shorter vector
    counts as padded with zeros.  Rows that repeat a query's id are its own and
    no candidates for it; repeated candidate rows are each returned.  ``scored``,
    an accumulator, counts the pairs of a query and a block that were scored.
    """
    spark = vectors.sparkSession
    batched(spark)
    numbers = stash(whole_numbers(vectors), "vectors")
    count, width = numbers.agg(F.count("*"), F.max(F.size("v"))).first()
    width = max(1, width or 1)
    pivots = _matrix(pa.array([r["v"] for r in numbers.orderBy(F.xxhash64(F.lit(7), "vec_id"), "vec_id").limit(PIVOTS).collect()] or [[0]], pa.list_(pa.int64())), width)
    # Ranges of the new order; their number follows the number of rows, so a hot pivot is split by id.
    ranges = max(1, -(-count // (4 * GROUP)))
    ranged = _near(numbers, pivots, width).repartitionByRange(ranges, "near", "vec_id").sortWithinPartitions("near", "vec_id").withColumn("region", F.floor(F.spark_partition_id() / -(-ranges // REGIONS)))
    groups = stash(_pack(ranged, "region", GROUP, width).drop("least").withColumnRenamed("key", "region").withColumn("g", F.monotonically_increasing_id()), "groups")
    sides = groups.select("region", F.posexplode(F.arrays_zip("high", "low")).alias("at", "x")).groupBy("region", "at").agg(F.max("x.high").alias("high"), F.min("x.low").alias("low"))
    found = sides.orderBy("region", "at").toPandas()
    names = found["region"].to_numpy(np.int64)[::width]
    high, low = (found[c].to_numpy(np.int64).reshape(len(names), width) for c in ("high", "low"))

    lowest = -(2**63)
    asked = stash(numbers.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"]).withColumn("least", F.lit(lowest).cast("long")), "asked")
    if not len(names):
        names, high, low = np.zeros(1, np.int64), np.zeros((1, width), np.int64), np.zeros((1, width), np.int64)
    start = stash(_meet(_regions(asked, names, high, low, width, True), groups, top, width, scored), "start")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    kth = start.withColumn("rank", rank).where(F.col("rank") == top).select(F.col("query_id").alias("vec_id"), F.col("score").alias("kth"))
    asked = asked.join(kth, "vec_id", "left").select("vec_id", "v", F.coalesce("kth", "least").alias("least"))
    rest = _meet(stash(_regions(asked, names, high, low, width, False), "pairs"), groups, top, width, scored)
    return start.unionByName(rest).withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS double))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS bigint) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS int) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 5
"""
