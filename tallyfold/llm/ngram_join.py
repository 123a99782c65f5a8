"""N-gram Jaccard self-join with set-relation skipping, and the classes it links.

How the skipping maps to Spark jobs:

* **Index lists by position.**  Each set's hashed shingles stand in one global
  order, widespread ones last.  Only a prefix is posted, with its position:
  two sets that link share a token of both prefixes.  A list is skipped as a
  whole when none of its postings lies in the block of early positions that
  one side of a pair must have (both late: the positions alone rule it out).
* **Answers from a similar set.**  Each list has a leader, its most central
  set.  The leader's overlaps with all sets of its lists are computed first.
  What they imply is not computed again: sets linked with the leader are in
  one class, and by the triangle inequality sets whose distances from it
  differ by more than the threshold cannot link.  The overlaps of a set that is
  left are derived from those of the most similar set computed before, through
  the lists of the tokens in which the two differ.

A class of equal sets is represented once.  Large families of a leader are cut
into chunks, each with a copy of the leader, so no task gets a whole family.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import batched, components, discard, stash
from .textkit import mix, pieces, shingles, utf8, words

#: Words in a shingle, least similarity in hundredths.
SIZE, PERCENT = 4, 85
#: Sets that have a token before it counts as widespread, and how many such tokens the order may know (16 bytes each).
WIDESPREAD, ORDER_LIMIT = 64, 1 << 18
#: Sets, and shingles, that one task compares at once.
CHUNK_SETS, CHUNK_TOKENS = 256, 2_000_000
#: Sets to a block of those that their family's leader leaves open; sets whose computed overlaps are held to derive others.
LOOSE_SETS, BASES = 1024, 4
#: Rows of ids (up to 40 bytes) that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1 << 20


def _prefix(n: np.ndarray | int, percent: int):
    """Leading tokens of which a linked set must share one."""
    return n - (percent * n + 99) // 100 + 1


def _sets(docs: DataFrame, size: int, percent: int, order=None, whole: bool = False) -> DataFrame:
    """(doc_id, n, s1, s2, tokens): set size, set signature and the prefix, or with ``whole`` all tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank = order.value if order is not None else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        for batch in batches:
            for part in pieces(batch, "text"):
                hashes, first = words(*utf8(part.column("text")))
                n, s1, s2, kept = [], [], [], []
                for tokens in shingles(hashes, first, size):
                    n.append(len(tokens))
                    s1.append(np.add.reduce(mix(tokens ^ np.uint64(0x51)), dtype=np.uint64))
                    s2.append(np.bitwise_xor.reduce(mix(tokens ^ np.uint64(0xA7))) if len(tokens) else np.uint64(0))
                    if not whole and len(tokens):
                        if len(known):
                            at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
                            late = np.where(known[at] == tokens, rank[at], 0)
                            if late.any():
                                tokens = tokens[np.argsort(late, kind="stable")]
                        tokens = tokens[: _prefix(len(tokens), percent)]
                    kept.append(tokens)
                flat = np.concatenate(kept) if kept else np.zeros(0, np.uint64)
                ends = np.concatenate([[0], np.cumsum([len(k) for k in kept])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(np.array(s1, np.uint64).view(np.int64)), pa.array(np.array(s2, np.uint64).view(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))],
                    ["doc_id", "n", "s1", "s2", "tokens"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, s1 long, s2 long, tokens array<long>")


def _links_of_group(ids: np.ndarray, sizes: np.ndarray, flat: np.ndarray, pivot: int | None, linked: np.ndarray, dist: np.ndarray, percent: int):
    """Links that join what is not yet joined, and distances from the pivot.

    ``linked`` marks sets known to be in the pivot's class, ``dist`` holds
    distances from it where a pivot is not among the sets.
    """
    m = len(ids)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    codes = np.unique(flat, return_inverse=True)[1]
    # The index of the group: the sets that hold each token.
    holder = np.repeat(np.arange(m), sizes)[np.argsort(codes, kind="stable")]
    first = np.concatenate([[0], np.cumsum(np.bincount(codes))])
    mark = np.zeros(len(first) - 1, bool)
    group = np.where(linked, 0, np.arange(1, m + 1))
    edges: list[tuple[int, int]] = []
    bases: list[tuple[int, np.ndarray]] = []

    def own(k: int) -> np.ndarray:
        return codes[starts[k] : ends[k]]

    def listed(tokens: np.ndarray) -> np.ndarray:
        """How many of the tokens each set holds."""
        long = first[tokens + 1] - first[tokens]
        at = np.arange(long.sum()) + np.repeat(first[tokens] - (np.cumsum(long) - long), long)
        return np.bincount(holder[at], minlength=m)

    def without(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        mark[b] = True
        rest = a[~mark[a]]
        mark[b] = False
        return rest

    def overlap(k: int) -> np.ndarray:
        """Tokens that each set shares with set k: its own lists, or the answers of a similar set and the lists of what the two differ in."""
        near = min(bases, key=lambda b: sizes[b[0]] - 2 * b[1][k], default=None)
        if near is not None and sizes[near[0]] + sizes[k] - 2 * near[1][k] < sizes[k]:
            shared = near[1] + listed(without(own(k), own(near[0]))) - listed(without(own(near[0]), own(k)))
        else:
            shared = listed(own(k))
        # The leader's answers stay, of the others the last ones.
        del bases[1 : max(1, len(bases) - BASES + 2)]
        bases.append((k, shared))
        return shared

    def join(k: int, others: np.ndarray) -> None:
        for o in others.tolist():
            if group[o] != group[k]:
                edges.append((int(ids[k]), int(ids[o])))
                group[group == group[o]] = group[k]

    if pivot is not None:
        shared = overlap(pivot)
        union = sizes + sizes[pivot] - shared
        dist = 1.0 - shared / union
        join(pivot, np.flatnonzero(100 * shared >= percent * union))
        linked = group == group[pivot]
    reach = 1 - percent / 100 + 1e-9
    for k in np.flatnonzero(~linked).tolist():
        near = (group != group[k]) & (100 * np.minimum(sizes, sizes[k]) >= percent * np.maximum(sizes, sizes[k])) & (np.abs(dist - dist[k]) <= reach)
        if near.any():
            shared = overlap(k)
            join(k, np.flatnonzero(near & (100 * shared >= percent * (sizes + sizes[k] - shared))))
    return edges, dist, linked


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each (leader, part), which stand together."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        lead, part = batch.column("leader").to_numpy(), batch.column("part").to_numpy()
        cuts = np.flatnonzero((lead[1:] != lead[:-1]) | (part[1:] != part[:-1])) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            now = (lead[a], part[a])
            if held and now != key:
                yield pa.Table.from_batches(held)
                held = []
            key = now
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the lists of a column, and their items one after the other."""
    lengths = [np.diff(c.offsets.to_numpy()) for c in column.chunks]
    return np.concatenate(lengths).astype(np.int64), np.concatenate([c.flatten().to_numpy() for c in column.chunks])


def _screen(rows: DataFrame, percent: int, order) -> DataFrame:
    """(leader, id) of the sets that may link with another of their (leader, part) group, by what the prefixes show.

    Up to the end of the shorter reach of two prefixes all tokens of both sets are
    known; the common ones there and all that may follow bound the overlap.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank = order.value
        leads, kept = [], []
        for group in _groups(batches):
            ids, n = group["id"].to_numpy(), group["n"].to_numpy().astype(np.int64)
            sizes, flat = _lists(group["tokens"])
            ends = np.cumsum(sizes)
            starts = ends - sizes
            tokens, codes = np.unique(flat.view(np.uint64), return_inverse=True)
            if len(known):
                at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
                place = np.empty(len(tokens), np.int64)
                place[np.argsort(np.where(known[at] == tokens, rank[at], 0), kind="stable")] = np.arange(len(tokens))
                codes = place[codes]
            last = codes[ends - 1]
            mark = np.zeros(len(tokens), np.int32)
            alive = np.zeros(len(ids), bool)
            need = percent / (100 + percent)
            for k in range(len(ids) - 1):
                own = codes[starts[k] : ends[k]]
                mark[own] = 1
                common = np.add.reduceat(mark[codes], starts)
                mark[own] = 0
                seen_k = np.minimum(np.searchsorted(own, last, "right"), sizes[k])
                seen = np.add.reduceat((codes <= last[k]).astype(np.int32), starts)
                may = common + np.minimum(n[k] - seen_k, n - seen) >= need * (n[k] + n) - 1e-6
                may &= (common > 0) & (100 * np.minimum(n, n[k]) >= percent * np.maximum(n, n[k]))
                may[: k + 1] = False
                if may.any():
                    alive |= may
                    alive[k] = True
            if alive.any():
                kept.append(ids[alive])
                leads.append(np.full(int(alive.sum()), group["leader"][0].as_py(), np.int64))
            if len(kept) > 2000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(leads)), pa.array(np.concatenate(kept))], ["leader", "id"])
                leads, kept = [], []
        none = np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *leads])), pa.array(np.concatenate([none, *kept]))], ["leader", "id"])

    rows = rows.select("leader", "part", "id", "n", "tokens")
    return rows.repartition("leader", "part").sortWithinPartitions("leader", "part").mapInArrow(run, "leader long, id long")


def _compare(rows: DataFrame, percent: int, report: bool) -> DataFrame:
    """Compares the sets of each (leader, part) group; the rows of a group come together, in order.

    Out come links (a, b), and with ``report`` also each set's distance from the leader.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def flush():
            a, b, lead, i, d = zip(*out) if out else ([], [], [], [], [])
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(lead, pa.int64()), pa.array(i, pa.int64()), pa.array(d, pa.float64())], ["a", "b", "leader", "id", "dist"])

        for group in _groups(batches):
            ids = group["id"].to_numpy()
            sizes, flat = _lists(group["tokens"])
            lead = int(group["leader"][0].as_py())
            at = np.flatnonzero(ids == lead)
            pivot = int(at[0]) if report and len(at) else None
            edges, dist, _ = _links_of_group(ids, sizes, flat, pivot, group["linked"].to_numpy().astype(bool), group["dist"].to_numpy().astype(float), percent)
            out.extend((a, b, None, None, None) for a, b in edges)
            if report and group["parts"][0].as_py() > 1:
                out.extend((None, None, lead, int(i), float(d)) for i, d in zip(ids, dist))
            if len(out) > 50_000:
                yield flush()
        yield flush()

    rows = rows.select("leader", "part", "parts", "id", "dist", "linked", "tokens")
    return rows.repartition("leader", "part").sortWithinPartitions("leader", "part").mapInArrow(run, "a long, b long, leader long, id long, dist double")


def _small(ids: DataFrame) -> DataFrame:
    """A stored table, to be broadcast if its rows are few enough by count."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def links(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, n, s1, s2) of each document, links between class representatives, and the representatives.

    The links join exactly what the Jaccard join at ``percent`` links; links that
    follow from others by transitivity may be left out.
    """
    spark = docs.sparkSession
    batched(spark)
    found = stash(_sets(docs, size, percent).select("doc_id", "n", "s1", "s2"), "signatures")
    classes = found.where("n > 0 and doc_id is not null").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("doc_id"))
    classes = stash(classes.select("doc_id", "n", "s1", "s2"), "classes")
    copies = stash(found.join(classes, ["doc_id", "n", "s1", "s2"], "left_anti").where("doc_id is not null").select("doc_id").distinct(), "copies")
    single = docs.select("doc_id", "text").where("doc_id is not null").join(_small(copies), "doc_id", "left_anti")

    spread = _sets(docs, size, percent).select(F.explode("tokens").alias("token")).groupBy("token").count()
    spread = stash(spread.where(F.col("count") > WIDESPREAD), "spread").orderBy(F.desc("count"), "token").limit(ORDER_LIMIT).toPandas()
    known = spread["token"].to_numpy().view(np.uint64)
    sort = np.argsort(known)
    order = spark.sparkContext.broadcast((known[sort], spread["count"].to_numpy()[sort]))
    prefixes = stash(_sets(single, size, percent, order).select("doc_id", "n", "tokens"), "prefixes")

    # Of a linked pair one side has the token within 2t/(1+t): lists without such an early posting are skipped.
    early = F.col("pos") <= F.col("n") - F.ceil(F.col("n") * (2.0 * percent / (100 + percent)) - 1e-6)
    postings = prefixes.select("doc_id", "n", F.posexplode("tokens").alias("pos", "token")).select("token", F.col("doc_id").alias("id"), F.col("n").cast("int").alias("n"), early.alias("early"))
    # The postings are shuffled once for their lists and then once to the few that are left; written between, the two do not lie on disk together.
    lists = postings.groupBy("token").agg(F.count("*").alias("width"), F.max("early").alias("early")).where("width > 1 and early").select("token", "width")
    lists = stash(lists, "lists")
    shared = stash(postings.join(lists, "token").select("token", "width", "id", "n", "early"), "postings")
    central = shared.groupBy("id").agg(F.avg("width").alias("central"))
    # Lists by size: sets that link are in the same band of sizes or in neighbouring ones.
    band = F.floor(F.log("n") / F.log(F.lit(100.0 / percent)) + 1e-9)
    banded = shared.join(central, "id").select("token", "id", "n", "early", "central", F.explode(F.array(F.struct(band.alias("band"), F.lit(True).alias("own")), F.struct((band + 1).alias("band"), F.lit(False).alias("own")))).alias("x")).select("token", "id", "n", "early", "central", "x.*")
    banded = stash(banded, "banded")
    discard(lists, shared)
    leaders = banded.groupBy("token", "band").agg(F.count("*").alias("width"), F.max("own").alias("own"), F.max("early").alias("early"), F.max(F.struct("central", "id"))["id"].alias("leader"))
    leaders = leaders.where("width > 1 and own and early").select("token", "band", "leader")
    members = banded.select("token", "band", "id", "n").join(leaders, ["token", "band"]).where("id != leader").select("leader", "id", "n").distinct()
    members = stash(members, "members")
    discard(banded)
    families = members.groupBy("leader").agg(F.greatest(F.ceil(F.count("*") / CHUNK_SETS), F.ceil(F.sum("n") / CHUNK_TOKENS)).cast("int").alias("parts"))
    families = stash(families, "families")
    cut = F.pmod(F.xxhash64("id"), F.col("parts").cast("long")).cast("int")
    heads = families.select("leader", F.col("leader").alias("id"), "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    pairs, members = members, stash(members.join(families, "leader").select("leader", "id", "parts", cut.alias("part")).unionByName(heads), "members")
    discard(pairs)
    # What the prefixes alone rule out is not read again. Families of several parts stay whole here, as all their sets need a distance from the leader.
    shown = prefixes.select(F.col("doc_id").alias("id"), "n", "tokens").join(members.where("parts = 1"), "id")
    alive = stash(_screen(shown, percent, order).distinct(), "alive")
    members = stash(members.where("parts > 1").unionByName(members.where("parts = 1").join(alive, ["leader", "id"], "left_semi")), "members")
    wanted = stash(members.select("id").distinct(), "wanted")
    texts = single.join(_small(wanted), F.col("doc_id") == F.col("id"), "left_semi")
    whole = _sets(texts, size, percent, whole=True)
    whole = whole.select(F.col("doc_id").alias("id"), "tokens")
    fresh = members.withColumns({"dist": F.lit(0.0), "linked": F.lit(False)})
    compared = stash(_compare(whole.join(_small(fresh), "id"), percent, report=True), "compared")
    edges = compared.where("a is not null").select("a", "b")
    if not families.where("parts > 1").limit(1).count():
        discard(prefixes)
        return found, edges, classes

    # Families of several parts: sets not linked with the leader meet each other and the linked ones across parts.
    limit = 1 - percent / 100 + 1e-12
    far = compared.where("id is not null and id != leader").select("leader", "id", "dist").distinct().withColumn("linked", F.col("dist") <= limit)
    # By the triangle inequality a linked set can only link with a loose one that is hardly farther from the leader.
    nearest = far.groupBy("leader").agg(F.min(F.when(~F.col("linked"), F.col("dist"))).alias("nearest"))
    far = far.join(nearest, "leader").where(~F.col("linked") | (F.col("dist") >= F.col("nearest") - (1 - percent / 100 + 1e-9))).drop("nearest")
    blocks = far.groupBy("leader").agg(F.sum((~F.col("linked")).cast("int")).alias("loose"), F.sum(F.col("linked").cast("int")).alias("close")).where("loose > 0")
    blocks = blocks.select("leader", F.ceil(F.col("loose") / LOOSE_SETS).cast("int").alias("nl"), F.ceil(F.col("close") / LOOSE_SETS).cast("int").alias("nc"))
    far = far.join(blocks, "leader").withColumn("slot", F.pmod(F.xxhash64("id"), F.greatest(F.lit(1), F.when(F.col("linked"), F.col("nc")).otherwise(F.col("nl"))).cast("long")).cast("int"))
    # Part (i, j): loose block i with loose block j >= i, or with linked block j (numbered after all loose pairs).
    loose_pairs = F.transform(F.sequence(F.lit(0), F.col("nl") - 1), lambda j: F.least(j, F.col("slot")) * F.col("nl") + F.greatest(j, F.col("slot")))
    with_close = F.slice(F.transform(F.sequence(F.lit(0), F.col("nc")), lambda j: F.col("nl") * F.col("nl") + F.col("slot") * F.col("nc") + j), F.lit(1), F.col("nc"))
    from_close = F.transform(F.sequence(F.lit(0), F.col("nl") - 1), lambda i: F.col("nl") * F.col("nl") + i * F.col("nc") + F.col("slot"))
    far = stash(far.select("leader", "id", "dist", "linked", F.lit(1).alias("parts"), F.explode(F.when(F.col("linked"), from_close).otherwise(F.concat(loose_pairs, with_close))).alias("part")), "far")
    # What the prefixes rule out within a part is not read again.
    shown = prefixes.select(F.col("doc_id").alias("id"), "n", "tokens").join(_small(far.select("leader", "part", "id")), "id")
    alive = stash(_screen(shown, percent, order).distinct(), "alive")
    discard(prefixes)
    far = stash(far.join(alive, ["leader", "id"], "left_semi"), "far")
    wanted = stash(far.select("id").distinct(), "wanted")
    texts = single.join(_small(wanted), F.col("doc_id") == F.col("id"), "left_semi")
    again = _sets(texts, size, percent, whole=True).select(F.col("doc_id").alias("id"), "tokens")
    crossed = _compare(again.join(_small(far), "id"), percent, report=False)
    edges = edges.unionByName(crossed.where("a is not null").select("a", "b"))
    return found, edges, classes


def classify(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs`` (doc_id, text; other columns are ignored).

    Two documents link when the Jaccard similarity of their distinct word
    shingles is at least ``percent`` hundredths.  A null, empty or blank text has
    an empty set, links with nothing and forms its own class.  A text with fewer
    words than ``size`` is one shingle.  Very long texts are read whole.  Equal texts have equal sets and link.  A
    null doc_id takes no part: its component is null.  Repeated rows are each
    returned; rows with one doc_id count as one document.
    """
    found, edges, classes = links(docs, size, percent)
    joined = components(edges)
    named = classes.join(joined, F.col("doc_id") == F.col("node"), "left").select("n", "s1", "s2", F.coalesce("component", "doc_id").alias("component_id"))
    return found.join(named, ["n", "s1", "s2"], "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
    )


def deduplicate(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each class: the one with the smallest doc_id, once.

    Documents without words are in no class and stay, as do rows without doc_id.
    """
    classes = stash(classify(docs.select("doc_id", "text"), size, percent), "classes")
    surplus = stash(classes.where("component_id != doc_id").select("doc_id").distinct(), "surplus")
    kept = docs.join(_small(surplus), "doc_id", "left_anti").select(*docs.columns)
    if classes.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count():
        kept = kept.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(kept.where("doc_id is null"))
    return kept


#: The same classes in SQL, by counting the shingles that each pair of documents shares. For small tables: its pairs grow with the square of a shingle's documents.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])
                                    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM w),
u AS (SELECT doc_id, len(s) AS n, unnest(s) AS s FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, count(*) AS shared FROM u a JOIN u b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p WHERE 100 * shared >= 85 * (nx + ny - shared)),
r(x, c) AS (SELECT doc_id, doc_id FROM s UNION SELECT l.y, r.c FROM r JOIN l USING (x))
SELECT s.doc_id, CAST(len(s.s) AS bigint) AS n_shingles, m.c AS component_id
FROM s JOIN (SELECT x, min(c) AS c FROM r GROUP BY x) m ON s.doc_id = m.x
"""
