"""Phrases whose words keep together, mined by dynamic itemset counting.

The texts are dealt into shards, which are read in turn, again and again.  In
each step one shard is read and phrases of all lengths are counted at the same
time: single words from the start, a longer phrase from the step after both of
its subphrases (without its last word, and without its first) have been seen
often enough.  Each phrase is counted for one full cycle, so its count is exact
whenever it starts.  Work ends when no phrase is left that has shards to see.

Which phrases have been seen often enough is a table of fixed size that every
task gets: at a phrase's slot the step at which some phrase of that slot
reached the threshold.  Phrases that share a slot only start others early, and
those are counted for a full cycle like any other, so no result depends on the size.
Counts never leave the executors; they are keyed by a 64-bit digest of language
and words, and only phrases that reach the threshold get their words back.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import batched, stash
from .textkit import LOWER, coded, digests, gathered, mix, pieces, spans, utf8

#: Fixed values of the contract: longest phrase, least occurrences, phrases to a language, the language of records without one.
LENGTH, LEAST, FIRST, UNKNOWN = 5, 100, 2000, "und"
#: Shards of a cycle, and slots of the table of phrases that have been seen often enough (two to this power, one byte each).
SHARDS, SLOTS = 3, 24
#: Digests that a task gathers before it hands them on.
TOGETHER = 1 << 21
NEVER = 255

#: Bytes that end a word, and those that end a piece.
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?\n\x0b\x0c\r"]] = True
_SPLIT = _BREAK.copy()
_SPLIT[[0x20, 0x09]] = True
_LANES = np.random.default_rng(1310).integers(1, 1 << 63, LENGTH + 1, dtype=np.uint64) | np.uint64(1)


class Words:
    """The words of a batch of texts: where they are, how many follow in their piece, and the digests of the phrases that begin with them."""

    def __init__(self, langs: pa.Array, texts: pa.Array) -> None:
        import xxhash

        data, starts = utf8(texts)
        self.data = LOWER[data]
        self.begin, self.end, first = spans(self.data, starts, _SPLIT)
        # Words in order are all bytes but those between them.
        at = np.zeros(len(self.begin) + 1, np.int64)
        np.cumsum(self.end - self.begin, out=at[1:])
        ids, distinct = coded(self.data[~_SPLIT[data]], at)
        self.digests = digests(distinct)[ids]
        # A piece ends where a text does, and where a byte that ends one stands between two words.
        breaks = np.zeros(len(data) + 1, np.int32)
        np.cumsum(_BREAK[data], dtype=np.int32, out=breaks[1:])
        last = np.ones(len(ids), bool)
        last[:-1] = breaks[self.begin[1:]] != breaks[self.begin[:-1]]
        ends = first[1:][first[1:] > first[:-1]] - 1
        last[ends] = True
        stops = np.flatnonzero(last)
        self.room = np.repeat(stops, np.diff(stops, prepend=-1)) - np.arange(len(ids)) + 1
        self.langs = langs.fill_null(UNKNOWN).dictionary_encode()
        codes = self.langs.indices.to_numpy(zero_copy_only=False)
        self.of_lang = np.repeat(codes, np.diff(first))
        self.seeds = np.fromiter((xxhash.xxh3_64_intdigest(x.encode(), seed=13) for x in self.langs.dictionary.to_pylist()), np.uint64, len(self.langs.dictionary))

    def phrases(self) -> Iterator[tuple[int, np.ndarray]]:
        """(length, digest of the phrase at each word, also where no such phrase is) for lengths 0 to 5; 0 stands for the language."""
        total = self.seeds[self.of_lang] if len(self.of_lang) else np.zeros(0, np.uint64)
        yield 0, mix(total)
        for k in range(1, LENGTH + 1):
            n = max(0, len(total) - k + 1)
            total[:n] += self.digests[k - 1 : k - 1 + n] * _LANES[k]
            yield k, mix(total + np.uint64(k))


def _slot(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[(keys & np.uint64(len(table) - 1)).astype(np.int64)]


def _counted(held: dict[tuple[int, int], list[np.ndarray]]) -> pa.RecordBatch:
    """Equal keys of each length and start as one row with their number."""
    columns: tuple[list, ...] = ([], [], [], [])
    for (k, start), lists in held.items():
        # Sorting numbers alone takes a tenth of the time of sorting their places, too.
        keys = np.sort(np.concatenate(lists))
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        for column, new in zip(columns, (keys[first].view(np.int64), np.full(len(first), k, np.int8), np.full(len(first), start, np.int16), np.diff(np.append(first, len(keys))))):
            column.append(new)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(columns, (pa.int64(), pa.int8(), pa.int16(), pa.int64()))], ["key", "k", "start", "n"])


def _count(shard: DataFrame, step: int, shards: int, table: object) -> DataFrame:
    """(key, k, start, n) of the phrases that one shard adds in this step; ``start`` is the step at which a phrase's cycle began."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reached = np.frombuffer(zlib.decompress(table.value), np.uint8)
        held: dict[tuple[int, int], list[np.ndarray]] = defaultdict(list)
        many = 0
        for batch in batches:
            for part in pieces(batch, "text"):
                words = Words(part.column(0), part.column(1))
                shorter: np.ndarray | None = None
                for k, keys in words.phrases():
                    if k < 2:
                        if step < shards and len(keys):
                            held[k, 0].append(keys)
                            many += len(keys)
                    else:
                        seen = _slot(shorter, reached)
                        both = np.maximum(seen[:-1], seen[1:]).astype(np.int16)
                        at = np.flatnonzero((both != NEVER) & (both + shards >= step) & (words.room[:-1] >= k))
                        start = both[at] + np.int16(1)
                        for s in np.flatnonzero(np.bincount(start)).tolist():
                            held[k, s].append(keys[at[start == s]])
                        many += len(at)
                    shorter = keys
                if many >= TOGETHER:
                    yield _counted(held)
                    held.clear()
                    many = 0
        if many:
            yield _counted(held)

    return shard.select("lang", "text").mapInArrow(run, "key long, k byte, start short, n long")


def _written(texts: DataFrame, found: object, slots: int, sparing: bool) -> DataFrame:
    """(key, k, lang, phrase) of phrases of the texts whose two slots ``found`` marks, once for each task at most.

    The mark says how frequent a phrase is. If ``sparing``, only so many of its occurrences are
    looked at that about ten remain in all texts, whatever the number of tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = np.frombuffer(zlib.decompress(found.value), np.uint8)
        done = np.zeros(0, np.uint64)
        for batch in batches:
            for part in pieces(batch, "text"):
                words = Words(part.column(0), part.column(1))
                for k, keys in words.phrases():
                    level = _slot(keys, marked)
                    at = np.flatnonzero((level != NEVER) & (words.room >= k))
                    at = at[_slot(keys[at] >> np.uint64(slots), marked) != NEVER]
                    if sparing:
                        lot = mix(keys[at] + (at + len(done)).astype(np.uint64)) >> np.uint64(24)
                        at = at[lot & ((np.uint64(1) << np.maximum(2 * level[at].astype(np.int64) - 3, 0).astype(np.uint64)) - np.uint64(1)) == 0]
                    new, where = np.unique(keys[at], return_index=True)
                    at = at[where[~np.isin(new, done, assume_unique=True)]]
                    if not len(at):
                        continue
                    # What a task has handed on is kept in mind up to a bound; more often is no harm.
                    done = np.append(done, keys[at]) if len(done) < TOGETHER else keys[at]
                    phrase = _joined(words, at, k)
                    lang = words.langs.dictionary.take(pa.array(words.of_lang[at]))
                    yield pa.RecordBatch.from_arrays([pa.array(keys[at].view(np.int64)), pa.array(np.full(len(at), k, np.int8)), lang.cast(pa.string()), phrase.cast(pa.string())], ["key", "k", "lang", "phrase"])

    return texts.select("lang", "text").mapInArrow(run, "key long, k byte, lang string, phrase string")


def _with_words(counts: DataFrame, dealt: DataFrame, shards: int, slots: int) -> DataFrame:
    """(lang, k, phrase, n) of counted phrases, whose words are looked up in the shards, one after the other until none is missing."""
    spark, parts = counts.sparkSession, []
    for shard, sparing in [(0, True), *((s, False) for s in range(1, shards)), (0, False)]:
        table = np.full(1 << slots, NEVER, np.uint8)
        _marked(counts.select(F.shiftrightunsigned("key", slots).alias("key")), table, F.lit(0))
        if not _marked(counts, table, F.floor(F.log2(F.greatest("n", F.lit(1))) / 2).cast("int"), over=True):
            break
        sent = spark.sparkContext.broadcast(zlib.compress(table.tobytes(), 1))
        texts = _written(dealt.where(F.col("shard") == shard), sent, slots, sparing).groupBy("key", "k").agg(F.min("lang").alias("lang"), F.min("phrase").alias("phrase"))
        parts.append(stash(texts.join(counts, ["key", "k"]).select("key", "lang", "k", "phrase", "n"), "written"))
        sent.destroy()
        counts = stash(counts.join(parts[-1].select("key", "k"), ["key", "k"], "left_anti"), "missing")
    return reduce(DataFrame.unionByName, parts).drop("key") if parts else counts.selectExpr("'' AS lang", "k", "'' AS phrase", "n")


def _joined(words: Words, at: np.ndarray, k: int) -> pa.Array:
    """The phrases of k words at the given words, with one blank between words."""
    if not k:
        return pa.array([""] * len(at), pa.large_string())
    each = (at[:, None] + np.arange(k)).ravel()
    joined, offsets = gathered(words.data, words.begin[each], words.end[each], 1)
    # The blank after a phrase's last word is left out.
    keep = np.ones(len(joined), bool)
    keep[offsets[k::k] - 1] = False
    offsets = offsets[::k] - np.arange(len(at) + 1)
    return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(joined[keep]))


def _marked(reached: DataFrame, table: np.ndarray, value: Column, over: bool = False) -> bool:
    """Sets the slots of ``reached`` that are not set yet, or all if ``over``, to a small number.

    Slots come as bitmaps by number, each of all slots together two megabytes at most.
    """
    slot = F.col("key").bitwiseAND(len(table) - 1) + 1
    maps = reached.select(F.bitmap_bucket_number(slot).alias("part"), F.bitmap_bit_position(slot).alias("bit"), value.alias("value")).groupBy("value", "part").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    for number, part, bits in sorted(maps):
        own = np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")) + ((part - 1) << 15)
        table[own if over else own[table[own] == NEVER]] = number
    return bool(maps)


def frequent(docs: DataFrame, least: int = LEAST, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """(lang, k, phrase, n) of all phrases of up to five words with at least ``least`` occurrences, and for k = 0 each language's number of words.

    ``docs`` has lang and text; null counts as ``und`` and as empty.
    """
    spark = docs.sparkSession
    batched(spark)
    own = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # Rows are dealt in turn, whatever they hold. The shards are files, so that a step reads only its own.
    dealt = stash(own.withColumn("shard", F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int")), "shards", "shard")
    table = np.full(1 << slots, NEVER, np.uint8)
    left: DataFrame | None = None
    found: list[DataFrame] = []
    step, latest = 0, 0
    while step <= latest + shards:
        sent = spark.sparkContext.broadcast(zlib.compress(table.tobytes(), 1))
        new = _count(dealt.where(F.col("shard") == step % shards), step, shards, sent).withColumn("was", F.lit(0).cast("long"))
        if left is not None:
            new = new.unionByName(left.select("key", "k", "start", "n", F.col("n").alias("was")))
        seen = stash(new.groupBy("key", "k", "start").agg(F.sum("n").alias("n"), F.sum("was").alias("was")), "phrases")
        sent.destroy()
        if _marked(seen.where((F.col("n") >= least) & (F.col("was") < least) & F.col("k").between(1, LENGTH - 1)), table, F.lit(step)):
            latest = step
        complete = F.col("start") + F.lit(shards) == step + 1
        done = seen.where(complete & ((F.col("n") >= least) | (F.col("k") == 0))).select("key", "k", "n")
        found.append(done)
        left = seen.where(~complete)
        step += 1
    counts = found[0]
    for more in found[1:]:
        counts = counts.unionByName(more)
    return stash(_with_words(stash(counts, "counts"), dealt, shards, slots), "frequent")


def _best(rows: DataFrame, first: int) -> DataFrame:
    """Each language's first rows by score, then a (both descending), then phrase, with their rank. Parts of a language choose first, so that no task sorts all of it."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(256)))
    for keys in (("lang", "_part"), ("lang",)):
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= first)
    return rows.drop("_part")


def _some(words: Column, a: Column | int, n: Column | int) -> Column:
    """``n`` words from the a-th on (from 1), joined."""
    return F.array_join(F.slice(words, a, n), " ")


def collocations(docs: DataFrame, least: int = LEAST, first: int = FIRST, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Each language's phrases of two to five words that keep together best: lang, rank, phrase, a, l, r, n, score.

    A-Z count as lower case, pieces end at ``.,;:!?`` and line ends, words at blanks
    and tabs.  a, l and r are occurrences of the phrase and of its two parts at the
    weakest cut (ties: the smallest), n of all the language's words; score is
    floor(1000 a n / (l r)), worked out in decimals of 38 digits.  A phrase inside a
    longer one with as many occurrences goes.

    Null texts are empty, a null lang is ``und``; other columns and ids are not
    looked at; repeated rows count each; very long texts are read whole; ties go by
    phrase; no rows, or no phrase seen often enough, give no rows.
    """
    known = frequent(docs, least, shards, slots)
    total = known.where("k = 0").select("lang", F.col("n").alias("_n"))
    phrases = known.where("k > 0").select("lang", F.col("k").cast("int").alias("k"), "phrase", F.col("n").alias("a"))
    longer = phrases.where("k > 1").withColumn("words", F.split("phrase", " "))
    cuts = longer.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.withColumns({"head": _some(F.col("words"), 1, F.col("cut")), "rest": _some(F.col("words"), F.col("cut") + 1, F.col("k") - F.col("cut"))}).drop("words")
    heads, rests = phrases.select("lang", F.col("phrase").alias("head"), F.col("a").alias("l")), phrases.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r"))
    cuts = cuts.join(heads, ["lang", "head"]).join(rests, ["lang", "rest"]).join(total, "lang")
    wide = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "_n", "l", "r")}
    cuts = cuts.withColumns({f"{c}_": v for c, v in wide.items()}).withColumn("score", F.expr("(a_ * _n_ * 1000) div (l_ * r_)"))
    scored = cuts.groupBy("lang", "phrase", "a", F.col("_n").alias("n")).agg(F.min(F.struct("score", "cut", "l", "r")).alias("s")).select("lang", "phrase", "a", "s.l", "s.r", "n", "s.score")
    # The parts of each longer phrase, with the most occurrences of a phrase that holds them.
    inside = longer.where("k > 2").withColumn("size", F.explode(F.sequence(F.lit(2), F.col("k") - 1))).withColumn("at", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)))
    cover = inside.select("lang", _some(F.col("words"), F.col("at"), F.col("size")).alias("phrase"), F.col("a").alias("cover")).groupBy("lang", "phrase").agg(F.max("cover").alias("cover"))
    kept = scored.join(cover, ["lang", "phrase"], "left").where("cover is null or cover < a").drop("cover")
    return _best(kept, first).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def oracle(least: int = LEAST, first: int = FIRST) -> str:
    """SQL with the same rows."""
    grams = " UNION ALL ".join(
        f"SELECT lang, {k} AS k, unnest(list_transform(range(1, len(ws) - {k - 2}), lambda i: array_to_string(ws[i:i + {k - 1}], ' '))) AS phrase FROM piece WHERE len(ws) >= {k}" for k in range(1, LENGTH + 1)
    )
    return f"""WITH cutup AS (
  SELECT coalesce(lang, '{UNKNOWN}') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p
  FROM documents),
piece AS (SELECT lang, list_filter(string_split_regex(p, '[\\x20\\x09]+'), lambda w: w <> '') AS ws FROM cutup),
total AS (SELECT lang, CAST(sum(len(ws)) AS bigint) AS n FROM piece GROUP BY lang),
often AS (SELECT lang, k, phrase, count(*) AS a FROM ({grams}) GROUP BY lang, k, phrase HAVING count(*) >= {least}),
longer AS (SELECT *, string_split(phrase, ' ') AS ws FROM often WHERE k > 1),
cuts AS (SELECT lang, k, phrase, a, ws, unnest(range(1, k)) AS cut FROM longer),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.cut, x.a AS l, y.a AS r, t.n,
         CAST((CAST(1000 AS hugeint) * c.a * t.n) // (CAST(x.a AS hugeint) * y.a) AS bigint) AS score
  FROM cuts c JOIN often x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1:c.cut], ' ')
  JOIN often y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[c.cut + 1:c.k], ' ') JOIN total t ON t.lang = c.lang),
weakest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS o FROM scored) WHERE o = 1),
sized AS (SELECT lang, k, a, ws, unnest(range(2, k)) AS size FROM longer WHERE k > 2),
parts AS (SELECT lang, a, ws, size, unnest(range(1, k - size + 2)) AS b FROM sized),
cover AS (SELECT lang, array_to_string(ws[b:b + size - 1], ' ') AS phrase, max(a) AS cover FROM parts GROUP BY 1, 2),
kept AS (SELECT w.* FROM weakest w LEFT JOIN cover c ON c.lang = w.lang AND c.phrase = w.phrase WHERE c.cover IS NULL OR c.cover < w.a)
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) WHERE rank <= {first}"""
