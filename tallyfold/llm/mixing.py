"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

A source's documents are dealt by hash into blocks of about a thousand.  The mix
draws whole passes over a source's blocks, then a part of one more in permuted
order, until the source's target is met to the word.  Those draws are exact
quotas of blocks per source; a binary tree splits them among the output shards,
each split a multivariate hypergeometric draw, so every shard is a random sample
of the whole mix without replacement.  A shard takes its own stretch of each
source's permuted blocks and is shuffled locally.  DataFrame operations only;
windows run over one block's documents, a part of a source's blocks, or the parts of
a source.  One row holds the quotas of all sources, some tens of bytes each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import restored, set_aside, stash, words_of

#: Weights of the sources in order, repeating; times a document may be taken.
WEIGHTS, MOST_PASSES = (1, 2, 3), 3
#: Documents to a block, words to an output shard, and the seed of all permutations.
BLOCK_DOCS, SHARD_WORDS, SEED = 1000, 4_000_000, 17
#: Bits of a block's place in the permutation that name the part of its source in which it is ranked: 256 parts.
PART_BITS = 8


def _uniform(*parts: Column) -> Column:
    """A number from 0 to 1 that depends on the parts and the seed alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *parts), 11) / F.lit(float(1 << 53))


def hypergeometric(u: Column, population: Column, good: Column, draws: Column) -> Column:
    """How many of ``draws`` out of ``population`` are among its ``good`` ones, by inversion of ``u``.

    Probabilities are summed outwards from the mode over ten standard deviations,
    beyond which no double is changed.
    """
    n, k, d = (c.cast("double") for c in (population, good, draws))
    low, high = F.greatest(F.lit(0.0), d + k - n), F.least(d, k)
    mode = F.least(F.greatest(F.floor((d + 1) * (k + 1) / (n + 2)).cast("double"), low), high)
    spread = F.sqrt(F.greatest(d * k / F.greatest(n, F.lit(1.0)) * (1 - k / F.greatest(n, F.lit(1.0))) * (n - d) / F.greatest(n - 1, F.lit(1.0)), F.lit(0.0)))
    width = F.ceil(10 * spread) + 10
    start = F.struct(low.alias("low"), high.alias("high"), mode.alias("mode"), F.least(high - mode, width.cast("double")).cast("int").alias("up"), F.least(mode - low, width.cast("double")).cast("int").alias("down"))

    def walk(s: Column, rising: bool, state: Column, wanted: Column | None) -> Column:
        """Adds the weights on one side of the mode; picks the first at which the sum reaches ``wanted``."""

        def step(acc: Column, i: Column) -> Column:
            x = s["mode"] + (i - 1 if rising else -(i - 1))
            ratio = (k - x) * (d - x) / ((x + 1) * (n - k - d + x + 1)) if rising else x * (n - k - d + x) / ((k - x + 1) * (d - x + 1))
            weight = acc["weight"] * ratio
            total = acc["total"] + weight
            at = x + (1 if rising else -1)
            pick = acc["pick"] if wanted is None else F.when(acc["pick"].isNull() & (total >= wanted), at).otherwise(acc["pick"])
            return F.struct(weight.alias("weight"), total.alias("total"), pick.alias("pick"))

        many = s["up"] if rising else s["down"]
        return F.when(many > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(many, F.lit(1))), state, step)).otherwise(state)

    def state(total: Column, pick: Column) -> Column:
        return F.struct(F.lit(1.0).alias("weight"), total.alias("total"), pick.cast("double").alias("pick"))

    def drawn(s: Column) -> Column:
        none = F.lit(None).cast("double")
        upper = walk(s, True, state(F.lit(1.0), none), None)
        mass = walk(s, False, state(upper["total"], none), None)["total"]
        wanted = u * mass
        first = F.when(wanted <= 1.0, s["mode"])
        risen = walk(s, True, state(F.lit(1.0), first), wanted)
        fallen = walk(s, False, state(risen["total"], risen["pick"]), wanted)
        return F.coalesce(fallen["pick"], s["mode"]).cast("long")

    return F.transform(F.array(start), drawn)[0]


def split_quotas(root: DataFrame, levels: int) -> DataFrame:
    """(shard, quotas, starts): the blocks of each source that each of 2**levels shards gets, and how many the shards before it get.

    ``root`` has one row with ``quotas``, the blocks of each source in order.
    Half of a node's blocks go left: source after source, a hypergeometric draw
    from what is left of the node and of the left half.
    """
    tree = root.select(F.lit(0).cast("long").alias("shard"), "quotas", F.transform("quotas", lambda q: F.lit(0).cast("long")).alias("starts"))
    for level in range(levels):
        total = F.aggregate("quotas", F.lit(0).cast("long"), lambda a, q: a + q)
        start = F.struct(total.alias("population"), F.floor((total + F.pmod(F.col("shard"), F.lit(2))) / 2).alias("room"), F.array().cast("array<bigint>").alias("left"))
        node = F.col("shard") + (1 << level)

        def give(acc: Column, q: Column) -> Column:  # noqa: B023
            took = hypergeometric(_uniform(node, F.size(acc["left"])), acc["population"], q, acc["room"])
            return F.transform(F.array(took), lambda t: F.struct((acc["population"] - q).alias("population"), (acc["room"] - t).alias("room"), F.concat(acc["left"], F.array(t)).alias("left")))[0]

        tree = tree.withColumn("left", F.aggregate("quotas", start, give)["left"])
        right = F.zip_with("quotas", "left", lambda q, t: q - t)
        # Each level is written: its expressions are long, and all levels in one plan would weigh on the driver.
        after = F.zip_with("starts", "left", lambda a, t: a + t)
        halves = F.array(F.struct((F.col("shard") * 2).alias("shard"), F.col("left").alias("quotas"), "starts"), F.struct((F.col("shard") * 2 + 1).alias("shard"), right.alias("quotas"), after.alias("starts")))
        tree = stash(tree.select(F.inline(halves)), "tree")
    return tree


def targets(sizes: DataFrame) -> DataFrame:
    """Adds ``target`` to a table of sources (source, source_size): weights share all sizes, the excess over the limit is reshared.

    Resharing until none is above ends where every source has the lesser of its
    limit and one common level times its weight; that level comes from running
    sums over the sources in the order in which they reach their limits.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    weighted = sizes.withColumn("place", F.row_number().over(order) - 1)
    weighted = weighted.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod("place", F.lit(len(WEIGHTS))) + 1).cast("int")))
    reach = MOST_PASSES * F.col("source_size") / F.col("weight")
    by_reach = Window.orderBy("reach", "place")
    everything = Window.partitionBy()
    held = weighted.withColumn("reach", reach)
    held = held.withColumns({"full": F.sum("source_size").over(by_reach) - F.col("source_size"), "spent": F.sum("weight").over(by_reach) - F.col("weight"), "step": F.row_number().over(by_reach), "all": F.sum("source_size").over(everything), "weights": F.sum("weight").over(everything)})
    level = (F.col("all") - MOST_PASSES * F.col("full")) / (F.col("weights") - F.col("spent"))
    held = held.withColumn("level", level)
    held = held.withColumn("level", F.min(F.when(F.col("level") <= F.col("reach"), F.struct("step", "level"))).over(everything)["level"])
    return held.select(*sizes.columns, "place", F.least(MOST_PASSES * F.col("source_size").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def mixed(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, source, other columns) with size, source_size, target, taken and ``draws``.

    ``draws`` has a struct (pass, shard, words) for each time a document is
    taken, in whole but for at most one document per source, whose last draw is
    its first words only.  A null text has size 0; null sources form one
    source, last in order.  Repeated rows count and are drawn as rows of their
    own.  A source without words has target 0.  Very long texts are counted whole;
    no rows give no rows.
    """
    return _drawn(_sized(docs))


def _sized(docs: DataFrame) -> DataFrame:
    plain = docs.withColumn("size", F.size(words_of(F.coalesce("text", F.lit("")))).cast("long"))
    # Rows are dealt by id and text, so that rows without id spread too.
    plain = plain.withColumn("_pick", F.xxhash64(F.lit(SEED), "doc_id", "text"))
    return plain.withColumn("_key", F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source")))


def _drawn(plain: DataFrame) -> DataFrame:
    light = stash(plain.select("source", "_key", "size", "_pick"), "sizes")
    sizes = light.groupBy("_key", "source").agg(F.sum("size").cast("long").alias("source_size"), F.count("*").alias("docs"))
    sources = targets(sizes).withColumns({"want": F.floor(F.col("target") + 0.5), "blocks": F.ceil(F.col("docs") / BLOCK_DOCS)})
    sources = sources.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("want") / F.greatest("source_size", F.lit(1)))).otherwise(F.lit(0)))
    sources = stash(sources.withColumn("rest", F.col("want") - F.col("whole") * F.col("source_size")), "sources")
    per_source = sources.select("_key", "source_size", "target", "blocks", "whole", "rest", "place")

    block = F.pmod("_pick", F.col("blocks"))
    heap = light.join(per_source, "_key").groupBy("_key", "place", "rest", "whole", block.alias("block")).agg(F.sum("size").cast("long").alias("words"))
    at = F.xxhash64(F.lit(SEED), "_key", "block")
    heap = stash(heap.withColumns({"order": at, "part": F.shiftrightunsigned(at, 64 - PART_BITS)}), "heap")
    parts = heap.groupBy("_key", "part").agg(F.sum("words").alias("part_words"), F.count("*").alias("part_blocks"))
    earlier, source = Window.partitionBy("_key").orderBy("part").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("_key")
    parts = parts.withColumns({"held": F.sum("part_blocks").over(source), "words_ahead": F.sum("part_words").over(earlier) - F.col("part_words"), "blocks_ahead": F.sum("part_blocks").over(earlier) - F.col("part_blocks")}).drop("part_words", "part_blocks")
    permuted = Window.partitionBy("_key", "part").orderBy("order", "block")
    heap = heap.join(parts, ["_key", "part"]).withColumns({"rank": F.col("blocks_ahead") + F.row_number().over(permuted) - 1, "before": F.col("words_ahead") + F.sum("words").over(permuted) - F.col("words")})
    heap = stash(heap.withColumn("partial", (F.col("before") < F.col("rest")).cast("int")).drop("words_ahead", "blocks_ahead", "order", "part"), "blocks")

    total = sources.agg(F.coalesce(F.sum("want"), F.lit(0))).first()[0]
    levels = max(0, -(-int(total) // SHARD_WORDS) - 1).bit_length()
    quotas = heap.groupBy("_key", "place").agg((F.sum("partial") + F.max(F.col("whole") * F.col("held"))).alias("quota"))
    # Draws of a source are looked up by stretches of about the length that a shard takes of it.
    quotas = stash(quotas.withColumn("wide", F.greatest(F.floor(F.col("quota") / 2**levels), F.lit(1))), "quotas")
    root = quotas.agg(F.sort_array(F.collect_list(F.struct("place", "_key", "quota", "wide"))).alias("s")).select("s", F.transform("s", lambda x: x["quota"].cast("long")).alias("quotas"))
    keys = root.select(F.posexplode("s").alias("i", "x")).select("i", F.col("x._key").alias("_key"), F.col("x.wide").alias("wide"))
    given = split_quotas(root.select("quotas"), levels).select("shard", F.posexplode(F.arrays_zip("quotas", "starts")).alias("i", "x")).where("x.quotas > 0")
    given = given.join(keys, "i").select("_key", "wide", "shard", F.col("x.starts").alias("from"), (F.col("x.starts") + F.col("x.quotas")).alias("to"))
    given = given.withColumn("stretch", F.explode(F.sequence(F.floor(F.col("from") / F.col("wide")), F.floor((F.col("to") - 1) / F.col("wide"))))).drop("wide")

    # Draws of a block: each whole pass, then the partial one, by its place in the source's sequence of draws.
    passes = heap.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole")))).where("pass < whole or partial = 1")
    passes = passes.join(quotas.select("_key", "wide"), "_key").withColumn("at", F.col("held") * F.col("pass") + F.col("rank")).withColumn("stretch", F.floor(F.col("at") / F.col("wide")))
    passes = passes.join(given, ["_key", "stretch"]).where((F.col("at") >= F.col("from")) & (F.col("at") < F.col("to")))
    drawn = stash(passes.groupBy("_key", "block", "before").agg(F.sort_array(F.collect_list(F.struct("pass", "shard"))).alias("passes")), "draws")

    rows = plain.join(per_source.drop("place"), "_key").withColumn("_block", block)
    inside = Window.partitionBy("_key", "_block").orderBy(F.xxhash64(F.lit(SEED + 1), "_pick"), "doc_id", "size")
    # Rows with one id and text stand apart by their number.
    rows = rows.withColumn("_ahead", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    rows = rows.join(drawn.withColumnRenamed("block", "_block"), ["_key", "_block"], "left")
    start = F.coalesce("before", F.lit(0)) + F.col("_ahead")
    words = F.least(F.greatest(F.col("rest") - start, F.lit(0)), F.col("size"))
    draws = F.transform(F.coalesce("passes", F.array().cast("array<struct<pass:bigint,shard:bigint>>")), lambda p: F.struct(p["pass"].alias("pass"), p["shard"].alias("shard"), F.when(p["pass"] < F.col("whole"), F.col("size")).otherwise(words).alias("words")))
    draws = F.filter(draws, lambda x: x["words"] > 0)
    rows = rows.withColumn("draws", draws)
    return rows.withColumn("taken", F.aggregate("draws", F.lit(0).cast("long"), lambda a, x: a + x["words"])).drop("_key", "_pick", "_block", "_ahead", "blocks", "whole", "rest", "before", "passes")


def mix_report(docs: DataFrame) -> DataFrame:
    """What the mix takes of each document: doc_id, size, source_size, target, taken, shards (of each draw, in order)."""
    return mixed(docs.select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken", F.transform("draws", lambda x: x["shard"]).alias("shards"))


def mix(docs: DataFrame) -> DataFrame:
    """The mix itself: a row for each time a document is taken, by shard, shuffled inside each shard.

    A last draw of part of a document has its first words, one blank apart.  Nulls,
    repeats and ties as in :func:`mixed`; columns may have any names.
    """
    # Each text is shuffled once under its own name, not a second time beside it.
    rows = _drawn(_sized(set_aside(docs, "doc_id", "text", "source")).drop("text")).withColumn("_draw", F.explode("draws"))
    text = F.col("_in_text")
    partial = F.col("_draw.words") < F.col("size")
    first = F.array_join(F.slice(words_of(F.coalesce(text, F.lit(""))), F.lit(1), F.col("_draw.words").cast("int")), " ")
    changed = {"text": F.when(partial, first).otherwise(text)}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(partial, F.length(first)).otherwise(F.col("_in_n_chars"))
    rows = rows.repartition("_draw.shard", F.pmod(F.xxhash64("doc_id", "_draw.pass"), F.lit(4))).sortWithinPartitions("_draw.shard", F.xxhash64(F.lit(SEED + 2), "doc_id", "_draw.pass"))
    return restored(rows, docs, **changed)
