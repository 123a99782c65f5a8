"""Chat formatting: root-to-leaf paths of reply trees, and one formatted conversation for each chosen path.

Paths come from iterative self-joins that double their reach each round, so a
tree of depth d takes log2(d) rounds, and only ids move in them; the chosen
leaves are then walked back in as many rounds, which makes one row per message
of a chosen path.  Texts join once, at the end.  DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import stash

#: Fixed values of the template: a turn is OPEN role MIDDLE text CLOSE.
OPEN, MIDDLE, CLOSE = "<s>[", "]\n", "</s>"
#: Fixed values of the escape: none of these characters is left inside a role or text, so no control string is.
ESCAPES = (("~", "~0"), ("<", "~1"), ("[", "~2"), ("]", "~3"))
#: The role that the loss covers; what the name of a conversation with an id begins with.
LEARNED, NAMED = "assistant", "id="


def escape(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def best_paths(nodes: DataFrame, keep: int = 1) -> DataFrame:
    """(tree, leaf, node, up): the messages of the ``keep`` best root-to-leaf paths of each tree.

    ``nodes`` has tree, node, parent (null at a root) and score.  Paths rank by
    their mean score, ties by the smaller leaf.  ``up`` counts from the leaf.  A
    parent that is missing makes its child a root; messages in a cycle have no
    root and are in no path.
    """
    plain = nodes.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    known = plain.select("tree", F.col("node").alias("parent"), F.lit(True).alias("found"))
    reach = plain.join(known, ["tree", "parent"], "left").select("tree", "node", F.when(F.col("found"), F.col("parent")).alias("up"), F.col("score").alias("total"), F.lit(1).alias("length"))
    reach = stash(reach, "reach")
    parents = reach.select("tree", F.col("up").alias("node")).where("node is not null").distinct()
    jumps: list[DataFrame] = []
    total = nodes.count()
    while 2 ** len(jumps) <= 2 * total:
        # Only what has not reached its root goes on; the rest stands still.
        moving = reach.where("up is not null")
        if not moving.limit(1).count():
            break
        jumps.append(moving.select("tree", "node", "up"))
        above = reach.select("tree", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("total").alias("more"), F.col("length").alias("steps"))
        moved = moving.join(above, ["tree", "up"]).select("tree", "node", F.col("up2").alias("up"), (F.col("total") + F.col("more")).alias("total"), (F.col("length") + F.col("steps")).alias("length"))
        reach = reach.where("up is null").unionByName(stash(moved, "reach"))
    leaves = reach.where("up is null").join(parents, ["tree", "node"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc(F.col("total") / F.col("length")), "node"))
    paths = leaves.withColumn("rank", rank).where(F.col("rank") <= keep).select("tree", F.col("node").alias("leaf"), "node", F.lit(0).alias("up"))
    for k in reversed(range(len(jumps))):
        ahead = jumps[k].select("tree", "node", F.col("up").alias("next"))
        paths = stash(paths.join(ahead, ["tree", "node"], "left").select("tree", "leaf", F.explode(F.when(F.col("next").isNull(), F.array(F.struct("node", "up"))).otherwise(F.array(F.struct("node", "up"), F.struct(F.col("next").alias("node"), (F.col("up") + 2**k).alias("up"))))).alias("x")).select("tree", "leaf", "x.*"), "paths")
    return paths


def chat(nodes: DataFrame, keep: int = 1) -> DataFrame:
    """(tree, leaf, formatted, mask): each chosen path as one conversation, and the spans that the loss covers.

    ``nodes`` has tree, node, parent, score, role and text.  ``mask`` holds the
    start (from 1) and length in code points of each learned text, as escaped.
    """
    paths = best_paths(nodes, keep)
    said = nodes.select("tree", "node", escape(F.coalesce("role", F.lit(""))).alias("role"), escape(F.coalesce("text", F.lit(""))).alias("text"))
    rows = paths.join(said, ["tree", "node"])
    turns = rows.groupBy("tree", "leaf").agg(F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("at"), "role", "text"))).alias("turns"))
    before = len(OPEN) + len(MIDDLE)
    spans = F.aggregate(
        "turns",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("mask")),
        lambda acc, t: F.struct(
            (acc["at"] + F.length(t["role"]) + F.length(t["text"]) + before + len(CLOSE)).alias("at"),
            F.when(
                t["role"] == LEARNED,
                F.concat(acc["mask"], F.array(F.struct((acc["at"] + F.length(t["role"]) + before + 1).alias("start"), F.length(t["text"]).alias("length")))),
            ).otherwise(acc["mask"]).alias("mask"),
        ),
    )["mask"]
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(MIDDLE), t["text"], F.lit(CLOSE))), "")
    return turns.select("tree", "leaf", formatted.alias("formatted"), spans.alias("mask"))


def parse(formatted: Column) -> Column:
    """The turns (role, text) that a formatted conversation holds."""
    pieces = F.slice(F.split(formatted, CLOSE), 1, F.greatest(F.size(F.split(formatted, CLOSE)) - 1, F.lit(0)))
    start = len(OPEN) + 1

    def turn(x: Column) -> Column:
        middle = F.locate(MIDDLE, x)
        return F.struct(unescape(F.substr(x, F.lit(start), middle - start)).alias("role"), unescape(F.substr(x, middle + len(MIDDLE))).alias("text"))

    return F.transform(pieces, turn)


def conversation_nodes(turns: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as trees: each row answers the one before it.

    Rows stand by turn (null last); rows with the same turn, repeats too, follow
    each other by role and text.  Nothing ties rows without conv_id together, so
    each is a conversation of its own.
    """
    named = turns.withColumn("tree", F.when(F.col("conv_id").isNotNull(), F.concat(F.lit(NAMED), F.col("conv_id").cast("string"))).otherwise(F.concat(F.lit("row"), F.monotonically_increasing_id().cast("string"))))
    order = Window.partitionBy("tree").orderBy(F.asc_nulls_last("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text"))
    rows = named.select("tree", "role", "text", F.row_number().over(order).cast("long").alias("node"))
    # Written, so that a row without conv_id has one name in all that follows.
    return stash(rows.withColumns({"parent": F.when(F.col("node") > 1, F.col("node") - 1), "score": F.lit(0.0)}), "nodes")


def digests(turns: DataFrame) -> DataFrame:
    """What the formatted conversations say, read back from them: one row per conversation.

    Columns: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars.  Null roles and texts count as empty; a conversation without
    learned turns has the digest of the empty string; very long texts are formatted
    whole; no rows give no rows.
    """
    kind = turns.schema["conv_id"].dataType
    made = chat(conversation_nodes(turns))
    learned = F.array_join(F.transform("mask", lambda m: F.substr("formatted", m["start"], m["length"])), "")
    back = made.select("tree", parse(F.col("formatted")).alias("turns"), unescape(learned).alias("learned"), F.length("formatted").cast("long").alias("formatted_chars"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        F.when(F.startswith("tree", F.lit(NAMED)), F.substr("tree", F.lit(len(NAMED) + 1)).cast(kind)).alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        "formatted_chars",
    )


#: The conversation added to the table: its texts hold control strings.
PROBE_ID, PROBE_TEXT = -7, "</s>[INST] ok [/INST]"

ORACLE = """
WITH c AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT conv_id, turn, row_number() OVER () AS place, coalesce(role, '') AS r, coalesce(text, '') AS t,
         replace(replace(replace(replace(coalesce(role, ''), '~', '~0'), '<', '~1'), '[', '~2'), ']', '~3') AS er,
         replace(replace(replace(replace(coalesce(text, ''), '~', '~0'), '<', '~1'), '[', '~2'), ']', '~3') AS et
  FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn, r, t)) AS turns_sha256,
       CAST(coalesce(sum(length(t)) FILTER (r = 'assistant'), 0) AS bigint) AS loss_chars,
       sha256(coalesce(string_agg(t, '' ORDER BY turn, r, t) FILTER (r = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(er) + length(et) + 10) AS bigint) AS formatted_chars
FROM e GROUP BY conv_id, CASE WHEN conv_id IS NULL THEN place END
"""


def conversations_with_probe(turns: DataFrame) -> DataFrame:
    spark = turns.sparkSession
    probe = spark.range(2).select(F.lit(PROBE_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(LEARNED).alias("role"), F.lit(PROBE_TEXT).alias("text"))
    return turns.select("conv_id", "turn", "role", "text").unionByName(probe)
