"""Quality rules: distribution divergence of a document from its language, beside plain counting rules.

Two histograms of each text, of character classes and of the common words of its
language, are compared with the language's own by the Jensen-Shannon distance
(base 2, 0 to 1).  A language's common words are those counted most often in all
its documents, and its histograms are summed over the documents that pass the
counting rules, less the document that is compared.  Texts under a least length have
too little mass for that and are judged by the counting rules alone.
DataFrame operations only; texts are read once for the words and once for the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import BLANKS, only, restored, set_aside, stash, words_of

#: Common words of a language.
COMMON = 24
#: Least words of a text; most words in repeated windows, in percent of all.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Least words for a verdict on the histograms, and the greatest distance of each that is kept.
GUARD_WORDS, MOST_CHARS, MOST_WORDS = 50, 0.30, 0.45
#: Hashes found twice in a text up to which its windows are looked up among them.
FEW = 16

#: Character classes after a-z and blanks, taken out of a text one after the other; what is left, beyond ASCII, is the last class.
CLASSES = (r"[A-Z]+", r"[.,;:?!'\x22()-]+", r"[#*$%&|<>]+", r"[0-9]+", r"[\x00-\x7F]+")
#: Place of the symbols' class in a histogram, and how many classes there are.
SYMBOLS, N_CLASSES = 4, len(CLASSES) + 3


def _char_counts(text: Column, word_chars: Column) -> Column:
    """Code points of each class: each is taken out of what the ones before left, so later patterns see short texts."""

    def taken(left: Column, patterns: tuple[str, ...], found: list[Column]) -> Column:
        if not patterns:
            return F.array(*[c.cast("double") for c in (*found, F.length(left))])
        rest = F.array(F.regexp_replace(left, patterns[0], ""))
        return F.transform(rest, lambda r: taken(r, patterns[1:], [*found, F.length(left) - F.length(r)]))[0]

    # Letters and blanks go together, in long runs.
    blanks = F.length(text) - word_chars
    first = F.array(F.regexp_replace(text, r"[a-z\x20\x09-\x0D]+", ""))
    return F.transform(first, lambda r: taken(r, CLASSES, [F.length(text) - F.length(r) - blanks, blanks]))[0]


def _word_counts(words: Column, listed: Column, longest: Column) -> Column:
    """How often each of the listed words occurs, the longest of ``longest`` code points (no word's lower case has fewer than itself), and the number of other words."""

    def count(held: Column, w: Column) -> Column:
        left = F.octet_length(F.replace(held, F.concat(F.lit(" "), w, F.lit(" ")), F.lit("")))
        return ((F.octet_length(held) - left) / (F.octet_length(w) + 2)).cast("double")

    # Most words are longer than any listed one, which takes less time to see.
    short = F.filter(words, lambda x: F.length(x) <= longest)
    there = F.filter(short, lambda x: F.array_contains(listed, F.lower(x)))
    spaced = F.concat(F.lit(" "), F.lower(F.array_join(there, "  ")), F.lit(" "))
    # The outer lambda makes the spaced text once for all words.
    hits = F.transform(F.array(spaced), lambda held: F.transform(listed, lambda w: count(held, w)))[0]
    return F.transform(F.array(hits), lambda h: F.concat(h, F.array(F.size(words) - F.aggregate(h, F.lit(0.0), lambda a, x: a + x))))[0]


def common_words(docs: DataFrame, most: int = COMMON) -> DataFrame:
    """(ref_lang, listed): the words, in lower case, that all documents (text, lang) of a language hold most often; ties by the word."""
    words = docs.select("lang", F.explode(words_of(F.lower("text"))).alias("word")).groupBy("lang", "word").count()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), "word"))
    top = words.withColumn("rank", rank).where(F.col("rank") <= most)
    lists = top.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("rank", "word"))).alias("top"))
    return lists.select(F.col("lang").alias("ref_lang"), F.transform("top", lambda x: x["word"]).alias("listed"))


def _bit(h: Column) -> Column:
    """One of 64 bits for a hash."""
    return F.element_at(F.array(*[F.lit(1 << k if k < 63 else -(1 << 63)) for k in range(64)]), (h.bitwiseAND(F.lit(63)) + 1).cast("int"))


def measured(docs: DataFrame, listed: DataFrame) -> DataFrame:
    """``docs`` (text, lang, other columns) with the counting rules and both histograms, ``_chars`` and ``_common``."""
    held = docs.join(listed, F.col("lang").eqNullSafe(F.col("ref_lang")), "left").withColumn("_text", F.coalesce("text", F.lit("")))
    held = held.withColumn("_words", words_of(F.col("_text")))
    n = F.size("_words")
    bare = F.col("_text")
    for blank in BLANKS:
        bare = F.replace(bare, F.lit(blank), F.lit(""))
    lines = F.filter(F.split("_text", "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    listed = F.coalesce("listed", F.array().cast("array<string>"))
    longest = F.coalesce(F.array_max(F.transform(listed, lambda x: F.length(x))), F.lit(0))
    held = held.withColumns({"_hashes": F.transform("_words", lambda w: F.xxhash64(w)), "_lines": lines, "word_chars": F.length(bare).cast("long"), "_listed": listed, "_longest": longest})
    pairs = F.zip_with("_hashes", F.slice("_hashes", F.lit(2), F.greatest(n, F.lit(0))), lambda a, b: F.xxhash64(a, b))
    runs = F.slice(F.zip_with(pairs, F.slice("_hashes", F.lit(3), F.greatest(n, F.lit(0))), lambda a, b: F.xxhash64(a, b)), F.lit(1), F.greatest(n - 2, F.lit(0)))
    held = held.withColumns({"_runs": runs, "_chars": _char_counts(F.col("_text"), F.col("word_chars"))})
    # Windows found twice or more: neighbours among the sorted hashes. Few such hashes are looked up in each window's place, many are sorted with the places.
    repeats = F.size(F.array_distinct("_runs")) < F.size("_runs")
    held = held.withColumn("_sorted", F.when(repeats, F.sort_array("_runs")).otherwise(F.array().cast("array<bigint>")))
    held = held.withColumn("_twice", F.array_distinct(F.filter("_sorted", lambda h, k: (k > 0) & (F.get("_sorted", k - 1) == h))))
    held = held.withColumn("_mask", F.aggregate("_twice", F.lit(0).cast("long"), lambda m, h: m.bitwiseOR(_bit(h))))
    places = F.when(F.size("_twice") <= FEW, F.array().cast("array<struct<h:bigint,i:int>>")).otherwise(F.sort_array(F.transform("_runs", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    held = held.withColumn("_places", places)
    many = F.transform(
        F.filter("_places", lambda e, k: ((k > 0) & (F.get("_places", k - 1)["h"] == e["h"])) | F.coalesce(F.get("_places", k + 1)["h"] == e["h"], F.lit(False))),
        lambda e: e["i"],
    )
    few = F.filter(F.transform("_runs", lambda h, i: F.when((F.col("_mask").bitwiseAND(_bit(h)) != 0) & F.array_contains("_twice", h), i)), lambda i: i.isNotNull())
    twice = F.when(F.size("_twice") == 0, F.array().cast("array<int>")).when(F.size("_twice") <= FEW, few).otherwise(many)
    covered = F.size(F.array_distinct(F.flatten(F.transform(twice, lambda i: F.array(i, i + 1, i + 2)))))
    held = held.withColumns(
        {
            "n_words": n.cast("long"),
            "n_symbols": F.col("_chars")[SYMBOLS].cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": covered.cast("long"),
            "_common": _word_counts(F.col("_words"), F.col("_listed"), F.col("_longest")),
        }
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return held.withColumn("base_failed", failed).drop("_text", "_words", "_hashes", "_runs", "_lines", "_sorted", "_twice", "_mask", "_places", "_listed", "_longest", "ref_lang", "listed")


def references(held: DataFrame) -> DataFrame:
    """One row per language: the histograms of its documents that pass the counting rules, summed. Counts are whole numbers, so any order gives the same sums."""
    chars = [F.sum(F.col("_chars")[i]).alias(f"c{i}") for i in range(N_CLASSES)]
    common = [F.sum(F.get("_common", F.lit(i))).alias(f"w{i}") for i in range(COMMON + 1)]
    sums = held.where("not base_failed").groupBy("lang").agg(F.max(F.size("_common")).alias("wide"), *chars, *common)
    return sums.select(F.col("lang").alias("ref_lang"), F.array(*[f"c{i}" for i in range(N_CLASSES)]).alias("ref_chars"), F.slice(F.array(*[f"w{i}" for i in range(COMMON + 1)]), F.lit(1), F.col("wide")).alias("ref_common"))


def distance(a: Column, b: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two arrays of counts; 0 where one has no mass."""

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))

    def part(p: Column, m: Column) -> Column:
        return F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0))

    ta, tb = total(a), total(b)
    pairs = F.zip_with(a, b, lambda x, y: F.struct((F.coalesce(x, F.lit(0.0)) / ta).alias("p"), (F.coalesce(y, F.lit(0.0)) / tb).alias("q")))
    terms = F.aggregate(pairs, F.lit(0.0), lambda s, z: s + 0.5 * part(z["p"], (z["p"] + z["q"]) / 2) + 0.5 * part(z["q"], (z["p"] + z["q"]) / 2))
    return F.when((ta > 0) & (tb > 0), F.sqrt(F.greatest(terms, F.lit(0.0)))).otherwise(F.lit(0.0))


def judged(docs: DataFrame) -> DataFrame:
    """``docs`` (text, lang and any other columns) with the counts and the verdict ``kept``, but without the text.

    A null text is empty.  A null language is a language of its own.  A document
    whose language no other has, or only documents that fail the counting rules,
    has no reference and is judged by those rules.  Very long texts are measured
    whole.  Repeated rows are each judged; no rows give no rows.
    """
    listed = stash(common_words(docs.where(F.col("text").isNotNull())), "words")
    held = stash(measured(docs, listed).drop("text"), "measured", codec="zstd")
    held = held.join(stash(references(held), "references"), F.col("lang").eqNullSafe(F.col("ref_lang")), "left")

    def others(reference: str, own: str) -> Column:
        return F.when(F.col("base_failed"), F.col(reference)).otherwise(F.zip_with(reference, own, lambda r, x: r - x))

    held = held.withColumns({"char_distance": distance(F.col("_chars"), others("ref_chars", "_chars")), "word_distance": distance(F.col("_common"), others("ref_common", "_common"))})
    far = (F.col("n_words") >= GUARD_WORDS) & ((F.col("char_distance") > MOST_CHARS) | (F.col("word_distance") > MOST_WORDS))
    return held.withColumn("kept", ~F.col("base_failed") & ~far).drop("_chars", "_common", "ref_lang", "ref_chars", "ref_common")


def verdicts(docs: DataFrame) -> DataFrame:
    """One row per document: its counts, distances and verdict."""
    return judged(docs.select("doc_id", "text", "lang")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("char_distance", 6).alias("char_distance"), F.round("word_distance", 6).alias("word_distance"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with the columns they came with, whatever their names."""
    return restored(only(judged(set_aside(docs, "text", "lang")), "kept"), docs)


def oracle() -> str:
    """The same counts and verdicts in SQL."""
    classes, steps = [], []
    for k, pattern in enumerate((r"[a-z]+", r"[\x20\x09-\x0D]+", *CLASSES)):
        quoted = pattern.replace("'", "''").replace(r"\x22", '"')
        steps.append(f"c{k} AS (SELECT *, regexp_replace(r{k}, '{quoted}', '', 'g') AS r{k + 1} FROM {'w' if k == 0 else f'c{k - 1}'})")
        classes.append(f"length(r{k}) - length(r{k + 1})")
    last = len(CLASSES) + 2
    chars = ", ".join([*classes, f"length(r{last})"])
    return rf"""
WITH x AS (
  SELECT doc_id, lang, coalesce(text, '') AS r0, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
e AS (SELECT lang, word, count(*) AS c FROM (SELECT lang, unnest(list_filter(string_split_regex(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS word FROM documents) GROUP BY ALL),
g AS (SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY c DESC, word) AS rank FROM e),
top AS (SELECT lang, list(word ORDER BY rank) AS listed FROM g WHERE rank <= {COMMON} GROUP BY lang),
w AS (SELECT doc_id, x.lang, r0, w, coalesce(listed, []) AS listed FROM x LEFT JOIN top ON x.lang IS NOT DISTINCT FROM top.lang),
{", ".join(steps)},
h AS (
  SELECT doc_id, lang, r0, w, [{chars}] AS ch,
         list_transform(listed, lambda v: len(list_filter(w, lambda x: lower(x) = v))) AS hits
  FROM c{last - 1}),
t AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM h WHERE len(w) >= 3),
t2 AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM t),
t3 AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM t2 WHERE c > 1) GROUP BY doc_id),
k AS (SELECT h.*, list_append(hits, len(w) - coalesce(list_sum(hits), 0)) AS cw, coalesce(t3.n, 0) AS repeated,
             len(w) < {LEAST_WORDS} OR 100 * coalesce(t3.n, 0) > {MOST_REPEATED} * len(w) AS base_failed FROM h LEFT JOIN t3 USING (doc_id)),
m AS (SELECT doc_id, lang, base_failed, unnest(ch) AS v, generate_subscripts(ch, 1) AS i FROM k),
n AS (SELECT doc_id, lang, base_failed, unnest(cw) AS v, generate_subscripts(cw, 1) AS i FROM k),
b AS (SELECT 'c' AS side, * FROM m UNION ALL SELECT 'w', * FROM n),
r AS (SELECT side, lang, i, sum(v) AS q FROM b WHERE NOT base_failed GROUP BY ALL),
o AS (SELECT side, doc_id, v, q - CASE WHEN base_failed THEN 0 ELSE v END AS q FROM b JOIN r USING (side, i) WHERE b.lang IS NOT DISTINCT FROM r.lang),
p AS (SELECT side, doc_id, CAST(v AS double) / nullif(sum(v) OVER (PARTITION BY side, doc_id), 0) AS p, CAST(q AS double) / nullif(sum(q) OVER (PARTITION BY side, doc_id), 0) AS q FROM o),
d AS (
  SELECT doc_id, max(CASE WHEN side = 'c' THEN js END) AS dc, max(CASE WHEN side = 'w' THEN js END) AS dw FROM (
    SELECT side, doc_id, sqrt(greatest(coalesce(sum(0.5 * CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + 0.5 * CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) FILTER (p IS NOT NULL AND q IS NOT NULL), 0), 0)) AS js
    FROM p GROUP BY ALL) GROUP BY doc_id)
SELECT k.doc_id, CAST(len(w) AS bigint) AS n_words, CAST(length(array_to_string(w, '')) AS bigint) AS word_chars,
       CAST(length(r0) - length(regexp_replace(r0, '[#*$%&|<>]', '', 'g')) AS bigint) AS n_symbols,
       CAST(len(list_filter(string_split(r0, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(r0, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS bigint) AS n_dup_lines,
       CAST(repeated AS bigint) AS n_repeat_words, base_failed,
       NOT base_failed AND NOT (len(w) >= {GUARD_WORDS} AND (coalesce(dc, 0) > {MOST_CHARS} OR coalesce(dw, 0) > {MOST_WORDS})) AS kept,
       round(coalesce(dc, 0), 6) AS char_distance, round(coalesce(dw, 0), 6) AS word_distance
FROM k LEFT JOIN d ON k.doc_id = d.doc_id
"""
