"""Language identification by Bayesian evidence fusion.

A record's language gets the product of four kinds of evidence: the likelihood
of its text under each language's hashed byte 4-grams, of the language that its
markup declares, of its address suffix, and a prior from its host.  The
likelihood tables and priors are grouped aggregates over all records of what
the texts alone say; a host's prior is smoothed towards its domain's and that
towards the whole corpus's, and leaves the record itself out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import batched, only, restored, set_aside, stash
from .textkit import LOWER, SEPARATOR, pieces, utf8

#: Texts that the text model is fitted on, about, dealt evenly among the languages, and the least bound for one language; hash buckets of 4-grams.
SAMPLE, EACH, BUCKETS = 4000, 200, 1 << 16
#: A declared name that may be one of a language: two or three letters, whatever follows a hyphen.
NAME = r"^([a-z]{2,3})(?:[-_].*)?$"
#: Two-letter names of languages, each with its three-letter name; other names of some of them; languages with a three-letter name only.
PAIRS = "aa:aar ab:abk ae:ave af:afr ak:aka am:amh an:arg ar:ara as:asm av:ava ay:aym az:aze ba:bak be:bel bg:bul bi:bis bm:bam bn:ben bo:bod br:bre bs:bos ca:cat ce:che ch:cha co:cos cr:cre cs:ces cu:chu cv:chv cy:cym da:dan de:deu dv:div dz:dzo ee:ewe el:ell en:eng eo:epo es:spa et:est eu:eus fa:fas ff:ful fi:fin fj:fij fo:fao fr:fra fy:fry ga:gle gd:gla gl:glg gn:grn gu:guj gv:glv ha:hau he:heb hi:hin ho:hmo hr:hrv ht:hat hu:hun hy:hye hz:her ia:ina id:ind ie:ile ig:ibo ii:iii ik:ipk io:ido is:isl it:ita iu:iku ja:jpn jv:jav ka:kat kg:kon ki:kik kj:kua kk:kaz kl:kal km:khm kn:kan ko:kor kr:kau ks:kas ku:kur kv:kom kw:cor ky:kir la:lat lb:ltz lg:lug li:lim ln:lin lo:lao lt:lit lu:lub lv:lav mg:mlg mh:mah mi:mri mk:mkd ml:mal mn:mon mr:mar ms:msa mt:mlt my:mya na:nau nd:nde ne:nep ng:ndo nl:nld no:nor nr:nbl nv:nav ny:nya oc:oci oj:oji om:orm or:ori os:oss pa:pan pi:pli pl:pol ps:pus pt:por qu:que rm:roh rn:run ro:ron ru:rus rw:kin sa:san sc:srd sd:snd se:sme sg:sag si:sin sk:slk sl:slv sm:smo sn:sna so:som sq:sqi sr:srp ss:ssw st:sot su:sun sv:swe sw:swa ta:tam te:tel tg:tgk th:tha ti:tir tk:tuk tl:tgl tn:tsn to:ton tr:tur ts:tso tt:tat tw:twi ty:tah ug:uig uk:ukr ur:urd uz:uzb ve:ven vi:vie vo:vol wa:wln wo:wol xh:xho yi:yid yo:yor za:zha zh:zho zu:zul"
OTHER = "alb:sq arm:hy baq:eu bur:my chi:zh cze:cs dut:nl fre:fr geo:ka ger:de gre:el ice:is mac:mk mao:mi may:ms per:fa rum:ro slo:sk tib:bo wel:cy nb:no nn:no nob:no nno:no iw:he in:id ji:yi jw:jv mo:ro cmn:zh arb:ar pes:fa prs:fa zsm:ms lvs:lv ekk:et fil:tl swh:sw"
ALONE = "ace arz ast awa azb bar bcl bho bjn ceb chr ckb dsb gsw haw hil hmn hsb ilo kab lmo lus mai mhr min mni nap nds new nso pag pam pap pcd pms pnb sah sat scn sco shn szl tpi tum vec war wuu xmf yue"
#: 4-grams of a text count in full up to this number, and four overlapping ones as one.
FULL = 400
#: Records that a parent's share stands for in the smoothing, of hosts and of the two likelihoods.
HOST_WEIGHT, TABLE_WEIGHT = 10.0, 10.0
#: Name of none of the languages, and least posterior of a language that is accepted.
UNKNOWN, CONFIDENT = "und", 0.5
#: Nats for each 4-gram that a language's own texts may be better under its model than another's texts are, if the two are one language.
SAME = 0.25
#: What one part of a posterior counts in the sums, which are whole numbers and so the same in any order.
UNIT = 1_000_000


#: Bytes as 4-grams see them: A-Z in lower case, white space as a blank; and whether a 4-gram may hold them: letters and blanks.
_SEEN = LOWER.copy()
_SEEN[SEPARATOR] = 32
_PLAIN = SEPARATOR.copy()
_PLAIN[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each run of four bytes, whether it counts, and where each text's runs begin and end.

    Runs with digits or marks say nothing of a language, as in numbers, addresses and keys, and don't count.
    """
    data, starts = utf8(texts)
    if len(data) < 4:
        none = np.zeros(len(starts) - 1, np.int64)
        return np.zeros(0, np.int64), np.zeros(0, bool), none, none
    low, plain = _SEEN[data].astype(np.uint32), _PLAIN[data]
    word = low[:-3] | low[1:-2] << np.uint32(8) | low[2:-1] << np.uint32(16) | low[3:] << np.uint32(24)
    buckets = (word * np.uint32(2654435761)) >> np.uint32(16)
    begin = np.minimum(starts[:-1], len(buckets))
    return buckets.astype(np.int64), plain[:-3] & plain[1:-2] & plain[2:-1] & plain[3:], begin, np.maximum(begin, np.minimum(starts[1:] - 3, len(buckets)))


@dataclass
class TextModel:
    """Languages, the unknown one last, and log probabilities of the buckets under each."""

    languages: list[str]
    table: np.ndarray

    def likelihoods(self, texts: pa.Array) -> np.ndarray:
        buckets, counted, begin, end = _grams(texts)
        many = np.concatenate([[0], np.cumsum(counted)])
        n = np.maximum(many[end] - many[begin], 1)
        scale = np.minimum(n, FULL) / (4.0 * n)
        out = np.zeros((len(begin), len(self.languages)))
        for k, row in enumerate(self.table):
            total = np.concatenate([[0.0], np.cumsum(row[buckets] * counted, dtype=np.float64)])
            out[:, k] = (total[end] - total[begin]) * scale
        return out


def registered() -> dict[str, str]:
    """The language of each registered name; a language goes by its two letters where it has such a name."""
    two = dict(p.split(":") for p in PAIRS.split())
    return {a: a for a in two} | {b: a for a, b in two.items()} | dict(p.split(":") for p in OTHER.split()) | {a: a for a in ALONE.split()}


def language_name(declared: Column) -> Column:
    """The language that a declared name says, or the name itself in lower case if it is no registered one; null if it is no name."""
    name = F.regexp_extract(F.lower(F.trim(declared)), NAME, 1)
    known = F.create_map(*[F.lit(x) for pair in registered().items() for x in pair])
    return F.when((name != "") & (name != UNKNOWN), F.coalesce(F.try_element_at(known, name), name))


def learn(records: DataFrame, sample: int = SAMPLE) -> TextModel:
    """Fits on the texts of each language with the least hashes; languages are all registered ones that ``records`` (text, declared) declare.

    A name that is not registered is no language, but evidence like any declared value.
    A language whose texts another one with more texts explains as well as its own texts is that
    one under a wrong name, and none of its own either.
    A language takes about ``sample`` divided by the number of languages, but ``EACH`` at least, or all
    its texts if they are fewer.  Tasks count the 4-grams; the sums, of bounded size for each language, come to the driver.
    """
    batched(records.sparkSession)
    known = records.where(F.col("declared").isin(sorted(set(registered().values()))) & F.col("text").isNotNull()).select("declared", "text")
    known = known.withColumn("hash", F.xxhash64(F.lit(3), "text"))
    labels = stash(known.groupBy("declared").agg(F.approx_count_distinct("hash").alias("texts")), "labels")
    many = dict(labels.select("declared", "texts").collect())
    languages = sorted(many)
    each = max(EACH, sample // max(1, len(languages)))
    # The least hashes of a language lie below a bound that its number of texts gives.
    bounds = labels.select("declared", F.when(F.col("texts") > each, each / F.col("texts")).otherwise(1.0).alias("share"))
    low = known.join(F.broadcast(bounds), "declared").where(F.pmod("hash", F.lit(1 << 40)) <= F.col("share") * float(1 << 40))
    place = {name: k for k, name in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            for part in pieces(batch, "text"):
                buckets, counted, begin, end = _grams(part.column("text"))
                for k, a, b in zip((place[x] for x in part.column("declared").to_pylist()), begin.tolist(), end.tolist()):
                    own = seen.setdefault(k, np.zeros(BUCKETS, np.int64))
                    own += np.bincount(buckets[a:b][counted[a:b]], minlength=BUCKETS)
        for k, own in seen.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k), pa.int32()), pa.array(at, pa.int32()), pa.array(own[at])], ["k", "bucket", "n"])

    counts = low.dropDuplicates(["declared", "hash"]).select("declared", "text").mapInArrow(run, "k int, bucket int, n long").groupBy("k", "bucket").agg(F.sum("n").alias("n")).toPandas()
    table = np.full((len(languages) + 1, BUCKETS), -np.log(BUCKETS), np.float32)
    seen = np.zeros((len(languages), BUCKETS), np.float32)
    seen[counts["k"].to_numpy(int), counts["bucket"].to_numpy(int)] = counts["n"].to_numpy(float)
    table[:-1] = np.log((seen + 0.05) / (seen.sum(axis=1, keepdims=True, dtype=np.float64) + 0.05 * BUCKETS))
    # Mean log probability of each language's 4-grams (rows) under each model (columns).
    mean = seen.astype(np.float64) @ table[:-1].T / np.maximum(seen.sum(axis=1, keepdims=True, dtype=np.float64), 1)
    merged = {k for k, a in enumerate(languages) for m, b in enumerate(languages) if (many[b], a) > (many[a], b) and seen[k].any() and mean[k, m] >= mean[m, m] - SAME}
    kept = [k for k in range(len(languages)) if k not in merged]
    return TextModel([*(languages[k] for k in kept), UNKNOWN], table[[*kept, -1]])


def evidence(records: DataFrame, model: TextModel, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``records`` and ``_ll``, the text's log likelihood under each language."""
    batched(records.sparkSession)
    columns = [c for c in records.columns if c in keep or c == "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                ll = model.likelihoods(part.column("text"))
                ends = np.arange(0, ll.size + 1, ll.shape[1], dtype=np.int32)
                rows = pa.ListArray.from_arrays(pa.array(ends), pa.array(ll.ravel()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), rows], [*keep, "_ll"])

    schema = T.StructType([*(records.schema[c] for c in keep), T.StructField("_ll", T.ArrayType(T.DoubleType()))])
    return records.select(columns).mapInArrow(run, schema)


def _softmax(x: Column) -> Column:
    top = F.array_max(x)
    powers = F.transform(x, lambda v: F.exp(v - top))
    return F.transform(F.array(powers), lambda p: F.transform(p, lambda v: v / F.aggregate(p, F.lit(0.0), lambda a, b: a + b)))[0]


def _key(column: str) -> Column:
    return F.when(F.col(column).isNull(), "").otherwise(F.concat(F.lit("="), F.col(column)))


@dataclass
class Tables:
    """Aggregates of the corpus, each stored: likelihoods of declared languages and suffixes, priors of hosts."""

    declared: DataFrame
    suffix: DataFrame
    host: DataFrame


def aggregates(seen: DataFrame, size: int) -> Tables:
    """Tables from evidence (declared, suffix, host, domain, _ll) of all records."""
    parts = seen.select(_key("declared").alias("declared"), _key("suffix").alias("suffix"), _key("host").alias("host"), _key("domain").alias("domain"), F.transform(_softmax(F.col("_ll")), lambda p: F.round(p * UNIT).cast("long")).alias("p"))

    def summed(rows: DataFrame, *by: str) -> DataFrame:
        return rows.groupBy(*by).agg(F.array(*[F.sum(F.col("p")[i]) for i in range(size)]).alias("p"))

    cells = stash(summed(parts, "declared", "suffix", "host", "domain"), "cells")
    everything = summed(cells).select(F.col("p").alias("all"))

    def likelihood(name: str) -> DataFrame:
        """log P(value | language), smoothed towards the value's overall share; a missing value says nothing."""
        values = summed(cells, name)
        rows = values.join(F.broadcast(everything)).withColumns({"n": F.aggregate("p", F.lit(0).cast("long"), lambda a, v: a + v), "total": F.aggregate("all", F.lit(0).cast("long"), lambda a, v: a + v)})
        weight = TABLE_WEIGHT * UNIT
        logs = F.zip_with("p", "all", lambda v, a: F.log((v + weight * (F.col("n") + 1) / (F.col("total") + 1)) / (a + weight)))
        return stash(rows.select(name, F.when(F.col(name) == "", F.transform("p", lambda v: F.lit(0.0))).otherwise(logs).alias(f"{name}_log")), name)

    def smoothed(own: Column, parent: Column) -> Column:
        total = F.aggregate(own, F.lit(0).cast("long"), lambda a, v: a + v)
        return F.zip_with(own, parent, lambda v, q: (v + HOST_WEIGHT * UNIT * q) / (total + HOST_WEIGHT * UNIT))

    corpus = everything.select(F.transform(F.array("all"), lambda a: F.transform(a, lambda v: (v + UNIT) / (F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y) + size * UNIT)))[0].alias("root"))
    hosts = summed(cells, "host", "domain")
    domains = summed(hosts, "domain").join(F.broadcast(corpus)).select("domain", smoothed(F.col("p"), F.col("root")).alias("domain_prior"))
    host = hosts.join(domains, "domain").select("host", "domain", F.col("p").alias("host_p"), "domain_prior")
    return Tables(likelihood("declared"), likelihood("suffix"), stash(host, "hosts"))


def fuse(seen: DataFrame, tables: Tables, languages: list[str]) -> DataFrame:
    """Adds text_language, language, confidence and kept to evidence, which keeps its columns but ``_ll``."""
    columns = [c for c in seen.columns if c != "_ll"]
    rows = seen.withColumns({"_d": _key("declared"), "_s": _key("suffix"), "_h": _key("host"), "_dom": _key("domain")})
    rows = rows.join(tables.declared.withColumnRenamed("declared", "_d"), "_d", "left").join(tables.suffix.withColumnRenamed("suffix", "_s"), "_s", "left")
    rows = rows.join(tables.host.withColumnsRenamed({"host": "_h", "domain": "_dom"}), ["_h", "_dom"], "left")
    own = F.transform(_softmax(F.col("_ll")), lambda p: F.round(p * UNIT).cast("long"))
    others = F.zip_with("host_p", own, lambda h, p: F.greatest(h - p, F.lit(0)))
    rows = rows.withColumn("_others", others)
    total = F.aggregate("_others", F.lit(0).cast("long"), lambda a, v: a + v)
    prior = F.zip_with("_others", "domain_prior", lambda v, q: F.log((v + HOST_WEIGHT * UNIT * q) / (total + HOST_WEIGHT * UNIT)))
    added = F.zip_with(F.zip_with("_ll", prior, lambda a, b: a + b), F.zip_with("declared_log", "suffix_log", lambda a, b: a + b), lambda a, b: a + b)
    rows = rows.withColumn("_post", _softmax(added))
    names = F.array(*map(F.lit, languages))

    def best(x: Column) -> Column:
        return F.element_at(names, F.array_position(x, F.array_max(x)).cast("int"))

    rows = rows.withColumns({"text_language": best(F.col("_ll")), "language": best(F.col("_post")), "confidence": F.array_max("_post")})
    kept = (F.col("language") != UNKNOWN) & (F.col("confidence") >= CONFIDENT)
    return rows.select(*columns, "text_language", "language", F.round("confidence", 4).alias("confidence"), kept.alias("kept"))


#: Bytes of ``<html lang=...>`` and what is no text in a page.
_DECLARED, _MARKUP = r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>"


def documents_as_records(docs: DataFrame) -> DataFrame:
    """Documents: the column lang is what they declare, their source is the host; they have no address."""
    return docs.withColumns({"declared": language_name(F.col("lang")), "host": F.col("source"), "domain": F.lit(None).cast("string"), "suffix": F.lit(None).cast("string")})


def pages_as_records(pages: DataFrame) -> DataFrame:
    """Pages: text without markup, the language their markup declares, host, domain (its last two parts, three below a country's shared ones) and suffix (the last)."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    declared = F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), _DECLARED, 1))
    rows = pages.withColumns({"text": F.regexp_replace("html", _MARKUP, " "), "declared": language_name(declared), "host": F.nullif(host, F.lit(""))})
    domain = F.when(F.rlike("host", F.lit(SHARED)), F.substring_index("host", ".", -3)).otherwise(F.substring_index("host", ".", -2))
    return rows.withColumns({"domain": domain, "suffix": F.substring_index("host", ".", -1)})


#: Second parts that a country's domains share.
SHARED = r"\.(?:ac|co|com|edu|go|gob|gov|mil|ne|net|nom|or|org)\.[a-z]{2}$"
_CLUES = ["declared", "suffix", "host", "domain"]


def identify(records: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns of each record with declared, text_language, language, confidence and kept.

    ``records`` has text, declared, suffix, host and domain; a null clue, or a
    null or empty text, says nothing.  Ties go to the first language by name.
    A corpus that declares no language has only the unknown one, and nothing is
    kept.  Very long texts are read whole.  Repeated rows are each returned.
    """
    model = learn(records)
    seen = stash(evidence(records, model, [*keep, *_CLUES]), "evidence")
    return fuse(seen, aggregates(seen, len(model.languages)), model.languages).drop("suffix", "host", "domain")


def identify_corpus(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """All documents and pages: doc_id or page_id, declared, text_language, language, confidence and kept."""
    ids = ["doc_id", "page_id"]
    a = documents_as_records(docs.select("doc_id", "text", "lang", "source")).withColumn("page_id", F.lit(None).cast("long"))
    b = pages_as_records(pages.select("page_id", "url", "html")).withColumn("doc_id", F.lit(None).cast("long"))
    columns = [*ids, "text", *_CLUES]
    return identify(a.select(columns).unionByName(b.select(columns)), ids)


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents with an accepted language, with their columns; lang becomes the language found.

    Nulls, empty texts, ties and repeats as in :func:`identify`; columns may have any names.  The
    evidence is written with the documents, so texts are read once.  Priors of hosts
    are broadcast while they are small; a join of more of them splits hot hosts where the session's adaptive joins do.
    """
    records = documents_as_records(set_aside(docs, "text", "lang", "source"))
    model = learn(records)
    aside = [c for c in records.columns if c.startswith("_in_")]
    seen = stash(evidence(records, model, [*aside, *_CLUES]), "evidence", codec="zstd")
    found = fuse(seen, aggregates(seen, len(model.languages)), model.languages)
    return restored(only(found, "kept"), docs, lang=F.col("language"))
