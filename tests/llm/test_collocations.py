"""Phrase mining against plain counting."""

import random
import re
from collections import Counter
from itertools import pairwise

import numpy as np
import pytest

from tallyfold.llm import collocations

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, least, first):
    count, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            count.update((lang, tuple(w[i : i + k])) for k in range(1, 6) for i in range(len(w) - k + 1))
    often = {p: a for p, a in count.items() if a >= least}
    cover = Counter()
    for (lang, w), a in often.items():
        for size in range(2, len(w)):
            for i in range(len(w) - size + 1):
                cover[lang, w[i : i + size]] = max(cover[lang, w[i : i + size]], a)
    kept = {}
    for (lang, w), a in often.items():
        if len(w) > 1 and cover[lang, w] < a:
            score, cut = min((1000 * a * total[lang] // (count[lang, w[:k]] * count[lang, w[k:]]), k) for k in range(1, len(w)))
            kept.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), count[lang, w[:cut]], count[lang, w[cut:]]))
    return sorted((lang, rank + 1, p.decode(), -a, l, r, total[lang], -score) for lang, found in kept.items() for rank, (score, a, p, l, r) in enumerate(sorted(found)[:first]))


def corpus(seed, n=300):
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(30)] + ["Été", "x-y", "ÄB", "a'b"]
    fixed = [["red", "Hot", "chili"], ["new", "york", "stock", "exchange", "index", "fund"], ["a", "a", "a"]]
    rows = []
    for _ in range(n):
        words = []
        for _ in range(rng.randrange(0, 40)):
            words += rng.choice(fixed) if rng.random() < 0.2 else [rng.choice(base[: rng.randrange(1, len(base))])]
            if rng.random() < 0.1:
                words[-1] += rng.choice([".", ",", ";", "\n", "\r\n", "!?", "\x0b", ":"])
        rows.append((rng.choice(["en", "en", "en", "fr", None, ""]), rng.choice([" ", "  ", "\t"]).join(words)))
    return rows + [(None, None), ("en", ""), ("de", " . "), ("xx", "word " * 9)]


@pytest.mark.parametrize("seed,shards,slots", [(1, 3, 24), (2, 1, 16), (3, 5, 4)])
def test_against_brute_force(spark, seed, shards, slots):
    """Any number of shards, and tables so small that all phrases share slots, give the same rows."""
    rows = corpus(seed)
    docs = spark.createDataFrame([(k, *r, 1, "c") for k, r in enumerate(rows)], "doc_id long, lang string, text string, n int, phrase string").repartition(3)
    found = collocations.collocations(docs, least=12, first=40, shards=shards, slots=slots)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    wanted = brute(rows, 12, 40)
    assert len(wanted) > 40 and sorted(map(tuple, found.collect())) == wanted


def test_longer_phrases_start_before_shorter_ones_end(spark, monkeypatch):
    """Lengths are counted in the same steps, and fewer steps are needed than one cycle to each length."""
    starts = []
    kept = collocations.stash

    def watched(df, tag, *by):
        out = kept(df, tag, *by)
        if tag == "phrases":
            starts.append({r.k for r in out.where("n > was").select("k").distinct().collect()})
        return out

    monkeypatch.setattr(collocations, "stash", watched)
    docs = spark.createDataFrame([("en", "one two three four five six") for _ in range(600)], "lang string, text string").repartition(2)
    found = collocations.collocations(docs, shards=6).collect()
    assert {r.phrase for r in found} == {"one two three four five", "two three four five six"}
    assert any({1, 2, 3} <= s for s in starts) and len(starts) < 5 * 6


def test_none(spark):
    docs = spark.createDataFrame([(None, None), ("en", "")], "lang string, text string")
    assert collocations.collocations(docs).collect() == [] and collocations.collocations(docs.limit(0)).collect() == []


def test_very_long_text_and_repeated_rows(spark):
    text = "alpha beta gamma " * 200_000
    docs = spark.createDataFrame([("en", text), ("en", text)], "lang string, text string")
    found = [tuple(r) for r in collocations.collocations(docs).collect()]
    assert sorted(found) == brute([("en", text)] * 2, 100, 2000)


def test_equal_digests_of_other_lengths_are_counted_apart():
    """Phrases are told apart by digest, length and start, also where a task adds them up."""
    keys = np.array([7, 7, 9], np.uint64)
    batch = collocations._counted({(1, 0): [keys, keys[:1]], (2, 1): [keys[:1]], (2, 3): [keys[2:]]})
    assert sorted(tuple(r.values()) for r in batch.to_pylist()) == [(7, 1, 0, 3), (7, 2, 1, 1), (9, 1, 0, 1), (9, 2, 3, 1)]
