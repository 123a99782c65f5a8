"""N-gram join, packing and mixing against plain Python."""

import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from tallyfold.llm import mixing, ngram_join, packing

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, size):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < size:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def brute(rows, size=4, percent=85):
    sets = {i: shingles(t, size) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def corpus(seed=3, families=6, copies=12, length=60):
    rng = random.Random(seed)
    rows, k = [], 0
    line = [f"common{i}" for i in range(12)]
    for f in range(families):
        base = [f"w{rng.randrange(10**6)}" for _ in range(length)]
        for c in range(copies):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                words[rng.randrange(length)] = f"x{rng.randrange(10**6)}"
            if f % 2:
                words += line
            rows.append((k * 7 % 1000, " ".join(words)))
            k += 1
    return rows


def test_ngram_join_matches_brute_force(spark):
    rows = corpus()
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.classify(frame(spark, rows)).collect()}
    assert found == brute(rows)


def test_ngram_join_large_family_in_parts(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CHUNK_SETS", 8)
    monkeypatch.setattr(ngram_join, "LOOSE_SETS", 8)
    monkeypatch.setattr(ngram_join, "WIDESPREAD", 4)
    rows = corpus(seed=5, families=2, copies=50, length=40)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.classify(frame(spark, rows)).collect()}
    assert found == brute(rows)


def test_overlaps_are_derived_from_similar_sets():
    """Links of a group equal those of all pairs, with and without a leader, and most overlaps come from a similar set's."""
    import numpy as np

    rng = random.Random(6)
    for leader in (None, 0):
        base = rng.sample(range(10**6), 80)
        sets = []
        for k in range(60):
            own = list(base if k % 3 else rng.sample(range(10**6), 80))
            for _ in range(k % 16):
                own[rng.randrange(80)] = rng.randrange(10**6)
            sets.append(sorted(set(own)))
        sizes = np.array([len(x) for x in sets])
        edges, dist, linked = ngram_join._links_of_group(np.arange(60), sizes, np.concatenate(sets), leader, np.zeros(60, bool), np.zeros(60), 85)
        root = list(range(60))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        def classes(pairs):
            root[:] = range(60)
            for a, b in pairs:
                root[find(a)] = find(b)
            return {frozenset(j for j in range(60) if find(j) == find(i)) for i in range(60)}

        pairs = [(a, b) for a, b in itertools.combinations(range(60), 2) if 100 * len(set(sets[a]) & set(sets[b])) >= 85 * len(set(sets[a]) | set(sets[b]))]
        assert classes(edges) == classes(pairs) and len(classes(pairs)) > 2
        if leader is not None:
            assert dist == pytest.approx([1 - len(set(sets[0]) & set(x)) / len(set(sets[0]) | set(x)) for x in sets])


def test_ngram_join_long_text(spark):
    text = " ".join(f"w{k}" for k in range(60_000))
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.classify(frame(spark, [(5, text), (3, text + " end"), (4, "x " * 100_000)])).collect()}
    assert found == {5: (59_997, 3), 3: (59_998, 3), 4: (1, 4)}


def test_ngram_join_odd_rows(spark):
    rows = [(1, "One two THREE four five"), (2, "one two three four  five"), (3, None), (4, ""), (5, " \n"), (6, "short one"), (7, "Short ONE"), (8, "É a b c"), (9, "é a b c"), (None, "one two three four five"), (1, "One two THREE four five")]
    docs = frame(spark, [(a, b, 1.0, "z") for a, b in rows], "doc_id long, text string, n double, token string")
    found = sorted(map(tuple, ngram_join.classify(docs).collect()), key=repr)
    assert found == sorted([(1, 2, 1), (2, 2, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 1, 6), (7, 1, 6), (8, 1, 8), (9, 1, 9), (None, 2, None), (1, 2, 1)], key=repr)
    kept = ngram_join.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([1, 3, 4, 5, 6, 8, 9, None], key=repr)


def test_ngram_join_empty_table(spark):
    assert ngram_join.classify(frame(spark, [])).collect() == []
    assert ngram_join.deduplicate(frame(spark, [])).collect() == []


def test_packing_round_trip(spark):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma,", "été", "x1"]) for _ in range(rng.randrange(1, 900)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "long text " * 3000), (103, "a <|endoftext|> b"), (104, "same"), (104, "same")]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = packing.packed(frame(spark, [(a, b, 0) for a, b in rows], "doc_id long, text string, offset int")).collect()
    by_doc = defaultdict(list)
    for r in found:
        by_doc[r.doc_id].append(r)
    for doc, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        parts = sorted(by_doc[doc], key=lambda r: r.piece)
        assert sum(r.length for r in parts) == len(ids) * (2 if doc == 104 else 1)
        for r in parts:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        assert all(r.length == 1024 for r in parts[1:]) or doc == 104
    sequences = defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= -(-sum(r.length for r in found) // 1024) + 1


def test_packing_long_runs_and_special_strings():
    """Texts that are one run of white space, and many with the special token's string, have the tokenizer's own ids."""
    import public_tokenizers
    from tokenizers import Tokenizer

    encode = packing._encoder("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in (" " * 2_000_000, "\n" * 2_000_000, "a \t" + " " * 400_000 + "b", "word\u3000" * 20_000, "x" * 100_000):
        assert encode(text) == tokenizer.encode(text, add_special_tokens=False).ids
    special = tokenizer.encode("line <|endoftext|>", add_special_tokens=False).ids
    assert all(encode("line <|endoftext|>") == special for _ in range(10_000))


def test_packing_search_saves_sequences():
    """Triplets that fill a sequence each: best fit leaves bins, which the search empties."""
    import numpy as np

    rng = np.random.default_rng(0)
    lengths = []
    for _ in range(200):
        a = int(rng.integers(390, 510))
        b = int(rng.integers((1024 - a) // 2 - 60, (1024 - a) // 2 + 60))
        lengths += [a, b, 1024 - a - b]
    lengths = rng.permutation(lengths)
    start = packing._best_fit(lengths, 1024)
    before = len(start)
    after = packing._improve(start, lengths, 1024)
    assert sorted(i for b in after for i in b) == list(range(600)) and all(lengths[b].sum() <= 1024 for b in after)
    assert before >= 214 and len(after) <= 207
    # 1,200 bins with room: more than a search over the nearest few could see.
    halves = rng.integers(342, 513, 2400)
    assert len(packing._improve(packing._best_fit(halves, 1024), halves, 1024)) <= 1200


def test_packing_improves_and_empty(spark):
    import numpy as np

    lengths = np.array([600, 500, 400, 300, 248])
    bins = packing._improve([[0, 3], [1, 4], [2]], lengths, 1024)
    assert sorted(i for b in bins for i in b) == [0, 1, 2, 3, 4] and len(bins) <= 3
    assert all(sum(lengths[i] for i in b) <= 1024 for b in bins)
    assert packing.packed(frame(spark, [])).collect() == []


def water(sizes):
    """Targets by resharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s] + 1e-9]
        if not over:
            return fixed | share
        fixed |= {s: 3 * sizes[s] for s in over}


def test_mix_meets_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_WORDS", 500)
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 5)
    rng = random.Random(2)
    rows = [(i, " ".join("w" * rng.randrange(1, 4) for _ in range(rng.randrange(0, 60))), s) for i, s in enumerate(rng.choices(["a", "b", "c", "é", None, "tiny"], [9, 3, 3, 3, 2, 0.3], k=200))]
    docs = frame(spark, [(*r, "x") for r in rows], "doc_id long, text string, source string, taken string")
    found = {r.doc_id: r for r in mixing.mix_report(docs).collect()}
    sizes = defaultdict(int)
    for i, text, source in rows:
        assert found[i].size == len(WORD.findall(text))
        sizes[source] += found[i].size
    aims = water(dict(sizes))
    for source in sizes:
        own = [found[i] for i, _, s in rows if s == source]
        assert own[0].source_size == sizes[source]
        assert own[0].target == pytest.approx(aims[source])
        assert sum(r.taken for r in own) == pytest.approx(aims[source], abs=0.51)
        assert all(r.taken <= 3 * r.size for r in own)
    again = {r.doc_id: r for r in mixing.mix_report(docs.repartition(7)).collect()}
    assert all(again[i].taken == found[i].taken and again[i].shards == found[i].shards for i in found)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    words = defaultdict(int)
    for r in mixed.collect():
        words[r.doc_id] += len(WORD.findall(r.text))
    assert all(words[i] == found[i].taken for i in found)


def test_mix_odd_rows(spark):
    schema = "doc_id long, text string, source string"
    assert mixing.mix_report(frame(spark, [], schema)).collect() == []
    rows = [(1, None, "a"), (2, "", "b"), (None, "x y", "c"), (3, "x", "c"), (3, "x", "c")]
    found = mixing.mix_report(frame(spark, rows, schema)).collect()
    assert sum(r.taken for r in found) == 4 and len(found) == 5


def test_hypergeometric_draws(spark):
    """Moments of the draws, and their bounds."""
    from pyspark.sql import functions as F

    rows = spark.range(4000).select(mixing.hypergeometric(mixing._uniform(F.col("id")), F.lit(500), F.lit(120), F.lit(200)).alias("k"))
    mean, var, low, high = rows.agg(F.avg("k"), F.var_samp("k"), F.min("k"), F.max("k")).first()
    assert mean == pytest.approx(48, abs=0.4) and var == pytest.approx(200 * 0.24 * 0.76 * 300 / 499, rel=0.1) and 0 <= low and high <= 120
    edge = spark.range(1).select(mixing.hypergeometric(F.lit(0.7), F.lit(9), F.lit(9), F.lit(4)).alias("a"), mixing.hypergeometric(F.lit(0.7), F.lit(9), F.lit(0), F.lit(4)).alias("b"), mixing.hypergeometric(F.lit(0.7), F.lit(0), F.lit(0), F.lit(0)).alias("c")).first()
    assert tuple(edge) == (4, 0, 0)
