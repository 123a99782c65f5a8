"""Periodic runs against brute force over all periods."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyfold.llm import run_detection

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w):
    """Every run by trying each period; a stretch keeps its smallest period."""
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = j
    return sorted((s, e, q) for (s, e), q in found.items())


def expected(doc, text, repeat=True):
    w = WORD.findall(text or "")
    n = len(w)
    if repeat and doc is not None and n:
        h = zlib.crc32(str(doc).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    found = brute(w)
    kept = [x for i, x in enumerate(w) if not any(s + q <= i < e for s, e, q in found)]
    best = min(((s - e, s, q) for s, e, q in found), default=None)
    top = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    listed = "".join(f"{s},{e - s},{q}\n" for s, e, q in sorted(found, key=lambda x: (x[0], x[2])))
    return (doc, len(found), *top, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(" ".join(kept).encode()).hexdigest())


def check(texts):
    ids = np.array([x for t in texts for x in t], np.int64)
    first = np.cumsum([0, *map(len, texts)])
    found = run_detection.runs(ids, first).tolist()
    assert found == [[first[k] + s, first[k] + e, q] for k, t in enumerate(texts) for s, e, q in brute(t)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), min_size=1, max_size=4))
def test_any_words(texts):
    check(texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=7), st.integers(1, 9)), max_size=8), st.booleans())
def test_repetitions_inside_repetitions(parts, twice):
    words = [x for block, times in parts for x in block * times]
    check([words * 5, words] if twice else [words])


@pytest.mark.parametrize("words", [[], [0], [0] * 5, [0] * 6, [0] * 3000, [0, 1] * 1500, list(range(3000)), [0, 1, 0, 0, 1] * 300, [*range(40)] * 30, ([0] * 9 + [1]) * 50])
def test_long_and_regular(words):
    check([words, words[::-1], []])


def test_thue_morse_and_fibonacci_words():
    a, b = [0], [0, 1]
    for _ in range(13):
        a, b = b, b + a
    check([b, [bin(i).count("1") % 2 for i in range(2048)] * 5])


def test_query_against_brute_force(spark):
    from tallyfold.llm.queries import op11_periodic_runs

    from ..conftest import DATA

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    found = {r.doc_id: tuple(r) for r in op11_periodic_runs(spark, DATA).collect()}
    assert len(found) == len(docs) and sum(r[1] > 0 for r in found.values()) > 10
    assert all(found[k] == expected(k, t) for k, t in docs.items() if len(t or "") < 12_000)


def test_odd_rows(spark):
    rng = random.Random(2)
    texts = [None, "", " \n\t ", "x", "a a a a a a", "a\x0ba\x0ca\ra\na\ta", "é É é É é É é É", "ab " * 200, " ".join(rng.choice("xyz") for _ in range(900)), "tail " + "p q " * 4 + "p"]
    rows = [(k, t, "n") for k, t in enumerate(texts * 2)] + [(None, "a b " * 9, "n"), (3, "x", "n"), (3, "x", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_runs string")
    found = sorted(map(tuple, run_detection.detect(docs, repeat=True).collect()), key=repr)
    assert found == sorted((expected(k, t) for k, t, _ in rows), key=repr)
    plain = sorted(map(tuple, run_detection.detect(docs).collect()), key=repr)
    assert plain == sorted((expected(k, t, False) for k, t, _ in rows), key=repr)
    assert run_detection.detect(docs.limit(0)).collect() == []


def test_very_long_texts(spark):
    long = [("loop " * 300_000), " ".join(f"w{i % 700}" for i in range(250_000)), "z" * 3_000_000, " " * 3_000_000]
    docs = spark.createDataFrame(list(enumerate(long)), "doc_id long, text string")
    found = {r.doc_id: (r.n_runs, r.start, r.length, r.period) for r in run_detection.detect(docs).collect()}
    assert found == {0: (1, 0, 300_000, 1), 1: (1, 0, 250_000, 700), 2: (0, None, None, None), 3: (0, None, None, None)}
