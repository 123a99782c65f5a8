"""Streaming byte-pair encoding against the tokenizers library."""

import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyfold.llm import bpe_stream

FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


@pytest.fixture(scope="module")
def encoder():
    return bpe_stream.Encoder(FILE)


def ids(encoder, text):
    return np.frombuffer(b"".join(encoder.encode(text)), "<u4").tolist()


def wanted(library, text):
    return library.encode(text, add_special_tokens=False).ids


def test_every_code_point_is_split_alike(encoder, library):
    odd = [c for c in range(0x32000) if not 0xD800 <= c < 0xE000 and ids(encoder, s := f"a{chr(c)}1{chr(c)}!{chr(c)}{chr(c)} x") != wanted(library, s)]
    assert odd == []


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=200) | st.text("aehs '\n\t1.-=<|>endoftext", max_size=300))
def test_any_text(encoder, library, text):
    assert ids(encoder, text) == wanted(library, text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "ab", "the", "er", "tion", "aaab", "-", "=", "é", "zzzz", "str"]), st.integers(1, 400)), min_size=1, max_size=60))
def test_long_words_are_emitted_on_the_way(encoder, library, parts):
    text = "".join(a * n for a, n in parts if a.isalpha()) or "x"
    parts_ = list(encoder.word(text))
    assert [t for p in parts_ for t in p] == wanted(library, text)
    # What is kept back is bounded: the lookahead, one step, and the longest token.
    size = encoder.merges.bytes
    assert all(sum(len(size[t]) for t in p) <= 4 * bpe_stream.STEP + encoder.merges.lookahead + 128 for p in parts_)


def test_lookahead_is_sufficient(encoder):
    """Tokens further back than the lookahead are the same whatever follows."""
    rng, back = random.Random(5), encoder.merges.lookahead
    tokens = [b.decode() for b in encoder.merges.bytes if b.isalpha() and b.isascii()]
    for _ in range(150):
        head = "".join(rng.choice(tokens) for _ in range(rng.randrange(60, 120)))
        found = []
        for tail in ("", *("".join(rng.choice(tokens) for _ in range(12)) for _ in range(6))):
            at, stable = 0, []
            for t in [t for p in encoder.word(head + tail) for t in p]:
                at += len(encoder.merges.bytes[t])
                if at <= len(head) - back:
                    stable.append(t)
            found.append(stable)
        assert all(f == found[0] for f in found)


def test_small_merge_list_by_hand(tmp_path):
    """Chains of merges: the lookahead is the longest, and any word over the letters has the library's tokens."""
    letters = {k: i for i, k in enumerate("abcd")}
    merges = [("a", "b"), ("c", "a"), ("d", "c"), ("ab", "ab"), ("b", "c")]
    vocabulary = letters | {x + y: 4 + k for k, (x, y) in enumerate(merges)}
    held = {"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}, "post_processor": None, "decoder": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}}
    held["model"] = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False, "vocab": vocabulary, "merges": [f"{x} {y}" for x, y in merges]}
    path = tmp_path / "small.json"
    path.write_text(json.dumps(held))
    own, library = bpe_stream.Encoder(str(path)), Tokenizer.from_file(str(path))
    # a-b takes a from c-a, which leaves c for d-c, which would have left d.
    assert own.merges.lookahead == 3
    rng = random.Random(1)
    for _ in range(3000):
        word = "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 24)))
        assert ids(own, word) == wanted(library, word)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 50_256), max_size=40), st.integers(1, 7))
def test_decoding_any_ids_in_parts(encoder, library, tokens, step):
    decoder = bpe_stream.Decoder(encoder.merges.bytes)
    text = "".join(decoder.feed(np.array(tokens[k : k + step], "<u4").tobytes()) for k in range(0, len(tokens), step)) + decoder.end()
    assert text == library.decode(tokens, skip_special_tokens=False)


def expected(library, doc, text):
    found = wanted(library, text or "")
    return (doc, len(found), hashlib.sha256(np.array(found, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(found, skip_special_tokens=False).encode()).hexdigest())


def test_query_against_the_library(spark, library):
    from tallyfold.llm.queries import op12_bpe_round_trip

    from ..conftest import DATA

    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    found = sorted(map(tuple, op12_bpe_round_trip(spark, DATA).collect()))
    assert found == sorted(expected(library, r.doc_id, r.text) for r in docs)


def test_odd_rows(spark, library):
    texts = [None, "", " ", "a<|endoftext|> b", "  <|endoftext|><|endoftext|>", "<|endoftext", "\x00\x85 ", "é" * 300, "👩‍👩‍👧" * 50, "don't  I'LL\n\n x"]
    rows = [(k, t, 1) for k, t in enumerate(texts * 2)] + [(None, "x", 1), (4, "x", 1), (4, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")
    found = sorted(map(tuple, bpe_stream.round_trip(docs).collect()), key=repr)
    assert found == sorted((expected(library, k, t) for k, t, _ in rows), key=repr)
    assert bpe_stream.round_trip(docs.limit(0)).collect() == []


def test_very_long_texts(spark, library):
    """One word, blanks and marks of millions of characters; the library takes too long on the whole word, so that one is compared in its digest of the text."""
    rng = random.Random(3)
    texts = ["word " * 400_000, " " * 2_000_000, "".join(rng.choice("abcdefgh") for _ in range(1_000_000)), "=" * 500_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: tuple(r) for r in bpe_stream.round_trip(docs).collect()}
    assert found[0] == expected(library, 0, texts[0]) and found[3] == expected(library, 3, texts[3])
    assert all(found[k][3] == hashlib.sha256(t.encode()).hexdigest() for k, t in enumerate(texts))
