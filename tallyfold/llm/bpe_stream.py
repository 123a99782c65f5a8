"""Byte-pair encoding as a streaming transducer with bounded lookahead, and decoding as an incremental state machine.

A prefix of a word has one encoding, and its last token tells the rest: tokens
stand side by side if and only if no merge across their seam comes before the
merges inside them.  So reading left to right needs the last token of each
prefix, found among the tokens that end there.  How far back unread bytes can
still change tokens follows from the merge list alone: each change of a token
boundary to the left takes a later merge than the one before, whose right part
begins with the left part of the earlier one; the longest such chain, in bytes,
is the sufficient lookahead.  Tokens further back than that are emitted and
forgotten, so a word of any length takes constant memory.
"""

from __future__ import annotations

import codecs
import hashlib
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import batched

#: Fixed value: the pattern of the byte-level vocabularies that splits a text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words kept with their tokens, their greatest length, and seams kept; then the memory is used anew. Bytes or tokens handled together.
WORDS, WORD_LENGTH, SEAMS, STEP = 1 << 19, 48, 1 << 19, 1 << 12
_NEVER = 1 << 40


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in such vocabularies: itself where it is printable, else the next free one from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


class Merges:
    """Tokens and merges of a byte-level vocabulary file, and what follows from them: reachable tokens and the sufficient lookahead."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as lines:
            held = json.load(lines)
        model, letters = held["model"], byte_letters()
        known, added = model["vocab"], {t["content"]: t["id"] for t in held.get("added_tokens", ())}
        for wanted, ok in (("a plain byte-level split", held["pre_tokenizer"] == held["pre_tokenizer"] | {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}), ("no normaliser", held["normalizer"] is None), ("plain added tokens", not any(t[k] for t in held.get("added_tokens", ()) for k in ("single_word", "lstrip", "rstrip", "normalized")))):
            if not ok:
                raise ValueError(f"the vocabulary needs {wanted}")
        size = max([*known.values(), *added.values()], default=-1) + 1
        #: Bytes of each token, its two parts (-1 for none) and the number of its merge.
        self.bytes: list[bytes] = [b""] * size
        self.left, self.right, self.rank = [-1] * size, [-1] * size, [_NEVER] * size
        self.rule: dict[int, int] = {}
        self.added = {text: i for text, i in added.items()}
        for text, i in known.items():
            self.bytes[i] = bytes(letters[c] for c in text) if all(c in letters for c in text) else text.encode()
        for text, i in added.items():
            self.bytes[i] = text.encode()
        for k, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y, z = known[a], known[b], known[a + b]
            if self.rank[z] != _NEVER or any(self.left[p] < 0 and len(self.bytes[p]) > 1 for p in (x, y)):
                raise ValueError(f"merge {k} is no proper one: its parts come later, or its token has another merge")
            self.left[z], self.right[z], self.rank[z], self.rule[x << 20 | y] = x, y, k, k
        made = sorted((r, i) for i, r in enumerate(self.rank) if r != _NEVER)
        self.reachable = [len(b) == 1 and i not in added.values() for i, b in enumerate(self.bytes)]
        for k, i in made:
            x, y = self.left[i], self.right[i]
            self.reachable[i] = self.reachable[x] and self.reachable[y] and self._across(x, y, k)
        self.lookahead = self._lookahead(i for _, i in made)
        self.seams: dict[int, bool] = {}

    def _across(self, x: int, y: int, before: int) -> bool:
        """Whether no merge across the seam of x and y comes first: before ``before`` and before those that use up its parts.

        Of two equal merges that overlap the left one comes first.
        """
        left, right, rank, rule = self.left, self.right, self.rank, self.rule
        u, used_u = x, before
        while u >= 0:
            v, used_v = y, before
            while v >= 0:
                k = rule.get(u << 20 | v)
                if k is not None and k < used_u and (k < before if v == y else k <= used_v):
                    return False
                used_v, v = rank[v], left[v]
            used_u, u = rank[u], right[u]
        return True

    def fits(self, x: int, y: int) -> bool:
        """Whether y may follow x."""
        key = x << 20 | y
        found = self.seams.get(key)
        if found is None:
            if len(self.seams) >= SEAMS:
                self.seams.clear()
            found = self.seams[key] = self._across(x, y, _NEVER)
        return found

    def _lookahead(self, by_rank: Iterable[int]) -> int:
        """Bytes that the longest chain of merges reaches back from unread bytes.

        A merge (c, d) moves the leftmost difference between two continuations back by
        c.  The next such merge has a greater number and a d that begins with this c.
        """
        reach: dict[int, int] = {}
        for i in by_rank:
            c, d, most = self.left[i], self.right[i], 0
            while d >= 0:
                most = max(most, reach.get(d, 0))
                d = self.left[d]
            reach[c] = max(reach.get(c, 0), most + len(self.bytes[c]))
        return max(reach.values(), default=0)


class Encoder:
    """Ids of texts, as packed little-endian 32-bit numbers in parts of bounded size."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        import regex

        self.merges = Merges(path)
        self.sizes = [len(x) for x in self.merges.bytes]
        self.longest = max(self.sizes, default=0)
        self.packed = [i.to_bytes(4, "little") for i in range(len(self.sizes))]
        self.pattern = regex.compile(PATTERN)
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.merges.added, key=len, reverse=True)))) if self.merges.added else None
        # A blank between two other characters begins a word, whatever is around it.
        self.cut = regex.compile(r"\S(?= \S)")
        self.ids = {held.decode("latin-1"): i for i, held in enumerate(self.merges.bytes) if self.merges.reachable[i]}
        # For each token the next shorter one that begins alike.
        self.begins = ahocorasick.Automaton()
        for text in self.ids:
            self.begins.add_word(text, len(text))
        self.shorter = [-1] * len(self.sizes)
        for text, i in self.ids.items():
            self.shorter[i] = self._longest(text[:-1])
        self.words: dict[str, bytes] = {}

    def _longest(self, text: str) -> int:
        """The longest token with which a text begins; -1 if there is none."""
        # The automaton knows how long a beginning of some token is, which need not be one itself.
        return next((self.ids[text[:k]] for k in range(self.begins.longest_prefix(text), 0, -1) if text[:k] in self.ids), -1)

    def _walk(self, part: str, path: list[int], at: int, before: int, stop: int) -> int:
        """Extends ``path``, the tokens that lead to place ``at`` after the token ``before`` (-1 for none), up to ``stop`` or beyond, and returns where it ends.

        Places and the encodings that lead to them form a tree, as each has one encoding. It is walked depth first, longer tokens first.
        """
        begins, known, seams, fits, sizes, shorter, longest = self.begins.longest_prefix, self.ids.get, self.merges.seams, self.merges.fits, self.sizes, self.shorter, self.longest
        last = path[-1] if path else before
        while at < stop:
            text = part[at : at + longest]
            k = begins(text)
            while (token := known(text[:k])) is None:
                k -= 1
            while True:
                if token < 0:
                    token = path.pop()
                    at -= sizes[token]
                    last, token = path[-1] if path else before, shorter[token]
                    continue
                if last < 0:
                    break
                ok = seams.get(last << 20 | token)
                if ok or (ok is None and fits(last, token)):
                    break
                token = shorter[token]
            path.append(token)
            at += sizes[token]
            last = token
        return at

    def word(self, text: str) -> Iterator[list[int]]:
        """Tokens of a word, each part as soon as it is stable; only the part of the walk within the lookahead is held."""
        keep = self.merges.lookahead + self.longest
        part, x, at, before = "", 0, 0, -1
        path: list[int] = []
        while x < len(text) or at < len(part):
            while x < len(text) and len(part) < STEP + 2 * keep:
                part, x = part + text[x : x + STEP].encode().decode("latin-1"), x + STEP
            at = self._walk(part, path, at, before, len(part) if x >= len(text) else STEP + keep)
            done = many = 0
            # Whatever follows, the encoding has these tokens.
            while many < len(path) and (x >= len(text) or done + self.sizes[path[many]] <= at - keep):
                done, many = done + self.sizes[path[many]], many + 1
            yield path[:many]
            before, path, part, at = path[many - 1], path[many:], part[done:], at - done

    def _parts(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(from, to, id of an added token or -1) of a text's parts, in order. Each begins and ends where a word does."""
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            yield at, m.start(), -1
            yield m.start(), m.end(), self.merges.added[m.group()]
            at = m.end()
        while len(text) - at > 16 * STEP and (m := self.cut.search(text, at + 8 * STEP)):
            yield at, m.end(), -1
            at = m.end()
        yield at, len(text), -1

    def encode(self, text: str) -> Iterator[bytes]:
        """Packed ids of a text; the strings of added tokens are those tokens."""
        words, packed = self.words, self.packed
        for a, b, added in self._parts(text):
            if added >= 0:
                yield packed[added]
                continue
            ready: list[bytes] = []
            for word in self.pattern.findall(text, a, b):
                held = words.get(word)
                if held is not None:
                    ready.append(held)
                elif len(word) > WORD_LENGTH:
                    for tokens in self.word(word):
                        ready += [packed[t] for t in tokens]
                        if len(ready) >= STEP:
                            yield b"".join(ready)
                            ready = []
                else:
                    letters = word.encode().decode("latin-1")
                    path: list[int] = []
                    self._walk(letters, path, 0, -1, len(letters))
                    if len(words) >= WORDS:
                        words.clear()
                    held = words[word] = b"".join([packed[t] for t in path])
                    ready.append(held)
            yield b"".join(ready)


class Decoder:
    """Text of ids, fed part by part. Bytes of an unfinished character wait for the next part; what is no UTF-8 becomes U+FFFD, one for each part that could have begun a character."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.tokens = tokens
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, packed: bytes) -> str:
        return self.state.decode(b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist())))

    def end(self) -> str:
        return self.state.decode(b"", True)


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def round_trip(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """For each document (doc_id, text; other columns are ignored) the digests of its ids and of the text decoded from them.

    A null or empty text has no ids.  A null doc_id stays null, repeated rows are
    encoded each, no rows give no rows.  Very long texts, of one word too, are
    encoded whole: beside the text itself a task holds its vocabulary, a bounded
    table of words and seams and a few thousand tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        encoder = Encoder(public_tokenizers.path(vocabulary))
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                count, ids, decoded, decoder = 0, hashlib.sha256(), hashlib.sha256(), Decoder(encoder.merges.bytes)
                for packed in encoder.encode(text.as_py() or ""):
                    count += len(packed) // 4
                    ids.update(packed)
                    decoded.update(decoder.feed(packed).encode())
                decoded.update(decoder.end().encode())
                rows.append((doc, count, ids.hexdigest(), decoded.hexdigest()))
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string()))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    batched(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
