"""Best-fit packing of tokenised documents, improved by swaps.

Tasks tokenise whole texts and pass on only the lengths and checksums of the
pieces.  Pieces are dealt by hash into groups of bounded size; in each group a
best-fit start is followed by a local search that moves documents, or exchanges
one for one and two for one, between underfull bins.  Every step increases the
sum of squared fills, so the search ends, and bins that empty are dropped.  A
partner is looked up among all underfull bins of the group by piece size and room.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import batched, stash

#: Tokens to a sequence, the id that ends a document, and pieces to a packing group.
LENGTH, END, GROUP = 1024, 2, 20_000
#: White space in one run from which the fast library's pattern may exhaust its stack: such texts go through the tokenizer file.
LONG_BLANKS = 10_000
#: Text that the vocabulary holds as a special token: such texts go through the tokenizer's own handling of it.
SPECIAL = "<|endoftext|>"


def _encoder(vocabulary: str, ranks: str):
    """A function from a text to its ids, made once per task. The ranks file has the same vocabulary in the form of the faster library."""
    import base64
    import re
    from functools import cache

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(ranks), "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    # Possessive, so that a shorter run is left after one look at it.
    blanks = re.compile(rf"\s{{{LONG_BLANKS},}}+")

    @cache
    def whole():
        from tokenizers import Tokenizer

        return Tokenizer.from_file(public_tokenizers.path(vocabulary))

    def encode(text: str) -> list[int]:
        if SPECIAL in text or (len(text) >= LONG_BLANKS and blanks.search(text)):
            return whole().encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def pieces_of(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", ranks: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of all documents, cut only where longer than a sequence, a shorter piece first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(vocabulary, ranks)
        for batch in batches:
            out: list[tuple[int | None, int, int, int, int]] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array([*encode(text.as_py() or ""), END], dtype="<u4")
                first = (len(ids) - 1) % LENGTH + 1
                cuts = [0, *range(first, len(ids) + 1, LENGTH)]
                out += [(doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
            columns = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[2:])], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def _best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Longest first, each into the fullest bin that has room. Bins of equal room are one list; a bit set tells which rooms there are."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        above = rooms >> need
        if above:
            room = need + (above & -above).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        left = room - need
        if left:
            by_room[left].append(b)
            rooms |= 1 << left
    return bins


def _improve(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Local search over underfull bins, the least full first, until no change applies or no fewer bins can do.

    A change takes a piece, or two, out of a bin and gives it one piece of another
    bin back, or none, and makes that bin fuller than the first one was: so the sum of squares rises.
    """
    least = max(-(-int(lengths.sum()) // capacity), int((2 * lengths > capacity).sum()))
    size = lengths.tolist()
    fill = [sum(size[i] for i in b) for b in bins]
    home = {i: b for b, held in enumerate(bins) for i in held}
    # Of underfull bins: their pieces by size and the bin's room, each size's rooms as bits, its greatest room; size 0 stands for the bin itself.
    at: dict[tuple[int, int], set[int]] = {}
    rooms = [0] * (capacity + 1)
    most = np.full(capacity + 1, -1)

    def index(b: int, add: bool) -> None:
        room = capacity - fill[b]
        for s, item in [(0, b), *((size[i], i) for i in bins[b])]:
            items = at.setdefault((s, room), set())
            items.add(item) if add else items.discard(item)
            if bool(items) != bool(rooms[s] >> room & 1):
                rooms[s] ^= 1 << room
                most[s] = rooms[s].bit_length() - 1

    def partner(given: int, back: range) -> tuple[int, int, int] | None:
        """(room left, size taken back, room) of the closest fit for pieces of ``given`` tokens."""
        best = None
        sizes = np.arange(back.start, min(back.stop, given))
        for s in sizes[most[sizes] >= given - sizes].tolist():
            above = rooms[s] >> (given - s)
            left = (above & -above).bit_length() - 1
            if best is None or left < best[0]:
                best = (left, s, given - s + left)
        return best

    def change(a: int) -> bool:
        """The first kind of change that applies to a bin, which is not in the index."""
        single = {size[i]: [i] for i in bins[a]}
        double = {size[i] + size[k]: [i, k] for x, i in enumerate(bins[a]) for k in bins[a][x + 1 :]} if len(bins[a]) > 1 else {}
        for given, back in ((single, range(0, 1)), (single, range(1, capacity)), (double, range(1, capacity))):
            found = min(((*p, g) for g in given if (p := partner(g, back))), default=None)
            if found and capacity - found[0] > fill[a]:
                left, s, room, g = found
                item = min(at[s, room])
                b = item if s == 0 else home[item]
                index(b, False)
                for i in given[g]:
                    bins[a].remove(i)
                    bins[b].append(i)
                    home[i] = b
                if s:
                    bins[b].remove(item)
                    bins[a].append(item)
                    home[item] = a
                fill[a], fill[b] = fill[a] - g + s, capacity - left
                if left:
                    index(b, True)
                return True
        return False

    used = len(bins)
    if used > least:
        for b in range(len(bins)):
            if fill[b] < capacity:
                index(b, True)
    changed = True
    while changed and used > least:
        changed = False
        for a in sorted((b for b in range(len(bins)) if 0 < fill[b] < capacity), key=fill.__getitem__):
            if not 0 < fill[a] < capacity:
                continue
            index(a, False)
            while bins[a] and change(a):
                changed = True
            if bins[a]:
                index(a, True)
            else:
                used -= 1
                if used <= least:
                    break
    return [b for b in bins if b]


def pack(pieces: DataFrame, capacity: int = LENGTH) -> DataFrame:
    """``pieces`` (length and other columns) with sequence_id and offset.

    Sequences are filled without gaps from 0; a full piece has one of its own.
    Groups hold about ``GROUP`` pieces each, whatever the number of documents, and
    number their sequences apart.
    """
    held = stash(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-held.count() // GROUP))
    dealt = held.withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(groups)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"

    def fill(table: pa.Table) -> pa.Table:
        lengths = table["length"].to_numpy()
        group = table["_group"][0].as_py()
        bins = _improve(_best_fit(lengths, capacity), lengths, capacity)
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for k, b in enumerate(bins):
            own = np.array(sorted(b))
            sequence[own] = group * (1 << 32) + k
            offset[own] = np.cumsum(lengths[own]) - lengths[own]
        return table.drop_columns(["_row", "_group"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return dealt.groupBy("_group").applyInArrow(fill, schema)


def packed(docs: DataFrame) -> DataFrame:
    """All pieces of ``docs`` (doc_id, text; other columns are ignored) in sequences.

    A null or empty text is one token, the end of a document.  Very long texts, of
    one word or of blanks alone too, are tokenised whole.  Repeated rows are
    packed each; a null doc_id stays null; no rows give no rows.
    """
    batched(docs.sparkSession)
    return pack(pieces_of(docs))
