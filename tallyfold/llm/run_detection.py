"""Runs (stretches that repeat with a period) of the words of whole texts, found on a grammar.

Tasks take Arrow batches and work on pieces of about two megabytes of text.  The
words' numbers are compressed by Re-Pair: in each round every pair of
neighbours that is more frequent than the pairs it overlaps becomes a
nonterminal, until no pair occurs twice; what is left of a text is paired up
evenly.  A nonterminal's boundary is where its two parts meet.  The runs that
cross it are worked out once, at its first place: a run of at least four periods has two of
them on one side, so its period is that of a square that begins or ends at the
boundary.  They are then translated to all places of the derivation, where a
piece that a nonterminal's ends cut lies inside the whole run, which some
nonterminal higher up holds; of each period only the maximal intervals stay.

Prefix sums of random numbers only screen for squares; every run is measured by
comparing the words' numbers themselves.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import batched
from .textkit import gathered, pieces, spans, utf8, word_ids

#: Fixed values of the contract: least length, and least number of periods.
LEAST, PERIODS = 6, 4
#: Rounds of pairing at most; what is left then is paired up evenly, with the same runs.
ROUNDS = 64
#: Words of nonterminals looked at together.
STEP = 1 << 20

_ODD = np.random.default_rng(4711).integers(1, 1 << 63, 2, dtype=np.uint64) | np.uint64(1)


class Grammar:
    """Nonterminals of some texts: where each begins, its parts meet and it ends at its first place, and its two parts.

    ``left`` and ``right`` are -1 - word number for words.  ``tops`` are the symbols that cover the texts and where they begin.
    """

    def __init__(self, ids: np.ndarray, first: np.ndarray) -> None:
        self.begin, self.middle, self.end, self.left, self.right = ([] for _ in range(5))
        self.size = 0
        self._pair_up(*self._repair(-1 - ids, first), first, len(ids))
        for name in ("begin", "middle", "end", "left", "right"):
            setattr(self, name, np.concatenate([np.zeros(0, np.int64), *getattr(self, name)]))

    def _add(self, at: np.ndarray, middle: np.ndarray, end: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        made = np.arange(self.size, self.size + len(at))
        for held, new in zip((self.begin, self.middle, self.end, self.left, self.right), (at, middle, end, left, right)):
            held.append(new)
        self.size += len(at)
        return made

    def _repair(self, symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all texts and where they begin, once no pair of neighbours occurs twice."""
        n = len(symbols)
        symbols = np.append(symbols, 0)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        full = first[1:] > first[:-1]
        after[first[1:][full] - 1], before[first[:-1][full]] = n, n
        after[n] = before[n] = n
        # Ranks of the pairs that begin at each place, kept only during a round; places that are left; pairs that a round must count.
        ranks, left = np.zeros(n + 1, np.int64), np.ones(n, bool)
        alive = np.flatnonzero(after[:n] < n)
        for _ in range(ROUNDS):
            if not len(alive):
                break
            low = symbols.min()
            _, back, count = np.unique((symbols[alive] - low) * (symbols.max() - low + 1) + symbols[after[alive]] - low, return_inverse=True, return_counts=True)
            # Frequency first, then the pair's number. A pair that occurs once never occurs again unless a part of it changes.
            order = np.lexsort((np.arange(len(count)), count))
            rank = np.zeros(len(count), np.int64)
            rank[order] = np.arange(1, len(count) + 1)
            often = count[back] > 1
            at, here = alive[often], rank[back[often]]
            if not len(at):
                break
            ranks[at] = here
            earlier, later = ranks[before[at]], ranks[after[at]]
            # A stretch of one pair (the same word again and again) takes every other place.
            opens = np.append(True, (at[1:] != after[at[:-1]]) | (here[1:] != here[:-1]))
            index = np.arange(len(at))
            stretch = np.maximum.accumulate(np.where(opens, index, 0))
            within = index - stretch - (here < earlier)[stretch]
            chosen = (within >= 0) & (within % 2 == 0) & (here >= later)
            ranks[at] = 0
            a, kinds = at[chosen], here[chosen]
            b = after[a]
            _, where, which = np.unique(kinds, return_index=True, return_inverse=True)
            ends = after[b]
            # The end of a text's last symbol is where the next text begins.
            stops = np.where(ends < n, ends, first[np.searchsorted(first, b, "right")])
            made = self._add(a[where], b[where], stops[where], symbols[a[where]], symbols[b[where]])
            symbols[a] = made[which]
            left[b] = False
            after[a], before[ends] = ends, a
            before[n] = n
            again = np.zeros(n + 1, bool)
            again[at] = again[a] = again[before[a]] = True
            again[b] = again[n] = False
            alive = np.flatnonzero(again)
            alive = alive[after[alive] < n]
        place = np.flatnonzero(left)
        return symbols[place], place

    def _pair_up(self, symbols: np.ndarray, place: np.ndarray, first: np.ndarray, n: int) -> None:
        """A balanced tree over each text's symbols."""
        owner = np.searchsorted(first, place, "right") - 1
        ends = np.append(place[1:], n)
        while len(symbols):
            opens = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            within = np.arange(len(symbols)) - np.repeat(opens, np.diff(np.append(opens, len(symbols))))
            a = np.flatnonzero((within[:-1] % 2 == 0) & (owner[:-1] == owner[1:])) if len(symbols) > 1 else np.zeros(0, np.int64)
            if not len(a):
                break
            symbols, ends = symbols.copy(), ends.copy()
            symbols[a] = self._add(place[a], place[a + 1], ends[a + 1], symbols[a], symbols[a + 1])
            ends[a] = ends[a + 1]
            keep = np.ones(len(symbols), bool)
            keep[a + 1] = False
            symbols, place, owner, ends = symbols[keep], place[keep], owner[keep], ends[keep]
        self.tops, self.at = symbols, place


def _same(ids: np.ndarray, a: int, b: int, most: int, step: int) -> int:
    """How many words from ``a`` and ``b`` on (backwards if step is -1) are the same, ``most`` at most."""
    found, width = 0, 64
    while found < most:
        k = min(width, most - found)
        x = ids[a + found : a + found + k] if step > 0 else ids[a - found - k + 1 : a - found + 1][::-1]
        y = ids[b + found : b + found + k] if step > 0 else ids[b - found - k + 1 : b - found + 1][::-1]
        odd = np.flatnonzero(x != y)
        if len(odd):
            return found + int(odd[0])
        found += k
        width *= 4
    return found


def _squares(sums: np.ndarray, powers: np.ndarray, grammar: Grammar, most: np.ndarray, ahead: bool) -> Iterator[tuple[int, np.ndarray]]:
    """(nonterminal, periods up to ``most``, increasing) of squares that begin (or end) at a boundary and go on for a period on either side."""
    at = grammar.middle
    rows = np.flatnonzero(most > 0)
    upto = np.cumsum(most[rows])
    x = 0
    while x < len(rows):
        y = max(x + 1, int(np.searchsorted(upto, (upto[x - 1] if x else 0) + STEP, "right")))
        some, x = rows[x:y], y
        row = np.repeat(some, most[some])
        opens = np.cumsum(most[some]) - most[some]
        q = np.arange(len(row)) - np.repeat(opens, most[some]) + 1
        low = at[row] if ahead else at[row] - 2 * q
        hit = np.flatnonzero((sums[low + q] - sums[low]) * powers[q] == sums[low + 2 * q] - sums[low + q])
        # A run has four periods, so two more than the square; one of them at least is whole on one side.
        r, p, low = row[hit], q[hit], low[hit]
        more = np.zeros(len(hit), bool)
        for a, b, fits in ((low - p, low, low - p >= grammar.begin[r]), (low + p, low + 2 * p, low + 3 * p <= grammar.end[r])):
            a, b, k = a[fits], b[fits], p[fits]
            more[fits] |= (sums[a + k] - sums[a]) * powers[k] == sums[b + k] - sums[b]
        hit = hit[more]
        cuts = np.flatnonzero(np.append(True, row[hit][1:] != row[hit][:-1])) if len(hit) else np.zeros(0, np.int64)
        for a, b in zip(cuts, np.append(cuts[1:], len(hit))):
            yield int(row[hit[a]]), q[hit[a:b]]


def crossing(ids: np.ndarray, grammar: Grammar) -> list[tuple[int, int, int, int]]:
    """(nonterminal, start, end, period) of the runs that cross a nonterminal's boundary, inside its first place."""
    codes = np.random.default_rng(20260101).integers(1, 1 << 63, int(ids.max()) + 1 if len(ids) else 0, dtype=np.uint64)
    powers = np.full(len(ids) + 1, _ODD[0], np.uint64)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    sums = np.zeros(len(ids) + 1, np.uint64)
    np.cumsum(codes[ids] * powers[: len(ids)], out=sums[1:])
    begin, middle, end = grammar.begin, grammar.middle, grammar.end
    whole = (end - begin) // PERIODS
    long = end - begin >= LEAST
    found = []
    for ahead in (True, False):
        side = end - middle if ahead else middle - begin
        most = np.where(long, np.minimum(side // 2, whole), 0)
        for x, periods in _squares(sums, powers, grammar, most, ahead):
            low, mid, high = int(begin[x]), int(middle[x]), int(end[x])
            past = 0
            for q in periods.tolist():
                # Up to half of a stretch known to have a period, all other periods of squares are its multiples.
                if 2 * q <= past:
                    continue
                right = q + _same(ids, mid, mid + q, high - mid - q, 1) if high - mid >= q else 0
                left = q + _same(ids, mid - 1, mid - 1 - q, mid - low - q, -1) if mid - low >= q else 0
                if ahead:
                    if right < 2 * q:
                        continue
                    start, stop = mid - _same(ids, mid - 1, mid - 1 + q, mid - low, -1), mid + right
                    past = right
                else:
                    if left < 2 * q:
                        continue
                    start, stop = mid - left, mid + _same(ids, mid, mid - q, high - mid, 1)
                    past = left
                if stop - start >= max(LEAST, PERIODS * q):
                    found.append((x, start, stop, q))
    return found


def runs(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Rows (start, end, period) of the runs of several texts' words, by start and period. ``first``: where each text begins, and the end."""
    grammar = Grammar(ids, first)
    own = np.array(crossing(ids, grammar), np.int64).reshape(-1, 4)
    if not len(own):
        return np.zeros((0, 3), np.int64)
    # Only nonterminals with runs somewhere below them are expanded. Words, -1 and less, are the last entry, which stays false.
    left, right = grammar.left, grammar.right
    below, fresh = np.zeros(grammar.size + 1, bool), True
    below[own[:, 0]] = True
    while fresh:
        more = (below[np.maximum(left, -1)] | below[np.maximum(right, -1)]) & ~below[:-1]
        below[:-1] |= more
        fresh = more.any()
    order = np.argsort(own[:, 0], kind="stable")
    own = own[order]
    opens = np.searchsorted(own[:, 0], np.arange(grammar.size + 1))
    symbols, at, pieces_ = grammar.tops, grammar.at, []
    while len(symbols):
        live = (symbols >= 0) & below[np.maximum(symbols, -1)]
        symbols, at = symbols[live], at[live]
        count = opens[symbols + 1] - opens[symbols]
        shift = np.repeat(at - grammar.begin[symbols], count)
        row = np.repeat(opens[symbols], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        pieces_.append(np.stack([own[row, 1] + shift, own[row, 2] + shift, own[row, 3]], 1))
        half = grammar.middle[symbols] - grammar.begin[symbols]
        symbols, at = np.concatenate([left[symbols], right[symbols]]), np.concatenate([at, at + half])
    every = np.unique(np.concatenate(pieces_), axis=0)
    # By period, start and falling end: what ends no later than one before it lies inside that one.
    every = every[np.lexsort((-every[:, 1], every[:, 0], every[:, 2]))]
    group = np.searchsorted(np.unique(every[:, 2]), every[:, 2])
    reach = np.maximum.accumulate(every[:, 1] + group * (len(ids) + 1))
    every = every[np.append(True, every[1:, 1] + group[1:] * (len(ids) + 1) > reach[:-1])]
    # The same stretch with a multiple of its period.
    every = every[np.lexsort((every[:, 2], every[:, 1], every[:, 0]))]
    every = every[np.append(True, (every[1:, :2] != every[:-1, :2]).any(1))]
    return every[np.lexsort((every[:, 2], every[:, 0]))]


def planted(doc: int | None, n: int) -> tuple[int, int] | None:
    """(from, period) of the contract's repetition of a document's own words, which one document in ten gets; none without an id or words."""
    if doc is None or not n:
        return None
    h = zlib.crc32(str(doc).encode())
    g = h // 10
    if h % 10:
        return None
    return g % n, 1 + (n - g % n) // (3 + g % 8)


SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _report(docs: list[int | None], texts: pa.Array, repeat: bool) -> pa.RecordBatch:
    data, starts = utf8(texts)
    begin, end, first = spans(data, starts)
    if repeat:
        source = np.arange(len(begin))
        for k, doc in enumerate(docs):
            place = planted(doc, int(first[k + 1] - first[k]))
            if place:
                a, p = first[k] + place[0], place[1]
                source[a : first[k + 1]] = a + np.arange(first[k + 1] - a) % p
        begin, end = begin[source], end[source]
    ids, _ = word_ids(data, begin, end)
    found = runs(ids, first)
    owner = np.searchsorted(first, found[:, 0], "right") - 1
    length = found[:, 1] - found[:, 0]
    # A word is dropped where a run has covered it for longer than its first period.
    dropped = np.zeros(len(ids) + 1, np.int64)
    np.add.at(dropped, found[:, 0] + found[:, 2], 1)
    np.add.at(dropped, found[:, 1], -1)
    kept = np.flatnonzero(np.cumsum(dropped)[: len(ids)] == 0)
    joined, at = gathered(data, begin[kept], end[kept], 1)
    kept_first, by_doc = np.searchsorted(kept, first), np.searchsorted(owner, np.arange(len(docs) + 1))
    rows = []
    for k, doc in enumerate(docs):
        own = slice(by_doc[k], by_doc[k + 1])
        starts_, lengths, periods = (found[own, 0] - first[k]).tolist(), length[own].tolist(), found[own, 2].tolist()
        best = min(zip([-x for x in lengths], starts_, periods), default=None)
        listed = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in zip(starts_, lengths, periods)).encode()).hexdigest()
        a, b = kept_first[k], kept_first[k + 1]
        text = hashlib.sha256(joined[at[a] : at[b] - 1] if b > a else b"").hexdigest()
        top = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
        rows.append((doc, len(starts_), *top, listed, text))
    kinds = [pa.int64()] * 6 + [pa.string()] * 2
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [f.split()[0] for f in SCHEMA.split(", ")])


def detect(docs: DataFrame, repeat: bool = False) -> DataFrame:
    """For each document (doc_id, text; other columns are ignored) its runs and the text without them.

    Columns: doc_id, n_runs; start, length, period and exponent_milli of the longest
    run (ties: smallest start, then period), null without runs; runs_sha256 of the
    list of all runs; collapsed_sha256 of the words that no run repeats.
    ``repeat`` first repeats words as the contract says.

    A null or empty text, and one of blanks, has no runs.  A null doc_id stays null
    and gets no repetition.  Repeated rows are reported each, very long texts are
    read whole, no rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                yield _report(part.column(0).to_pylist(), part.column(1), repeat)

    batched(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
