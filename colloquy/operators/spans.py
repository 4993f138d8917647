"""Exact search of the words that a transcript segment stands for.

A segment meets the words of its band of places; every start in the band is tried with six sizes. Words
travel in blocks of a conversation, each segment takes only the blocks of its band, and a long band is cut
into pieces of its own, so no task holds a conversation. Within a piece the shared tokens and 3-grams of all
windows come from differences at the places where each token enters and leaves the moving window. With the
lengths they bound the score of a window; windows are scored best bound first, by bit-parallel
edit distances, until no bound beats what is found. A distance that is known bounds those of all windows
that share most of its words, so a window scored rules out its neighbours. Segments of a task are searched together:
each step of a distance serves windows of many of them.

The score is that of :func:`colloquy.functions.text.with_span_score`, digit for digit.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.edits import within
from ..functions.text import GRAMS, INSIDE, SORTED, TOKENS, WHOLE, normal

#: Words in a block; starts in a piece of a band.
BLOCK, PIECE = 128, 2048
#: Rounding of scores, and more than what it and floating point can add.
PLACES, SLACK = 6, 1e-5
#: The sizes tried for a segment of n words: n, n - 1, n + 1, n - 2, n + 2 and 7 n / 10.
SHRUNK = 0.7
FOUND = "start long, size long, score double"


def sizes(n: int) -> list[int]:
    return [s for s in dict.fromkeys([n, n - 1, n + 1, n - 2, n + 2, math.floor(n * SHRUNK)]) if s > 0]


def size_column(n: Column) -> Column:
    """The same as a column of distinct sizes, some of which may not be positive."""
    return F.array_distinct(F.array(n, n - 1, n + 1, n - 2, n + 2, F.floor(n * SHRUNK).cast("long")))


#: The characters of a normal form.
CHARACTERS = "abcdefghijklmnopqrstuvwxyz0123456789_ "
#: Texts of so many characters are measured with all windows at once; of longer ones so many windows, which lie this part of the text apart.
SHORT, LANES, GAP = 150, 2, 100
#: Windows whose middles lie within this part of the text have a core.
CORES = 12
#: Characters of the words that are searched at once, and of those that are counted at once.
TOGETHER, COUNTED = 2_000_000, 150_000


def masks(text: str) -> dict[str, int]:
    """For each character the places at which a text has it, a bit each."""
    out = dict.fromkeys(CHARACTERS, 0)
    for i, c in enumerate(text):
        out[c] |= 1 << i
    return out


def edits(places: dict[str, int], m: int, text: str, ends: list[int]) -> list[int]:
    """Edit distances of a text of ``m`` characters, given by its ``masks``, and each of the beginnings of another that end at ``ends``, in order.

    A column of the table of distances is two integers, a bit for each cell that is one more (or one less) than
    the cell above; all cells of a column take a step at once.
    """
    whole = (1 << m) - 1
    more, less, at, out = whole, 0, 0, []
    for end in ends:
        for eq in map(places.__getitem__, text[at:end]):
            diagonal = (((eq & more) + more) ^ more) | eq
            either = eq | less
            right = ((less | (whole ^ ((diagonal | more) & whole))) << 1) | 1
            more = (((more & diagonal) << 1) | (whole ^ ((either | right) & whole))) & whole
            less = right & either
        at = end
        out.append(end + more.bit_count() - less.bit_count())
    return out


def _bits(rows: np.ndarray) -> list[int]:
    """Each row of truth values as an integer, the first value in its lowest bit."""
    return [int.from_bytes(r.tobytes(), "little") for r in np.packbits(rows, axis=1, bitorder="little")]


def edits_beside(text: str, others: list[str], anywhere: bool = False) -> list[np.ndarray]:
    """For each of the others the edit distances of ``text`` and of its beginnings of 1, 2, ... characters.

    As :func:`edits`, but the tables of all others stand side by side in the integers, a bit apart that takes the
    carry. ``anywhere``: the least distance of any part that ends there, wherever it begins.
    """
    raw = np.frombuffer("\0".join([*others, ""]).encode("ascii"), np.uint8)
    kinds = sorted(set(text))
    inside = raw != 0
    low = np.append(True, ~inside[:-1])
    whole, lows, *places = _bits(np.vstack([inside, low, raw == np.frombuffer("".join(kinds).encode("ascii"), np.uint8)[:, None]]))
    more, less = 0 if anywhere else whole, 0
    for eq in map(dict(zip(kinds, places)).__getitem__, text):
        diagonal = (((eq & more) + more) ^ more) | eq | less
        right = ((less | (whole ^ ((diagonal | more) & whole))) << 1) | lows
        more, less = (((more & diagonal) << 1) | (whole ^ ((diagonal | right) & whole))) & whole, right & diagonal
    step = [np.unpackbits(np.frombuffer(x.to_bytes(len(raw) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(raw)].astype(np.int64) for x in (more, less & whole)]
    at, out, change = 0, [], step[0] - step[1]
    for o in others:
        out.append(len(text) + np.cumsum(change[at : at + len(o)]))
        at += len(o) + 1
    return out


class Counted:
    """What the windows of some segments share with the wanted texts.

    All arrays are of all segments, so a step of numpy serves thousands of windows. The texts stand in one stream,
    for each segment what is wanted and then what is said.
    """

    COLUMNS = ("unit", "start", "size", "first", "end", "longest", "dice", "inside", "shared", "known", "least_sorted", "least_plain")

    def __init__(self, units: list[tuple[str, list[str], int, int]]):
        self.wanted = [u[0] for u in units]
        parts: list[str] = []
        for wanted, words, _, _ in units:
            parts += wanted, " ".join(filter(None, words))
        self.stream = "\n".join([*parts, ""])
        self._measure(units, np.array([len(t) for t in parts], dtype=np.int64).reshape(-1, 2))

    def _measure(self, units: list[tuple[str, list[str], int, int]], chars: np.ndarray) -> None:
        spots = len(self.stream)
        every = np.arange(len(units))
        n_words = np.array([len(u[1]) for u in units], dtype=np.int64)
        tried = [sizes(u[2]) for u in units]
        self.tried = np.array([t + [0] * (6 - len(t)) for t in tried], dtype=np.int64)
        starts = np.array([u[3] for u in units], dtype=np.int64)[:, None]
        self.counts = np.where(self.tried > 0, np.clip(np.minimum(starts, n_words[:, None] - self.tried + 1), 0, None), 0)
        # a slot for each window, and one after those of a size
        self.slots = int((self.counts + 1).sum())
        self.slot = (np.cumsum(self.counts + 1) - self.counts.ravel() - 1).reshape(self.counts.shape)
        codes = np.full(128, len(CHARACTERS), dtype=np.uint16)
        codes[np.frombuffer(CHARACTERS.encode("ascii"), np.uint8)] = np.arange(len(CHARACTERS))
        code = codes[np.frombuffer(self.stream.encode("ascii"), np.uint8)]
        # the segment of each character, and whether it is said
        unit = np.repeat(every, chars.sum(axis=1) + 2)
        is_said = np.repeat(np.tile([False, True], len(units)), chars.ravel() + 1)
        # words that are not empty, and the number in its segment of each that a character belongs to; a blank belongs to the word before
        length = np.array([len(w) for u in units for w in u[1]], dtype=np.int64)
        base = np.cumsum(n_words) - n_words
        filled = length > 0
        before = np.append(0, np.cumsum(filled))
        owner = np.repeat(every, n_words)
        place = np.arange(len(length)) - base[owner]
        word = np.zeros(spots, dtype=np.int64)
        word[is_said] = np.repeat(place[filled], length[filled] + 1)
        begin = np.cumsum(length[filled] + 1) - length[filled] - 1 + np.cumsum(chars[:, 0] + 1)[owner[filled]]
        end = begin + length[filled]
        own, full, common = self._tokens(code, unit, is_said, word)
        x, y, both = self._grams(code, unit, is_said, word, chars[:, 0])
        parts = self.counts.ravel()
        slot = np.arange(self.slots - len(parts)) + np.repeat(np.arange(len(parts)), parts)
        self.unit = np.repeat(np.arange(len(parts)) // 6, parts)
        self.size = np.repeat(self.tried.ravel(), parts)
        self.start = slot - np.repeat(self.slot.ravel(), parts)
        at = base[self.unit] + self.start
        a, b = before[at], before[at + self.size]
        some = b > a
        self.unit, self.size, self.start, slot, a, b = (v[some] for v in (self.unit, self.size, self.start, slot, a, b))
        self.first, self.end = begin[a], end[b - 1]
        full, common, y, both = full[slot], common[slot], y[slot], both[slot]
        p, q, own, x = chars[self.unit, 0], self.end - self.first, own[self.unit], x[self.unit]
        for k in np.flatnonzero(q < 3).tolist():
            y[k], both[k] = 1, int(self.stream[self.first[k] : self.end[k]] == self.wanted[self.unit[k]])
        self.dice = 2.0 * common / np.maximum(own + full, 1)
        self.longest = longest = np.maximum(p, q)
        self.inside = both / np.maximum(np.minimum(x, y), 1).astype(np.float64)
        self.shared = both / np.maximum(x + y - both, 1).astype(np.float64)
        # an edit changes one character, at most two tokens and at most three 3-grams
        lost = np.maximum(own - common, full - common)
        self.least_sorted = np.maximum(np.abs(p - q), (lost + 1) // 2)
        self.least_plain = np.minimum(longest, np.maximum(np.abs(p - q), (np.maximum(x, y) - both + 2) // 3))
        self.known = TOKENS * self.dice + INSIDE * self.inside + GRAMS * self.shared

    def _distinct(self, unit: np.ndarray, one: np.ndarray, last: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        """By slot, how many different things each window holds whole.

        A thing begins in the word ``one`` and ends in ``last``; windows from the word ``earlier`` on do not hold the same
        thing before it. It counts for a run of windows of each size: one is added where the run starts and taken off where it ends.
        """
        change = np.zeros(self.slots, dtype=np.int64)
        for size, count, slot in zip(self.tried.T, self.counts.T, self.slot.T):
            count, slot = count[unit], slot[unit]
            lo = np.minimum(np.maximum(last + 1 - size[unit], earlier), count)
            hi = np.maximum(np.minimum(one + 1, count), lo)
            change += np.bincount(slot + lo, minlength=self.slots) - np.bincount(slot + hi, minlength=self.slots)
        return np.cumsum(change)

    def _runs(self, ids: np.ndarray, at: np.ndarray, unit: np.ndarray, is_said: np.ndarray, word: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of things with ``ids`` at ``at``: how many different ones are wanted by each segment, and by slot how many are said and how many of these are wanted."""
        order = np.argsort(ids, kind="stable")
        ids, at, last = ids[order], at[order], last[order]
        owner, said = unit[at], is_said[at]
        new = np.append(True, (ids[1:] != ids[:-1]) | (owner[1:] != owner[:-1]))[: len(ids)]
        # what is wanted stands before what is said, so it heads the run of its kind
        wanted = (~said)[new][np.cumsum(new) - 1]
        mine = np.bincount(owner[new & ~said], minlength=len(self.wanted))
        earlier = np.append(0, np.where(new[1:] | ~said[:-1], 0, word[at[:-1]] + 1))[: len(ids)]
        owner, one, last, earlier, wanted = owner[said], word[at[said]], last[said], earlier[said], wanted[said]
        return mine, self._distinct(owner, one, last, earlier), self._distinct(owner[wanted], one[wanted], last[wanted], earlier[wanted])

    def _tokens(self, code: np.ndarray, unit: np.ndarray, is_said: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids: dict[str, int] = {}
        found = np.array([ids.setdefault(t, len(ids)) for t in self.stream[:-1].replace("\n", " ").split(" ")])
        at = np.append(0, np.flatnonzero(code[:-1] >= len(CHARACTERS) - 1) + 1)
        return self._runs(found, at, unit, is_said, word, word[at])

    def _grams(self, code: np.ndarray, unit: np.ndarray, is_said: np.ndarray, word: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        k = len(CHARACTERS) + 1
        inside = code < k - 1
        at = np.flatnonzero(inside[:-2] & inside[1:-1] & inside[2:])
        # a blank at the end is held with the word after it
        ends = at + 2 + (code[at + 2] == k - 2)
        mine, said, both = self._runs((code[at] * k + code[at + 1]) * k + code[at + 2], at, unit, is_said, word, word[ends])
        return np.where(p < 3, 1, mine), said, both


class Windows:
    """The windows of many segments over consecutive words, with bounds of their scores."""

    #: What is known of each window.
    COLUMNS = (*Counted.COLUMNS, "order", "sorted", "plain", "scores")

    def __init__(self, units: list[tuple[str, list[str], int, int]]):
        """Of each unit the wanted text, words in normal form, the number of words wanted, and that of starts: the first word is the first of them."""
        # without a word on either side nothing scores
        self.of = [i for i, (wanted, words, _, _) in enumerate(units) if wanted and any(words)]
        units = [units[i] for i in self.of]
        self.wanted = [u[0] for u in units]
        self.in_order = [" ".join(sorted(w.split(" "))) for w in self.wanted]
        self.chars = np.array([len(w) for w in self.wanted], dtype=np.int64)
        self.shrunk = np.array([math.floor(u[2] * SHRUNK) for u in units], dtype=np.int64)
        self.rounds, done, spots, streams = 0, 0, 0, []
        columns: dict[str, list[np.ndarray]] = {c: [] for c in Counted.COLUMNS}
        for some in _shares(units, COUNTED):
            part = Counted(some)
            for c, values in columns.items():
                values.append(getattr(part, c) + (done if c == "unit" else spots if c in ("first", "end") else 0))
            streams.append(part.stream)
            done, spots = done + len(some), spots + len(part.stream)
        self.stream = "".join(streams)
        for c, values in columns.items():
            setattr(self, c, np.concatenate(values) if values else np.zeros(0, dtype=np.int64))
        # in (size, start)
        self.order = self.size * (int(self.start.max(initial=0)) + 1) + self.start
        self.scores = np.full(len(self.start), -1.0)
        self.plain, self.sorted = np.full(len(self.start), -1), np.full(len(self.start), -1)

    def _bound(self) -> np.ndarray:
        return self.known + SORTED * (1 - self.least_sorted / self.longest) + WHOLE * (1 - self.least_plain / self.longest)

    def _narrow(self, least: float, sure: float | None) -> tuple[np.ndarray, np.ndarray]:
        """Drops what cannot be a result; the bounds of the others and what each segment's windows have to reach."""
        reach = np.full(len(self.wanted), least)
        bound = self._bound()
        keep = np.ones(len(bound), dtype=bool)
        if sure is not None:
            np.maximum.at(reach, self.unit, self.scores)
            reach = np.minimum(reach, sure)
            # of sure windows the first counts
            first = np.full(len(self.wanted), np.iinfo(np.int64).max)
            good = self.scores >= sure
            np.minimum.at(first, self.unit[good], self.order[good])
            keep = self.order <= first[self.unit]
        keep &= np.where(self.scores < 0, bound + SLACK >= reach[self.unit], self.scores >= reach[self.unit])
        if not keep.all():
            for c in self.COLUMNS:
                setattr(self, c, getattr(self, c)[keep])
        return bound[keep], reach

    def _next(self, bound: np.ndarray, sure: bool) -> np.ndarray:
        """Windows to be measured: one of each segment, then all of short texts, and of long ones the best that do not lie close to each other."""
        todo = np.flatnonzero(self.scores < 0)
        order = todo[np.lexsort((-bound[todo], self.unit[todo]))]
        if sure and not self.rounds:
            return order[np.append(True, self.unit[order][1:] != self.unit[order][:-1])] if len(order) else order
        size = self.chars[self.unit[order]]
        long = order[size > SHORT]
        # neighbours are bounded by the same distance
        cell = (self.first[long] + self.end[long]) // np.maximum(2 * size[size > SHORT] // GAP, 1)
        near = np.lexsort((-bound[long], cell, self.unit[long]))
        u, c = self.unit[long][near], cell[near]
        best = long[near[np.append(True, (u[1:] != u[:-1]) | (c[1:] != c[:-1]))[: len(near)]]]
        best = best[np.lexsort((-bound[best], self.unit[best]))]
        return np.concatenate([order[size <= SHORT], best[_rank(self.unit[best]) < LANES * self.rounds]])

    def _cores(self) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
        """What neighbours among the windows of long texts have in common, those of the shrunk size aside, if that is most of them: windows in order of their cores, where those begin, and the cores' places.

        Most words that a window has beside it are said in the text, so they take off of its distance what the bound assumes.
        """
        ks = np.flatnonzero((self.scores < 0) & (self.chars > SHORT)[self.unit] & (self.size > self.shrunk[self.unit]))
        cell = (self.first[ks] + self.end[ks]) // (2 * self.chars[self.unit[ks]] // CORES)
        ks = ks[order := np.lexsort((cell, self.unit[ks]))]
        unit, cell = self.unit[ks], cell[order]
        at = np.flatnonzero(np.append(True, (unit[1:] != unit[:-1]) | (cell[1:] != cell[:-1]))[: len(ks)])
        count = np.diff(np.append(at, len(ks)))
        a, b = (np.maximum.reduceat(self.first[ks], at), np.minimum.reduceat(self.end[ks], at)) if len(at) else (at, at)
        good = (count > 2) & (2 * (b - a) > self.chars[unit[at]])
        ks = ks[np.repeat(good, count)]
        return ks, (np.cumsum(count[good]) - count[good]), list(zip(a[good].tolist(), b[good].tolist()))

    def _learn(self, unit: np.ndarray, first: np.ndarray, end: np.ndarray, distances: np.ndarray, least: np.ndarray) -> None:
        """Windows of long texts are nearer to the text than the given parts by no more than what they do not share with those."""
        of = np.flatnonzero(self.chars[unit] > SHORT)
        of = of[np.argsort(unit[of], kind="stable")]
        rank = _rank(unit[of])
        near = np.flatnonzero((self.chars > SHORT)[self.unit])
        mine, begins, ends, bound = self.unit[near], self.first[near], self.end[near], least[near]
        for r in range(int(rank.max(initial=-1)) + 1):
            some, parts = of[rank == r], np.zeros((3, len(self.wanted)), dtype=np.int64)
            parts[:, unit[some]] = distances[some], first[some], end[some]
            d, a, b = parts[:, mine]
            np.maximum(bound, d - np.abs(begins - a) - np.abs(ends - b), out=bound)
        least[near] = np.minimum(bound, self.longest[near])

    def _most(self, ks: np.ndarray, reach: np.ndarray, weight: float, other: np.ndarray) -> np.ndarray:
        """A distance of each of the windows ``ks`` beyond which it does not reach what its segment asks for."""
        spare = self.known[ks] + (SORTED + WHOLE - weight) * (1 - other[ks] / self.longest[ks]) + weight - (reach[self.unit[ks]] - SLACK)
        return np.maximum(np.floor(self.longest[ks] * spare / weight).astype(np.int64) + 1, 0)

    def _measured(self, ks: np.ndarray, reach: np.ndarray, weight: float, other: np.ndarray, cores: tuple, known: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Those of the windows ``ks`` that may count by their distance; it goes to ``known``, and what follows for all windows to ``least``."""
        group, heads, places = cores
        unit, first, end, most = self.unit[ks], self.first[ks], self.end[ks], self._most(ks, reach, weight, other)
        if places:
            a, b = np.array(places).T
            of = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(group))))
            # far enough to drop every window of the core
            far = np.maximum.reduceat(self._most(group, reach, weight, other) + a[of] - self.first[group] + self.end[group] - b[of], heads)
            unit, first, end, most = np.append(unit, self.unit[group[heads]]), np.append(first, a), np.append(end, b), np.append(most, far)
        said = [self.stream[x:y] for x, y in zip(first.tolist(), end.tolist())]
        if weight == SORTED:
            said = [" ".join(sorted(t.split(" "))) for t in said]
        got = within(self.in_order if weight == SORTED else self.wanted, unit, said, most)
        self._learn(unit, first, end, got, least)
        got, most = got[: len(ks)], most[: len(ks)]
        least[ks] = np.maximum(least[ks], got)
        known[ks] = np.where(got <= most, got, -1)
        return ks[got <= most]

    def _score(self, ks: np.ndarray, reach: np.ndarray) -> None:
        """Scores those windows ``ks`` that may reach what their segment asks for."""
        cores = self._cores() if self.rounds == 1 else ((), (), [])
        ks = self._measured(ks, reach, SORTED, self.least_plain, cores, self.sorted, self.least_sorted)
        ks = self._measured(ks, reach, WHOLE, self.least_sorted, cores, self.plain, self.least_plain)
        longest = self.longest[ks].astype(np.float64)
        value = TOKENS * self.dice[ks] + SORTED * (1 - self.sorted[ks] / longest) + INSIDE * self.inside[ks] + WHOLE * (1 - self.plain[ks] / longest) + GRAMS * self.shared[ks]
        self.scores[ks] = np.floor(value * 10.0**PLACES + 0.5) / 10.0**PLACES

    def found(self, least: float, sure: float | None = None) -> tuple[list[int], list[int], list[int], list[float]]:
        """Unit, start, size and score of every window that scores ``least``; with ``sure`` of each unit's window of highest score, or of those from ``sure`` on the first in (size, start)."""
        if not self.of:
            return [], [], [], []
        while True:
            bound, reach = self._narrow(least, sure)
            ks = self._next(bound, sure is not None)
            if not len(ks):
                break
            self._score(ks, reach)
            self.rounds += 1
        top = np.arange(len(self.start))
        if sure is not None:
            top = np.lexsort((self.order, -np.minimum(self.scores, sure), self.unit))
            top = top[np.append(True, self.unit[top][1:] != self.unit[top][:-1])[: len(top)]]
        return [self.of[u] for u in self.unit[top].tolist()], self.start[top].tolist(), self.size[top].tolist(), self.scores[top].tolist()


def _shares(units: Iterable[tuple], most: int) -> Iterator[list[tuple]]:
    """The units, in order, in lists with about so many characters of words."""
    share: list[tuple] = []
    held = 0
    for u in units:
        share.append(u)
        held += sum(map(len, u[1])) + len(u[1])
        if held >= most:
            yield share
            share, held = [], 0
    if share:
        yield share


def _rank(groups: np.ndarray) -> np.ndarray:
    """The number of each row in its run of equal groups, from 0."""
    at = np.arange(len(groups))
    new = np.append(True, groups[1:] != groups[:-1])[: len(groups)]
    return at - np.maximum.accumulate(np.where(new, at, 0)) if len(groups) else at


class Search:
    """The windows of one segment; the first of ``words``, in normal form, is at the first of ``starts`` consecutive starts."""

    def __init__(self, wanted: str, words: list[str], n: int, starts: int):
        self.windows = Windows([(wanted, words, n, starts)])

    def at_least(self, least: float) -> list[tuple[int, int, float]]:
        """(start, size, score) of every window that scores so much."""
        return list(zip(*self.windows.found(least)[1:]))

    def best(self, least: float, sure: float) -> list[tuple[int, int, float]]:
        """The window of highest score, or of those from ``sure`` on the first in (size, start); none below ``least``."""
        return list(zip(*self.windows.found(least, sure)[1:]))


def blocks(words: DataFrame) -> DataFrame:
    """The normal forms of a conversation's words in blocks of consecutive ones; words by word_index, gapless from 0."""
    block = F.floor(F.col("word_index") / BLOCK).cast("long").alias("block")
    return words.select("conversation_id", block, "word_index", normal(F.col("word")).alias("word")).groupBy("conversation_id", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("word_index", "word"))), lambda w: w["word"]).alias("said"))


def search(segments: DataFrame, said: DataFrame, least: float, sure: float | None = None) -> DataFrame:
    """(conversation_id, segment_index, n, start, size, score) of the windows of each segment that score ``least`` or more.

    In: segments with n_words, text and the band ``first`` to ``last`` of starts, and ``stop``, the place before
    which a window ends at the latest (null: the last word); ``said`` from :func:`blocks`. With ``sure`` a segment's best window alone, by the rule of :meth:`Search.best`. Segments without words, an empty
    band or an empty text give nothing.
    """
    spark = segments.sparkSession
    key = ["conversation_id", "segment_index"]
    s = segments.filter("n_words > 0 AND last >= first").select(*key, F.col("n_words").cast("long").alias("n"), normal(F.col("text")).alias("wanted"), F.greatest("first", F.lit(0)).cast("long").alias("first"), F.col("last").cast("long").alias("last"), F.col("stop").cast("long").alias("stop"))
    s = s.filter("wanted <> '' AND last >= first").withColumn("at", F.explode(F.sequence("first", "last", F.lit(PIECE).cast("long"))))
    s = s.select(*key, "n", "wanted", "at", F.least(F.lit(PIECE), F.col("last") - F.col("at") + 1).alias("starts"), "stop")
    ends = F.col("at") + F.col("starts") + F.col("n") + 1
    ends = F.greatest(F.least(ends, F.coalesce(F.col("stop") - 1, ends)), F.col("at"))
    s = s.withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / BLOCK), F.floor(ends / BLOCK)).cast("array<long>")))
    # a piece is much work for few bytes: pieces are dealt out by number, not by size; many of a task are searched together
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    unit = [*key, "at"]
    j = s.join(said, ["conversation_id", "block"]).repartition(tasks, *unit)
    units = j.groupBy(*unit).agg(F.first("n").alias("n"), F.first("wanted").alias("wanted"), F.first("starts").alias("starts"), F.first("stop").alias("stop"), F.array_sort(F.collect_list(F.struct("block", "said"))).alias("blocks"))
    kinds = {c: segments.schema[c].dataType.simpleString() for c in key}

    def said_of(batch: pa.RecordBatch, i: int) -> list[str]:
        at, n, starts, stop = (batch.column(c)[i].as_py() for c in ("at", "n", "starts", "stop"))
        got = batch.column("blocks")[i].as_py()
        said = [w for b in got for w in b["said"]][at - got[0]["block"] * BLOCK :]
        return said[: starts + n + 2 if stop is None else max(0, min(starts + n + 2, stop - at))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # texts of about one length are searched together
            asked = pa.compute.sort_indices(pa.compute.utf8_length(batch.column("wanted"))).to_pylist()
            for share in _shares(((i, said_of(batch, i)) for i in asked), TOGETHER):
                taken = batch.take(pa.array([i for i, _ in share], pa.int64()))
                at, n, wanted, starts = (taken.column(c).to_pylist() for c in ("at", "n", "wanted", "starts"))
                unit, start, size, score = Windows([(w, words, k, s) for w, (_, words), k, s in zip(wanted, share, n, starts)]).found(least, sure)
                cells = ([n[u] for u in unit], [at[u] + s for u, s in zip(unit, start)], size, score)
                columns = [taken.column(c).take(pa.array(unit, pa.int64())) for c in key]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array(c, t) for c, t in zip(cells, (pa.int64(), pa.int64(), pa.int64(), pa.float64()))]], [*key, "n", "start", "size", "score"])

    return units.mapInArrow(run, f"conversation_id {kinds['conversation_id']}, segment_index {kinds['segment_index']}, n long, {FOUND}")
