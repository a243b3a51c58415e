"""External induced sorting of suffixes with common prefixes.

The suffixes of a sequence of numbers are sorted from those that begin a rise behind a fall (leaders).
Each sorted suffix induces the place of the suffix one to its left: in ascending order for the suffixes
that begin a fall, then in descending order for those that begin a rise.  Both passes take their suffixes
from a priority queue, which holds tuples of position, symbols before it and common prefix with the tuple
queued before it under the same first symbol, and which writes what exceeds its memory to disk as sorted runs.

Leaders are sorted by the same two passes: from leaders in order of first symbol alone they give the order
of the stretches between leaders.  Equal stretches get one name, and the sequence of names is sorted by
recursion, or directly where it is short.  Common prefixes are exact up to ``most``; so is the order.
"""

from __future__ import annotations

import bisect
import heapq
import tempfile
from collections.abc import Iterator

import numpy as np

#: Tuples that a queue holds in memory, and names that are sorted directly.
IN_MEMORY = 4_000_000
#: Bytes of a column that stay in memory.
HELD_BYTES = 32_000_000
#: Stands for the common prefix of stretches that are equal to their ends.
WHOLE = np.int32(1 << 30)
#: Suffixes that one step takes from a file.
BLOCK = 1 << 20

Batch = tuple[np.ndarray, ...]


def scratch(values: np.ndarray) -> np.ndarray:
    """The values, in a temporary file if they are many, which goes with the last reference."""
    if values.nbytes <= HELD_BYTES:
        return values
    file = tempfile.TemporaryFile()
    values.tofile(file)
    file.flush()
    return np.memmap(file, values.dtype, "r+", shape=values.shape)


class Column:
    """Values appended block by block, to a temporary file once they are many, read back from either end."""

    def __init__(self, dtype: type) -> None:
        self.held, self.file, self.dtype, self.size = [], None, np.dtype(dtype), 0

    def append(self, values: np.ndarray) -> None:
        self.held.append(values.astype(self.dtype))
        self.size += len(values)
        if self.file is not None or self.size * self.dtype.itemsize > HELD_BYTES:
            self.file = self.file or tempfile.TemporaryFile()
            for part in self.held:
                part.tofile(self.file)
            self.held = []

    def all(self) -> np.ndarray:
        if self.file is None:
            self.held = [np.concatenate([np.zeros(0, self.dtype), *self.held])]
            return self.held[0]
        self.file.flush()
        return np.memmap(self.file, self.dtype, "r+", shape=(self.size,))


class PriorityQueue:
    """Tuples by key, first in first out under one key; keys leave in one direction only.

    ``sign`` is 1 where the smallest key leaves first and -1 where the largest does.  Tuples beyond
    ``memory`` are written as a run sorted by key; tuples under one key are read run by run, which is the
    order they came in.
    """

    def __init__(self, sign: int, memory: int) -> None:
        self.sign, self.memory, self.size = sign, memory, 0
        self.runs: list[list] = []
        self.held: dict[int, list[Batch]] = {}
        self.order: list[int] = []

    def push(self, keys: np.ndarray, batch: Batch) -> None:
        """Add tuples, which are sorted by key in either direction."""
        if not len(keys):
            return
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(keys)], strict=True):
            key = int(keys[lo])
            if key not in self.held:
                self.held[key] = []
                heapq.heappush(self.order, self.sign * key)
            self.held[key].append(tuple(column[lo:hi] for column in batch))
        self.size += len(keys)
        if self.size > self.memory:
            self._write()

    def _write(self) -> None:
        keys = sorted(self.held, key=lambda k: self.sign * k)
        counts = [sum(len(part[0]) for part in self.held[k]) for k in keys]
        width = len(self.held[keys[0]][0])
        columns = [scratch(np.concatenate([part[c] for k in keys for part in self.held[k]])) for c in range(width)]
        self.runs.append([keys, np.cumsum([0, *counts]).tolist(), columns, 0])
        self.held, self.order, self.size = {}, [], 0

    def first(self) -> int | None:
        """The key that leaves next."""
        heads = [self.sign * run[0][run[3]] for run in self.runs] + self.order[:1]
        return self.sign * min(heads) if heads else None

    def pop(self) -> Iterator[Batch]:
        """The tuples under the first key that are queued now, in blocks."""
        key = self.first()
        mine = self.held.pop(key, [])
        if mine:
            heapq.heappop(self.order)
        self.size -= sum(len(part[0]) for part in mine)
        live = [(run[2], *run[1][run[3] : run[3] + 2]) for run in self.runs if run[0][run[3]] == key]
        for run in self.runs:
            run[3] += run[0][run[3]] == key
        self.runs = [run for run in self.runs if run[3] < len(run[0])]
        for columns, lo, hi in live:
            for at in range(lo, hi, BLOCK):
                yield tuple(np.array(column[at : min(at + BLOCK, hi)]) for column in columns)
        if mine:
            yield tuple(np.concatenate(parts) for parts in zip(*mine, strict=True)) if len(mine) > 1 else mine[0]


class Text:
    """A sequence of numbers on disk; the last one is 0 and the only 0."""

    def __init__(self, symbols: np.ndarray) -> None:
        self.symbols, self.n = symbols, len(symbols)
        self.top = int(symbols.max())
        self.bits = max(1, self.top.bit_length())
        self.carried = 63 // self.bits

    def before(self, positions: np.ndarray) -> np.ndarray:
        """The symbols before each position, packed from the nearest on, as many as a tuple carries."""
        # A long text is read in the order of its positions.
        order = np.argsort(positions) if self.n > IN_MEMORY << 4 else slice(None)
        own, out = positions[order], np.zeros(len(positions), np.int64)
        for k in range(self.carried):
            found = self.symbols[np.maximum(own - 1 - k, 0)].astype(np.int64)
            out |= np.where(own > k, found, 0) << (k * self.bits)
        if isinstance(order, slice):
            return out
        back = np.empty_like(out)
        back[order] = out
        return back

    def leaders(self) -> np.ndarray:
        """Positions that begin a rise behind a fall, the last position included."""
        found, rising = Column(np.int64), True
        found.append(np.array([self.n - 1]))
        for hi in range(self.n - 1, 0, -BLOCK):
            lo = max(0, hi - BLOCK)
            part = np.asarray(self.symbols[lo : hi + 1]).astype(np.int64)
            step = np.sign(part[1:] - part[:-1])
            # A flat stretch goes on as what follows it does.
            place = np.where(step != 0, np.arange(len(step)), len(step))
            place = np.minimum.accumulate(place[::-1])[::-1]
            rises = np.append(step > 0, rising)[place]
            start = max(lo, 1)
            behind = np.asarray(self.symbols[start - 1 : hi - 1]) > part[start - lo : hi - lo]
            found.append(start + np.flatnonzero(rises[start - lo :] & behind)[::-1])
            rising = bool(rises[0])
        return found.all()[::-1]

    def repeats(self, position: int, most: int) -> int:
        """How often the symbol at a position repeats from there, up to ``most``."""
        part = np.asarray(self.symbols[position : position + most])
        return int(np.argmax(np.append(part != part[0], True)))

    def common(self, a: np.ndarray, b: np.ndarray, known: np.ndarray, most: int) -> np.ndarray:
        """Common prefixes of the suffixes at ``a`` and ``b``, of which ``known`` symbols are equal, up to ``most``."""
        out = np.minimum(known, most).astype(np.int32)
        left = np.flatnonzero(out < most)
        # Four symbols at once where they are short: the lowest bit that differs tells how many are equal.
        step = 4 if self.symbols.dtype == np.uint16 and self.n > 4 else 1
        words = np.ndarray(self.n - 3, "<u8", self.symbols, strides=(2,)) if step == 4 else self.symbols
        while len(left):
            x, y = a[left] + out[left], b[left] + out[left]
            near = np.maximum(x, y) < len(words)
            if not near.all():
                end = left[~near]
                while len(end):
                    p, q = a[end] + out[end], b[end] + out[end]
                    equal = (np.maximum(p, q) < self.n) & (out[end] < most)
                    equal[equal] = self.symbols[p[equal]] == self.symbols[q[equal]]
                    end = end[equal]
                    out[end] += 1
                left, x, y = left[near], x[near], y[near]
            differ = words[x] ^ words[y]
            equal = differ == 0
            if step == 4:
                out[left] += np.where(equal, 4, np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)) >> 4).astype(np.int32)
            else:
                out[left] += equal
            left = left[equal & (out[left] < most)]
        return np.minimum(out, most)


class _Pass:
    """One pass of induction: what is scanned puts the suffix to its left into a queue.

    The common prefix of two tuples queued one after the other under a symbol is one more than the least
    common prefix among the suffixes scanned from behind the first one's source to the second one's.
    """

    def __init__(self, text: Text, sign: int, memory: int, most: int) -> None:
        self.text, self.sign, self.most = text, sign, most
        self.queue = PriorityQueue(sign, memory)
        # For each symbol the step that queued it last, and the least common prefix behind it in that step.
        self.step, self.queued = 0, np.full(text.top + 1, -1, np.int64)
        self.rest = np.zeros(text.top + 1, np.int32)
        # Steps whose least common prefix is below that of all later ones.
        self.steps: list[int] = []
        self.lows: list[int] = []

    def scan(self, symbol: int, positions: np.ndarray, before: np.ndarray, common: np.ndarray, *, own: bool) -> None:
        """Induce from scanned suffixes that begin with ``symbol``; ``own``: they are of the kind that the pass sorts."""
        if not len(positions):
            return
        text = self.text
        common = common.astype(np.int32)
        left = before & ((1 << text.bits) - 1)
        side = self.sign * (left - symbol)
        goes = (positions > 0) & ((side > 0) | (side == 0 if own else False))
        place = np.flatnonzero(goes)
        kinds = left[place]
        order = np.argsort(kinds.astype(np.uint16) if text.top < 1 << 16 else kinds, kind="stable")
        place, kinds = place[order], kinds[order]
        if len(place):
            first = np.flatnonzero(np.append(True, kinds[1:] != kinds[:-1]))
            # Between tuples of one kind: the least common prefix behind the earlier source up to the later one.
            between = np.minimum.reduceat(np.append(common, WHOLE), np.append(place + 1, len(common)))
            value = np.empty(len(place), np.int32)
            value[1:] = between[: len(place) - 1]
            value[first] = np.minimum(self._since(kinds[first]), np.minimum.accumulate(common)[place[first]])
            last = np.append(first[1:], len(place)) - 1
            behind = np.append(np.minimum.accumulate(common[::-1])[::-1], WHOLE)
            self.queued[kinds[first]], self.rest[kinds[first]] = self.step, behind[place[last] + 1]
            self._queue(place, kinds, positions, before, value)
        low = int(common.min())
        while self.lows and self.lows[-1] >= low:
            self.lows.pop()
            self.steps.pop()
        self.lows.append(low)
        self.steps.append(self.step)
        self.step += 1

    def _since(self, kinds: np.ndarray) -> np.ndarray:
        """For each symbol the least common prefix scanned since it was queued, -1 if it was not."""
        out = self.rest[kinds]
        for k, step in enumerate(self.queued[kinds].tolist()):
            if step < 0:
                out[k] = -1
                continue
            later = bisect.bisect_right(self.steps, step)
            if later < len(self.lows):
                out[k] = min(out[k], self.lows[later])
        return out

    def _queue(self, place: np.ndarray, kinds: np.ndarray, positions: np.ndarray, before: np.ndarray, value: np.ndarray) -> None:
        text = self.text
        # Equal stretches stay equal; other common prefixes grow by the symbol.
        value = np.where(value >= WHOLE, WHOLE, np.minimum(value + 1, self.most))
        shifted = before[place] >> text.bits
        moved = positions[place] - 1
        empty = (shifted == 0) & (moved > 0)
        shifted[empty] = text.before(moved[empty])
        self.queue.push(kinds, (moved, shifted, value))


def induce(text: Text, leaders: np.ndarray, common: np.ndarray, most: int, memory: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(positions, common prefixes with the one before, whether they begin a rise) of all suffixes in descending order.

    ``leaders`` are sorted ascending with their common prefixes with the one before.
    """
    falls = _Pass(text, 1, memory, most)
    sizes: list[tuple[int, int, int]] = []
    positions, symbols, prefixes = Column(np.int64), Column(np.int64), Column(np.int32)
    at = 0
    while True:
        queued = falls.queue.first()
        lead = int(text.symbols[leaders[at]]) if at < len(leaders) else None
        if queued is None and lead is None:
            break
        symbol = min(x for x in (queued, lead) if x is not None)
        begun, repeats = positions.size, 0
        # Each round holds suffixes with one more repetition of the symbol.
        while falls.queue.first() == symbol:
            repeats += 1
            for moved, before, value in falls.queue.pop():
                positions.append(moved)
                symbols.append(before)
                prefixes.append(value)
                falls.scan(symbol, moved, before, value, own=True)
        sizes.append((symbol, positions.size - begun, repeats))
        if lead == symbol:
            fresh = True
            while lead == symbol:
                some, value = np.asarray(leaders[at : at + BLOCK]), np.array(common[at : at + BLOCK], np.int32)
                own = int(np.searchsorted(np.asarray(text.symbols[some]), symbol, side="right"))
                some, value, at = some[:own], value[:own], at + own
                if fresh:
                    # The last fall and the first rise under a symbol share its shorter repetition.
                    value[0] = min(repeats, text.repeats(int(some[0]), most))
                falls.scan(symbol, some, text.before(some), value, own=False)
                fresh, lead = False, int(text.symbols[leaders[at]]) if at < len(leaders) else None
    fallen = positions.all(), symbols.all(), prefixes.all()
    rises = _Pass(text, -1, memory, most)
    end = positions.size
    while True:
        queued = rises.queue.first()
        lower = sizes[-1][0] if sizes else None
        if queued is None and lower is None:
            break
        symbol = max(x for x in (queued, lower) if x is not None)
        repeats = 0
        while rises.queue.first() == symbol:
            repeats += 1
            for moved, before, value in rises.queue.pop():
                yield moved, value, True
                rises.scan(symbol, moved, before, value, own=True)
        if lower == symbol:
            _, number, fall_repeats = sizes.pop()
            for hi in range(end, end - number, -BLOCK):
                lo = max(end - number, hi - BLOCK)
                some, before = fallen[0][lo:hi][::-1], fallen[1][lo:hi][::-1]
                # In descending order a suffix is compared with the next one of the ascending order.
                value = np.empty(hi - lo, np.int32)
                value[1:] = fallen[2][lo + 1 : hi][::-1]
                value[0] = fallen[2][hi] if hi < end else min(repeats, fall_repeats, most)
                yield some, value, False
                rises.scan(symbol, some, before, value, own=False)
            end -= number


def _sorted_directly(names: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the order of their suffixes, by doubling up to ``depth`` names, and how many names each surely shares with the one before."""
    n, reach = len(names), 1
    order = np.argsort(names, kind="stable")
    first = np.append(True, names[order][1:] != names[order][:-1])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    shared = np.where(first, 0, depth)
    while reach < depth:
        # Ranks are places of the first member of a group; only groups of several members are sorted on.
        open_ = np.flatnonzero(~(first & np.append(first[1:], True)))
        if not len(open_):
            break
        at = order[open_]
        ahead = np.where(at + reach < n, rank[np.minimum(at + reach, n - 1)] + 1, 0)
        key = rank[at] * (n + 1) + ahead
        inner = np.argsort(key)
        order[open_], key = at[inner], key[inner]
        fresh = np.append(True, key[1:] != key[:-1])
        # Neighbours that part now were equal as far as the last round reached.
        shared[open_] = np.where(fresh & ~first[open_], reach, shared[open_])
        first[open_] = fresh
        rank[order[open_]] = np.maximum.accumulate(np.where(first[open_], open_, 0))
        reach *= 2
    return order, shared


def _by_first_symbol(text: Text, leaders: np.ndarray, memory: int) -> tuple[np.ndarray, np.ndarray]:
    """The leaders by first symbol alone, through a queue; those under one symbol count as equal to their ends."""
    queue, sorted_, common = PriorityQueue(1, memory), Column(np.int64), Column(np.int32)
    for lo in range(0, len(leaders), BLOCK):
        some = np.asarray(leaders[lo : lo + BLOCK])
        first = np.asarray(text.symbols[some]).astype(np.int64)
        order = np.argsort(first, kind="stable")
        queue.push(first[order], (some[order],))
    last = None
    while (symbol := queue.first()) is not None:
        for (some,) in queue.pop():
            value = np.full(len(some), WHOLE)
            value[0] = WHOLE if symbol == last else 0
            last = symbol
            sorted_.append(some)
            common.append(value)
    return sorted_.all(), common.all()


def _names(text: Text, leaders: np.ndarray, most: int, memory: int) -> np.ndarray:
    """A number for the stretch from each leader to the next; equal stretches have equal numbers, in their order.  The last one is 0."""
    ordinal = scratch(np.full(text.n, -1, np.int32 if text.n < 1 << 31 else np.int64))
    for lo in range(0, len(leaders), BLOCK):
        ordinal[leaders[lo : lo + BLOCK]] = np.arange(lo, min(lo + BLOCK, len(leaders)))
    name, least, places, names = 0, WHOLE, Column(ordinal.dtype), Column(np.int64)
    for positions, value, rising in induce(text, *_by_first_symbol(text, leaders, memory), most, memory):
        known = ordinal[positions] if rising else np.zeros(0, np.int32)
        own = np.flatnonzero(known >= 0)
        if not len(own):
            least = min(least, value.min(initial=WHOLE))
            continue
        lows = np.minimum.reduceat(value[: own[-1] + 1], np.append(0, own[:-1] + 1))
        lows[0] = min(lows[0], least)
        least = value[own[-1] + 1 :].min(initial=WHOLE)
        label = name + np.cumsum(lows < WHOLE)
        name = int(label[-1])
        places.append(known[own])
        names.append(label)
    places, names = places.all(), names.all()
    numbers = scratch(np.zeros(len(leaders), np.int64))
    for lo in range(0, len(places), BLOCK):
        numbers[places[lo : lo + BLOCK]] = name + 1 - names[lo : lo + BLOCK]
    return numbers


def sort_leaders(text: Text, most: int, memory: int) -> tuple[np.ndarray, np.ndarray]:
    """The leaders in the order of their suffixes, and their common prefixes with the one before."""
    leaders = text.leaders()
    names = _names(text, leaders, most, memory)
    # Two leaders are at least two symbols apart.
    depth = most // 2 + 1
    ranked, prefix = _sorted_directly(np.asarray(names), depth) if len(names) <= memory else suffix_order(names, depth, memory)
    result, shared = Column(np.int64), Column(np.int32)
    before = None
    for lo in range(0, len(ranked), BLOCK):
        some, equal = np.asarray(ranked[lo : lo + BLOCK]), np.asarray(prefix[lo : lo + BLOCK])
        position = leaders[some]
        earlier = np.append(position[0] if before is None else before, position[:-1])
        # Equal names are equal stretches, as long as the way to the leader behind them.
        known = leaders[np.minimum(some + equal, len(leaders) - 1)] - position
        value = text.common(earlier, position, known, most)
        if before is None:
            value[0] = 0
        before = position[-1]
        result.append(position)
        shared.append(value)
    return result.all(), shared.all()


def suffix_order(symbols: np.ndarray, most: int, memory: int = IN_MEMORY) -> tuple[np.ndarray, np.ndarray]:
    """All positions in the order of their suffixes, and their common prefixes with the one before, up to ``most``."""
    positions, prefixes = Column(np.int64), Column(np.int32)
    for some, value in descending(symbols, most, memory):
        positions.append(some)
        prefixes.append(value)
    order, value = positions.all()[::-1], np.zeros(positions.size, np.int32)
    value[1:] = prefixes.all()[1:][::-1]
    return np.asarray(order), value


def descending(symbols: np.ndarray, most: int, memory: int = IN_MEMORY) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of positions in descending order of their suffixes, with common prefixes with the one before.

    The last symbol must be 0 and the only 0.  Suffixes with ``most`` equal symbols may stand in any order.
    """
    text = Text(symbols)
    if text.n == 1:
        yield np.zeros(1, np.int64), np.zeros(1, np.int32)
        return
    leaders, shared = sort_leaders(text, most, memory)
    for positions, value, _ in induce(text, leaders, shared, most, memory):
        yield positions, value
    # Nothing induces the last position, which sorts before all others.
    yield np.array([text.n - 1]), np.zeros(1, np.int32)
