"""A HAT-trie over rows of word ids: hash containers that burst into a shallow trie, spilled as sorted runs.

A row has a fixed number of 64-bit ids, 0 where a phrase is shorter.  Rows are inserted in batches.  A
container counts rows in an open-addressing table; one that grows beyond ``burst`` entries bursts: the ids
that begin many of its rows get children of their own, which hold the rest of these rows, and the other
rows stay in the node's shared container.  When the trie holds more than ``most`` entries, the largest
subtree below the root is written whole as a run sorted by ids and let go.  At the end the runs are merged
for one partition of first ids after another, in blocks, so memory stays bounded.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

from tallyspark.llm.common import row_hash

Rows = tuple[np.ndarray, np.ndarray]


def summed(rows: np.ndarray, n: np.ndarray) -> Rows:
    """Rows sorted by ids, each once, with the sums of their numbers."""
    if not len(rows):
        return rows, n
    order = np.lexsort(rows.T[::-1])
    rows, n = rows[order], n[order]
    first = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]).any(axis=1)))
    return rows[first], np.add.reduceat(n, first)


class Container:
    """An open-addressing hash table from rows to their numbers."""

    def __init__(self, width: int) -> None:
        self.size, self.width = 0, width
        self._room(64)

    def _room(self, room: int) -> None:
        held = self.entries() if self.size else None
        self.table = np.full(2 * room, -1, np.int32)
        self.rows, self.hashes, self.counts = np.zeros((room, self.width), np.uint64), np.zeros(room, np.uint64), np.zeros(room, np.int64)
        self.size = 0
        if held:
            self._place(held[0], row_hash(held[0]), held[1])

    def entries(self) -> Rows:
        return self.rows[: self.size], self.counts[: self.size]

    def add(self, rows: np.ndarray, n: np.ndarray) -> None:
        h = row_hash(rows)
        order = np.argsort(h, kind="stable")
        h, rows, n = h[order], rows[order], n[order]
        first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (rows[1:] != rows[:-1]).any(axis=1)))
        h, rows, n = h[first], rows[first], np.add.reduceat(n, first)
        room = len(self.counts)
        while self.size + len(h) > room:
            room *= 2
        if room > len(self.counts):
            self._room(room)
        self._place(rows, h, n)

    def _place(self, rows: np.ndarray, h: np.ndarray, n: np.ndarray) -> None:
        mask = len(self.table) - 1
        slot, left = (h & np.uint64(mask)).astype(np.int64), np.arange(len(h))
        while len(left):
            at = self.table[slot[left]]
            free = at < 0
            same = np.zeros(len(left), bool)
            taken = np.flatnonzero(~free)
            same[taken] = (self.hashes[at[taken]] == h[left[taken]]) & (self.rows[at[taken]] == rows[left[taken]]).all(axis=1)
            self.counts[at[same]] += n[left[same]]
            fresh = left[free]
            won = fresh[np.unique(slot[fresh], return_index=True)[1]]
            ids = np.arange(self.size, self.size + len(won))
            self.rows[ids], self.hashes[ids], self.counts[ids], self.table[slot[won]] = rows[won], h[won], n[won], ids
            self.size += len(won)
            passed = left[~free & ~same]
            slot[passed] = (slot[passed] + 1) & mask
            left = np.concatenate((passed, np.setdiff1d(fresh, won, assume_unique=True)))


class Node:
    """A trie node: children by the next id, and a container shared by all other ids."""

    def __init__(self, width: int, burst: int) -> None:
        self.width, self.burst, self.shared = width, burst, Container(width)
        self.ids, self.children, self.tried = np.zeros(0, np.uint64), [], 0

    @property
    def size(self) -> int:
        return self.shared.size + sum(child.size for child in self.children)

    def add(self, rows: np.ndarray, n: np.ndarray) -> None:
        if len(self.ids):
            place = np.minimum(np.searchsorted(self.ids, rows[:, 0]), len(self.ids) - 1)
            own = self.ids[place] == rows[:, 0]
            order = np.flatnonzero(own)[np.argsort(place[own], kind="stable")]
            bounds = np.searchsorted(place[order], np.arange(len(self.ids) + 1))
            for k in np.flatnonzero(bounds[1:] > bounds[:-1]):
                some = order[bounds[k] : bounds[k + 1]]
                self.children[k].add(rows[some, 1:], n[some])
            rows, n = rows[~own], n[~own]
        if len(rows):
            self.shared.add(rows, n)
        # A container without frequent ids is tried again when it has doubled.
        if self.width > 1 and self.shared.size > max(self.burst, 2 * self.tried):
            self._burst()

    def _burst(self) -> None:
        rows, n = self.shared.entries()
        ids, number = np.unique(rows[:, 0], return_counts=True)
        often = ids[number >= max(2, self.burst // 64)]
        self.tried = 0 if len(often) else self.shared.size
        if not len(often):
            return
        self.shared = Container(self.width)
        order = np.argsort(np.append(self.ids, often), kind="stable")
        children = [*self.children, *(Node(self.width - 1, self.burst) for _ in often)]
        self.ids, self.children = np.append(self.ids, often)[order], [children[k] for k in order]
        self.add(rows, n)

    def entries(self) -> Rows:
        """All rows of the subtree below the node's own path."""
        parts = [self.shared.entries()]
        for own, child in zip(self.ids, self.children, strict=True):
            rows, n = child.entries()
            parts.append((np.column_stack((np.full(len(rows), own, np.uint64), rows)), n))
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _at_most(rows: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Which rows do not sort behind ``bound``."""
    out = np.ones(len(rows), bool)
    for column, value in zip(rows.T[::-1], bound[::-1], strict=True):
        out = (column < value) | ((column == value) & out)
    return out


class HatTrie:
    """Counts rows of ``width`` ids; ``merged`` gives them back, sorted within partitions of the first id."""

    def __init__(self, width: int, *, most: int = 1_000_000, burst: int = 1 << 16, partitions: int = 16) -> None:
        self.width, self.most, self.burst, self.partitions = width, most, burst, partitions
        self.root, self.runs = Node(width, burst), []

    def add(self, rows: np.ndarray, n: np.ndarray | None = None) -> None:
        if len(rows):
            self.root.add(rows, np.ones(len(rows), np.int64) if n is None else n)
        while self.root.size > self.most:
            self._spill()

    def _spill(self) -> None:
        """Write the largest subtree below the root as a sorted run."""
        sizes = [self.root.shared.size, *(child.size for child in self.root.children)]
        largest = int(np.argmax(sizes)) - 1
        if largest < 0:
            rows, n = self.root.shared.entries()
            self.root.shared, self.root.tried = Container(self.width), 0
        else:
            rows, n = self.root.children[largest].entries()
            rows = np.column_stack((np.full(len(rows), self.root.ids[largest], np.uint64), rows))
            self.root.children[largest] = Node(self.width - 1, self.burst)
        self.runs.append(self._run(rows, n, tempfile.TemporaryFile()))

    def _bounds(self, rows: np.ndarray) -> np.ndarray:
        part = rows[:, 0] // np.uint64(-(-(1 << 64) // self.partitions))
        return np.searchsorted(part, np.arange(self.partitions + 1))

    def _run(self, rows: np.ndarray, n: np.ndarray, file: object | None = None) -> tuple[np.ndarray, np.ndarray]:
        rows, n = summed(rows, n)
        both = np.column_stack((rows, n.view(np.uint64)))
        bounds = self._bounds(rows)
        if file is not None:
            file.write(both.tobytes())
            file.flush()
            both = np.memmap(file, np.uint64, "r", shape=both.shape)
        return both, bounds

    def merged(self, block: int = 100_000) -> Iterator[Rows]:
        """Sorted blocks of rows with their numbers; a row is in one block only."""
        runs = [*self.runs, self._run(*self.root.entries())]
        self.root = Node(self.width, self.burst)
        for part in range(self.partitions):
            places = [[int(bounds[part]), int(bounds[part + 1])] for _, bounds in runs]
            while live := [k for k, (lo, hi) in enumerate(places) if lo < hi]:
                heads = [np.array(runs[k][0][places[k][0] : min(places[k][1], places[k][0] + block)]) for k in live]
                # Rows up to the smallest last row of the blocks that have more behind them are complete.
                last = [tuple(head[-1, :-1].tolist()) for k, head in zip(live, heads, strict=True) if places[k][0] + len(head) < places[k][1]]
                whole = [_at_most(head[:, :-1], np.array(min(last), np.uint64)) if last else np.ones(len(head), bool) for head in heads]
                for k, head, own in zip(live, heads, whole, strict=True):
                    places[k][0] += int(own.sum())
                both = np.concatenate([head[own] for head, own in zip(heads, whole, strict=True)])
                yield summed(both[:, :-1], np.ascontiguousarray(both[:, -1]).view(np.int64))
        self.runs = []
