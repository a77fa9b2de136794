"""Runs of periodic words, by suffix trees and Lyndon roots.

A run is a stretch of words that repeats with a smallest period and cannot be extended. Every run of two
periods or more has a rotation of its period that is the longest Lyndon word at its place, for the order of the
words or for the reverse order, so two candidates per place are enough. A candidate is extended
to the right by a longest common extension in the suffix tree of the words and to the left by
one in the tree of the reversed words. Trees are built by Ukkonen's algorithm; an extension is
the depth of a lowest common ancestor, a range minimum over the tour of the tree, answered in constant time from
a sparse table and for all candidates at once.

Trees are built where a run can be. A run of at least 24 words and three periods q has at
least 2 q starts of nine words, so each nine words in it occur twice in the text; the trees cover the maximal stretches of
nine words that occur twice, and the stretch decides whether a run can be extended, as a run's extension would be such a stretch too.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from costwright.llm.bpe import slices

#: A run has at least this many words and this many periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Words that a repeated stretch is made of; any w <= LEAST_WORDS with LEAST_WORDS - w + 1 >= 2 q for q <= 8 is safe.
GRAM = 9
#: Distinct words that a worker numbers before it starts anew (between two texts).
MEMORY = 500_000

_U = np.uint64


class SuffixTree:
    """Ukkonen's suffix tree of a list of symbols (1 .. kinds - 1); symbol 0 is added as the end."""

    def __init__(self, symbols: list[int], kinds: int) -> None:
        s = [*symbols, 0]
        n = len(s)
        begin, end, link = [0], [0], [0]
        leaf_of = [0] * n  # the leaf of the suffix that starts there
        go: dict[int, int] = {}
        node = length = edge = made = waiting = 0
        for i, c in enumerate(s):
            waiting += 1
            fresh = 0
            while waiting:
                if not length:
                    edge = i
                key = node * kinds + s[edge]
                down = go.get(key)
                if down is None:
                    go[key] = leaf_of[made] = len(begin)
                    made += 1
                    begin.append(i)
                    end.append(n)
                    link.append(0)
                    if fresh:
                        link[fresh] = node
                        fresh = 0
                else:
                    first = begin[down]
                    span = end[down] - first
                    if length >= span:
                        edge += span
                        length -= span
                        node = down
                        continue
                    if s[first + length] == c:
                        length += 1
                        if fresh:
                            link[fresh] = node
                        break
                    split = len(begin)
                    go[key] = split
                    begin += (first, i)
                    end += (first + length, n)
                    link += (0, 0)
                    begin[down] = first + length
                    go[split * kinds + s[first + length]] = down
                    go[split * kinds + c] = leaf_of[made] = split + 1
                    made += 1
                    if fresh:
                        link[fresh] = split
                    fresh = split
                waiting -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - waiting + 1
        self.kinds = kinds
        keys = np.fromiter(go.keys(), np.int64, len(go))
        self._child = np.fromiter(go.values(), np.int64, len(go))
        self._parent, self._symbol = keys // kinds, keys % kinds
        self._span = (np.array(end) - np.array(begin)).tolist()
        self._suffix = np.full(len(begin), -1, np.int64)
        self._suffix[leaf_of] = np.arange(n)
        self._table: list[np.ndarray] = []

    def _tour(self, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes in depth-first order, children by the given symbols, and the depths between them.

        Of the Euler tour only the returns to a node between two of its children are
        kept: one between each two leaves, and the only places where a minimum can be.
        """
        order = np.lexsort((-symbol, self._parent))  # last child first, as a stack wants it
        child, parent = self._child[order], self._parent[order]
        nodes = len(self._span)
        ends = np.searchsorted(parent, np.arange(nodes + 1)).tolist()
        above = np.zeros(nodes, np.int64)
        above[child] = parent
        later = np.ones(nodes, bool)  # not the first child of its parent
        later[child[np.flatnonzero(np.append(parent[1:] != parent[:-1], True))]] = False
        child, above, later = child.tolist(), above.tolist(), later.tolist()
        span, depth, leaves, between = self._span, [0] * nodes, [], []
        stack = child[ends[0] : ends[1]]
        while stack:
            node = stack.pop()
            up = depth[above[node]]
            if later[node]:
                between.append(up)
            at, stop = ends[node], ends[node + 1]
            if at == stop:
                leaves.append(node)
            else:
                depth[node] = up + span[node]
                stack += child[at:stop]
        return self._suffix[np.array(leaves)], np.array(between, np.int32)

    def ranks(self, reverse: bool = False) -> np.ndarray:
        """The rank of each suffix, for the order of the symbols or the reverse one; the end is least in both."""
        symbol = np.where(self._symbol == 0, 0, self.kinds - self._symbol) if reverse else self._symbol
        order, between = self._tour(symbol)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        if not self._table:
            self._table, self._rank = [between], rank
            step = 1
            while 2 * step <= len(between):
                half = self._table[-1]
                self._table.append(np.minimum(half[:-step], half[step:]))
                step *= 2
        return rank

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes a and b (never equal)."""
        if not self._table:
            self.ranks()
        low, high = np.minimum(self._rank[a], self._rank[b]), np.maximum(self._rank[a], self._rank[b])
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        found = np.empty(len(low), np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            row = self._table[k]
            found[at] = np.minimum(row[low[at]], row[high[at] - (1 << int(k))])
        return found


def _next_smaller(rank: np.ndarray) -> np.ndarray:
    """For each suffix but the last the next one that is smaller; the word between is its longest Lyndon word."""
    found, open_at = np.zeros(len(rank) - 1, np.int64).tolist(), []
    for i, r in enumerate(rank.tolist()):
        while open_at and open_at[-1][0] > r:
            found[open_at.pop()[1]] = i
        open_at.append((r, i))
    return np.array(found, np.int64)


def runs_of(symbols: np.ndarray, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> np.ndarray:
    """(start, length, period) of all runs of that many symbols and periods (two at least), by start and period."""
    n = len(symbols)
    kinds, symbols = np.unique(symbols, return_inverse=True)
    kinds, forward = len(kinds) + 1, (symbols + 1).tolist()
    if n < 2:
        return np.empty((0, 3), np.int64)
    tree, back = SuffixTree(forward, kinds), SuffixTree(forward[::-1], kinds)
    start = np.arange(n)
    found = []
    for reverse in (False, True):
        period = _next_smaller(tree.ranks(reverse)) - start
        at = np.flatnonzero(periods * period <= n)
        p, i = period[at], start[at]
        right = tree.extension(i, i + p)
        left = back.extension(n - i, n - i - p)
        found.append(np.stack((i - left, left + p + right, p), axis=1))
    found = np.concatenate(found)
    found = found[found[:, 1] >= np.maximum(least, periods * found[:, 2])]
    return np.unique(found[:, [0, 2, 1]], axis=0)[:, [0, 2, 1]]


def _stretches(ids: np.ndarray) -> list[tuple[int, int]]:
    """Maximal stretches (start, end) covered by GRAM words that occur twice in the text."""
    if len(ids) < LEAST_WORDS:
        return []
    h = (ids.astype(_U) + _U(1)) * _U(0x9E3779B97F4A7C15)
    h ^= h >> _U(29)
    for step in (1, 2, 4):
        h = h[:-step] * _U(0xBF58476D1CE4E5B9) + (h[step:] ^ (h[step:] >> _U(31)))
    h = h[:-1] * _U(0x94D049BB133111EB) + ids[8:].astype(_U)
    ordered = np.sort(h)
    same = ordered[1:] == ordered[:-1]
    if not same.any():
        return []
    twice = np.unique(ordered[1:][same])
    place = np.searchsorted(twice, h)
    place[place == len(twice)] = 0
    at = np.flatnonzero(twice[place] == h)
    breaks = np.flatnonzero(at[1:] - at[:-1] > GRAM) + 1
    starts = at[np.concatenate(([0], breaks))]
    ends = at[np.concatenate((breaks - 1, [len(at) - 1]))] + GRAM
    return [(a, b) for a, b in zip(starts.tolist(), ends.tolist()) if b - a >= LEAST_WORDS]


def text_runs(ids: np.ndarray) -> np.ndarray:
    """(start, length, period) of all runs of a text's word numbers, by start and period."""
    found = [runs_of(ids[a:b]) + np.array([a, 0, 0]) for a, b in _stretches(ids)]
    return np.concatenate(found) if found else np.empty((0, 3), np.int64)


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length / period, compared exactly; ties go to the smallest start, then period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


_RUN = pa.struct([(name, pa.int64()) for name in ("start", "length", "period")])


def periodic_runs(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns of every row with its runs, its strongest run and its collapsed text.

    runs: array of (start, length, period) in words numbered from 0, by start and period; strongest: that of the greatest
    length / period, null without runs; collapsed: the words joined by one space, without those that
    a run contains after its first period. Words are what ASCII white space separates. A null text counts as
    empty and has no words, no runs and an empty collapsed text. Rows stay one to one, repeated ones
    included; an empty table gives no rows. Columns that are not kept are not read; a kept column must not have one
    of the three names. One pass, no shuffle.
    """
    chosen = docs.select(*keep, docs[text].alias("__text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    run = "struct<start: bigint, length: bigint, period: bigint>"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
        for batch in batches:
            at, texts = 0, batch.column(len(keep)).to_pylist()
            for part in slices([t or "" for t in texts]):
                runs, best, collapsed = [], [], []
                for words in (t.encode().split() for t in part):
                    if len(numbers) > MEMORY:
                        numbers.clear()
                    found = text_runs(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
                    rows = list(map(tuple, found.tolist()))
                    runs.append(rows)
                    best.append(strongest(rows))
                    if rows:
                        change = np.zeros(len(words) + 1, np.int64)
                        np.add.at(change, found[:, 0] + found[:, 2], 1)
                        np.add.at(change, found[:, 0] + found[:, 1], -1)
                        words = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
                    collapsed.append(b" ".join(words).decode())
                columns = [c.slice(at, len(part)) for c in batch.columns[: len(keep)]]
                names = ("start", "length", "period")
                columns += [
                    pa.array([[dict(zip(names, r)) for r in rows] for rows in runs], pa.list_(_RUN)),
                    pa.array([b and dict(zip(names, b)) for b in best], _RUN),
                    pa.array(collapsed, pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, "runs", "strongest", "collapsed"])
                at += len(part)

    return chosen.mapInArrow(scan, f"{kept}, runs array<{run}>, strongest {run}, collapsed string")
