"""Periodic runs of words: a suffix automaton whose root paths are recoloured by link-cut access.

A run is a stretch of consecutive words with smallest period q that no neighbouring word extends. Words are appended
one after the other: each one recolours the path of its prefix in the automaton's suffix-link tree with its position.
Where the path passes a segment that was last coloured at an earlier position e, the longest suffix of the segment
ends both there and here, so the distance d to e is the smallest period of that suffix together with its occurrence
before. A segment at least d long is a square of period d; where the next word breaks the period, it is extended to
the left into the run.

The automaton is only built over stretches that can hold a run at all (``_zones``, an exact bound: every word of a run
but the last q returns within q words), so texts without repetition cost one sort of their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: A run has at least this many words, and this many times its period.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Words that are numbered and bounded at once; longer texts are taken alone.
WORDS_AT_ONCE = 200_000

RUN_SCHEMA = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, "
    "collapsed_sha256 string, runs array<struct<start:long,length:long,period:long>>, collapsed string"
)


def _zones(gap: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of positions that can hold the words of a run but for its last period.

    ``gap`` is the distance to the next equal word of the text. A run of period q has 3 q such positions at least, all
    with gaps up to q, so a position whose gap is over a third of its stretch is in no run; leaving it out splits the
    stretch, until nothing more goes.
    """
    open_ = gap < np.iinfo(np.int64).max
    least = LEAST_WORDS - LEAST_WORDS // LEAST_PERIODS
    while True:
        edge = np.flatnonzero(np.diff(np.concatenate(([False], open_, [False])).astype(np.int8)))
        start, end = edge[::2], edge[1::2]
        size = end - start
        at = np.flatnonzero(open_)
        most = np.repeat(np.where(size >= least, size // (LEAST_PERIODS - 1), 0), size)
        out = gap[at] > most
        if not out.any():
            return list(zip(start.tolist(), end.tolist()))
        open_[at[out]] = False


class _Automaton:
    """Suffix automaton of a list of word numbers; state 1 is the root, 0 stands for none."""

    def __init__(self, words: list[int]):
        self.link, self.size, self.prefix = [0, 0], [0, 0], []
        link, size, step, last = self.link, self.size, [{}, {}], 1
        for w in words:
            new = len(size)
            size.append(size[last] + 1)
            link.append(1)
            step.append({})
            p = last
            while p and w not in step[p]:
                step[p][w] = new
                p = link[p]
            if p:
                q = step[p][w]
                if size[q] == size[p] + 1:
                    link[new] = q
                else:
                    twin = len(size)
                    size.append(size[p] + 1)
                    link.append(link[q])
                    step.append(step[q].copy())
                    while p and step[p].get(w) == q:
                        step[p][w] = twin
                        p = link[p]
                    link[q] = link[new] = twin
            last = new
            self.prefix.append(new)


class _Paths:
    """Root paths of the suffix-link tree as splay trees (shallow states to the left), each with the position that coloured it."""

    def __init__(self, link: list[int]):
        self.up, self.left, self.right, self.seen = link[:], [0] * len(link), [0] * len(link), [-1] * len(link)

    def _rotate(self, x: int, p: int, g: int) -> None:
        up, left, right = self.up, self.left, self.right
        if left[p] == x:
            child = left[p] = right[x]
            right[x] = p
        else:
            child = right[p] = left[x]
            left[x] = p
        if child:
            up[child] = p
        if left[g] == p and g:
            left[g] = x
        elif right[g] == p and g:
            right[g] = x
        else:  # p was the top of its path, so x now holds the colour
            self.seen[x] = self.seen[p]
        up[p], up[x] = x, g

    def _splay(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        while True:
            p = up[x]
            if not p or (left[p] != x and right[p] != x):
                return
            g = up[p]
            if g and (left[g] == p or right[g] == p):
                if (left[p] == x) == (left[g] == p):
                    self._rotate(p, g, up[g])
                    self._rotate(x, p, up[p])
                else:
                    self._rotate(x, p, g)
                    self._rotate(x, g, up[g])
            else:
                self._rotate(x, p, g)

    def access(self, state: int, position: int) -> Iterator[tuple[int, int]]:
        """Colour the path from the root to ``state`` with ``position``; gives (state, colour before) of each segment, deepest first."""
        up, right, seen = self.up, self.right, self.seen
        x, below = state, 0
        while x:
            self._splay(x)
            before = seen[x]
            if before >= 0:
                yield x, before
            if right[x]:
                seen[right[x]] = before
            right[x] = below
            below, x = x, up[x]
        seen[below] = position


def runs_of(words: np.ndarray, zones: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a text's word numbers, by start, then period."""
    found, n = set(), len(words)
    for a, b in zones:
        b = min(n, b + (b - a) // (LEAST_PERIODS - 1))
        local = words[a:b].tolist()
        automaton = _Automaton(local)
        paths, size = _Paths(automaton.link), automaton.size
        for i, state in enumerate(automaton.prefix):
            for segment, before in paths.access(state, i):
                q, end = i - before, a + i + 1
                if size[segment] < q or (end < n and words[end] == words[end - q]):
                    continue  # no square, or one that goes on
                start = end - q - size[segment]
                while start and words[start - 1] == words[start - 1 + q]:
                    start -= 1
                if end - start >= max(LEAST_WORDS, LEAST_PERIODS * q):
                    found.add((start, end - start, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def _digest(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    """The result columns of one text."""
    if runs:
        kept = np.ones(len(words), bool)
        for start, length, period in runs:
            kept[start + period : start + length] = False
        words = [w for w, k in zip(words, kept.tolist()) if k]
    collapsed = b" ".join(words)
    start, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    return (
        len(runs), start, length, period, 1000 * length // period if runs else None, hashlib.sha256(listed.encode()).hexdigest(),
        hashlib.sha256(collapsed).hexdigest(), [{"start": s, "length": n, "period": p} for s, n, p in runs], collapsed,
    )


def _all_runs(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """Runs of several texts: their words are numbered and their gaps found at once."""
    number: dict[bytes, int] = {}
    flat = np.fromiter((number.setdefault(w, len(number)) for t in texts for w in t), np.int32)
    ends = np.cumsum([len(t) for t in texts])
    order = np.argsort(flat, kind="stable")
    gap = np.full(len(flat), np.iinfo(np.int64).max)
    again = flat[order[1:]] == flat[order[:-1]]
    here, there = order[:-1][again], order[1:][again]
    owner = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
    same = owner[here] == owner[there]
    gap[here[same]] = (there - here)[same]
    starts, out = ends - [len(t) for t in texts], [[] for _ in texts]
    zones: dict[int, list] = {}
    for a, b in _zones(gap):  # the last word of a text has no gap, so none spans two texts
        k = int(owner[a])
        zones.setdefault(k, []).append((a - int(starts[k]), b - int(starts[k])))
    for k, z in zones.items():
        out[k] = runs_of(flat[starts[k] : ends[k]], z)
    return out


def find_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", prepare: Callable[[object, list[bytes]], list[bytes]] | None = None, full: bool = True) -> DataFrame:
    """Runs of each text's words (``[^\\x20\\x09-\\x0D]+``, from 0) and the text with every run cut to its first period.

    One row per row of ``docs``: doc_id, n_runs, the longest run's start, length, period and exponent_milli (ties: the
    smallest start, then period), SHA-256 of all runs and of the collapsed text; with ``full`` the runs and that text
    too. ``prepare`` may change the words of a row before. A null text has no words; without a run the four numbers are
    null; equal texts give equal rows; other columns are not read. No row is moved: there is no shuffle, and a task
    holds the words of one text, or of few short ones, at a time.
    """
    kept = [f for f in RUN_SCHEMA.split(", ") if full or not f.startswith(("runs array", "collapsed string"))]
    n_columns = len(kept)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            rows, waiting, n = [], [], 0
            for k in range(len(ids) + 1):
                if k < len(ids):
                    words = (texts[k].as_py() or "").encode("utf-8", "surrogatepass").split()
                    waiting.append(prepare(ids[k], words) if prepare else words)
                    n += len(words)
                if waiting and (n >= WORDS_AT_ONCE or k == len(ids)):
                    rows += [_digest(w, r)[: n_columns - 1] for w, r in zip(waiting, _all_runs(waiting))]
                    waiting, n = [], 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), *(pa.array([r[c] for r in rows], t) for c, t in enumerate(TYPES[: n_columns - 1]))],
                names=[f.split()[0] for f in kept],
            )

    TYPES = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])), pa.string()]
    return docs.selectExpr(f"cast(`{id_column}` as long) as doc_id", f"`{text_column}` as text").mapInArrow(work, ", ".join(kept))
