"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

A random walk (CGK: at each output position emit the current word and step on or stay, by a random bit of the
position and the word) turns sequences at small edit distance into sequences at small Hamming distance. Items
and windows of documents are embedded with the same walks; hashes of sampled output positions, with samples
drawn per class of item sizes, are the LSH keys. Windows that meet an item under any key are verified by exact
word edit distance against a window of the item's size, so what is reported is exact. The numbers of walks and samples
are constants: with them recall is some 0.99 on items of up to 60 words, and less on long, heavily edited ones (README).

Every word position of every document starts a window. Positions that cannot match are passed over by the
q-gram lemma before walking: e edits break at most 2e of an item's n - 1 word pairs, so a window holds at least
n - 1 - 2e pairs of benchmark items. This loses nothing, at any size of corpus.

The benchmark is read in blocks of at most about ``BLOCK_WORDS`` words, each sent to
the tasks by a broadcast of its own, so none grows with it; documents are never shuffled. Words are runs of letters and digits, case-folded. Items without words
never match; an item without an id shows as -1. Null or empty texts are clean. A null doc_id is carried. Repeated rows get equal results. Empty
tables give empty results, or clean documents. Extra columns are carried by ``drop_contaminated`` and unread.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import durable, mix64

SIMILARITY = 0.8
#: Walks, samples of output positions per walk and item size, and positions per sample.
WALKS, SAMPLES, POSITIONS = 6, 16, 3
#: Words of benchmark items that one pass over the documents holds.
BLOCK_WORDS = 200_000
#: Item sizes fall into classes, each a quarter larger than the last.
GROWTH = 1.25
#: Documents are matched in runs of about this many words; pairs are looked up in a table of this many slots, and keys likewise.
RUN_WORDS, PAIR_SLOTS, KEY_SLOTS = 200_000, 1 << 21, 1 << 12

_WORD = re.compile(r"[^\W_]+")


_SPACES = str.maketrans({chr(c): " " for c in range(128) if not chr(c).isalnum()})


def words_of(text: str | None) -> list[str]:
    text = (text or "").casefold()
    return text.translate(_SPACES).split() if text.isascii() else _WORD.findall(text)


def edits_allowed(n: int) -> int:
    return int(round(n * (1 - SIMILARITY), 9))


def edit_distance(item: np.ndarray, window: np.ndarray, most: int) -> int:
    """Least word edit distance from ``item`` to a prefix of ``window``; most + 1 if it is larger than ``most``."""
    n = len(item)
    if np.array_equal(item, window[:n]):
        return 0
    width = min(len(window), n + most)
    row = np.arange(width + 1)
    steps = np.arange(width + 1)
    for k in range(n):
        diff = (window[:width] != item[k]).astype(np.int64)
        new = np.minimum(row[1:] + 1, row[:-1] + diff)
        new = np.concatenate([[k + 1], new])
        row = np.minimum.accumulate(new - steps) + steps  # insertions along the row
        if row.min() > most:
            return most + 1
    return int(min(row.min(), most + 1))


class Index:
    """Embedded items of one block of the benchmark. Words are numbered; 0 is any word that no item has."""

    def __init__(self, items: list[tuple[int, list[str]]]):
        items = [(i, w) for i, w in items if w]
        self.number = {w: k + 1 for k, w in enumerate(sorted({x for _, words in items for x in words}))}
        self.items = [(i, np.array([self.number[x] for x in w], dtype=np.int64)) for i, w in items]
        rng = np.random.default_rng(424242)
        self._bits: dict[tuple[int, int], np.ndarray] = {}
        self.codes = rng.integers(1, 1 << 63, len(self.number) + 1, dtype=np.uint64)
        self.pairs = np.zeros(PAIR_SLOTS, dtype=bool)
        classes: dict[int, list[int]] = defaultdict(list)
        for k, (_, w) in enumerate(self.items):
            self.pairs[self.slots(w)] = True
            classes[int(np.floor(np.log(len(w)) / np.log(GROWTH)))].append(k)
        #: By class: least pairs and most words of a window, sampled output positions, items by key.
        self.tables = []
        self.item_pairs = [frozenset(self.slots(w).tolist()) for _, w in self.items]
        for c in sorted(classes):
            sizes = [len(self.items[k][1]) for k in classes[c]]
            pairs, span = min(n - 1 - 2 * edits_allowed(n) for n in sizes), max(n + edits_allowed(n) for n in sizes)
            reach = max(1, int(min(sizes) * 1.3))
            picks = np.sort(rng.integers(0, reach, (WALKS, SAMPLES, POSITIONS)), axis=2)
            found: dict[tuple[int, int], set[int]] = defaultdict(set)
            for k in classes[c]:
                for walk in range(WALKS):
                    emitted = self.walk(self.items[k][1], np.zeros(1, np.int64), walk, reach)
                    for s in range(SAMPLES):
                        found[walk * SAMPLES + s, int(self.keys(emitted, picks[walk, s])[0])].add(k)
            self.tables.append((pairs, span, reach, picks, dict(found)))
        self._bits.clear()

    def slots(self, words: np.ndarray) -> np.ndarray:
        """Slots of the adjacent pairs of a sequence."""
        return (words[:-1] * 1_000_003 + words[1:]) * 7_919 % PAIR_SLOTS

    def bits(self, walk: int, at: int) -> np.ndarray:
        """Random bits of each word for 64 output positions of a walk, by a hash; few are kept, so long items cost no memory."""
        if (walk, at) not in self._bits:
            if len(self._bits) >= 16 * WALKS:
                self._bits.clear()
            with np.errstate(over="ignore"):
                self._bits[walk, at] = mix64(self.codes + np.uint64(walk + WALKS * at + 1) * np.uint64(0xD6E8FEB86659FD93))
        return self._bits[walk, at]

    def walk(self, words: np.ndarray, starts: np.ndarray, walk: int, reach: int) -> np.ndarray:
        """The first ``reach`` words that the walks from ``starts`` emit: reach x starts."""
        padded, at = np.append(words, 0), starts.copy()
        out = np.empty((reach, len(starts)), dtype=np.int64)
        for j in range(reach):
            out[j] = padded[at]
            step = self.bits(walk, j // 64)[out[j]] >> np.uint64(j % 64) & np.uint64(1)
            at = np.minimum(at + step.view(np.int64), len(words))
        return out

    def keys(self, emitted: np.ndarray, picks: np.ndarray) -> np.ndarray:
        total = np.zeros(emitted.shape[1], dtype=np.uint64)
        with np.errstate(over="ignore"):
            for k, j in enumerate(picks):
                total += self.codes[emitted[j]] * np.uint64(2 * k + 1)
        return mix64(total)

    def match(self, docs: list[list[str]]) -> list[dict[int, float]]:
        """For each document (its words): item id to the similarity of a window that matches; 1 if any is equal."""
        found: list[dict[int, float]] = [{} for _ in docs]
        ends = np.cumsum([len(w) for w in docs], dtype=np.int64)
        n = int(ends[-1]) if len(docs) else 0
        if not n or not self.items:
            return found
        get = self.number.get
        words = np.fromiter((get(x, 0) for w in docs for x in w), dtype=np.int64, count=n)
        hit, slots = np.zeros(n, dtype=np.int64), self.slots(words)
        hit[:-1] = self.pairs[slots] & (words[:-1] > 0) & (words[1:] > 0)
        hits = np.concatenate([[0], np.cumsum(hit)])
        candidates: set[tuple[int, int]] = set()
        for pairs, span, reach, picks, table in self.tables:
            starts = np.flatnonzero(hits[np.minimum(np.arange(n) + span, n)] - hits[:n] >= pairs)
            if not len(starts):
                continue
            maybe = np.zeros((WALKS * SAMPLES, KEY_SLOTS), dtype=bool)  # which keys the table may hold
            for row, key in table:
                maybe[row, key % KEY_SLOTS] = True
            for at in range(0, len(starts), 20_000):
                part = starts[at : at + 20_000]
                for walk in range(WALKS):
                    emitted = self.walk(words, part, walk, reach)
                    for s in range(SAMPLES):
                        row = walk * SAMPLES + s
                        here = self.keys(emitted, picks[walk, s])
                        for p in np.flatnonzero(maybe[row][here % np.uint64(KEY_SLOTS)]).tolist():
                            for k in table.get((row, int(here[p])), ()):
                                candidates.add((k, int(part[p])))
        near = []
        for k, start in sorted(candidates):  # equal windows first: they settle an item without edit distances
            i, item = self.items[k]
            most = edits_allowed(len(item))
            # The q-gram lemma again, for this item alone: it spares most edit distances.
            if sum(map(self.item_pairs[k].__contains__, slots[start : start + len(item) + most - 1].tolist())) < len(item) - 1 - 2 * most:
                continue
            doc = int(np.searchsorted(ends, start, side="right"))
            if i not in found[doc]:
                if start + len(item) <= ends[doc] and np.array_equal(item, words[start : start + len(item)]):
                    found[doc][i] = 1.0
                elif most:
                    near.append((doc, k, start))
        for doc, k, start in near:
            i, item = self.items[k]
            most = edits_allowed(len(item))
            if i not in found[doc]:
                d = edit_distance(item, words[start : min(int(ends[doc]), start + len(item) + most)], most)
                if d <= most:
                    found[doc][i] = 1 - d / len(item)
        return found

    def match_texts(self, texts: list[str | None]) -> Iterator[dict[int, float]]:
        run: list[list[str]] = []
        held = 0
        for text in texts:
            run.append(words_of(text))
            held += len(run[-1])
            if held >= RUN_WORDS:
                yield from self.match(run)
                run, held = [], 0
        yield from self.match(run)


def _blocks(benchmark: DataFrame) -> Iterator[tuple[Index, bool]]:
    """The benchmark as indexes of bounded size, each with whether there are several; one is on the driver at a time."""
    sized = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = sized.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total // (5 * BLOCK_WORDS)))
    for k in range(n):
        part = sized.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield Index(sorted((r["item_id"] if r["item_id"] is not None else -1, words_of(r["text"])) for r in part.collect())), n > 1


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, contaminated, items (item ids found, ascending), similarity (the highest of its
    items'; 0 if clean)."""
    parts = []
    for index, several in _blocks(benchmark):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [sorted(f.items()) for f in index.match_texts(batch.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        batch.column(1),
                        pa.array([[i for i, _ in f] for f in found], pa.list_(pa.int64())),
                        pa.array([max((s for _, s in f), default=0.0) for f in found], pa.float64()),
                    ],
                    ["doc_id", "row", "items", "similarity"],
                )

        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), "text")
        found = rows.mapInArrow(run, "doc_id long, row long, items array<long>, similarity double")
        parts.append(durable(found, "found") if several else found)  # written, so that no index outlives its block
    out = parts[0]
    if len(parts) > 1:  # a row per document and block; repeated rows are kept apart by their number
        for part in parts[1:]:
            out = out.unionByName(part)
        out = out.groupBy("doc_id", "row").agg(
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
            F.max("similarity").alias("similarity"),
            (F.count("*") / len(parts)).cast("int").alias("times"),
        )
        out = out.withColumn("again", F.explode(F.sequence(F.lit(1), "times")))
    return out.select("doc_id", (F.size("items") > 0).alias("contaminated"), "items", "similarity")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item was found; a pass without a shuffle for each block of items."""
    at = docs.columns.index("text")
    for index, several in _blocks(benchmark):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not f for f in index.match_texts(batch.column(at).to_pylist())], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
        docs = durable(docs, "clean") if several else docs
    return docs
