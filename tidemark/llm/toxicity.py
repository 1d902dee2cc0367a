"""Toxicity by maximum-scoring segments.

Tokens are scored with log-odds of toxic against clean, smoothed by nested Dirichlet priors: a word's prior is
the odds of its first seven letters, theirs is the odds of the first five, theirs the overall odds. Counts are
held in hashed slots, so the model's size is fixed. A linear-time scan (Ruzzo and Tompa) finds all maximal
scoring segments of a text. Segment scores follow an extreme-value law on clean text; its lambda comes from the
score distribution of clean text and its K from the highest segments of clean documents. A segment with an
expectation under ``CHANCE`` is a toxic passage; the normalised scores of a document's passages are summed and
a logistic curve, fitted on labelled rows whose own counts are left out, maps the sum to a score from 0 to 1.

Labels are learnt from rows that the caller names; at most about ``FIT_ROWS`` of them, chosen by hash. The calibration
is fitted on about ``CURVE_ROWS`` of these, chosen by hash of id and text, and on twice as many at most. Scores
read the text alone, all of it. Null or empty texts score like texts without any toxic token. A null doc_id is
carried and scored. Repeated rows get equal scores; a label repeated with another value counts as toxic. Without
any label of one of the classes, every score is 0. Empty table: empty result. Extra columns are unread.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIT_ROWS, CURVE_ROWS = 150_000, 20_000
SLOTS = 1 << 18
#: Letters of the prefixes that stand behind a word, and the weight of each prior in documents.
PREFIXES, PRIOR = (7, 5), 4.0
#: Log-odds that a token needs to raise a segment, and the lowest score of a token.
MARGIN, FLOOR = 1.0, -2.0
CHANCE = 0.05
THRESHOLD = 0.7

_WORD = re.compile(r"[^\W\d_]+")


def tokens(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def slots_of(word: str) -> tuple[int, int, int]:
    """Slots of a word, of its first seven and of its first five letters."""
    parts = (word, word[: PREFIXES[0]], word[: PREFIXES[1]])
    return tuple(k * SLOTS + xxhash.xxh32_intdigest(p.encode("utf-8", "surrogatepass"), k) % SLOTS for k, p in enumerate(parts))


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence, in order, in linear time.

    Runs of one sign are folded first; the candidate list then follows Ruzzo and Tompa (1999).
    """
    up = np.flatnonzero(scores > 0)
    if not len(up):
        return []
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    breaks = np.flatnonzero(np.diff(up) > 1)
    firsts, lasts = up[np.concatenate([[0], breaks + 1])], up[np.concatenate([breaks, [len(up) - 1]])] + 1
    stack: list[tuple[float, float, int, int, int]] = []  # left sum, right sum, start, end, index of a lower left
    for a, b in zip(firsts.tolist(), lasts.tolist()):
        left, right, start = float(sums[a]), float(sums[b]), a
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][0] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][1] >= right:
                stack.append((left, right, start, b, j))
                break
            left, start = stack[j][0], stack[j][2]
            del stack[j:]
    return [(s, e, r - lo) for lo, r, s, e, _ in stack]


class Model:
    """Slot counts by class (clean, toxic documents), what they sum to, and the calibration."""

    def __init__(self, counts: np.ndarray, docs: tuple[int, int]):
        self.counts = counts.astype(np.float32)
        self.base = docs[1] / max(1, sum(docs))
        self.usable = docs[0] > 0 and docs[1] > 0
        self.lam, self.log_k, self.curve = 1.0, 0.0, np.array([-4.0, 1.0])
        self._cache: dict[str, float] = {}

    def token_score(self, word: str, own: int | None = None) -> float:
        """Log-odds less the margin; ``own`` is the class of the document whose counts are left out."""
        share = self.base
        for at in reversed(slots_of(word)):
            clean, toxic = self.counts[0, at], self.counts[1, at]
            if own is not None:
                clean, toxic = max(clean - (own == 0), 0), max(toxic - (own == 1), 0)
            share = (toxic + PRIOR * share) / (clean + toxic + PRIOR)
        odds = np.log(share / (1 - share)) - np.log(self.base / (1 - self.base))
        return float(max(odds - MARGIN, FLOOR))

    def scores(self, words: list[str], own: int | None = None) -> np.ndarray:
        cache = self._cache if own is None else {}
        if len(cache) > 400_000:
            cache.clear()
        for w in set(words):
            if w not in cache:
                cache[w] = self.token_score(w, own)
        out = np.fromiter(map(cache.__getitem__, words), dtype=np.float64, count=len(words))
        again = [k for k in range(1, len(words)) if words[k] == words[k - 1]] if out.max(initial=0) > 0 else []
        out[again] = np.minimum(out[again], 0)  # a token said over and over is not new evidence
        return out

    def passages(self, scores: np.ndarray) -> list[tuple[int, int, float]]:
        """Significant segments, with scores in nats above what chance gives in a text of this length."""
        room = self.log_k + np.log(max(1, len(scores)))
        found = [(s, e, self.lam * x - room) for s, e, x in segments(scores)]
        return [f for f in found if f[2] > -np.log(CHANCE)]

    def evidence(self, scores: np.ndarray) -> tuple[float, list[tuple[int, int, float]]]:
        found = self.passages(scores)
        return float(np.log1p(sum(x for _, _, x in found))), found

    def probability(self, evidence: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.curve[0] + self.curve[1] * evidence, -30, 30)))) if self.usable else 0.0


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, text) to non-zero (slot, clean, toxic) counts of documents; slot -1 counts the documents."""
    sums, docs = np.zeros((2, 3 * SLOTS), dtype=np.int64), [0, 0]
    for batch in batches:
        for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            at = {s for w in set(tokens(text)) for s in slots_of(w)}
            sums[toxic, list(at)] += 1
            docs[toxic] += 1
    at = np.flatnonzero(sums.any(0))
    cols = [np.append(at, -1), np.append(sums[0, at], docs[0]), np.append(sums[1, at], docs[1])]
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["slot", "clean", "toxic"])


def _solve_lambda(values: np.ndarray, weights: np.ndarray) -> float:
    """The positive root of E[exp(lambda score)] = 1 on clean text; 1, the value for log-odds, if there is none."""
    p = weights / max(weights.sum(), 1)
    if not len(values) or p @ values >= 0 or values[weights > 0].max(initial=-1) <= 0:
        return 1.0
    lo, hi = 1e-6, 1.0
    while p @ np.exp(hi * values) < 1 and hi < 20:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if p @ np.exp(mid * values) < 1 else (lo, mid)
    return min(hi, 3.0)


def _fit_curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic curve by Newton steps with a light ridge; the slope is not negative."""
    design, beta = np.column_stack([np.ones(len(x)), x]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        hess = (design * (p * (1 - p))[:, None]).T @ design + np.diag([1e-3, 1e-3])
        step = np.linalg.solve(hess, design.T @ (y - p) - 1e-3 * beta)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return np.array([beta[0], max(beta[1], 0.0)])


def _steps(model: Model):
    """(toxic, text) to (toxic, words, highest segment, evidence parts): what the calibration needs, own counts left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.arange(FLOOR, 12.01, 0.1)
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s = model.scores(tokens(text), own=toxic)
                out[0].append(toxic)
                out[1].append(len(s))
                out[2].append([x for _, _, x in segments(s)])
                out[3].append(np.histogram(s, edges)[0].tolist() if not toxic else [])
            kinds = (pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["toxic", "words", "found", "histogram"])

    return run


def labelled_rows(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(toxic, text, pick) of the documents that ``labels`` (doc_id, toxic) names; the labels' number is bounded, so they are broadcast."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    every = max(1, -(-known.count() // fit_rows))
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("toxic", "text", F.xxhash64("doc_id", "text", F.lit(5)).alias("pick"))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, curve_rows: int = CURVE_ROWS) -> Model:
    picked = labelled_rows(docs, labels, fit_rows)
    rows = picked.select("toxic", "text")
    got = rows.mapInArrow(_count, "slot long, clean long, toxic long").groupBy("slot").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toPandas()
    counts, total = np.zeros((2, 3 * SLOTS)), got[got.slot == -1]
    at = got[got.slot >= 0]
    counts[0, at.slot], counts[1, at.slot] = at.clean, at.toxic
    n = (int(total.clean.sum()), int(total.toxic.sum()))
    model = Model(counts, n)
    if not model.usable:
        return model
    every = max(1, -(-sum(n) // curve_rows))
    sample = picked.where(F.pmod("pick", F.lit(every)) == 0).select("toxic", "text") if every > 1 else rows
    seen = sample.mapInArrow(_steps(model), "toxic int, words long, found array<double>, histogram array<long>").limit(2 * curve_rows).toPandas()
    clean = seen[seen.toxic == 0]
    if len(clean):
        model.lam = _solve_lambda(np.arange(FLOOR, 12.0, 0.1)[: len(clean.histogram.iloc[0])] + 0.05, np.sum([np.asarray(h) for h in clean.histogram], axis=0).astype(float))
        # The highest normalised score of a clean text has mean ln K + Euler's constant under the extreme-value law.
        tops = np.array([model.lam * max(f, default=0.0) - np.log(max(1, w)) for f, w in zip(clean.found, clean.words)])
        model.log_k = float(np.clip(tops.mean() - np.euler_gamma, -8, 2))
    sums = []
    for f, w in zip(seen.found, seen.words):
        over = model.lam * np.asarray(f, dtype=float) - model.log_k - np.log(max(1, w))
        sums.append(np.log1p(over[over > -np.log(CHANCE)].sum()))
    model.curve = _fit_curve(np.array(sums), seen.toxic.to_numpy(float))
    return model


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, score, n_passages, first_word and last_word of the strongest passage (else null)."""
    own = model  # of fixed size; Spark broadcasts it with the function

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text in batch.column(1).to_pylist():
                x, found = own.evidence(own.scores(tokens(text)))
                best = max(found, key=lambda f: f[2], default=(None, None, 0.0))
                for column, value in zip(out, (own.probability(x), len(found), best[0], None if best[1] is None else best[1] - 1)):
                    column.append(value)
            kinds = (pa.float64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds))], ["doc_id", "score", "n_passages", "first_word", "last_word"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, n_passages long, first_word long, last_word long")
