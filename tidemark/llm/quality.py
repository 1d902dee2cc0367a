"""Quality classifier from weak labels.

Heuristic labellers vote on every document (reject, abstain, keep). Expectation-maximisation over the counts
of vote patterns of all documents estimates how accurate each labeller is on good documents and on several
kinds of bad ones, and how common these are; the posterior of a document's pattern is its soft label. A hashed linear scorer is fitted to the soft labels
of a bounded sample (``FIT_ROWS``, chosen by hash of the id and the text, and never more than twice that) and scores
every document.

Vote patterns are bounded by 3 to the number of labellers, whatever the corpus holds; they and the model are
all that reaches the driver. Features read whole texts. A null or empty text has no words: labellers abstain
and it is scored by the same model. A null doc_id is carried. Repeated rows get equal scores. Empty table:
empty result. Extra columns are carried by ``filter_quality`` and unread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents the scorer is fitted on, at most about this many.
FIT_ROWS = 12_000
#: Dimensions of the hashed feature space.
DIMS = 1 << 14
#: Patterns are weighed as if the corpus had so many documents, so that verdicts depend on shares alone, not on its size.
SCALE = 10_000.0
#: The prior: documents of each class; votes of each labeller on good documents and on a kind of bad.
PRIOR, GOOD_VOTES, BAD_VOTES = 1.0, 20_000.0, 20.0
#: Believed share of rejects: by any labeller of good documents, by its own labeller of a kind of bad, by the others.
GOOD_REJECT, OWN_REJECT, OTHER_REJECT = 0.00005, 0.98, 0.05
#: Documents scored below this are rejected.
THRESHOLD = 0.5

LABELLERS = ("symbols", "stutter", "shouting", "variety", "exclaims", "cells", "glue", "letters")

# Byte classes: 1 lower or non-ASCII letter, 2 upper, 3 digit, 4 space, 5 line end; other ASCII keeps its own class.
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[128:] = _CLASS[97:123] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[[32, 9, 11, 12]] = 4
_CLASS[[10, 13]] = 5
for _k, _byte in enumerate(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"):
    _CLASS[_byte] = 6 + _k
_TABLE = _CLASS.tobytes()
_PLAIN = np.zeros(40, dtype=bool)
_PLAIN[[_CLASS[b] for b in b".,;:'\"-()?!|"]] = True


def measures(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The labellers' eight measures of a text, and its shape: byte classes with runs of one class folded."""
    text = text or ""
    shape = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(_TABLE), dtype=np.uint8)
    words = text.split()
    n, by = len(words), np.bincount(shape, minlength=40)
    if not n:
        return np.zeros(len(LABELLERS)), shape[:0]
    lower, upper, size = int(by[1]), int(by[2]), max(1, len(shape) - int(by[4]) - int(by[5]))
    odd = int(by[6:][~_PLAIN[6:]].sum())
    stutter = sum(a == b for a, b in zip(words, words[1:])) / n
    glue = sum(len(a) <= 3 and a.isalpha() for a in words)
    variety = len(set(words)) / n**0.85
    values = [
        odd / n,
        stutter,
        upper / max(1, lower + upper),
        min(variety, 3.0),
        int(by[_CLASS[33]]) / n,
        int(by[_CLASS[124]]) / n,
        glue / n if n > 5 else 0.2,
        (lower + upper + int(by[3])) / size,
    ]
    fold = shape[np.flatnonzero(np.diff(shape, prepend=255))] if len(shape) else shape
    return np.array(values), fold


def votes(m: np.ndarray, n_shape: int) -> np.ndarray:
    """Of each labeller: -1 reject, 0 abstain, 1 keep."""
    if not n_shape:
        return np.zeros(len(LABELLERS), dtype=np.int8)
    low = np.array([0.10, 0.05, 0.25, 0.0, 0.10, 0.10, 0.0, 0.0])
    high = np.array([0.30, 0.20, 0.55, 9.0, 0.40, 0.25, 16.0, 9.0])
    out = np.where(m > high, -1, np.where(m <= low, 1, 0))
    out[3] = -1 if m[3] < 0.45 and n_shape > 60 else 1 if m[3] > 0.9 else 0
    out[6] = -1 if m[6] < 0.05 else 1 if m[6] >= 0.12 else 0
    out[7] = -1 if m[7] < 0.72 else 1 if m[7] > 0.8 else 0
    return out.astype(np.int8)


def features(m: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features: shares of shape 3-grams, and the measures in steps."""
    steps = np.floor(np.minimum(m, 8.0) * np.array([20, 20, 10, 10, 10, 20, 20, 20])).astype(np.int64)
    fixed = (np.arange(len(m)) * 1009 + steps * 31 + 7) * 2654435761 % DIMS
    if len(fold) < 3:
        return np.append(fixed, 1), np.ones(len(fixed) + 1)
    g = fold.astype(np.int64)
    grams, counts = np.unique(g[:-2] * 1681 + g[1:-1] * 41 + g[2:], return_counts=True)
    at = (grams * 40503 + 12345) * 2654435761 % DIMS
    return np.concatenate([fixed, [1], at]), np.concatenate([np.ones(len(fixed) + 1), np.sqrt(counts / counts.sum())])


def _vote_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for text in batch.column(0).to_pylist():
            m, fold = measures(text)
            found.append("".join("-0+"[v + 1] for v in votes(m, len(fold))))
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["votes"])


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [[], [], []]
        for text in batch.column(0).to_pylist():
            m, fold = measures(text)
            at, x = features(m, fold)
            out[0].append("".join("-0+"[v + 1] for v in votes(m, len(fold))))
            out[1].append(at.astype(np.int32))
            out[2].append(x.astype(np.float32))
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.list_(pa.int32())), pa.array(out[2], pa.list_(pa.float32()))], ["votes", "at", "x"])


def fit_votes(patterns: dict[str, int], rounds: int = 5000) -> tuple[float, np.ndarray, dict[str, float]]:
    """EM over a latent class: good, or one kind of bad for each labeller; labellers are independent given it.

    Kinds of bad are needed because labellers overlap and exclude each other: a page of table cells is rejected
    by one labeller and kept by the rest, which two classes would take for that labeller's mistake. Abstentions
    count as missing. How often good documents are rejected by one labeller alone and how common that labeller's
    kind of bad is can't be told apart by counts; fixed Dirichlet priors on shares and votes settle it: a good
    document is seldom rejected. Counts are scaled to ``SCALE`` documents, so the prior weighs the same at any size.
    Rounds end when no posterior moves. Returns the share of bad documents, each labeller's (reject, keep) shares by class bad and
    good, and the posterior of "good" by pattern.
    """
    keys = sorted(patterns)
    if not keys:
        return 0.0, np.zeros((2, len(LABELLERS), 2)), {}
    v = np.array([["-0+".index(c) for c in k] for k in keys], dtype=np.int64)
    w = np.array([patterns[k] for k in keys], dtype=float)
    w *= SCALE / w.sum()
    eye = np.eye(3)[v][:, :, [0, 2]]  # pattern, labeller, (reject, keep)
    rejects = eye[:, :, 0]
    r = np.column_stack([~rejects.any(1), rejects / np.maximum(1, rejects.sum(1, keepdims=True))]).astype(float)
    reject = np.full((r.shape[1], len(LABELLERS)), OTHER_REJECT)
    reject[0], reject[np.arange(1, r.shape[1]), np.arange(len(LABELLERS))] = GOOD_REJECT, OWN_REJECT
    believed = np.stack([reject, 1 - reject], axis=2) * np.array([GOOD_VOTES] + [BAD_VOTES] * len(LABELLERS))[:, None, None]
    for _ in range(rounds):
        found = w @ r + PRIOR
        share = found / found.sum()
        theta = np.einsum("pc,plv->clv", w[:, None] * r, eye) + believed
        theta /= theta.sum(2, keepdims=True)
        log = np.log(share) + np.einsum("plv,clv->pc", eye, np.log(theta))
        new = np.exp(log - log.max(1, keepdims=True))
        new /= new.sum(1, keepdims=True)
        done, r = np.abs(new - r).max() < 1e-7, new
        if done:
            break
    good = r[:, 0]
    by = np.stack([np.einsum("p,plv->lv", w * x, eye) + 1e-9 for x in (1 - good, good)])
    return float(w @ (1 - good) / w.sum()), by / by.sum(2, keepdims=True), dict(zip(keys, good.tolist()))


def fit_scorer(at: list[np.ndarray], x: list[np.ndarray], target: np.ndarray, epochs: int = 8, rate: float = 0.5) -> np.ndarray:
    """Logistic regression on soft targets by AdaGrad over fixed-order mini-batches."""
    w, g2 = np.zeros(DIMS), np.full(DIMS, 1e-2)
    order = np.random.default_rng(7).permutation(len(at))
    for _ in range(epochs):
        for part in np.array_split(order, max(1, len(order) // 64)):
            if not len(part):
                continue
            idx = np.concatenate([at[k] for k in part])
            val = np.concatenate([x[k] for k in part])
            row = np.repeat(np.arange(len(part)), [len(at[k]) for k in part])
            p = 1 / (1 + np.exp(-np.clip(np.bincount(row, val * w[idx], minlength=len(part)), -30, 30)))
            grad = np.bincount(idx, val * (p - target[part])[row], minlength=DIMS) / len(part) + 1e-5 * w
            g2 += grad**2
            w -= rate * grad / np.sqrt(g2)
    return w.astype(np.float32)


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[np.ndarray, dict]:
    """Weights of the scorer, and what EM found. Reads all documents once for the votes, then a sample."""
    patterns = {r["votes"]: r["n"] for r in docs.select("text").mapInArrow(_vote_batches, "votes string").groupBy("votes").agg(F.count("*").alias("n")).collect()}
    share, theta, posterior = fit_votes(patterns)
    every = max(1, -(-sum(patterns.values()) // fit_rows))
    sample = docs.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text", F.lit(11)), F.lit(every)) == 0).select("text")
    rows = sample.mapInArrow(_feature_batches, "votes string, at array<int>, x array<float>").limit(2 * fit_rows).toPandas()
    target = np.array([posterior.get(k, 0.5) for k in rows["votes"]])
    weights = fit_scorer([np.asarray(a) for a in rows["at"]], [np.asarray(a) for a in rows["x"]], target)
    names = ("reject", "keep")
    found = {"bad_share": share, "labellers": {n: {c: dict(zip(names, theta[k, i].round(4).tolist())) for k, c in enumerate(("bad", "good"))} for i, n in enumerate(LABELLERS)}}
    return weights, found


def _score(weights: np.ndarray, text: str | None) -> float:
    at, x = features(*measures(text))
    return float(1 / (1 + np.exp(-np.clip(x @ weights[at], -30, 30))))


def score_quality(docs: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """One row per document: doc_id, score (0 to 1, higher is better), kept."""
    weights = fit(docs)[0] if weights is None else weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.array([_score(weights, t) for t in batch.column(1).to_pylist()], dtype=float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array(s >= THRESHOLD, pa.bool_())], ["doc_id", "score", "kept"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, kept boolean")


def filter_quality(docs: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """The rows of ``docs`` that the scorer keeps, all columns carried, without a shuffle."""
    weights, at = fit(docs)[0] if weights is None else weights, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [_score(weights, t) >= THRESHOLD for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
