"""Alignment of two tokenizers over a corpus: groups of tokens between common ends, and how often id pairs meet.

Byte offsets where tokens of A and B both end cut a text into groups. Most groups are one token of each side with the
same bytes: their pairs follow from the A id alone, by a map from A ids to B ids of the same bytes made beforehand, and
are counted in one vector as long as A's vocabulary. Only links of other groups are shuffled as pairs, one row for each
distinct pair of a block of documents.

Texts are cut before single spaces, where tokens of both sides always end, and each distinct word is encoded and
aligned once in a while (``Memo``); a text with white space before a space is encoded whole. Documents wait in the
shared folder as references to their block's words while the pairs are counted, so nothing is encoded twice.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import durable
from tidemark.llm.tokens import Memo, load_tokenizer, of_worker, tokenizer_path

#: Words of documents that make a block, and aligned words that a worker keeps.
BLOCK_WORDS, MEMO_WORDS = 1_000_000, 200_000
APART = r"\s | \Z"  # white space before a space, or a space at the end: such a text isn't cut

NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]
STEP_SCHEMA = (
    "kind int, block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, words binary, "
    "pair array<long>, n array<long>"
)
RESULT_SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
DOCUMENT, WORDS, PAIRS, VECTOR = range(4)


def _byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level vocabularies: printable bytes stand for themselves, the others follow from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Pair:
    """Two tokenizers: A a byte-level one of the tokenizers library, B a sentencepiece model that puts a space before a text."""

    def __init__(self, a: str, b: str):
        import sentencepiece

        self.a, self.b = load_tokenizer(a, plain_specials=True), sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(b))
        letters = _byte_alphabet()
        entries = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for piece, i in entries.items():
            self.a_bytes[i] = bytes(letters[c] for c in piece) if all(c in letters for c in piece) else piece.encode()
        self.b_bytes, n = [], self.b.get_piece_size()
        for i in range(n):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        if max(len(self.a_bytes), n) > 1 << 16:
            raise ValueError("ids of more than 16 bits")
        # B's merges stay between spaces if no piece goes on after a character with a space.
        self.local = not any(re.search("[^▁]▁", self.b.id_to_piece(i)) for i in range(n))
        same = {x: i for i, x in reversed(list(enumerate(self.b_bytes))) if not self.b.is_control(i) and not self.b.is_unknown(i)}
        self.same = np.array([same.get(x, -1) for x in self.a_bytes], np.int64)
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.a_text = np.array([[b"%d," % i, b"%d|" % i] for i in range(len(self.a_bytes))], "S6")
        self.b_text = np.array([[b"%d," % i, b"%d;" % i] for i in range(n)], "S6")

    @staticmethod
    def _given_back(raw: list[bytes], ids: list[list[int]], pieces: list[bytes], sizes: np.ndarray) -> np.ndarray:
        """Whether the joined pieces of each word are its bytes."""
        flat, n = _flat(ids)
        fits = _sums(sizes[flat], n) == np.fromiter(map(len, raw), np.int64, len(raw))
        if fits.all() and b"".join(map(pieces.__getitem__, flat.tolist())) == b"".join(raw):
            return fits
        return np.array([b"".join([pieces[i] for i in x]) == r for x, r in zip(ids, raw)], bool)

    def align(self, words: list[str]) -> list[tuple | None]:
        """Of each word, with a space before it: (n_a, n_b, n_groups, groups as text, A ids of one-to-one groups of the same bytes, id pairs of all other links).

        None where the joined bytes of either side differ from the word's.
        """
        a = [e.ids for e in self.a.encode_batch_fast([" " + w for w in words], add_special_tokens=False)]
        b = self.b.encode(words, num_threads=1)
        out: list = [None] * len(words)
        raw = [b" " + w.encode("utf-8", "surrogatepass") for w in words]
        fits = self._given_back(raw, a, self.a_bytes, self.a_size) & self._given_back(raw, b, self.b_bytes, self.b_size)
        if not fits.all():
            a, b = ([x for x, fit in zip(side, fits.tolist()) if fit] for side in (a, b))
        fits = np.flatnonzero(fits).tolist()
        if not fits:
            return out
        (a, n_a), (b, n_b) = _flat(a), _flat(b)
        owner = np.repeat(np.arange(len(fits)), n_a)
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        common = np.intersect1d(a_end, b_end, assume_unique=True)
        a_group, b_group = np.searchsorted(common, a_end), np.searchsorted(common, b_end)
        n_in_a, n_in_b = np.bincount(a_group), np.bincount(b_group)
        # Between two neighbouring ends of either side lies one token of each: a link.
        ends = np.union1d(a_end, b_end)
        link_a, link_b = np.searchsorted(a_end, ends), np.searchsorted(b_end, ends)
        alone = (n_in_a == 1) & (n_in_b == 1)
        plain = alone[a_group[link_a]] & (self.same[a[link_a]] == b[link_b])
        # Text of the groups: A's tokens of a group, then B's.
        place_a = np.arange(len(a)) + (np.cumsum(n_in_b) - n_in_b)[a_group]
        place_b = np.arange(len(b)) + np.cumsum(n_in_a)[b_group]
        text = np.empty(len(a) + len(b), "S6")
        text[place_a] = self.a_text[a, (a_end == common[a_group]).astype(int)]
        text[place_b] = self.b_text[b, (b_end == common[b_group]).astype(int)]
        n_groups = np.bincount(owner, weights=a_end == common[a_group]).astype(np.int64)
        link_owner = owner[link_a]
        plain_ids, other = a[link_a[plain]].astype("<u2"), (a[link_a[~plain]] << 16 | b[link_b[~plain]]).astype("<u4")
        plain_to = np.cumsum(np.bincount(link_owner[plain], minlength=len(fits)))
        other_to = np.cumsum(np.bincount(link_owner[~plain], minlength=len(fits)))
        to = np.cumsum(n_a + n_b)
        at = p = q = 0
        for k, x, y, g, e, pe, qe in zip(fits, n_a.tolist(), n_b.tolist(), n_groups.tolist(), to.tolist(), plain_to.tolist(), other_to.tolist()):
            out[k] = (x, y, g, text[at:e].tobytes().translate(None, b"\0")[:-1], plain_ids[p:pe].tobytes(), other[q:qe].tobytes())
            at, p, q = e, pe, qe
        return out


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The lists as one array, and their lengths."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, int(sizes.sum())), sizes


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive parts of the given sizes."""
    total = np.concatenate(([0], np.cumsum(values)))
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


class _Block:
    """Documents that are counted together, with their distinct words numbered."""

    def __init__(self, pair: Pair, memo: Memo):
        self.pair, self.memo, self.ids, self.words, self.n = pair, memo, [], [], 0

    def add(self, doc_id, text: str | None) -> None:
        whole = not self.pair.local or re.search(APART, " " + text) is not None if text else False
        # A text that isn't cut is wrapped, so that it is no key of the memo.
        words = [(text,)] if whole else text.split(" ") if text else []
        self.ids.append(doc_id)
        self.words.append(words)
        self.n += max(1, len(words))

    def rows(self, block: int, vector: np.ndarray) -> pa.RecordBatch:
        """The block's rows; counts of one-to-one groups are added to ``vector``."""
        number: dict = {}
        refs = np.fromiter((number.setdefault(w, len(number)) for words in self.words for w in words), np.int32)
        self.memo.learn(w for w in number if isinstance(w, str))
        known = [self.memo[w] if isinstance(w, str) else self.pair.align([w[0]])[0] for w in number]
        sizes = np.array([len(w) for w in self.words])
        fits = np.array([k is not None for k in known], bool)
        good = _sums((~fits)[refs], sizes) == 0
        empty = (0, 0, 0, b"", b"", b"")
        known = [k or empty for k in known]
        n_a, n_b, n_groups = (np.array([k[c] for k in known], np.int64) for c in range(3))
        n_plain, n_other = (np.array([len(k[c]) // w for k in known], np.int64) for c, w in ((4, 2), (5, 4)))
        used = np.bincount(refs[np.repeat(good, sizes)], minlength=len(known))
        plain, other = np.frombuffer(b"".join([k[4] for k in known]), "<u2"), np.frombuffer(b"".join([k[5] for k in known]), "<u4")
        vector += np.bincount(plain, weights=np.repeat(used, n_plain), minlength=len(vector)).astype(np.int64)
        pairs, index = np.unique(other, return_inverse=True)
        counts = np.bincount(index, weights=np.repeat(used, n_other), minlength=len(pairs)).astype(np.int64)
        columns = [np.where(good, _sums(x[refs], sizes), 0) for x in (n_a, n_b, n_groups, n_plain + n_other)]
        shas, binaries, at, texts = [], [], 0, [k[3] for k in known]
        for ok, size in zip(good.tolist(), sizes.tolist()):
            mine = refs[at : at + size]
            at += size
            shas.append(hashlib.sha256(b";".join(map(texts.__getitem__, mine.tolist()))).hexdigest() if ok and size else "")
            binaries.append(mine.tobytes() if ok else b"")
        words = np.int64(len(known)).tobytes() + n_plain.astype("<i4").tobytes() + n_other.astype("<i4").tobytes() + plain.tobytes() + index.astype("<i4").tobytes()
        n = len(self.ids)
        none = [None, None]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([DOCUMENT] * n + [WORDS, PAIRS], pa.int32()), pa.array([block] * (n + 2), pa.int64()), pa.array(self.ids + none, pa.int64()),
                *(pa.array(c.tolist() + none, pa.int64()) for c in columns), pa.array(shas + none, pa.string()), pa.array(binaries + [words, None], pa.binary()),
                pa.array([None] * (n + 1) + [pairs.astype(np.int64)], pa.list_(pa.int64())), pa.array([None] * (n + 1) + [counts], pa.list_(pa.int64())),
            ],
            names=[c.split()[0] for c in STEP_SCHEMA.split(", ")],
        )


def _blocks(docs: DataFrame, a: str, b: str) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = of_worker(("pair", a, b), lambda: Pair(a, b))
        memo = of_worker(("aligned", a, b), lambda: Memo(pair.align, MEMO_WORDS))
        vector, n_blocks, first = np.zeros(len(pair.a_bytes), np.int64), 0, TaskContext.get().partitionId() << 32
        block = _Block(pair, memo)
        for batch in batches:
            texts = batch.column(1)
            for k, doc_id in enumerate(batch.column(0).to_pylist()):
                block.add(doc_id, texts[k].as_py())
                if block.n >= BLOCK_WORDS:
                    yield block.rows(first + n_blocks, vector)
                    block, n_blocks = _Block(pair, memo), n_blocks + 1
        if block.ids:
            yield block.rows(first + n_blocks, vector)
        seen = np.flatnonzero(vector)
        row = {"kind": VECTOR, "block": first, "pair": (seen << 16 | pair.same[seen]).tolist(), "n": vector[seen].tolist()}
        yield pa.RecordBatch.from_pylist([row], schema=SCHEMA)

    types = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    SCHEMA = pa.schema([(c.split()[0], types[c.split()[1]]) for c in STEP_SCHEMA.split(", ")])
    return docs.mapInArrow(work, STEP_SCHEMA)


def align_tokenizers(docs: DataFrame, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model", id_column: str = "doc_id", text_column: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, pairs): the alignment of each row's text, and the counts of all id pairs of the corpus.

    documents: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is the most frequent one of its B id, ties
    included), count_sum (of the links' pairs), groups_sha256. A text that is null, empty or not given back by both
    vocabularies has no tokens: zeros and ''. Repeated rows count as often as they are there; other columns aren't read.
    pairs: pair (A id << 16 | B id), n, best.

    What reaches the driver, and what is broadcast, is bounded by the vocabularies: a vector over A's ids and the best
    counts of B's ids. A block of documents has a bounded number of words, or holds one text.
    """
    spark = docs.sparkSession
    step = durable(_blocks(docs.selectExpr(f"cast(`{id_column}` as long) as doc_id", f"`{text_column}` as text"), a, b), "aligned")
    rows = lambda kind, *keep: step.where(F.col("kind") == kind).select(
        *keep,
        F.posexplode(F.arrays_zip("pair", "n")).alias("index", "x"),
    ).select(*keep, "index", "x.pair", "x.n")
    met = rows(PAIRS, "block")
    vector = rows(VECTOR).groupBy("pair").agg(F.sum("n").alias("n"))
    totals = met.select("pair", "n").unionByName(vector).groupBy("pair").agg(F.sum("n").alias("n"))
    totals = durable(totals, "pairs")
    b_id = F.col("pair").bitwiseAND(65535)
    most = totals.groupBy(b_id.alias("b_id")).agg(F.max("n").alias("most"))  # a row for each B id at most
    pairs = totals.join(F.broadcast(most), b_id == F.col("b_id")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    plain = pairs.join(F.broadcast(vector.select("pair")), "pair", "left_semi").collect()  # a row for each A id at most
    counts, best = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    for r in plain:
        counts[r.pair >> 16], best[r.pair >> 16] = r.n, r.best
    shared = spark.sparkContext.broadcast((counts, best))

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        counts, best = shared.value
        kind = left.column("kind").to_numpy()
        data = left.column("words").filter(pa.array(kind == WORDS))[0].as_py()
        n = int(np.frombuffer(data, "<i8", 1)[0])
        n_plain, n_other = np.frombuffer(data, "<i4", n, 8), np.frombuffer(data, "<i4", n, 8 + 4 * n)
        ids = np.frombuffer(data, "<u2", int(n_plain.sum()), 8 + 8 * n)
        index = np.frombuffer(data, "<i4", int(n_other.sum()), 8 + 8 * n + 2 * len(ids))
        table = np.zeros((2, right.num_rows), np.int64)
        at = right.column("index").to_numpy()
        table[0, at], table[1, at] = right.column("n").to_numpy(), right.column("best").to_numpy().astype(np.int64)
        of_word = [_sums(v[ids], n_plain) + _sums(t[index], n_other) for v, t in ((counts, table[0]), (best, table[1]))]
        docs = left.filter(pa.array(kind == DOCUMENT))
        refs = [np.frombuffer(x.as_py(), "<i4") for x in docs.column("words")]
        sizes = np.array([len(r) for r in refs], np.int64)
        flat = np.concatenate([np.zeros(0, np.int32), *refs])
        count_sum, n_best = (_sums(w[flat], sizes) for w in of_word)
        columns = {c: docs.column(c) for c in ("doc_id", *NUMBERS, "groups_sha256")} | {"n_best": pa.array(n_best), "count_sum": pa.array(count_sum)}
        return pa.table({c.split()[0]: columns[c.split()[0]] for c in RESULT_SCHEMA.split(", ")})

    found = met.select("block", "index", "pair").join(pairs, "pair").select(F.col("block").alias("of_block"), "index", "n", "best")
    blocks = step.where(F.col("kind").isin(DOCUMENT, WORDS)).select("block", "kind", "doc_id", *NUMBERS, "groups_sha256", "words")
    return blocks.groupBy("block").cogroup(found.groupBy("of_block")).applyInArrow(finish, RESULT_SCHEMA), pairs
