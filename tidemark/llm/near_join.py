"""N-gram Jaccard join by a MinHash LSH forest.

Each distinct word sequence gets a MinHash signature of ``TREES`` labels. A tree is the sorted trie of its
labels' prefixes: the join starts from the longest prefix that still reaches ``RECALL`` at the threshold
(solved from 1 - (1 - t^depth)^trees) and shortens the matched prefix where the subtree stays small, which
only adds candidates. Candidates are verified exactly on their sets of word shingles.

Work that grows with a group of near copies is split: a subtree with many documents or shingles is dealt out as
pairs of blocks, and pairs are counted in the task, never emitted. Counting every link of a group takes the square of its
size. Where only connected groups are asked for (``drop_near_duplicates``), the members of a large subtree are compared
with its first one, and those that are not linked to it with all: work and rows dealt grow with the group's size, times
the blocks that the unlinked ones fill. Equal texts are folded before the trees are
built and come back through their class. Each pair is counted in the first tree in which it meets.

Texts are lower-cased and split at white space. A text of fewer than five words is one shingle, so it matches
equal texts alone; null and empty texts are one class of equal texts without shingles. Rows with a null doc_id
are returned as classes of their own, without links. Repeated rows count as copies. Rows with one doc_id and several
texts are several documents: a document is known by its place, doc_id and hash of the text. Empty table: empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WordHashes, durable, free_name, mix64, semi_or_anti
from tidemark.llm.components import connected_components

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.999
TREES = 24
#: The shortest prefix, used where its subtree has at most SPARSE documents.
SHORTEST, SPARSE = 4, 8
#: A block of a large subtree holds at most about this many documents and shingles.
BLOCK_DOCS, BLOCK_SHINGLES = 512, 400_000

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def depth_for(recall: float = RECALL, threshold: float = THRESHOLD, trees: int = TREES) -> int:
    """The longest prefix with which a pair at the threshold still meets in some tree with probability ``recall``."""
    return max(1, math.floor(math.log(1 - (1 - recall) ** (1 / trees)) / math.log(threshold) + 1e-9))


DEPTH = depth_for()


def shingles(words: np.ndarray) -> np.ndarray:
    """64-bit identities of the five-word shingles of a sequence of word hashes, in order, with repeats."""
    n = len(words)
    with np.errstate(over="ignore"):
        if n < WORDS:
            return mix64(np.array([(words * _ODD[:n]).sum(dtype=np.uint64) + np.uint64(n)], dtype=np.uint64)) if n else words
        total = np.zeros(n - WORDS + 1, dtype=np.uint64)
        for k in range(WORDS):
            total += words[k : n - WORDS + 1 + k] * _ODD[k]
    return mix64(total)


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    n = TREES * DEPTH
    return rng.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(place, text) to (place, digest, n, short, full): per tree a hash of the short and of the full prefix."""
    a, b = _coefficients()
    hashes = WordHashes()
    short = min(SHORTEST, DEPTH)

    def prefixes(least: np.ndarray, upto: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            out = np.zeros((len(least), TREES), dtype=np.uint64)
            for k in range(upto):
                out = mix64(out * _ODD[0] + least[:, k::DEPTH].astype(np.uint64) + np.uint64(k + 1))
        return out.view(np.int64)

    for batch in batches:
        ids, digests, sizes, low = [], [], [], []
        pending: list[np.ndarray] = []

        def flush() -> None:
            if not pending:
                return
            starts = np.cumsum([0] + [len(p) for p in pending[:-1]])
            x = np.concatenate(pending)
            with np.errstate(over="ignore"):
                hashed = x[:, None] * a[None, :] + b[None, :]
            low.append(np.minimum.reduceat(hashed, starts, axis=0))
            pending.clear()

        held = 0
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = (text or "").lower().split()
            ids.append(i)
            digests.append(xxhash.xxh3_128_digest(" ".join(words).encode("utf-8", "surrogatepass")))
            s = (shingles(hashes.array(words)) >> np.uint64(32)).astype(np.uint32)
            sizes.append(len(s))
            if not len(s):
                s = np.zeros(1, dtype=np.uint32)
            for at in range(0, len(s), 1 << 15):  # a very long text is signed in pieces
                if at or len(s) > 1 << 15:
                    flush()
                    with np.errstate(over="ignore"):
                        piece = (s[at : at + (1 << 15), None] * a + b).min(axis=0)[None]
                    if at:
                        low[-1] = np.minimum(low[-1], piece)
                    else:
                        low.append(piece)
                else:
                    pending.append(s)
                    held += len(s)
            if held > 1 << 12:
                flush()
                held = 0
        flush()
        least = np.concatenate(low) if low else np.zeros((0, len(a)), dtype=np.uint32)
        lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, (len(ids) + 1) * TREES, TREES, dtype=np.int32)), pa.array(prefixes(least, d).ravel())) for d in (short, DEPTH)]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), *lists], ["place", "digest", "n", "short", "full"])


def _verified(group: list[tuple], tree: int, same_block: bool, forest_only: bool = False) -> tuple[np.ndarray, np.ndarray, list[tuple[bytes, bytes]]]:
    """Exact links within a bucket: per member the number of linked texts and documents, and a spanning forest.

    ``group`` has (rep, copies, side, buckets by tree, shingle set) per member; between two blocks only pairs of
    members of different sides count. A pair that met in an earlier tree is left to that tree. ``forest_only``: pairs
    that are connected already are passed over, and all members are held against the first before any others, so the
    work in a group of near copies grows with its size, not with its square; links are then not counted.
    """
    n = len(group)
    links, docs, parent = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), list(range(n))
    copies = np.array([g[1] for g in group], dtype=np.int64)
    side = np.array([g[2] for g in group])
    met = np.array([g[3] for g in group], dtype=np.int64).reshape(n, TREES)
    size = np.array([len(g[4]) for g in group], dtype=np.int64)
    forest: list[tuple[bytes, bytes]] = []

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    step = 128
    blocks = [(np.arange(i0, min(n, i0 + step)), np.arange(j0, min(n, j0 + step))) for i0 in range(0, n, step) for j0 in range(i0, n, step)]
    if forest_only and n > 8:
        blocks = [(np.arange(1), np.arange(j0, min(n, j0 + step))) for j0 in range(0, n, step)] + blocks
    for i, j in blocks:
        if forest_only:
            roots = np.array([find(k) for k in range(i[0], i[-1] + 1)])[:, None] != np.array([find(k) for k in range(j[0], j[-1] + 1)])[None]
            if not roots.any():
                continue
        ok = np.minimum(size[i][:, None], size[j][None]) >= THRESHOLD * np.maximum(size[i][:, None], size[j][None])
        if forest_only:
            ok &= roots
        if i[0] == j[0]:
            ok &= i[:, None] < j[None]
        if not same_block:
            ok &= side[i][:, None] != side[j][None]
        for t in range(tree):
            ok &= (met[i, t][:, None] != met[j, t][None]) | (met[i, t][:, None] == 0)
        rows, cols = np.flatnonzero(ok.any(1)), np.flatnonzero(ok.any(0))
        if not len(rows):
            continue
        if ok.sum() <= 4:
            common = np.zeros(ok.shape)
            for x, y in zip(*np.nonzero(ok)):
                common[x, y] = len(np.intersect1d(group[i[x]][4], group[j[y]][4], assume_unique=True))
        else:
            common = np.zeros(ok.shape)
            common[np.ix_(rows, cols)] = _intersections([group[k][4] for k in i[rows]], [group[k][4] for k in j[cols]])
        union = size[i][:, None] + size[j][None] - common
        linked = ok & (common >= THRESHOLD * union - 1e-9) & (union > 0)
        links[i] += linked.sum(1)
        docs[i] += linked @ copies[j]
        links[j] += linked.sum(0)
        docs[j] += copies[i] @ linked
        for x, y in zip(*np.nonzero(linked)):
            p, q = find(int(i[x])), find(int(j[y]))
            if p != q:
                parent[max(p, q)] = min(p, q)
                forest.append((group[i[x]][0], group[j[y]][0]))
    return links, docs, forest


def _intersections(left: list[np.ndarray], right: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of every left set with every right set, over shingles that both sides have."""
    la, ra = np.concatenate(left), np.concatenate(right)
    shared = np.intersect1d(la, ra)
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    for at in range(0, len(shared), columns):
        part = shared[at : at + columns]
        sides = []
        for sets in (left, right):
            m = np.zeros((len(sets), len(part)), dtype=np.float32)
            for k, s in enumerate(sets):
                where = np.searchsorted(part, s)
                where[where == len(part)] = 0
                m[k, where[part[where] == s]] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out


def _verify(forest_only: bool):
    """Rows sorted by bucket and block pair to link counts (dst null) and forest edges (dst set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes(most=200_000)
        key, group = None, []

        def results() -> list[tuple]:
            if len(group) < 2:
                return []
            links, docs, forest = _verified(group, key[0], key[2] == key[3], forest_only)
            counted = [] if forest_only else [(group[k][0], None, int(links[k]), int(docs[k])) for k in np.flatnonzero(links).tolist()]
            return counted + [(max(e), min(e), 0, 0) for e in forest]

        def rows(found: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate(kinds)], ["src", "dst", "links", "docs"])

        for batch in batches:
            found = []
            c = {name: batch.column(k).to_pylist() for k, name in enumerate(batch.schema.names)}
            for row in zip(c["tree"], c["bucket"], c["lo"], c["hi"], c["rep"], c["copies"], c["side"], c["met"], c["text"]):
                if row[:4] != key:
                    found += results()
                    key, group = row[:4], []
                words = (row[8] or "").lower().split()
                group.append((row[4], row[5], row[6], row[7], np.unique(shingles(hashes.array(words)))))
            yield rows(found)
        yield rows(results())

    return run


def _links(docs: DataFrame, reps: DataFrame, forest_only: bool) -> DataFrame:
    """(src, dst, links, docs) rows of all verified links between representatives, or of a spanning forest of them."""
    trees = reps.where("n > 0").select("rep", "copies", "n", F.posexplode(F.arrays_zip("short", "full")).alias("tree", "label"))
    trees = trees.select("rep", "copies", "n", "tree", F.col("label.short").alias("short"), F.col("label.full").alias("full"))
    # Prefixes are counted before anything else is shuffled by them; those of one document alone have no partner.
    by_short = trees.groupBy("tree", "short").agg(F.count("*").alias("n_short"), F.sum("n").alias("shingles_short")).where("n_short > 1")
    near = durable(trees.join(by_short, ["tree", "short"]), "subtrees")
    by_full = near.where(F.col("n_short") > SPARSE).groupBy("tree", "full").agg(F.count("*").alias("n_full"), F.sum("n").alias("shingles_full")).where("n_full > 1")
    sparse = near.where(F.col("n_short") <= SPARSE).select(
        "rep",
        "copies",
        "tree",
        F.col("short").alias("bucket"),
        F.col("n_short").alias("members"),
        F.col("shingles_short").alias("shingles"),
    )
    dense = near.where(F.col("n_short") > SPARSE).join(by_full, ["tree", "full"]).select(
        "rep",
        "copies",
        "tree",
        F.col("full").alias("bucket"),
        F.col("n_full").alias("members"),
        F.col("shingles_full").alias("shingles"),
    )
    rows = sparse.unionByName(dense).withColumn("bucket", F.when(F.col("bucket") == 0, F.lit(1)).otherwise(F.col("bucket")))
    # The buckets a document meets others in, by tree: at most one for each tree; 0 is none.
    by_tree = F.map_from_entries(F.array_distinct(F.collect_list(F.struct("tree", "bucket"))))
    met = rows.dropDuplicates(["rep", "tree"]).groupBy("rep").agg(by_tree.alias("by_tree"))
    met = met.select("rep", F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.coalesce(F.col("by_tree")[t], F.lit(0))).alias("met"))
    rows = durable(rows.join(met, "rep"), "buckets")
    # A bucket whose members all met in an earlier tree has nothing left to verify.
    ends = rows.groupBy("tree", "bucket").agg(*[f(F.when(F.col("tree") > t, F.col("met")[t])).alias(f"{name}{t}") for t in range(TREES - 1) for name, f in (("lo", F.min), ("hi", F.max))])
    settled = F.lit(False)
    for t in range(TREES - 1):
        settled = settled | F.coalesce((F.col(f"lo{t}") == F.col(f"hi{t}")) & (F.col(f"lo{t}") != 0), F.lit(False))
    rows = rows.join(ends.where(~settled).select("tree", "bucket"), ["tree", "bucket"])
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK_DOCS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("side", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    rows = durable(rows, "candidates")
    texts = semi_or_anti(docs.select(_place().alias("rep"), "text"), rows.select("rep").distinct(), "rep", "left_semi").dropDuplicates(["rep"])
    if not forest_only:
        return _compared(_pairs_of_blocks(rows), texts, False)
    small, large = rows.where("blocks = 1"), rows.where("blocks > 1")
    met = durable(_with_texts(_heads(large), texts).repartition("tree", "bucket", "side").sortWithinPartitions("tree", "bucket", "side", F.desc("is_head")).mapInArrow(_against_head, "tree int, bucket long, rep binary, head binary"), "heads")
    joined = met.where("head is not null").select(
        F.greatest("rep", "head").alias("src"),
        F.least("rep", "head").alias("dst"),
        F.lit(0).cast("long").alias("links"),
        F.lit(0).cast("long").alias("docs"),
    )
    left = met.where("head is null").select("tree", "bucket", "rep")
    return joined.unionByName(_compared(_pairs_of_blocks(small).unionByName(_rest(large, left)), texts, True))


def _pairs_of_blocks(rows: DataFrame) -> DataFrame:
    """Members dealt to all pairs of their block with a block of their subtree: members x blocks rows."""
    dealt = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select("tree", "bucket", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "rep", "copies", "side", "met")


def _heads(large: DataFrame) -> DataFrame:
    """Members of large subtrees, each in its block, with the subtree's first member sent to every block: members + blocks rows."""
    first = large.groupBy("tree", "bucket").agg(F.min("rep").alias("rep"), F.max("blocks").alias("n"))
    heads = first.withColumn("side", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select("tree", "bucket", "side", "rep", F.lit(True).alias("is_head"))
    return large.select("tree", "bucket", "side", "rep", F.lit(False).alias("is_head")).unionByName(heads)


def _rest(large: DataFrame, left: DataFrame) -> DataFrame:
    """What stays to be compared once members that are linked to their subtree's first one are joined by it: the others,
    with every member. Blocks of the others meet blocks of all: members x blocks of others + others x blocks rows."""
    counted = left.groupBy("tree", "bucket").agg(F.count("*").alias("n_left"))
    more = F.ceil(F.col("n_left") / BLOCK_DOCS).cast("int")
    counted = counted.withColumn("others", more)
    every = large.join(counted, ["tree", "bucket"])
    members = every.withColumn("lo", F.explode(F.sequence(F.lit(0), F.col("others") - 1))).select("tree", "bucket", "lo", F.col("side").alias("hi"), "rep", "copies", "side", "met")
    mine = every.join(left, ["tree", "bucket", "rep"], "left_semi").withColumn("lo", F.pmod(F.xxhash64("rep"), F.col("others")).cast("int"))
    mine = mine.withColumn("hi", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("tree", "bucket", "lo", "hi", "rep", "copies", F.lit(-1).alias("side"), "met")
    # Blocks are numbered from 1 on here, so that no pair looks like one of a block with itself.
    return members.unionByName(mine).withColumns({"lo": -1 - F.col("lo")})


def _with_texts(dealt: DataFrame, texts: DataFrame) -> DataFrame:
    return dealt.join(texts, "rep")


def _compared(dealt: DataFrame, texts: DataFrame, forest_only: bool) -> DataFrame:
    keys = ["tree", "bucket", "lo", "hi"]
    rows = _with_texts(dealt, texts).select(*keys, "rep", "copies", "side", "met", "text")
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_verify(forest_only), "src binary, dst binary, links long, docs long")


def _against_head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of blocks, each with its subtree's first member before the others, to (tree, bucket, rep, head): head is null where the two are not linked."""
    hashes = WordHashes(most=200_000)
    key, head, name = None, None, None
    for batch in batches:
        out: list[tuple] = []
        c = {column: batch.column(k).to_pylist() for k, column in enumerate(batch.schema.names)}
        for tree, bucket, side, rep, is_head, text in zip(c["tree"], c["bucket"], c["side"], c["rep"], c["is_head"], c["text"]):
            own = np.unique(shingles(hashes.array((text or "").lower().split())))
            if is_head:
                key, head, name = (tree, bucket, side), own, rep
                continue
            if rep == name:
                continue
            assert key == (tree, bucket, side)
            linked = False
            if min(len(own), len(head)) >= THRESHOLD * max(len(own), len(head)):
                common = len(np.intersect1d(own, head, assume_unique=True))
                linked = common >= THRESHOLD * (len(own) + len(head) - common) - 1e-9 and len(own) > 0
            out.append((tree, bucket, rep, name if linked else None))
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["tree", "bucket", "rep", "head"])


def _place() -> Column:
    """A document's place, doc_id and hash of the text, as 16 bytes that sort like the two."""
    hexed = [F.lpad(F.hex(c), 16, "0") for c in (F.col("doc_id").bitwiseXOR(F.lit(-(1 << 63))), F.xxhash64("text"))]
    return F.unhex(F.concat(*hexed))


def _id_of(place: str) -> Column:
    unsigned = F.conv(F.hex(F.substring(F.col(place), 1, 8)), 16, 10).cast("decimal(20,0)")
    return (unsigned - F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("long")


def _classes(docs: DataFrame, forest_only: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(place, digest) of all documents, (digest, rep, copies, root) of distinct texts, and the links found.

    ``docs`` has no null doc_id. root is the smallest place of the connected group.
    """
    placed = docs.select(_place().alias("place"), "text")
    signed = durable(placed.mapInArrow(_sign, "place binary, digest binary, n long, short array<long>, full array<long>"), "signatures")
    # Equal digests have equal signatures, so any one of them stands for the class.
    reps = durable(
        signed.groupBy("digest").agg(
            F.min("place").alias("rep"),
            F.count("*").alias("copies"),
            F.first("n").alias("n"),
            F.first("short").alias("short"),
            F.first("full").alias("full"),
        ),
        "classes",
    )
    found = durable(_links(docs, reps, forest_only), "links")
    groups = connected_components(found.where("dst is not null").select("src", "dst"))
    classes = reps.select("digest", "rep", "copies").join(groups, F.col("node") == F.col("rep"), "left").select("digest", "rep", "copies", F.coalesce("root", "rep").alias("root"))
    return signed.select("place", "digest"), classes, found


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document.

    doc_id; class_id: the smallest doc_id of the connected group; text_id: the smallest doc_id with the same word
    sequence; n_copies: documents with that sequence; n_links: other sequences with similarity of 0.8 or more;
    n_linked_docs: documents that have those sequences.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed, classes, found = _classes(docs.where("doc_id is not null"), False)
    counts = found.where("dst is null").groupBy("src").agg(F.sum("links").alias("n_links"), F.sum("docs").alias("n_linked_docs"))
    zero = F.lit(0).cast("long")
    classes = classes.join(counts, F.col("src") == F.col("rep"), "left").select(
        "digest",
        _id_of("root").alias("class_id"),
        _id_of("rep").alias("text_id"),
        F.col("copies").alias("n_copies"),
        F.coalesce("n_links", zero).alias("n_links"),
        F.coalesce("n_linked_docs", zero).alias("n_linked_docs"),
    )
    out = signed.join(classes, "digest").select(_id_of("place").alias("doc_id"), "class_id", "text_id", "n_copies", "n_links", "n_linked_docs")
    none = F.lit(None).cast("long")
    nameless = docs.where("doc_id is null").select(
        "doc_id",
        none.alias("class_id"),
        none.alias("text_id"),
        F.lit(1).cast("long").alias("n_copies"),
        zero.alias("n_links"),
        zero.alias("n_linked_docs"),
    )
    return out.unionByName(nameless)


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without all but one document of each connected group: the smallest doc_id stays, of
    several texts with that id the one with the smallest hash.

    Rows with a null doc_id stay. Repeated rows of the document that stays all stay. Links are not counted: see above.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed, classes, _ = _classes(plain.where("doc_id is not null"), True)
    dropped = durable(signed.join(classes, "digest").where("place <> root").select("place"), "dropped")
    place = free_name("place", docs.columns)
    named = docs.withColumn(place, F.when(F.col("doc_id").isNotNull(), _place()))
    return semi_or_anti(named, dropped.withColumnRenamed("place", place), place, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
