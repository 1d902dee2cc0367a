"""Exact dedup by content sort.

Sampled splitters range-partition the normalised bytes (by the first 32 and a hash), an external sort places equal
texts next to each other, and each text is compared in full with its neighbours. Equal texts of one input batch are
folded before the shuffle, so a text that a third of all rows share crosses the network once per batch of rows, and
what leaves its task is one row.

Nulls: a null text is the empty text, so null and empty texts are equal. Rows with a null doc_id take part;
they lose against any id. Empty table: empty result. Repeated rows: each comes back. Very long texts are
whole. Columns besides doc_id and text are not read (``duplicate_groups``) or carried (``drop_duplicates``).
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import durable

#: Bytes of a text that partitions are split by, before its hash.
HEAD = 32
#: Ranges to a partition, and sampled texts to a range.
RANGES, SAMPLED = 4, 8
#: Texts that more rows share than this, and than the rows over ``MOST_HOT``, are labelled by a broadcast of theirs.
HOT, MOST_HOT = 64, 10_000


def normal(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()  # bytes.lower() changes A-Z alone


def _split_key(norm: bytes) -> tuple[bytes, int]:
    return norm[:HEAD], xxhash.xxh3_64_intdigest(norm) - (1 << 63)


def _better(a: int | None, b: int | None, largest: bool) -> bool:
    """Whether id a stays rather than id b."""
    if a is None or b is None:
        return b is None and a is not None
    return a > b if largest else a < b


def splitters(docs: DataFrame, partitions: int) -> list[tuple[bytes, int]]:
    """Keys that cut the texts into about equal ranges, from a sample of about ``SAMPLED`` to a range: heads and hashes, no texts."""
    wanted = partitions * RANGES * SAMPLED
    rows = docs.count()

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_split_key(normal(t)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in found], pa.binary()), pa.array([k for _, k in found], pa.int64())], ["head", "hash"])

    sample = docs.select("text").sample(min(1.0, wanted / max(1, rows)), 17)
    found = sorted((bytes(r["head"]), r["hash"]) for r in sample.mapInArrow(keys, "head binary, hash long").collect())
    return sorted({found[k * len(found) // (partitions * RANGES)] for k in range(1, partitions * RANGES)}) if found else []


def _partitions(docs: DataFrame) -> int:
    return int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _fold(cuts: list[tuple[bytes, int]], largest: bool):
    """(doc_id, text) to (part, head, hash, best, n, norm): equal texts of a batch become one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups: dict[bytes, list] = {}
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                g = groups.setdefault(normal(text), [i, 0])
                g[0] = i if _better(i, g[0], largest) else g[0]
                g[1] += 1
            keys = [_split_key(norm) for norm in groups]
            columns = [
                pa.array([bisect_right(cuts, k) for k in keys], pa.int32()), pa.array([h for h, _ in keys], pa.binary()), pa.array([k for _, k in keys], pa.int64()),
                pa.array([g[0] for g in groups.values()], pa.int64()), pa.array([g[1] for g in groups.values()], pa.int64()), pa.array(list(groups), pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["part", "head", "hash", "best", "n", "norm"])

    return run


def _runs(largest: bool):
    """Sorted rows of ``_fold`` to one row per text: text_sha256, keep_id, group_size."""

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, run = None, {}

        def rows(runs: list[dict[bytes, list]]) -> pa.RecordBatch:
            found = [(hashlib.sha256(norm).hexdigest(), *g) for run in runs for norm, g in run.items()]
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["text_sha256", "keep_id", "group_size"])

        for batch in batches:
            done = []
            for head, hashed, best, n, norm in zip(*(batch.column(k).to_pylist() for k in range(1, 6))):
                if (head, hashed) != key:
                    done.append(run)
                    key, run = (head, hashed), {}
                g = run.get(norm)  # the full comparison with the neighbours of equal head and hash
                if g is None:
                    run[norm] = [best, n]
                else:
                    g[0] = best if _better(best, g[0], largest) else g[0]
                    g[1] += n
            yield rows(done)
        yield rows([run])

    return label


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([hashlib.sha256(normal(t)).hexdigest() for t in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text_sha256"])


def duplicate_groups(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. ``keep`` is "smallest" or "largest": whose doc_id
    stays. kept is true where doc_id is keep_id (true for all of several rows with that id and text).
    """
    largest = keep == "largest"
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = _partitions(docs)
    folded = docs.mapInArrow(_fold(splitters(docs, parts), largest), "part int, head binary, hash long, best long, n long, norm binary")
    runs = folded.repartition(parts, "part").sortWithinPartitions("part", "head", "hash").mapInArrow(_runs(largest), "text_sha256 string, keep_id long, group_size long")
    runs = durable(runs, "runs").where("group_size > 1")
    rows = docs.mapInArrow(_digests, "doc_id long, text_sha256 string")
    # Texts that very many rows share are few by their number alone, so no key of the shuffled join is hot.
    hot = F.col("group_size") > F.greatest(F.lit(HOT), F.lit(docs.count() // MOST_HOT))
    rows = rows.join(F.broadcast(runs.where(hot).withColumnsRenamed({"keep_id": "hot_keep", "group_size": "hot_size"})), "text_sha256", "left")
    key = F.when(F.col("hot_size").isNull(), F.col("text_sha256")).otherwise(F.concat(F.lit("hot "), F.col("doc_id").cast("string")))
    rows = rows.withColumn("looked_up", F.coalesce(key, F.lit("hot")))
    cold = runs.where(~hot).select(F.col("text_sha256").alias("looked_up"), "keep_id", "group_size")
    rows = rows.join(cold, "looked_up", "left")
    keep_id = F.when(F.col("hot_size").isNotNull(), F.col("hot_keep")).when(F.col("group_size").isNotNull(), F.col("keep_id")).otherwise(F.col("doc_id"))
    out = rows.select("doc_id", keep_id.alias("keep_id"), F.coalesce("hot_size", "group_size", F.lit(1).cast("long")).alias("group_size"), "text_sha256")
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def _chosen(names: list[str], largest: bool, cuts: list[tuple[bytes, int]]):
    """Of each batch, one row of equal texts, with what its place is split and sorted by."""
    text_at, id_at = names.index("text"), names.index("doc_id")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best: dict[bytes, tuple[int, int | None]] = {}
            for k, (text, i) in enumerate(zip(batch.column(text_at).to_pylist(), batch.column(id_at).to_pylist())):
                norm = normal(text)
                if norm not in best or _better(i, best[norm][1], largest):
                    best[norm] = (k, i)
            keys = [_split_key(norm) for norm in best]
            rows = batch.take(pa.array([k for k, _ in best.values()], pa.int64()))
            split = [pa.array([bisect_right(cuts, k) for k in keys], pa.int32()), pa.array([h for h, _ in keys], pa.binary()), pa.array([k for _, k in keys], pa.int64())]
            yield pa.RecordBatch.from_arrays([*rows.columns, *split], [*names, *_split_names(names)])

    return choose


def _split_names(names: list[str]) -> list[str]:
    """Names for the split columns that no column of the table has."""
    tail = "_" * (1 + max(map(len, names)))
    return [f"{c}{tail}" for c in ("part", "head", "hash")]


def _first_of_runs(names: list[str], largest: bool):
    """Of sorted rows, one of each run of equal texts: the first, as the best id comes first."""
    text_at, n = names.index("text"), len(names)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, seen = None, set()
        for batch in batches:
            rows = []
            for k, (head, hashed, text) in enumerate(zip(batch.column(n + 1).to_pylist(), batch.column(n + 2).to_pylist(), batch.column(text_at).to_pylist())):
                if (head, hashed) != key:
                    key, seen = (head, hashed), set()
                norm = normal(text)
                if norm not in seen:  # the full comparison with the neighbours of equal head and hash
                    seen.add(norm)
                    rows.append(k)
            yield batch.take(pa.array(rows, pa.int64())).select(names)

    return choose


def drop_duplicates(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """The rows of ``docs`` without all but one of equal texts; all columns are carried through one shuffle.

    Of repeated rows with one id and one text, one stays.
    """
    largest, names, parts = keep == "largest", docs.columns, _partitions(docs)
    part, head, hashed = _split_names(names)
    split = ", ".join(f"`{c}` {t}" for c, t in ((part, "int"), (head, "binary"), (hashed, "long")))
    rows = docs.mapInArrow(_chosen(names, largest, splitters(docs, parts)), f"{docs.schema.toDDL()}, {split}")
    ident = F.col("doc_id").desc_nulls_last() if largest else F.col("doc_id").asc_nulls_last()
    rows = rows.repartition(parts, part).sortWithinPartitions(part, head, hashed, ident)
    return rows.mapInArrow(_first_of_runs(names, largest), docs.schema)
