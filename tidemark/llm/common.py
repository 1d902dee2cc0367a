"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most ids that may be broadcast to drop or select rows; beyond it the same step is a shuffled join.
MAX_BROADCAST_IDS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Only a local session (tests) may leave it unset."""
    set_to = spark.sparkContext.getCheckpointDir()
    if set_to is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured is None and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(configured or tempfile.mkdtemp(prefix="spark-tidemark-"))
        set_to = spark.sparkContext.getCheckpointDir()
    return set_to


_written: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A folder in the shared folder that nothing uses yet; ``clear`` removes it."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def durable(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage: a lost executor costs the re-read of files, not a recomputation. The table stays until
    ``discard`` or, at the end of a job, ``clear`` removes it.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.durable_path = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    _written.remove(path)


def discard(*frames: DataFrame) -> None:
    """Remove tables of ``durable`` that no later step reads."""
    for df in frames:
        _remove(df.sparkSession, df.durable_path)


def clear(spark: SparkSession) -> None:
    """Remove all tables that this process has written with ``durable``: their results must have been used by then."""
    for path in list(_written):
        _remove(spark, path)


def free_name(wanted: str, taken: list[str]) -> str:
    """``wanted``, with underscores added until no column has that name (case does not matter)."""
    names = {c.lower() for c in taken}
    while wanted.lower() in names:
        wanted += "_"
    return wanted


def is_small(ids: DataFrame, bound: int = MAX_BROADCAST_IDS) -> bool:
    """Whether ``ids`` (already durable) has at most ``bound`` rows; reads no more than it must."""
    return ids.limit(bound + 1).count() <= bound


def semi_or_anti(df: DataFrame, ids: DataFrame, key: str, how: str, bound: int = MAX_BROADCAST_IDS) -> DataFrame:
    """Keep (``left_semi``) or drop (``left_anti``) the rows of ``df`` whose ``key`` is in ``ids``.

    ``ids`` must be durable. Up to ``bound`` ids are broadcast, so that ``df`` is not shuffled; more are
    joined by a shuffle, with the same result.
    """
    ids = ids.select(key).distinct() if how == "left_anti" else ids.select(key)
    return df.join(F.broadcast(ids) if is_small(ids, bound) else ids, key, how)


def lower_az(text: Column) -> Column:
    """Lower-case A-Z alone; a null text is the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class WordHashes(dict):
    """Cache of 64-bit word hashes; emptied when it has grown to ``most`` words, so its memory is bounded."""

    def __init__(self, seed: int = 0, most: int = 400_000):
        super().__init__()
        self.seed, self.most = seed, most

    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), self.seed)
        return h

    def array(self, words: list[str]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (multiply and xor-shift), wrapping as intended."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))
