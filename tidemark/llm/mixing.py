"""Mixing sources to target weights, with DataFrame functions alone.

Tokens are aggregated per source, targets are shared out by weight below a ceiling, and each document is
emitted floor(rate) times plus once more with probability equal to the fraction, by a seeded hash of its id.

Nulls: a null source is a source of its own, the last one; a null text has size 0; a row with a null doc_id draws by
the hash of its text. Columns may have any names: rows travel as one value. Empty table: empty result. Sources without any token have target 0 and rate 0. Repeated rows
get the same number of copies. Reruns agree: nothing depends on partitions or row order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import durable, free_name

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)


def source_targets(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, ceiling: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, size) rows: one row per source.

    Weights repeat over the sources in code-point order, null last. The excess over ``ceiling`` times a
    source's size is reshared by weight until no target is above its ceiling; each round needs two sums.
    """
    per = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    # One row per source name (not per document) is ordered here.
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    per = durable(per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(ceiling))), "sources")
    total = per.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0] * float(share)
    level = 0.0
    while True:
        full = F.col("weight") * F.lit(level) >= F.col("cap")
        capped, open_weight = per.agg(
            F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))
        ).first()
        raised = (total - capped) / open_weight if open_weight else level
        if raised <= level:
            break
        level = raised
    return per.select("source", "source_size", F.least(F.col("cap"), F.col("weight") * F.lit(level)).alias("target"))


def mixed(docs: DataFrame, seed: str = "mix", **params) -> DataFrame:
    """Each row of ``docs`` as one value (doc), with mix_size, mix_source_size, mix_target and mix_copies (how often the mix takes it)."""
    sized = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long").alias("mix_size"))
    targets = source_targets(sized.select(F.col("doc.source").alias("source"), F.col("mix_size").alias("size")), **params)
    named = targets.select(F.col("source").alias("mix_source"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"))
    # A row per source: Spark broadcasts it while it is small and splits skewed keys beyond.
    joined = sized.join(named, F.col("doc.source").eqNullSafe(F.col("mix_source")), "left").drop("mix_source")
    rate = F.coalesce(F.try_divide(F.col("mix_target"), F.col("mix_source_size").cast("double")), F.lit(0.0))
    ident = F.coalesce(F.col("doc.doc_id").cast("string"), F.md5(F.coalesce(F.col("doc.text"), F.lit(""))))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), ident)), 1, 12), 16, 10).cast("long") / F.lit(float(16**12))
    return joined.withColumn("mix_copies", (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("long"))


def emit(docs: DataFrame, **params) -> DataFrame:
    """The mix itself: each document's row as many times as it is taken, with its copy number (mix_copy, or the next free name)."""
    taken = mixed(docs, **params).where("mix_copies > 0")
    return taken.select("doc.*", F.explode(F.sequence(F.lit(1).cast("long"), "mix_copies")).alias(free_name("mix_copy", docs.columns)))
