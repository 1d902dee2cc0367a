"""Writes: contract first, then append, overwrite of one batch, or fan-out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class ContractError(ValueError):
    pass


def assert_contract(df: DataFrame, contract: StructType) -> DataFrame:
    """The contract's columns in its order; a missing column or another type is an error."""
    have = {f.name: f.dataType for f in df.schema.fields}
    wrong = [f"{f.name}: {have.get(f.name)} instead of {f.dataType}" for f in contract.fields if have.get(f.name) != f.dataType]
    if wrong:
        raise ContractError("; ".join(wrong))
    return df.select(*contract.names)


def append(df: DataFrame, path: str, contract: StructType, partition: str = "_batch_id") -> None:
    assert_contract(df, contract).write.mode("append").partitionBy(partition).parquet(path)


def overwrite_batches(df: DataFrame, path: str, contract: StructType, partition: str = "_batch_id") -> None:
    """Replace the batches that ``df`` holds and leave the others as they are."""
    assert_contract(df, contract).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def full_refresh(df: DataFrame, path: str, contract: StructType, **options: str) -> None:
    assert_contract(df, contract).write.mode("overwrite").options(**options).parquet(path)


def fan_out(df: DataFrame, path: str, by: str, targets: list[str], rest: str = "other") -> dict[str, int]:
    """One pass over ``df`` writes a folder for each of ``targets``, by the values of ``by``, and one for what has no target.

    Returns the rows of each target, counted while they are written.
    """
    kind = F.when(F.col(by).isin(*targets), F.col(by)).otherwise(rest)
    seen = Observation()
    counts = [F.count_if(F.col("_target") == t).alias(f"t{k}") for k, t in enumerate([*targets, rest])]
    df.withColumn("_target", kind).observe(seen, *counts).write.mode("overwrite").partitionBy("_target").parquet(path)
    return {t: seen.get[f"t{k}"] for k, t in enumerate([*targets, rest])}


def read_target(spark: SparkSession, path: str, target: str, schema: StructType) -> DataFrame:
    """One target of ``fan_out``; no row of another is read."""
    every = StructType(schema.fields).add("_target", "string")
    return spark.read.schema(every).parquet(path).where(F.col("_target") == target).drop("_target")


def unloaded_batches(df: DataFrame, control: DataFrame, batch: str = "_batch_id") -> DataFrame:
    """Rows of batches that the control table does not name yet."""
    return df.join(control.select(batch).distinct(), batch, "left_anti")


def replace_batch(stored: DataFrame, incoming: DataFrame, batch: str = "_batch_id") -> DataFrame:
    """What a table holds after a batch is loaded again: the incoming batches in place of the stored ones."""
    return stored.join(incoming.select(batch).distinct(), batch, "left_anti").unionByName(incoming)


def evidence(df: DataFrame, **constants) -> DataFrame:
    """Rows for an append-only log, with constant columns of the run."""
    return df.withColumns({k: F.lit(v) for k, v in constants.items()})
