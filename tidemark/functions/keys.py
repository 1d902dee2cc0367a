"""Row hashes, surrogate keys and the load envelope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NULL_TOKEN = "~null~"


def joined(columns: list[str | Column], separator: str = "|") -> Column:
    """Columns as one text; NULL and the empty text stay apart."""
    cols = [F.col(c) if isinstance(c, str) else c for c in columns]
    return F.concat_ws(separator, *[F.coalesce(c.cast("string"), F.lit(NULL_TOKEN)) for c in cols])


def row_hash(columns: list[str | Column]) -> Column:
    """Content hash of the business columns, for equality alone."""
    return F.md5(joined(columns))


def row_hash64(columns: list[str | Column]) -> Column:
    """The first 64 bits of a SHA-256 of the business columns, as an unsigned number."""
    return F.conv(F.substring(F.sha2(joined(columns), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def surrogate_key(*columns: str | Column) -> Column:
    return F.md5(joined(list(columns), "-"))


def packed(c: Column, prefix: str = "") -> dict[str, Column]:
    """A hash in two columns for the way through a shuffle: MD5 texts as 16 bytes, any other text as it is. Equal values stay equal, NULL stays NULL; MD5 texts keep their order."""
    hashed = c.rlike(r"^[0-9a-f]{32}\z")
    return {f"{prefix}_packed": F.when(hashed, F.unhex(c)), f"{prefix}_text": F.when(~hashed, c)}


def unpacked(prefix: str = "") -> Column:
    return F.coalesce(F.lower(F.hex(f"{prefix}_packed")), F.col(f"{prefix}_text"))


def digest(c: Column) -> Column:
    """128 bits of a text's SHA-256, to group by in place of long texts."""
    return F.unhex(F.substring(F.sha2(c, 256), 1, 32))


def smart_date_key(c: Column) -> Column:
    return F.date_format(c, "yyyyMMdd").cast("int")


def second_of_day(c: Column) -> Column:
    return F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)


def second_of_text(c: Column) -> Column:
    """Second of the day of an ``H:M:S`` text."""
    part = lambda k: F.try_element_at(F.split(c, ":"), F.lit(k)).try_cast("int")
    return part(1) * 3600 + part(2) * 60 + part(3)


def with_envelope(df: DataFrame, batch_id: Column, business: list[str], source: Column, loaded_at: Column) -> DataFrame:
    """Attach batch, file, load time and content hash; hash columns are the business ones alone."""
    return df.withColumns({"_batch_id": batch_id, "_source_file": source, "_loaded_at": loaded_at, "_row_hash": row_hash(business)})
