"""Nested XML actions to flat customer and account rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PHONE = "struct<C_CTRY_CODE:string,C_AREA_CODE:string,C_LOCAL:string,C_EXT:string>"
ACTION = (
    "_ActionType string, _ActionTS string, Customer struct<_C_ID:bigint,_C_TAX_ID:string,_C_GNDR:string,_C_TIER:int,_C_DOB:string,"
    "Name:struct<C_L_NAME:string,C_F_NAME:string,C_M_NAME:string>,"
    "Address:struct<C_ADLINE1:string,C_ADLINE2:string,C_ZIPCODE:string,C_CITY:string,C_STATE_PROV:string,C_CTRY:string>,"
    f"ContactInfo:struct<C_PRIM_EMAIL:string,C_ALT_EMAIL:string,C_PHONE_1:{_PHONE},C_PHONE_2:{_PHONE},C_PHONE_3:{_PHONE}>,"
    "TaxInfo:struct<C_LCL_TX_ID:string,C_NAT_TX_ID:string>,"
    "Account:array<struct<_CA_ID:bigint,_CA_TAX_ST:int,CA_B_ID:bigint,CA_NAME:string>>>"
)


def row_prefix(spark: SparkSession, path: str, tag: str = "Action") -> str:
    """The namespace prefix, with its colon, that a file's row tags carry; found at the first one."""
    tags = spark.read.option("lineSep", ">").text(path)
    found = tags.select(F.regexp_extract("value", rf"(?s)<((?:[\w.-]+:)?){tag}(?:\s.*)?/?$", 1).alias("prefix"), F.col("value").rlike(rf"(?s)<(?:[\w.-]+:)?{tag}(?:\s.*)?/?$").alias("hit"))
    first = found.where("hit").first()
    return first.prefix if first else ""


def read_actions(spark: SparkSession, path: str, prefix: str | None = None, keep_path: bool = False) -> DataFrame:
    """Actions of XML files, one to a row; prefixes are ignored.

    Files are cut at the end of their actions, so Spark splits a large file into many tasks (its own XML reader takes a
    whole file in one). An end tag must not stand in comments or CDATA. ``prefix`` is that of the row tags ("TPCDI:");
    by default the first action tells it. With ``keep_path`` each row has its file's ``_path``.
    """
    prefix = row_prefix(spark, path) if prefix is None else prefix
    end = f"</{prefix}Action>"
    cut = spark.read.option("lineSep", end).text(path).select("value", F.col("_metadata.file_path").alias("_path"))
    begun = F.regexp_extract("value", rf"(?s)<{prefix}Action[\s>].*", 0)
    rows = cut.select("_path", begun.alias("_begun")).where("_begun <> ''").select("_path", F.concat("_begun", F.lit(end)).alias("_action"))
    return parse_actions(rows, "_action", ["_path"] if keep_path else [])


def parse_actions(df: DataFrame, column: str, keep: list[str] = ()) -> DataFrame:
    """Actions held as text, one to a row.

    A generator over one parsed row keeps Catalyst from repeating the parse in every filter and field above it.
    """
    return df.select(*keep, F.inline(F.array(F.from_xml(F.col(column), ACTION, {"ignoreNamespace": "true"}))))


def _phones() -> list:
    part = {"C_CTRY_CODE": "c_ctry", "C_AREA_CODE": "c_area", "C_LOCAL": "c_local", "C_EXT": "c_ext"}
    return [F.nullif(F.trim(F.col(f"Customer.ContactInfo.C_PHONE_{n}.{x}")), F.lit("")).alias(f"{name}_{n}") for n in (1, 2, 3) for x, name in part.items()]


def customers(actions: DataFrame, keep: list[str] = ()) -> DataFrame:
    """One row per action that names a customer; repeated phone groups become flat columns."""
    c = lambda path: F.nullif(F.trim(F.col(f"Customer.{path}")), F.lit(""))
    return actions.where("Customer._C_ID is not null").select(
        *keep, F.col("_ActionType").alias("actiontype"), F.try_to_timestamp("_ActionTS", F.lit("y-M-d'T'H:m:s")).cast("timestamp_ntz").alias("actionts"),
        F.col("Customer._C_ID").alias("c_id"), c("_C_TAX_ID").alias("c_tax_id"), c("_C_GNDR").alias("c_gndr"), F.col("Customer._C_TIER").alias("c_tier"),
        F.try_to_timestamp("Customer._C_DOB", F.lit("y-M-d")).cast("date").alias("c_dob"),
        *[c(f"Name.{x}").alias(x.lower()) for x in ("C_L_NAME", "C_F_NAME", "C_M_NAME")],
        *[c(f"Address.{x}").alias(x.lower()) for x in ("C_ADLINE1", "C_ADLINE2", "C_ZIPCODE", "C_CITY", "C_STATE_PROV", "C_CTRY")],
        *[c(f"ContactInfo.{x}").alias(x.lower()) for x in ("C_PRIM_EMAIL", "C_ALT_EMAIL")], *_phones(),
        *[c(f"TaxInfo.{x}").alias(x.lower()) for x in ("C_LCL_TX_ID", "C_NAT_TX_ID")],
    )


def accounts(actions: DataFrame, keep: list[str] = ()) -> DataFrame:
    """One row per nested account, with its action and customer."""
    rows = actions.where("Customer._C_ID is not null").select(
        *keep, F.col("_ActionType").alias("actiontype"), F.try_to_timestamp("_ActionTS", F.lit("y-M-d'T'H:m:s")).cast("timestamp_ntz").alias("actionts"),
        F.col("Customer._C_ID").alias("ca_c_id"), F.explode("Customer.Account").alias("_x"),
    )
    return rows.select(
        *keep,
        "actiontype",
        "actionts",
        "ca_c_id",
        F.col("_x._CA_ID").alias("ca_id"),
        F.col("_x._CA_TAX_ST").alias("ca_tax_st"),
        F.col("_x.CA_B_ID").alias("ca_b_id"),
        F.nullif(F.trim("_x.CA_NAME"), F.lit("")).alias("ca_name"),
    )
