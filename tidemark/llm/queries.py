"""Registered queries of the training-data operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import alignment, decontaminate, exact_dedup, html_text, licenses, line_dedup, mixing, near_join, quality, runs, surrogates, token_files, toxicity
from tidemark.llm.common import clear, table  # noqa: F401  clear: for callers that are done with the results


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))
    model = toxicity.fit(docs, labels.where(~held_out).select("doc_id", "toxic"))
    return toxicity.score_toxicity(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "n_passages", "first_word", "last_word"
    )


def op2_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join.near_duplicates(table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op5_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace_entities(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(table(spark, sf_dir, "documents"), keep="largest")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mixed(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mix.select(
        F.col("doc.doc_id").alias("doc_id"), F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"),
        (F.col("mix_size") * F.col("mix_copies")).alias("taken"),
    )


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_index(table(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_tokenizers(table(spark, sf_dir, "documents"))[0]


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """In a tenth of the documents the words from one place on repeat (rows without id are left as they are)."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.find_runs(table(spark, sf_dir, "documents"), prepare=planted, full=False)


QUERIES = {
    f.__name__: f for f in (
        op1_toxicity,
        op2_near_join,
        op3_decontaminate,
        op4_license,
        op5_surrogates,
        op6_quality,
        op7_line_dedup,
        op8_html_text,
        op9_exact_dedup,
        op10_mixing,
        op11_token_files,
        op12_token_alignment,
        op13_periodic_runs,
    )
}

ORACLE = {
    "op9_exact_dedup": """
        WITH n AS (
          SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
        )
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY t)
    """,
    "op10_mixing": r"""
        WITH d AS (
          SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
        ), s AS (
          SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
        ), w AS (
          SELECT *, 2.0::DOUBLE * source_size AS cap,
                 CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight
          FROM s
        ), o AS (
          SELECT *, coalesce(sum(cap) OVER b, 0) AS capped_before, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS weight_left,
                 sum(source_size) OVER () * 1.5::DOUBLE AS total, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS nth
          FROM w WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), l AS (
          SELECT coalesce(arg_min((total - capped_before) / weight_left, nth) FILTER (WHERE (total - capped_before) / weight_left < cap / weight), 1e300) AS level FROM o
        ), t AS (
          SELECT source, source_size, least(cap, weight * level) AS target FROM w, l
        ), r AS (
          SELECT d.doc_id, d.size, t.source_size, t.target,
                 CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
                 ('0x' || substr(md5('mix|' || coalesce(d.doc_id::VARCHAR, md5(coalesce(d.text, '')))), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS draw
          FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
        )
        SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
    """,
}
