import random
import re

import duckdb
import pytest
from odd_rows import ODD, SCHEMA
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import decontaminate, exact_dedup, mixing, near_join, quality, queries

SF = "/root/testdata/sf0.001"


def plain(v):
    return f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_rows_agree_with_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    ours, sql = queries.QUERIES[name](spark, SF), con.sql(queries.ORACLE[name])
    assert sorted(ours.columns) == sorted(sql.columns)
    at = [sql.columns.index(c) for c in sorted(ours.columns)]
    assert sorted(tuple(plain(r[c]) for c in sorted(ours.columns)) for r in ours.collect()) == sorted(tuple(plain(r[k]) for k in at) for r in sql.fetchall())


def water(sizes, total):
    """Targets by raising the level in small exact steps: weights 5, 2, 1 repeat, caps are twice the size."""
    w = [(5, 2, 1)[k % 3] for k in range(len(sizes))]
    open_, left, out = set(range(len(sizes))), float(total), [0.0] * len(sizes)
    while open_:
        level = left / sum(w[k] for k in open_)
        full = {k for k in open_ if w[k] * level >= 2 * sizes[k]}
        if not full:
            for k in open_:
                out[k] = w[k] * level
            break
        for k in full:
            out[k] = 2.0 * sizes[k]
            left -= out[k]
        open_ -= full
    return out


def test_mix_against_brute_force(spark):
    rng = random.Random(9)
    names = ["b", "a", "Z", "é", None, "empty"]
    rows = [(k, "w " * rng.choice([1, 5, 30]), None, s, None, 1, "x") for k in range(900) for s in [rng.choices(names[:5], [500, 200, 100, 50, 20])[0]]]
    rows += [(2000, None, None, "empty", None, 1, "x"), (None, "w w", None, "a", None, 1, "x"), (5, "w w", None, "a", None, 1, "x"), (5, "w w", None, "a", None, 1, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mixed(df).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    per = {}
    for r in rows:
        per[r[3]] = per.get(r[3], 0) + size(r[1])
    order = sorted((s for s in per if s is not None), key=lambda s: s.encode()) + [None]
    want = dict(zip(order, water([per[s] for s in order], 1.5 * sum(per.values()))))
    taken = {}
    assert len(got) == len(rows)
    for r in got:
        s = r.doc.source
        assert r.mix_size == size(r.doc.text) and r.mix_source_size == per[s] and abs(r.mix_target - want[s]) < 1e-6 and 0 <= r.mix_copies <= 2
        taken[s] = taken.get(s, 0) + r.mix_size * r.mix_copies
    for s in order:  # within four standard deviations of the Bernoulli draws
        part = want[s] / per[s] % 1 if per[s] else 0
        sizes = [size(r[1]) for r in rows if r[3] == s]
        assert abs(taken[s] - want[s]) <= 4 * (part * (1 - part) * sum(n * n for n in sizes)) ** 0.5 + 1e-6
    again = mixing.mixed(df.repartition(9)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    out = mixing.emit(df)
    assert out.columns == [*df.columns, "mix_copy"] and out.count() == sum(r.mix_copies for r in got)
    assert {r.mix_copies for r in out.collect()} == {"x"}
    assert mixing.mixed(df.where("false")).count() == 0


def test_mix_of_clashing_names_null_ids_and_a_long_text(spark):
    rows = [(None, f"w{k} " * 20, "a", "s", 1, "t", "m") for k in range(400)] + [(None, "w w", "b", "s", 1, "t", "m")] * 3 + [(7, "long " * 200_000, "c", "s", 1, "t", "m")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_source string, mix_size int, mix_target string, MIX_COPY string")
    out = mixing.emit(df)
    assert out.columns == [*df.columns, "mix_copy_"]
    assert {tuple(r)[3:7] for r in out.collect()} == {("s", 1, "t", "m")}
    mix = mixing.mixed(df).where("doc.source = 'a'").agg({"mix_target": "max", "mix_source_size": "max"}).first()
    taken = sum(r.mix_size * r.mix_copies for r in mixing.mixed(df).where("doc.source = 'a'").collect())
    assert abs(taken - mix[0]) <= 4 * (0.25 * 400 * 20**2) ** 0.5


def test_stages_take_effect(spark, docs):
    clean = ["The house of the man is at the end of the road and it is old.", "A day in the life of a cat that is not at home with us now."]
    body = [f"{a} and the number of it is {k} of the {k * 7} that we have in the town of {k}" for k in range(30) for a in clean]
    near = " ".join(f"the n{k} of" for k in range(40))
    leak = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    rows = [(100 + k, t) for k, t in enumerate(body)] + [(500, body[3].upper().lower()), (501, near), (502, near + " end"), (503, "So the text is this: " + leak)]
    rows += [(600 + k, "NOW!! BUY!! THIS!! " * 12) for k in range(9)] + ODD
    out = docs(*rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, out = out, stage(spark, out, SF)
        assert out.columns == before.columns
        kept = {r.doc_id for r in out.collect()}
        lost = {r.doc_id for r in before.collect()} - kept
        assert lost >= {"quality": set(range(600, 609)), "exact": {500}, "near": {502}, "benchmark": {503}}[name]
    assert set(range(100, 160)) <= kept and 501 in kept


def test_pipeline_equals_its_stages(spark):
    by_hand = spark.read.parquet(f"{SF}/documents.parquet")
    by_hand = quality.filter_quality(by_hand)
    by_hand = near_join.drop_near_duplicates(exact_dedup.drop_duplicates(by_hand))
    by_hand = mixing.emit(decontaminate.drop_contaminated(by_hand, spark.read.parquet(f"{SF}/benchmark.parquet")))
    got = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, r.mix_copy) for r in got.collect()) == sorted((r.doc_id, r.mix_copy) for r in by_hand.collect())
    assert got.groupBy("doc_id").agg(F.countDistinct(F.lower("text")).alias("n")).where("n > 1").count() == 0


def test_empty_documents(spark, docs):
    out = docs()
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, SF)
    assert out.count() == 0
