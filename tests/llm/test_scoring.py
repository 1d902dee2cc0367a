import random

import numpy as np
import pytest
from odd_rows import ODD
from pyspark.sql import functions as F

from tidemark.llm import queries, quality, toxicity

SF = "/root/testdata/sf0.01"


def test_segments_against_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        s = np.array([rng.choice([-3, -2, -1, 1, 2, 4]) for _ in range(rng.randrange(25))], dtype=float)

        def best(lo, hi):  # Ruzzo and Tompa: the best segment, then those left and right of it
            top = max(((s[a:b].sum(), -a, -b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=(0, 0, 0))
            if top[0] <= 0:
                return []
            cands = [(a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1) if s[a:b].sum() == top[0]]
            a, b = min(cands, key=lambda c: (c[1] - c[0], c[0]))  # no part of it scores as much
            return [*best(lo, a), (a, b, top[0]), *best(b, hi)]

        got = toxicity.segments(s)
        assert sorted(round(x, 6) for _, _, x in got) == sorted(round(x, 6) for _, _, x in best(0, len(s)))
        assert all(abs(s[a:b].sum() - x) < 1e-9 for a, b, x in got)


def test_toxicity_on_held_out_rows(spark):
    rows = queries.op1_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    bad, good = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    auc = np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good])
    assert auc > 0.8 and np.mean([s >= 0.7 for s in good]) < 0.02
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)


def test_toxicity_of_odd_rows(spark, docs):
    labels = spark.createDataFrame([(1, 0), (4, 1), (4, 0), (None, 1), (99, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs(*ODD, (8, "vile words"), (9, "fine words")), labels)
    got = toxicity.score_toxicity(docs(*ODD), model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score_toxicity(docs(), model).count() == 0
    empty = toxicity.fit(docs(*ODD), labels.where("false"))
    assert {r.score for r in toxicity.score_toxicity(docs(*ODD), empty).collect()} == {0.0}


def test_quality_against_labels(spark):
    scored = queries.op6_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    assert np.mean([r.kept == bool(r.quality) for r in scored]) > 0.97
    assert np.mean([r.kept for r in scored if r.quality]) > 0.99


def test_votes_tell_kinds_apart():
    good, table, shout = "++++++++", "+++++-++", "++---+++"
    share, by, post = quality.fit_votes({good: 9000, table: 1, shout: 500, "-+++++--": 400})
    assert post[good] > 0.99 and post[shout] < 0.01 and 0.08 < share < 0.12
    assert quality.fit_votes({})[2] == {}


@pytest.mark.parametrize("size", [20_000, 1_000_000, 30_000_000])
@pytest.mark.parametrize("share", [0.001, 0.01, 0.02, 0.03])
def test_rare_kinds_of_one_labeller_are_bad_at_any_size(size, share):
    for k in range(len(quality.LABELLERS)):
        kind = "+" * k + "-" + "+" * (len(quality.LABELLERS) - k - 1)
        n = int(size * share)
        post = quality.fit_votes({"++++++++": size * 9 // 10 - n, "+++0++++": size // 10, kind: n})[2]
        assert post[kind] < 0.1 and post["++++++++"] > 0.99 and post["+++0++++"] > 0.9


def test_quality_of_odd_rows(docs):
    df = docs(*ODD, *((k, "The house of the man is at the end of the road.") for k in range(10, 60)), *((k, "BUY!! NOW!! IT!! IS!! CHEAP!! " * 9) for k in range(60, 80)))
    got = quality.score_quality(df).collect()
    assert len(got) == df.count() and all(0 <= r.score <= 1 for r in got)
    kept = quality.filter_quality(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} >= set(range(10, 60)) and not kept.where(F.col("doc_id") >= 60).count()
    assert quality.score_quality(docs()).count() == 0


@pytest.mark.parametrize("text,vote", [("A b c d e f " * 5, 1), ("Tok### tok&&& tok%%% tok$$$ " * 9, -1)])
def test_symbol_labeller(text, vote):
    m, fold = quality.measures(text)
    assert quality.votes(m, len(fold))[0] == vote
