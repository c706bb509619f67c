"""Substring joins through an index of short runs, and cuts of one hierarchy."""

import random

import numpy as np
from pyspark.sql import functions as F

from cadencia.operators import catalog as K
from cadencia.operators import cluster as C


def test_containing_against_all_pairs(spark):
    r = random.Random(1)

    def word(n):
        return "".join(r.choice("abAé") for _ in range(n))

    texts = [(r.randint(0, 2), i, word(r.randint(0, 9)) if i % 9 else None) for i in range(120)]
    needles = [(r.randint(0, 2), i, word(r.randint(0, 4)) if i % 8 else None) for i in range(120)]
    got = K.containing(spark.createDataFrame(needles, "k int, n int, s string"), spark.createDataFrame(texts, "k int, t int, x string"), ["k"], "s", "x")
    want = sorted((a, b) for k, a, s in needles for k2, b, x in texts if k == k2 and s is not None and x is not None and s in x)
    assert sorted((x.n, x.t) for x in got.select("n", "t").collect()) == want


def test_one_folder_of_many_trials_and_sets(spark):
    """100,000 trials and 1,000 sets of one folder: far fewer pairs are verified than the 100 million there are."""
    sets = spark.range(1000).select(F.lit("f").alias("folder"), F.format_string("subject_%04d", "id").alias("base"))
    trials = spark.range(100_000).select(F.col("id").alias("trial_id"), F.lit("f").alias("folder"), F.array(F.format_string("SUBJECT_%04d", F.col("id") % 2000)).alias("subjects"))
    got = K.resolve_subject_params(trials, sets)
    assert got.groupBy("status").count().orderBy("status").collect() == [("ambiguous", 50_000), ("ok", 50_000)]
    one = got.where("trial_id = 1234 OR trial_id = 234").select("base").collect()
    assert {x.base for x in one} == {None, "subject_0234"}


def test_cuts_nest(spark):
    rng = np.random.default_rng(2)
    mid = rng.normal(size=(6, 8)) * 10
    rows = [(i, [float(x) for x in mid[i % 6] + rng.normal(size=8) * 0.1]) for i in range(120)]
    w = spark.createDataFrame(rows, "sample_id long, wave array<double>")
    got = C.bisecting(w, [2, 3, 4, 5, 6]).toPandas()
    by = {k: g.set_index("sample_id")["label"] for k, g in got.groupby("k")}
    assert all(len(by[k]) == 120 and by[k].nunique() == k for k in by)
    for k in (2, 3, 4, 5):
        # every cluster of the finer cut lies in one of the coarser
        assert (by[k].groupby(by[k + 1].reindex(by[k].index)).nunique() == 1).all()
    truth = {i: i % 6 for i in range(120)}
    assert by[6].groupby(truth).nunique().max() == 1


def test_equal_waves_are_not_split(spark):
    w = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(6)], "sample_id long, wave array<double>")
    got = C.bisecting(w, [2, 3]).select("sample_id", "k", "label").collect()
    assert len(got) == 12 and {r.label for r in got} == {0}
