"""Edge rules of labels and the catalogue."""

import pytest
from pyspark.sql import functions as F

from cadencia.functions import text as X
from cadencia.operators import catalog as K
from cadencia.operators import labels as L


def one(spark, value, col):
    return spark.createDataFrame([(value,)], "s string").select(col).first()[0]


@pytest.mark.parametrize(
    "raw, want",
    [("Force.Fx1", "Force_Fx1"), ("EMG.EMG_01_R M.soleus", "EMG_01_R_M_soleus"), ("  a  A. b ", "a_b")],
)
def test_normalise(spark, raw, want):
    assert one(spark, raw, X.normalise_label("s")) == want


@pytest.mark.parametrize("raw, want", [("EMG.EMG_05_R M.soleus", "emg#5"), ("Force.Fx1", "forcefx1"), ("EMG x", "emgx")])
def test_alias(spark, raw, want):
    assert one(spark, raw, X.alias_key("s")) == want


def test_channel_info(spark):
    assert one(spark, "EMG.EMG_18_R M.x", X.channel_info("s")) is None
    assert one(spark, "EMG.NFU 3", X.channel_info("s")).is_nfu
    i = one(spark, "EMG.EMG_04_R M.gastroc.med.", X.channel_info("s"))
    assert (i.number, i.side, i.muscle_key) == (4, "R", "mgastrocmed")
    assert one(spark, "mgastrocmed", X.canonical_muscle("s")) == "gastro_med"


@pytest.mark.parametrize(
    "names, want",
    [
        (["A B", "A B"], ["A_B", "A_B_1"]),
        (["A", "A", "A_1"], ["A", "A_1", "A_1_1"]),
        (["A_1", "A", "A"], ["A_1", "A", "A_2"]),
        (["alphabet_bravissimo_charlatan_delta"], ["alp_bra_cha_del"]),
    ],
)
def test_unique(spark, names, want):
    df = spark.createDataFrame([("t", i, n) for i, n in enumerate(names)], "trial string, ord int, raw string")
    got = L.unique_labels(df, "trial", "raw", "ord").orderBy("ord").collect()
    assert [r.channel for r in got] == want


@pytest.mark.parametrize("mapping, want", [({"a": "b"}, ["b", "a", "c"]), ({"a": "z"}, ["z", "b", "c"])])
def test_swaps(spark, mapping, want):
    la = spark.createDataFrame([("s", i, x) for i, x in enumerate("abc")], "sid string, pos int, label string")
    mp = spark.createDataFrame([("s", a, b) for a, b in mapping.items()], "sid string, src string, dst string")
    assert [r.new_label for r in L.apply_swaps(la, mp, "sid").orderBy("pos").collect()] == want


def test_swap_pairs(spark):
    mp = spark.createDataFrame([("s", "b", "a"), ("s", "a", "b"), ("s", "c", "c")], "sid string, src string, dst string")
    assert [tuple(r) for r in L.normalise_swaps(mp).collect()] == [("s", "a", "b")]


def test_variants(spark):
    names = [f"Rd1_Rd1_2022-10-25_13-52-18_Dyn_WalkA03_fp0_splitCycles{v}.mat" for v in ("_osim", "_check", "")]
    df = spark.createDataFrame([(n, n) for n in names], "name string, path string")
    p = K.parse_trial_names(df, "name")
    prio, var = K.variant_priority("name")
    b = K.best_variant(p.withColumns({"priority": prio, "variant": var}), ["pid", "trial_base", "datetime", "trial_full"], "priority", "path")
    r = b.collect()
    assert len(r) == 1 and (r[0].variant, r[0].trial_base) == ("check", "WalkA")


def test_cores(spark):
    stem = "Rd0001_Rd0001_2022-10-25_13-52-18_Dyn_WalkA03_fp0_clean_splitCycles"
    core, base = K.trial_core(F.col("s"))
    r = spark.createDataFrame([(stem,)], "s string").select(core, base).first()
    assert r[0] == stem[: -len("_splitCycles")] and r[1].endswith("_WalkA03")


def test_natural_order(spark):
    df = spark.createDataFrame([("cycle10",), ("cycle2",), ("Cycle1",)], "c string")
    assert [r.c for r in L.natural_sorted(df, "c").collect()] == ["Cycle1", "cycle2", "cycle10"]


def test_sides(spark):
    for key, want in (("EMG_04_R_M_x", "EMG_*_M_x"), ("LKnee", "Knee"), ("hip_l_on", "hip_on"), ("knee_angle_r", "knee_angle"), ("time", "time")):
        assert one(spark, key, X.side_free_key("s")) == want
    assert one(spark, "med_l_on_l_in", X.key_for_side("s", F.lit(False))) == "med_r_on_r_in"


def test_inventory_ties_and_stars(spark):
    df = spark.createDataFrame([("a.b",), ("a b",), ("*1",), ("q",)], "l string")
    inv = {r.group_key: r for r in L.label_inventory(df, "l").collect()}
    assert inv["ab"].canonical == "a b" and inv["ab"].mutable and not inv["q"].mutable and "1" not in inv


def test_sample_is_stable(spark):
    ids = spark.range(1000)
    a = [r.id for r in K.sample_ids(ids, "id", 10, 1).collect()]
    assert a == [r.id for r in K.sample_ids(ids.repartition(7), "id", 10, 1).collect()] and len(set(a)) == 10
    assert K.sample_ids(spark.range(3), "id", 10, 1).count() == 3


def test_long_labels_keep_their_cut(spark):
    from cadencia.operators import labels as L

    long = " ".join(f"token{i}{c}" for i, c in enumerate("abcdefghijkl"))
    rows = [("t", long, 1), ("t", long, 2), ("t", "short", 3), ("t", "short", 4), ("t", "short_1", 5), ("t", "short", 6)]
    df = spark.createDataFrame(rows, "trial string, label string, pos int")
    got = [r["channel"] for r in L.unique_labels(df, "trial", "label", "pos").orderBy("pos").collect()]
    cut = "_".join(["tok"] * 12)
    assert got == [cut, cut[:29] + "_1", "short", "short_1", "short_1_1", "short_2"]
    strict = [r["field"] for r in L.safe_field_names(df, "trial", "label", "pos", limit=20).orderBy("pos").collect()]
    assert len(set(strict)) == 6 and all(len(x) <= 20 for x in strict)


def test_natural_key_of_long_numbers(spark):
    from cadencia.functions.text import natural_key

    names = ["a5", "a1" + "0" * 24, "a007", "b", "a10b2", "a10b10"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r["n"] for r in df.orderBy(natural_key("n")).collect()]
    assert got == ["a5", "a007", "a10b2", "a10b10", "a1" + "0" * 24, "b"]


def test_many_trials_share_a_task(spark):
    """Trials that need the step-by-step rule aren't a Python group each."""
    df = spark.range(3000).select(F.floor(F.col("id") / 2).alias("trial"), F.concat(F.lit("7"), F.repeat(F.lit("long name "), 9)).alias("label"), F.col("id").alias("pos"))
    named = L.safe_field_names(df, "trial", "label", "pos")
    plan = named._jdf.queryExecution().toString()
    assert "FlatMapGroupsInPandas" not in plan
    got = {(r.trial, r.pos % 2): r.field for r in named.collect()}
    assert len(got) == 3000 and len({v for (_, k), v in got.items() if k == 0}) == 1
    assert got[7, 0].endswith("_1") and got[7, 1].endswith("_2") and len(got[7, 1]) == 63
