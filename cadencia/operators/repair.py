"""Finding mislabelled channels and deciding on their repair.

Traces are (sid, label, wave), one per subject and channel label. Label facts
are (label, side, muscle_key, canon, close_group). The number of labels is that
of a recording system, so joining a trace to its candidate labels multiplies it
by a small, fixed number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as N
from ..functions.text import canonical_muscle, channel_info, close_group
from ..session import cut_lineage
from .ordered import exact_quantiles
from .rows import struct_kernel
from .waves import aggregate_waves, central_interval, circular_best, leave_one_out, quantile_threshold

# fixed values: gains a swap must reach, lag window of a left/right swap, share of
# the gains that makes a near miss worth a review
CORR_GAIN = 0.10
MAD_GAIN = 0.20
LR_LAGS = (55, 65)
CLOSE_SHARE = 0.8


def label_facts(labels: DataFrame, label: str = "label") -> DataFrame:
    """Side, muscle key, canonical muscle and neighbour group of muscle labels."""
    d = labels.select(label).distinct().withColumn("_i", channel_info(label)).where("_i is not null and not _i.is_nfu")
    d = d.select(
        label, F.col("_i.side").alias("side"), F.col("_i.muscle_key").alias("muscle_key"), canonical_muscle("_i.muscle_key").alias("canon")
    )
    return d.withColumn("close_group", close_group("canon"))


def compare_to_global(traces: DataFrame, globals_: DataFrame, *, max_lag: int) -> DataFrame:
    """Each trace against the global trace of its label, circularly within the lag
    limit: base_corr, base_lag, base_mad."""
    g = globals_.select("label", F.col("wave").alias("_g"))
    j = traces.join(g, "label").withColumn("_c", circular_best("wave", "_g", range(-max_lag, max_lag + 1)))
    return j.select(
        *traces.columns, F.col("_c.corr").alias("base_corr"), F.col("_c.lag").alias("base_lag"), F.col("_c.mad").alias("base_mad")
    )


def _limit(rows: DataFrame, value: str, *, upper: bool = False) -> float | None:
    got = quantile_threshold(rows, value, upper=upper).first()
    return None if got is None else got[0]


def validate_channels(stats: DataFrame, *, within_lag_max: int, two_pass: bool = True) -> DataFrame:
    """Status of every channel.

    ``stats`` is (sid, label, snr, corr, lag) against the global trace over all
    lags, (corr_med, lag_abs_med_lim, homogeneity_flag, within_corr_low) from
    within the subject, and (base_corr, base_lag, base_mad) within the lag limit.
    Each empirical limit is a barrier: one number that is read before the next
    step can be planned.
    """
    s = stats.withColumn("_alag", F.abs("lag"))
    snr_low = _limit(s, "snr")
    good = s if snr_low is None else s.where(F.col("snr").isNull() | (F.col("snr") >= snr_low))
    c, a = _limit(good, "corr"), _limit(good, "_alag", upper=True)
    if two_pass and c is not None and a is not None:
        kept = good.where((F.col("corr") >= c) & (F.col("_alag") <= a))
        c2, a2 = _limit(kept, "corr"), _limit(kept, "_alag", upper=True)
        c, a = (c, a) if c2 is None else (c2, a2)
    known = c is not None and a is not None
    low_snr = F.lit(False) if snr_low is None else F.col("snr") < snr_low
    first = (
        F.when(low_snr, "low_snr")
        .when(F.lit(not known), "unknown")
        .when((F.col("corr") < F.lit(c)) | (F.col("_alag") > F.lit(a)), "flagged")
        .otherwise("validated")
    )
    reasons = F.array_compact(
        F.array(
            F.when(F.col("lag_abs_med_lim") > within_lag_max, "within_lag"),
            F.when(F.col("homogeneity_flag"), "homogeneity"),
            F.when(F.col("corr_med") < F.col("within_corr_low"), "within_corr"),
        )
    )
    s = s.withColumn("_first", first).withColumn("reasons", F.array_join(reasons, ","))
    second = (
        F.when(F.col("_first").isin("low_snr", "unknown"), F.col("_first"))
        .when(F.col("corr_med").isNull(), "flagged_within_missing")
        .when(F.col("reasons") != "", "flagged_within")
        .otherwise(F.col("_first"))
    )
    s = cut_lineage(s.withColumn("_second", second))
    ok = s.where("_second = 'validated'").select("label", "base_corr", "base_lag", "base_mad")
    ci = None
    for c in ("corr", "lag", "mad"):
        one = central_interval(ok, ["label"], f"base_{c}").select(
            "label", F.col("low").alias(f"_{c}_lo"), F.col("high").alias(f"_{c}_hi")
        )
        ci = one if ci is None else ci.join(one, "label")
    s = s.join(ci.withColumn("_has", F.lit(True)), "label", "left")
    inside = F.lit(True)
    for c in ("corr", "lag", "mad"):
        inside = inside & F.coalesce(F.col(f"base_{c}").between(F.col(f"_{c}_lo"), F.col(f"_{c}_hi")), F.lit(False))
    final = F.when(
        ~F.col("_second").isin("low_snr", "unknown") & F.coalesce("_has", F.lit(False)) & ~inside, "flagged_ci"
    ).otherwise(F.col("_second"))
    return s.select("sid", "label", final.alias("status"), "reasons")


def candidates(facts: DataFrame) -> DataFrame:
    """(label, stage, candidate) of every label: the other side's channel of the
    same muscle, same-side neighbours, other same-side muscles."""
    c = facts.select(
        F.col("label").alias("candidate"),
        F.col("side").alias("_s"),
        F.col("muscle_key").alias("_m"),
        F.col("close_group").alias("_g"),
    )
    other = facts.where("side is not null and muscle_key <> ''").withColumn("_s", F.when(F.col("side") == "R", "L").otherwise("R"))
    lr = other.join(c, "_s").where(F.col("muscle_key") == F.col("_m"))
    lr = lr.groupBy("label").agg(F.min("candidate").alias("candidate")).withColumn("stage", F.lit("lr"))
    same = facts.join(c, F.col("side") == F.col("_s")).where("label <> candidate")
    close = same.where("close_group = _g").select("label", "candidate", F.lit("close").alias("stage"))
    general = same.where("coalesce(muscle_key, '') = '' or muscle_key <> coalesce(_m, '')").select("label", "candidate", F.lit("general").alias("stage"))
    return lr.select("label", "candidate", "stage").unionByName(close).unionByName(general)


def score_candidates(
    flagged: DataFrame,
    globals_: DataFrame,
    cand: DataFrame,
    *,
    max_lag: int,
    lr_lags: tuple[int, int] = LR_LAGS,
    both_signs: bool = True,
    present: DataFrame | None = None,
) -> DataFrame:
    """Every flagged trace against each candidate's global trace.

    ``flagged`` carries base_corr and base_mad. A left/right candidate is first
    shifted by its best lag of the swap window, then compared like the others.
    Adds corr, mad, lag, corr_up, mad_down and score.
    """
    j = flagged.join(cand, "label")
    if present is not None:
        have = present.select("sid", F.col("label").alias("candidate")).distinct()
        j = j.where("stage = 'lr'").unionByName(j.where("stage <> 'lr'").join(have, ["sid", "candidate"], "left_semi").select(*j.columns))
    j = j.join(globals_.select(F.col("label").alias("candidate"), F.col("wave").alias("_g")), "candidate")
    lo, hi = lr_lags
    window = list(range(lo, hi + 1))
    if both_signs:
        window = list(range(-hi, -lo + 1)) + window
    limited = range(-max_lag, max_lag + 1)
    plain = j.where("stage <> 'lr'").withColumn("_c", circular_best("wave", "_g", limited)).select(
        *flagged.columns, "candidate", "stage", "_c.corr", "_c.lag", "_c.mad"
    )
    lr = j.where("stage = 'lr'").withColumn("_c", shifted_best("wave", "_g", window, limited)).select(
        *flagged.columns, "candidate", "stage", "_c.corr", "_c.lag", "_c.mad"
    )
    out = plain.unionByName(lr)
    down = (F.col("base_mad") - F.col("mad")) / F.greatest(F.col("base_mad"), F.lit(1e-8))
    return out.withColumns({"corr_up": F.col("corr") - F.col("base_corr"), "mad_down": down}).withColumn(
        "score", F.col("corr_up") + F.col("mad_down")
    )


def shifted_best(a: str, b: str, window: Sequence[int], limited: Sequence[int]) -> Column:
    """struct(corr, lag, mad): roll by the best lag of the window (``lag``), then
    the best limited correlation of the rolled wave and its difference there."""
    window, limited = list(window), list(limited)

    def run(x, y):
        _, shift = N.circular_best_rows(x, y, window)
        rolled = N.roll_rows(x, shift)
        c, k = N.circular_best_rows(rolled, y, limited)
        return c, shift, N.mad_rows(N.roll_rows(rolled, k), y)

    return struct_kernel(run, "corr double, lag double, mad double", a, b)


def suggest_remap(
    scored: DataFrame, flagged: DataFrame, *, corr_gain: float | Column = CORR_GAIN, mad_gain: float | Column = MAD_GAIN, gate: Column | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """One decision per flagged channel.

    Stages are tried in the order lr, close, general; each offers its best
    candidate, and the first that reaches both gains (and the optional ``gate``)
    is suggested. A target serves one channel only: of several suggestions the
    first by (sid, label) stays. Without a suggestion the candidate of smallest
    difference is kept as unsure. ``flagged`` may carry ``low_snr``.
    """
    key = [*by, "sid", "label"]
    rank = F.when(F.col("stage") == "lr", 0).when(F.col("stage") == "close", 1).otherwise(2)
    cols = ["stage", "candidate", "corr", "lag", "mad", "corr_up", "mad_down", "score", "_rank"]
    s = scored.withColumn("_rank", rank)
    best = s.groupBy(*key, "_rank").agg(
        F.min_by(F.struct(*cols), F.struct((-F.col("score")).alias("s"), "candidate")).alias("_b")
    )
    cg = corr_gain if isinstance(corr_gain, Column) else F.lit(float(corr_gain))
    mg = mad_gain if isinstance(mad_gain, Column) else F.lit(float(mad_gain))
    ok = (F.col("_b.corr_up") >= cg) & (F.col("_b.mad_down") >= mg)
    if gate is not None:
        ok = ok & gate
    pos = F.col("_b._rank")
    g = best.groupBy(*key).agg(
        F.min_by("_b", F.when(ok, pos)).alias("_s"),
        F.min_by("_b", F.struct(F.col("_b.mad"), pos.alias("r"))).alias("_m"),
    )
    low = F.coalesce(F.col("low_snr"), F.lit(False)) if "low_snr" in flagged.columns else F.lit(False)
    base_ok = F.coalesce(F.col("base_mad") > 0, F.lit(False))
    j = flagged.select(*key, low.alias("_low"), base_ok.alias("_base")).join(g, key, "left")
    j = j.withColumn("_go", F.col("_s").isNotNull() & ~F.col("_low") & F.col("_base"))
    first = (
        j.where("_go")
        .groupBy(*by, F.col("_s.candidate").alias("_t"))
        .agg(F.min(F.struct("sid", "label")).alias("_f"))
    )
    on = [*by, "_t"]
    j = j.withColumn("_t", F.when(F.col("_go"), F.col("_s.candidate"))).join(first, on, "left")
    won = F.col("_go") & (F.col("_f.sid") == F.col("sid")) & (F.col("_f.label") == F.col("label"))
    decision = (
        F.when(won, F.concat(F.lit("suggest_"), F.col("_s.stage")))
        .when(F.col("_go"), "unsure_target_used")
        .when(F.col("_low"), "unsure_low_snr")
        .otherwise("unsure_ci")
    )
    use = F.when(won, F.col("_s")).when(~F.col("_go"), F.col("_m"))
    j = j.withColumns({"decision": decision, "_u": use})
    return j.select(
        *key,
        "decision",
        F.col("_u.candidate").alias("target"),
        F.col("_u.stage").alias("stage"),
        F.col("_u.corr").alias("corr"),
        F.col("_u.lag").alias("lag"),
        F.col("_u.mad").alias("mad"),
        F.col("_u.corr_up").alias("corr_up"),
        F.col("_u.mad_down").alias("mad_down"),
    )


def mapping_of(decisions: DataFrame) -> DataFrame:
    """(sid, src, dst) of the suggested swaps."""
    return decisions.where(F.col("decision").startswith("suggest_")).select(
        "sid", F.col("label").alias("src"), F.col("target").alias("dst")
    )


def review_queue(decisions: DataFrame, *, corr_gain: float = CORR_GAIN, mad_gain: float = MAD_GAIN, share: float = CLOSE_SHARE) -> DataFrame:
    """Suggested swaps and the near misses that reach ``share`` of both gains."""
    near = (
        F.col("decision").startswith("unsure_")
        & F.col("target").isNotNull()
        & (F.col("corr_up") >= corr_gain * share)
        & (F.col("mad_down") >= mad_gain * share)
    )
    return decisions.where(F.col("decision").startswith("suggest_") | F.coalesce(near, F.lit(False))).select(
        "sid", "label", F.col("target").alias("candidate"), F.col("decision").alias("reason")
    )


def review_sample(items: DataFrame, done: DataFrame, *, n: int, per_subject: int, seed: int) -> DataFrame:
    """A seeded random sample of items not yet reviewed, at most ``per_subject``
    of one subject and n in all."""
    todo = items.join(done.select("sid", "label"), ["sid", "label"], "left_anti")
    h = F.md5(F.concat_ws(":", F.col("sid").cast("string"), "label", F.lit(seed)))
    w = Window.partitionBy("sid").orderBy(h, "label")
    capped = todo.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per_subject).drop("_r")
    return capped.orderBy(h, "sid", "label").limit(n)


def apply_feedback(mapping: DataFrame, feedback: DataFrame) -> DataFrame:
    """Mapping after review: the last answer per channel counts; swap sets it, ok
    removes it, unsure leaves it. ``feedback`` is (sid, label, candidate,
    response, seq)."""
    last = feedback.groupBy("sid", F.col("label").alias("src")).agg(
        F.max_by(F.struct("response", "candidate"), "seq").alias("_f")
    )
    j = mapping.join(last, ["sid", "src"], "full_outer")
    r = F.coalesce(F.lower("_f.response"), F.lit("unsure"))
    dst = F.when(r == "swap", F.col("_f.candidate")).when(r == "ok", None).otherwise(F.col("dst"))
    return j.select("sid", "src", dst.alias("dst")).where(F.col("dst").isNotNull())


def flip_summary(decisions: DataFrame, *, top: int = 10) -> tuple[DataFrame, DataFrame]:
    """(p10, p50, p90 of the absolute lags of left/right swaps; per subject the
    number and share of such swaps, largest share first)."""
    lr = F.col("decision") == "suggest_lr"
    lags = exact_quantiles(decisions.where(lr).select(F.abs("lag").alias("_l")), [], "_l", {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    per = decisions.groupBy("sid").agg(F.count_if(lr).alias("n_lr"), F.count(F.lit(1)).alias("n"))
    per = per.withColumn("ratio", F.col("n_lr") / F.col("n"))
    return lags, per.orderBy(F.desc("ratio"), "sid").limit(top)


def leave_one_subject_out(
    traces: DataFrame, base: DataFrame, mapping: DataFrame | None = None, by: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """Global traces rebuilt without one subject: (by, sid, label, wave) for the
    labels the subject contributes to, and (by, label, wave) with all subjects,
    which holds for its other labels.

    The base trace of a label counts once, then every trace of the subjects under
    the label it is mapped to.
    """
    by = list(by)
    t = traces
    if mapping is not None:
        m = mapping.select(*by, "sid", F.col("src").alias("label"), "dst")
        t = t.join(m, [*by, "sid", "label"], "left").withColumn("label", F.coalesce("dst", "label")).drop("dst")
    own = t.select(*by, "sid", "label", "wave")
    b = base.select("label", "wave")
    if by:
        # the base is repeated per grid point, of which there are as many as pairs of gains
        points = traces.select(F.struct(*by).alias("_p")).agg(F.collect_set("_p")).scalar()
        b = b.withColumn("_p", F.explode(points)).select("_p.*", *b.columns)
    pool = own.select(*by, "label", "wave").unionByName(b.select(*by, "label", "wave"))
    loo = leave_one_out(own, [*by, "label"], "sid", pool=pool)
    loo = loo.groupBy(*by, "sid", "label").agg(F.first("loo_wave").alias("wave"))
    return loo, aggregate_waves(pool, [*by, "label"], "pca")


def tune_thresholds(
    traces: DataFrame,
    base: DataFrame,
    facts: DataFrame,
    expected: DataFrame,
    feedback: DataFrame,
    corr_gains: Sequence[float],
    mad_gains: Sequence[float],
    *,
    max_lag: int,
    lr_lags: tuple[int, int] = LR_LAGS,
    iterations: int = 2,
    metric: str = "score",
    expected_weight: float = 1.0,
    feedback_weight: float = 1.0,
) -> DataFrame:
    """Score every pair of gains: remap all subjects against global traces that
    leave them out, as often as asked, then compare with the expected cases
    (sid, mode lr|ok) and with reviewers' answers.

    ``combined`` is what ``metric`` names: ``score``, the weighted sum of the
    subjects' expected shares and the feedback accuracy; ``f1_expected``, which
    takes flips as positives; ``f1_feedback``; or ``f1_combined``, their mean.

    Candidate scores do not depend on the gains, so the first round is worked out
    once and the grid is joined to its few rows per channel. Within a round all
    subjects are remapped together.
    """
    cand = candidates(facts)
    pairs = [(float(c), float(m)) for c in corr_gains for m in mad_gains]
    grid = F.explode(
        F.array(*[F.struct(F.lit(i).alias("grid_id"), F.lit(c).alias("corr_gain"), F.lit(m).alias("mad_gain")) for i, (c, m) in enumerate(pairs)])
    )
    mapping, by = None, []
    t = traces.select("sid", "label", "wave")
    for step in range(max(1, iterations)):
        loo, full = leave_one_subject_out(t, base, mapping, by)
        flagged, scored = _scored(t, loo, full, cand, by, max_lag, lr_lags)
        if step == 0:
            flagged = flagged.withColumn("_g", grid).select("*", "_g.*").drop("_g")
            scored = scored.withColumn("_g", grid).select("*", "_g.*").drop("_g")
        by = ["grid_id"]
        pred = _predict(scored, flagged)
        if step + 1 < iterations:
            t = flagged.select("grid_id", "corr_gain", "mad_gain", "sid", "label", "wave")
            mapping = pred.select("grid_id", "sid", F.col("label").alias("src"), F.col("pred").alias("dst"))
            by = ["grid_id", "corr_gain", "mad_gain"]
            mapping = mapping.join(t.select(*by, "sid", F.col("label").alias("src")), ["grid_id", "sid", "src"])
    known = facts.select(
        F.col("label"), F.col("side").alias("_side"), F.col("muscle_key").alias("_mk")
    )
    p = pred.join(known, "label", "left").join(
        facts.select(F.col("label").alias("pred"), F.col("side").alias("_ps"), F.col("muscle_key").alias("_pm")), "pred", "left"
    )
    p = p.join(expected, "sid", "left").withColumn("mode", F.coalesce("mode", F.lit("ok")))
    flipped = (F.col("stage") == "lr") & (F.col("_mk") == F.col("_pm")) & (F.col("_side") != F.col("_ps"))
    right = F.when(F.col("mode") == "lr", F.coalesce(flipped, F.lit(False))).otherwise(F.col("pred") == F.col("label"))
    grp = ["grid_id", "corr_gain", "mad_gain"]
    lr, found, moved = F.col("mode") == "lr", F.coalesce(flipped, F.lit(False)), F.col("pred") != F.col("label")
    acc = p.groupBy(*grp, "sid").agg(
        # a swap can't be expected of labels of which side and muscle are unknown
        F.coalesce(F.avg(F.when(lr & F.col("_mk").isNull(), None).when(right, 1.0).otherwise(0.0)), F.lit(0.0)).alias("_a"),
        F.count_if(lr & found).alias("_tp"),
        F.count_if(moved & ~(lr & found)).alias("_fp"),
        F.count_if(lr & ~found).alias("_fn"),
    )
    acc = acc.groupBy(*grp).agg(
        F.sum("_a").alias("expected_score"), F.count(F.lit(1)).alias("n_subjects"), *[F.sum(c).alias(c) for c in ("_tp", "_fp", "_fn")]
    )

    f0 = traces.join(feedback.select("sid", "label").distinct(), ["sid", "label"], "left_semi")
    fl, sc = _scored(f0.select("sid", "label", "wave"), None, base.select("label", "wave"), cand, [], max_lag, lr_lags)
    fb = _predict(
        sc.withColumn("_g", grid).select("*", "_g.*").drop("_g"), fl.withColumn("_g", grid).select("*", "_g.*").drop("_g")
    ).join(feedback, ["sid", "label"])
    swap, ok = F.lower("response") == "swap", F.lower("response") == "ok"
    hit, kept = (F.col("pred") == F.col("candidate")) & (F.col("pred") != F.col("label")), F.col("pred") == F.col("label")
    n = fb.groupBy(*grp).agg(
        F.count(F.lit(1)).alias("_tot"),
        F.count_if((swap & hit) | (ok & kept)).alias("_ok"),
        F.count_if(swap & hit).alias("tp"),
        F.count_if((swap & ~hit & ~kept) | (ok & ~kept)).alias("fp"),
        F.count_if(swap & ~hit).alias("fn"),
    )

    def f1(tp: str, fp: str, fn: str) -> Column:
        return F.coalesce(F.try_divide(2.0 * F.col(tp), 2.0 * F.col(tp) + F.col(fp) + F.col(fn)), F.lit(0.0))

    out = acc.join(n, grp, "left").select(
        *grp,
        "expected_score",
        "n_subjects",
        f1("_tp", "_fp", "_fn").alias("expected_f1"),
        F.coalesce(F.try_divide(F.col("_ok").cast("double"), F.col("_tot")), F.lit(0.0)).alias("feedback_accuracy"),
        f1("tp", "fp", "fn").alias("feedback_f1"),
    )
    choice = {
        "score": expected_weight * F.col("expected_score") + feedback_weight * F.col("feedback_accuracy"),
        "f1_expected": F.col("expected_f1"),
        "f1_feedback": F.col("feedback_f1"),
        "f1_combined": (F.col("expected_f1") + F.col("feedback_f1")) / 2,
    }
    return out.withColumn("combined", choice[metric])


def best_thresholds(scores: DataFrame) -> DataFrame:
    """The grid point of the largest combined score, the first on ties."""
    return scores.groupBy().agg(
        F.max_by(F.struct(*scores.columns), F.struct("combined", (-F.col("grid_id")).alias("g"))).alias("_b")
    ).select("_b.*")


def _scored(t: DataFrame, loo: DataFrame | None, full: DataFrame, cand: DataFrame, by: Sequence[str], max_lag: int, lr_lags: tuple[int, int]):
    """(traces with their own-label comparison, their scored candidates) against
    the global traces without the subject where there are such."""
    by = list(by)

    def against(rows: DataFrame, label: str) -> DataFrame:
        j = rows.join(full.select(*by, F.col("label").alias(label), F.col("wave").alias("_f")), [*by, label])
        if loo is None:
            return j.withColumnRenamed("_f", "_g")
        own = loo.select(*by, "sid", F.col("label").alias(label), F.col("wave").alias("_o"))
        return j.join(own, [*by, "sid", label], "left").withColumn("_g", F.coalesce("_o", "_f")).drop("_o", "_f")

    limited = range(-max_lag, max_lag + 1)
    fl = against(t, "label").withColumn("_c", circular_best("wave", "_g", limited))
    fl = fl.select(*t.columns, F.col("_c.corr").alias("base_corr"), F.col("_c.mad").alias("base_mad"))
    j = against(fl.join(cand, "label"), "candidate")
    lo, hi = lr_lags
    parts = []
    for stage, col in (("<> 'lr'", circular_best("wave", "_g", limited)), ("= 'lr'", shifted_best("wave", "_g", range(lo, hi + 1), [0]))):
        parts.append(j.where(f"stage {stage}").withColumn("_c", col).select(*fl.columns, "candidate", "stage", "_c.corr", "_c.lag", "_c.mad"))
    s = parts[0].unionByName(parts[1])
    down = (F.col("base_mad") - F.col("mad")) / F.greatest(F.col("base_mad"), F.lit(1e-8))
    s = s.withColumns({"corr_up": F.col("corr") - F.col("base_corr"), "mad_down": down})
    return fl, s.withColumn("score", F.col("corr_up") + F.col("mad_down"))


def _predict(scored: DataFrame, flagged: DataFrame) -> DataFrame:
    """Predicted label per channel and grid point; its own label when no stage
    reaches both gains. Targets may repeat here."""
    key = ["grid_id", "corr_gain", "mad_gain", "sid", "label"]
    rank = F.when(F.col("stage") == "lr", 0).when(F.col("stage") == "close", 1).otherwise(2)
    best = scored.withColumn("_rank", rank).groupBy(*key, "_rank").agg(
        F.min_by(
            F.struct("candidate", "stage", "corr_up", "mad_down"), F.struct((-F.col("score")).alias("s"), "candidate")
        ).alias("_b")
    )
    ok = (F.col("_b.corr_up") >= F.col("corr_gain")) & (F.col("_b.mad_down") >= F.col("mad_gain"))
    won = best.where(ok).groupBy(*key).agg(F.min_by("_b", "_rank").alias("_w"))
    return flagged.select(*key).join(won, key, "left").select(
        *key, F.coalesce("_w.candidate", "label").alias("pred"), F.coalesce("_w.stage", F.lit("ok")).alias("stage")
    )
