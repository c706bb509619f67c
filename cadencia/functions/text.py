"""Label and name expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalise_label(label: str | Column) -> Column:
    """Tokens between runs of space, dot and underscore, joined by ``_``; a token
    equal to the one before it, whatever the case, is left out."""
    toks = F.filter(F.split(F.trim(_c(label)), r"[ \._]+"), lambda t: t != "")
    keep = F.filter(
        toks, lambda t, i: (i == 0) | (F.lower(t) != F.lower(F.get(toks, i - F.lit(1))))
    )
    return F.array_join(keep, "_")


def short_label(label: str | Column, limit: int = 31) -> Column:
    """Normalised label; past the limit each token is cut to three characters."""
    n = normalise_label(label)
    cut = F.array_join(F.transform(F.split(n, "_+"), lambda t: F.substring(t, 1, 3)), "_")
    return F.when(F.length(n) > limit, cut).otherwise(n)


# fixed values: phrases shortened in very long column names
LONG_PHRASES = (
    ("sagittal_articulation_frame", "sagFrame"),
    ("Lerner_knee", "LernerKnee"),
    ("femoral_cond", "femcond"),
    ("tibial_plat", "tibplat"),
    ("med_cond", "medcond"),
    ("lat_cond", "latcond"),
)


def safe_name(name: str | Column, limit: int = 63) -> Column:
    """Field name of letters, digits and ``_`` that starts with a letter. Past the
    limit known phrases are shortened, then a digest replaces the tail."""
    n = _c(name)
    s = n
    for old, new in LONG_PHRASES:
        s = F.replace(s, F.lit(old), F.lit(new))
    digest = F.concat(F.substring(s, 1, limit - 7), F.lit("_"), F.substring(F.md5(n), 1, 6))
    s = F.when(F.length(n) <= limit, n).when(F.length(s) <= limit, s).otherwise(digest)
    s = F.when(s.rlike("^[A-Za-z]"), s).otherwise(F.concat(F.lit("f_"), s))
    return F.regexp_replace(s, "[^A-Za-z0-9_]", "_")


def strip_subject(label: str | Column, subjects: Column) -> Column:
    """``Subject:Marker`` to ``Marker`` when the prefix holds a subject name."""
    lab = F.trim(_c(label))
    prefix = F.lower(F.trim(F.substring_index(lab, ":", 1)))
    rest = F.trim(F.substring(lab, F.instr(lab, ":") + 1, F.length(lab)))
    named = F.exists(subjects, lambda s: F.contains(prefix, F.lower(s)))
    return F.when(lab.contains(":") & named, rest).otherwise(lab)


def alias_key(label: str | Column) -> Column:
    """``emg#N`` for a numbered muscle channel, else lower-case alphanumerics."""
    s = F.lower(_c(label))
    num = F.coalesce(
        F.regexp_extract(s, r"emg[\.\s_\-]*([0-9]{1,2})", 1).try_cast("int"), F.lit(0)
    )
    plain = F.lower(F.regexp_replace(_c(label), "[^0-9a-zA-Z]", ""))
    return F.when(s.contains("emg") & num.between(1, 99), F.concat(F.lit("emg#"), num.cast("string"))).otherwise(plain)


# fixed values: channel numbers of the right and the left side
RIGHT_NUMBERS = (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13)
LEFT_NUMBERS = (17, 18, 19, 20, 21, 22, 23, 24, 25, 26, 27, 31, 32)

# fixed values: spellings of each muscle, in order of precedence
MUSCLE_ALIASES = (
    ("tibialis_ant", ("tibialisanterior", "tibant", "tibialisant")),
    ("peroneus_long", ("peroneuslong", "peroneuslongus", "perlong")),
    ("gastro_lat", ("gastroclat", "gastrolat", "gastroclateral", "gastro. lat", "gastro.lat")),
    ("gastro_med", ("gastrocmed", "gastromed", "gastrocmedial", "gastro. med", "gastro.med")),
    ("soleus", ("soleus",)),
    ("vastus_lat", ("vastuslat", "vastuslateral")),
    ("vastus_med", ("vastusmed", "vastusmedial")),
    ("rectus_fem", ("rectusfem", "rectusfemoris")),
    ("semitendinosus", ("semitendinosus", "semitend")),
    ("biceps_femoris", ("bicepsfemoris", "bicepsfem")),
    ("gluteus_medius", ("gluteusmedius", "glutmed")),
    ("gluteus_maximus", ("gluteusmaximus", "glutmax")),
    ("erector_spinae", ("erectorspine", "erectorspinae", "erectorsp")),
)

# fixed values: muscles that lie next to each other
CLOSE_MUSCLES = (
    ("tibialis_ant", "peroneus_long", "gastro_lat", "gastro_med", "soleus"),
    ("vastus_lat", "vastus_med", "rectus_fem"),
    ("semitendinosus", "biceps_femoris"),
    ("gluteus_medius", "gluteus_maximus"),
)


def channel_info(label: str | Column) -> Column:
    """Number, side, muscle and muscle key of a muscle channel as a struct, or
    NULL for other channels and for numbers that do not belong to the side."""
    s = F.trim(_c(label))
    num = F.regexp_extract(s, r"(?i)emg[_\.\s-]*([0-9]{1,2})", 1).try_cast("int")
    side = F.upper(F.regexp_extract(s, r"(?i)emg[_\.\s-]*[0-9]{1,2}[_\.\s-]*([LR])\b", 1))
    side = F.when(side != "", side)
    muscle = F.trim(F.regexp_extract(s, r"(?i)emg[_\.\s-]*[0-9]{1,2}[_\.\s-]*[LR]\s*(.*)$", 1))
    key = F.regexp_replace(F.lower(muscle), "[^a-z0-9]", "")
    nfu = F.lower(s).contains("nfu")
    wrong = (F.coalesce(side == "R", F.lit(False)) & ~num.isin(*RIGHT_NUMBERS)) | (
        F.coalesce(side == "L", F.lit(False)) & ~num.isin(*LEFT_NUMBERS)
    )
    none = F.lit(None)
    info = F.struct(
        F.when(nfu, none).otherwise(num).alias("number"),
        F.when(nfu, none).otherwise(side).alias("side"),
        F.when(nfu, none).otherwise(muscle).alias("muscle"),
        F.when(nfu, none).otherwise(key).alias("muscle_key"),
        nfu.alias("is_nfu"),
    )
    usable = F.lower(s).contains("emg") & (nfu | (num.isNotNull() & ~wrong))
    return F.when(usable, info)


def canonical_muscle(key: str | Column) -> Column:
    """Name of the first muscle one of whose spellings occurs in the key."""
    k = F.regexp_replace(F.lower(F.coalesce(_c(key), F.lit(""))), "^m", "")
    out = None
    for name, spellings in MUSCLE_ALIASES:
        hit = F.lit(False)
        for p in spellings:
            hit = hit | k.contains(p)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(F.when(k == "", "unknown").otherwise(k))


def close_group(canon: str | Column) -> Column:
    """Number of the neighbour group of a muscle, NULL for muscles without one."""
    out = F.lit(None).cast("int")
    for i, group in enumerate(CLOSE_MUSCLES):
        out = F.when(_c(canon).isin(*group), i).otherwise(out)
    return out


def side_free_key(key: str | Column) -> Column:
    """Key without its side, by the first of five spellings that fits."""
    k = _c(key)
    return (
        F.when(k.rlike(r"^EMG_\d+_[LR]_.+$"), F.regexp_replace(k, r"^EMG_\d+_[LR]_", "EMG_*_"))
        .when(k.contains("*"), k)
        .when(k.rlike("_(?:L|R)_"), F.regexp_replace(k, "_(?:L|R)_", "_"))
        .when(k.rlike("^[LR][A-Z]"), F.regexp_replace(k, "^[LR]([A-Z])", "$1"))
        .when(k.rlike("_[lLrR]_"), F.regexp_replace(k, "_[lLrR]_", "_"))
        .when(k.rlike("_[lrLR]$"), F.regexp_replace(k, "_[lrLR]$", ""))
        .otherwise(k)
    )


def key_for_side(key: str | Column, left: Column) -> Column:
    """The key a side-bound key has on the given side."""
    k = _c(key)
    up, low = F.when(left, "L").otherwise("R"), F.when(left, "l").otherwise("r")
    upper = F.regexp_replace(k, F.lit("_(?:L|R)_"), F.concat(F.lit("_"), up, F.lit("_")))
    lower = F.regexp_replace(k, F.lit("_[lr]_"), F.concat(F.lit("_"), low, F.lit("_")))
    return (
        F.when(k.rlike("_(?:L|R)_"), upper)
        .when(k.rlike("^[LR][A-Z]"), F.regexp_replace(k, F.lit("^[LR](?=[A-Z])"), up))
        .when(k.rlike("_[lr]_"), lower)
        .when(k.rlike("(?i)_(?:l|r)$"), F.regexp_replace(k, F.lit("(?i)_(?:l|r)$"), F.concat(F.lit("_"), low)))
        .otherwise(k)
    )


def natural_key(s: str | Column) -> Column:
    """Sort key with runs of digits, of any length, compared as numbers: a run
    becomes the count of its digits without leading zeros, and these digits."""
    runs = F.regexp_extract_all(F.lower(_c(s)), F.lit(r"\d+|\D+"), F.lit(0))

    def ordered(run: Column) -> Column:
        number = F.regexp_replace(run, r"^0+(?=\d)", "")
        return F.when(run.rlike(r"^\d"), F.concat(F.lpad(F.length(number).cast("string"), 10, "0"), number)).otherwise(run)

    return F.array_join(F.transform(runs, ordered), "")


def slug(s: str | Column) -> Column:
    """File-name-safe text: other characters become ``_``, none at the ends."""
    return F.trim(F.regexp_replace(_c(s), "[^a-zA-Z0-9._-]+", "_"), F.lit("_"))
