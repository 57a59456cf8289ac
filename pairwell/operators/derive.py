"""From cleaned tables to one row per subject.

Frames and columns used here (text flags are '0'/'1'):

master   subject_id, index_date, sex_code, sex, birth_year, ind_death, within_5, no_vaccine, first_dose_date, err
stays    subject_id, arrival, release_date, recorded_days, division, death_date, err
updates  subject_id, first_state, first_date, last_state, last_date
base     one row per subject, grown step by step by ``subject_table``
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from pairwell import config as C
from pairwell.config import SITUATION_LEVELS, StudyConfig
from pairwell.functions.scalars import arm_of, bin_left_closed, year_month, year_week
from pairwell.operators import quality as Q
from pairwell.operators.clean import level_name, level_order
from pairwell.operators.groups import (
    first_last_to_long,
    first_per_group,
    merge_intervals,
    newly_covered,
    total_days,
)
from pairwell.operators.joins import join_during, join_lookback, join_within_days
from pairwell.session import Tables
from pairwell.skew import HotKeys, attach, hot_keys

ID = "subject_id"


def tag_master(master: DataFrame, stays: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Apply the master rules in their order. ``hot`` are the hot subjects of ``master``, counted here if not given."""
    hot = hot or hot_keys(master, [ID])
    dated = stays.filter(F.col("death_date").isNotNull())
    marked = Q.mark_duplicate_key(Q.with_empty_tags(master), ID, "index_date", "_dup", hot)
    marked = Q.mark_known(marked, dated, ID, "_dated", hot)
    missing = {ID: C.TAG_NO_ID, "index_date": C.TAG_NO_INDEX, "sex_code": C.TAG_NO_SEX, "birth_year": C.TAG_NO_BIRTH}
    rules = [
        (F.col("_dup"), C.TAG_DUPLICATE),
        *[(F.col(c).isNull(), tag) for c, tag in missing.items()],
        ((F.col("ind_death") == "1") & F.col("_dated").isNull(), C.TAG_NO_DEATH_DATE),
    ]
    return Q.flags(marked, rules).drop("_dup", "_dated")


def tag_stays(
    stays: DataFrame, tagged_master: DataFrame, cfg: StudyConfig, hot: HotKeys | None = None
) -> DataFrame:
    """Apply the hospital-stay rules in their order. ``hot`` are the hot subjects of ``stays``."""
    hot = hot or hot_keys(stays, [ID])
    least = cfg.min_days_to_death
    marked = Q.mark_conflicting_value(Q.with_empty_tags(stays), ID, "death_date", "_diff", hot)
    index = Q.without_tags(tagged_master).select(ID, F.col("index_date").alias("_index"))
    # a subject with several untagged master rows repeats its stays, as a left join does
    marked = attach(marked, index, [ID], "left", hot=hot)
    rules = [
        (F.col("_diff"), C.TAG_DIFF_DEATH),
        (F.datediff("release_date", "arrival") < 0, C.TAG_RELEASE_ORDER),
        (F.datediff("death_date", "arrival") < least, C.TAG_DEATH_ARRIVAL),
        (F.datediff("death_date", "_index") < least, C.TAG_DEATH_INDEX),
    ]
    return Q.flags(marked, rules).drop("_diff", "_index")


def index_rows(master: DataFrame, clean_first: bool = False) -> DataFrame:
    """One row per subject: the earliest row is chosen, then dropped if it carries a tag.

    With ``clean_first`` the tagged rows go before the choice.
    """
    rows = Q.without_tags(master) if clean_first else master
    first = first_per_group(rows, [ID], [F.col("index_date").asc_nulls_last(), F.col(Q.ERR)])
    return Q.without_tags(first).drop(Q.ERR)


def outcome_dates(stays: DataFrame, base: DataFrame) -> DataFrame:
    """Death date of each subject flagged dead, from stays without a death-date tag."""
    dates = Q.without_tags(stays, [C.TAG_DIFF_DEATH, C.TAG_DEATH_INDEX]).select(ID, "death_date").dropna().distinct()
    return dates.join(base.filter("ind_death = '1'").select(ID), ID, "left_semi")


def qualifying_stays(
    stays: DataFrame, base: DataFrame, cfg: StudyConfig, hot: HotKeys | None = None
) -> DataFrame:
    """Distinct dedicated stays near the index date and not released before it."""
    rows = (
        stays.filter((F.col("division") == "dedicated") & F.col("arrival").isNotNull())
        .select(ID, "arrival", "release_date", Q.ERR)
        .distinct()
    )
    index = base.select(ID, "index_date")
    return join_within_days(
        rows, index, ID, "arrival", "release_date", "index_date", cfg.min_days_to_stay, cfg.max_days_to_stay, hot
    )


def prior_history(
    stays: DataFrame, base: DataFrame, cfg: StudyConfig, hot: HotKeys | None = None
) -> DataFrame:
    """Standard stays before the index date: days back, duration, and whether the stay was open on the index date.

    A stay without release date has neither duration nor flag. Rows are not made unique; see ``latest_prior`` and
    ``quality.expect_unique``.
    """
    rows = stays.filter(F.col("division") == "standard").select(ID, "arrival", "release_date", "recorded_days")
    found = join_lookback(
        rows, base.select(ID, "index_date"), ID, "arrival", "index_date", 1, cfg.max_days_prior_stay, hot
    )
    open_stay = F.col("release_date") >= F.col("index_date")
    days = F.datediff("index_date", "arrival")
    return found.select(
        ID,
        days.alias("prior_days"),
        F.when(open_stay, days.cast("double"))
        .when(~open_stay, F.col("recorded_days").cast("double"))
        .alias("prior_duration"),
        F.when(open_stay, F.lit("1")).when(~open_stay, F.lit("0")).alias("during_prior"),
    )


def latest_prior(prior: DataFrame) -> DataFrame:
    """The latest prior stay per subject, for sources in which prior stays repeat."""
    order = [F.col(c).asc_nulls_last() for c in ("prior_days", "prior_duration", "during_prior")]
    return first_per_group(prior, [ID], order)


def stay_indicator(qualifying: DataFrame) -> DataFrame:
    """'-1' if any qualifying stay carries a tag, else '1'; subjects without one are not listed."""
    worst = F.min(F.when(F.col(Q.ERR) != "", F.lit(-1)).otherwise(F.lit(1)))
    return qualifying.groupBy(ID).agg(worst.cast("string").alias("ind_hospitalized"))


def stay_duration(qualifying: DataFrame) -> DataFrame:
    """Days in hospital over merged, untagged, complete qualifying stays."""
    merged = merge_intervals(Q.without_tags(qualifying), ID, "arrival", "release_date")
    return total_days(merged, ID, "arrival", "release_date", "duration_hospitalization")


def first_arrival(qualifying: DataFrame) -> DataFrame:
    """First untagged qualifying arrival."""
    return Q.without_tags(qualifying).groupBy(ID).agg(F.min("arrival").alias("first_arrival"))


def states_during(updates: DataFrame, base: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Mildest, worst and first clinical state while in hospital, per subject, in one aggregate.

    The window runs from the first arrival for the merged number of days. Two updates on one day: the "first" entry
    goes before the "last" entry, then the milder state.
    """
    long = first_last_to_long(
        updates, ID, ("first_state", "first_date"), ("last_state", "last_date"), ("state", "at")
    ).select(ID, "which", "at", level_order("state", SITUATION_LEVELS).alias("ord"))
    long = long.dropna(subset=[ID, "at", "ord"])
    stay = base.select(ID, "first_arrival", "duration_hospitalization").dropna()
    inside = join_during(long, stay, ID, "at", "first_arrival", "duration_hospitalization", hot)
    place = F.datediff("at", "first_arrival").cast("bigint") * 100 + F.col("which") * 10 + F.col("ord")
    best = inside.groupBy(ID).agg(
        F.min("ord").alias("_min"), F.max("ord").alias("_max"), F.min_by("ord", place).alias("_first")
    )
    return best.select(
        ID, *[level_name(F.col(f"_{p}"), SITUATION_LEVELS).alias(f"{p}_state") for p in ("min", "max", "first")]
    )


def state_during(updates: DataFrame, base: DataFrame, pick: str, hot: HotKeys | None = None) -> DataFrame:
    """One of the three states (``min``, ``max`` or ``first``)."""
    return states_during(updates, base, hot).select(ID, f"{pick}_state")


def with_state_defaults(base: DataFrame, cols=("min_state", "max_state", "first_state")) -> DataFrame:
    """Fill missing states from the stay indicator."""
    from_indicator = (
        F.when(F.col("ind_hospitalized") == "1", F.lit("unknown"))
        .when(F.col("ind_hospitalized") == "0", F.lit("not_hospitalized"))
        .otherwise(F.lit("hospitalization_unknown"))
    )
    return base.withColumns({c: F.coalesce(F.col(c), from_indicator) for c in cols})


def with_arm(base: DataFrame) -> DataFrame:
    """Treated '1', else untreated '0', else missing."""
    return base.withColumn("arm", arm_of(F.col("within_5"), F.col("no_vaccine")))


def study_columns(base: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Age, day gaps, calendar keys, arm and age bands."""
    index = F.col("index_date")
    age = F.lit(cfg.age_year) - F.col("birth_year")
    return base.withColumns(
        {
            "age": age,
            "days_dose_to_index": F.datediff(index, "first_dose_date"),
            "days_index_to_death": F.datediff("death_date", index),
            "days_index_to_stay": F.datediff("first_arrival", index),
            "index_week": year_week(index),
            "index_month": year_month(index),
            "arm": arm_of(F.col("within_5"), F.col("no_vaccine")),
            "age_group": bin_left_closed(age, cfg.age_breaks, cfg.age_labels),
            "age_group_narrow": bin_left_closed(age, cfg.age_breaks_narrow, cfg.age_labels_narrow),
        }
    )


def stay_features(stays: DataFrame, base: DataFrame, cfg: StudyConfig, hot: HotKeys | None = None) -> DataFrame:
    """Everything the study takes from the stays, per subject: death date, prior history, indicator, days, arrival.

    The stays are joined to the index rows once and then reduced per (subject, arrival) before the running window, so
    the window sees at most one row per calendar day of a subject. Gives what ``outcome_dates``, ``latest_prior``,
    ``stay_indicator``, ``stay_duration`` and ``first_arrival`` give apart; ``prior_n`` counts the prior stays.
    """
    cols = [ID, "arrival", "release_date", "recorded_days", "division", "death_date", Q.ERR]
    rows = attach(stays.select(*cols), base.select(ID, "index_date", "ind_death"), [ID], "inner", hot=hot)
    after = F.datediff("arrival", "index_date")
    released = F.col("release_date").isNull() | (F.col("index_date") <= F.col("release_date"))
    near = after.between(cfg.min_days_to_stay, cfg.max_days_to_stay)
    qualifies = (F.col("division") == "dedicated") & near & released
    untagged = F.col(Q.ERR) == ""
    dead = (F.col("ind_death") == "1") & Q.lacks_tags([C.TAG_DIFF_DEATH, C.TAG_DEATH_INDEX])
    prior = (F.col("division") == "standard") & (-after > 1) & (-after < cfg.max_days_prior_stay)
    open_stay = F.col("release_date") >= F.col("index_date")
    duration = F.when(open_stay, (-after).cast("double")).when(~open_stay, F.col("recorded_days").cast("double"))
    flag = F.when(open_stay, F.lit("1")).when(~open_stay, F.lit("0"))
    latest = F.struct(
        (-after).alias("days"), duration.isNull().alias("n1"), duration.alias("duration"), flag.isNull().alias("n2"),
        flag.alias("during"),
    )
    days = rows.groupBy(ID, "arrival").agg(
        F.min(F.when(qualifies, F.when(untagged, 1).otherwise(-1))).alias("_ind"),
        F.max(F.when(qualifies & untagged, F.col("release_date"))).alias("_end"),
        F.min(F.when(qualifies & untagged, F.col("arrival"))).alias("_first"),
        F.max(F.when(dead, F.col("death_date"))).alias("_death"),
        F.min(F.when(prior, latest)).alias("_prior"),
        F.count_if(prior).alias("_prior_n"),
    )
    covered = days.withColumn("_days", newly_covered(ID, "arrival", "_end"))
    out = covered.groupBy(ID).agg(
        F.max("_death").alias("death_date"),
        F.min("_prior").alias("_prior"),
        F.sum("_prior_n").alias("prior_n"),
        F.min("_ind").cast("string").alias("ind_hospitalized"),
        F.sum("_days").alias("duration_hospitalization"),
        F.min("_first").alias("first_arrival"),
    )
    return out.select(
        ID,
        "death_date",
        F.col("_prior.days").alias("prior_days"),
        F.col("_prior.duration").alias("prior_duration"),
        F.col("_prior.during").alias("during_prior"),
        "prior_n",
        "ind_hospitalized",
        "duration_hospitalization",
        "first_arrival",
    )


def subject_table(
    master: DataFrame,
    stays: DataFrame,
    updates: DataFrame,
    cfg: StudyConfig,
    repeated_prior: str = "error",
    hot_stays: HotKeys | None = None,
    hot_updates: HotKeys | None = None,
    tables: Tables | None = None,
) -> DataFrame:
    """The whole chain from tagged master and stays to one row per subject with all study columns.

    ``repeated_prior``: ``error`` stops the run when a subject has two prior stays, ``latest`` keeps the latest. The
    per-subject table before the states is one of ``tables`` (of its own, if none are given), bucketed by subject, since
    two joins read it; the number of prior stays is observed on the way.
    """
    base = index_rows(master, cfg.clean_first)
    base = base.join(stay_features(stays, base, cfg, hot_stays), ID, "left").withColumns(
        {
            "during_prior": F.coalesce("during_prior", F.lit("0")),
            "ind_hospitalized": F.coalesce("ind_hospitalized", F.lit("0")),
        }
    )
    most, tables = Observation(), tables or Tables(master.sparkSession)
    base = tables.keep(base, "subjects", ID, most, (F.max("prior_n").alias("n"), F.max_by(ID, "prior_n").alias("id")))
    if repeated_prior == "error" and (most.get["n"] or 0) > 1:
        raise ValueError(f"subject {most.get['id']!r} has {most.get['n']} prior stays")
    base = base.drop("prior_n").join(states_during(updates, base, hot_updates), ID, "left")
    return study_columns(with_state_defaults(base), cfg)
