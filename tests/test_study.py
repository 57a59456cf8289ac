"""The whole job on delimited files, against a plain Python reading of the rules."""

import csv
import random
from collections import defaultdict
from datetime import date, timedelta

import pytest

from pairwell.config import StudyConfig
from pairwell.plans.study import build, load, run

CFG = StudyConfig()
SITUATIONS = {"לא ידוע": None, "החלים": "recovered", "קל": "mild", "בינוני": "moderate", "קשה": "severe", "קריטי": "critical", "נפטר": "dead"}
LEVELS = ["recovered", "mild", "moderate", "severe", "critical", "dead"]


def text(v):
    return "NULL" if v is None else str(v)


def write(path, header, rows):
    with open(path, "w", encoding="utf-8") as f:
        f.write("|".join(header) + "\n")
        for r in rows:
            f.write("|".join(text(v) for v in r) + "\n")


def make(seed, n, repeat_prior=False):
    rng = random.Random(seed)
    master, stays, updates = [], [], []
    for i in range(n):
        pid = f"id{i:04d}"
        index = date(2020, 12, 20) + timedelta(days=rng.randrange(280))
        if i % 23 == 0:
            index = date(2000, 1, 1)
        kind = i % 5
        dead = "1" if i % 9 == 0 else rng.choice([None, "0"])
        birth = rng.randrange(1930, 2012) if i % 31 else None
        dose = index - timedelta(days=rng.randrange(6)) if kind == 0 else None
        row = [pid, index, rng.choice([1, 2]) if i % 37 else 999, dead, "Y" if kind == 0 else None, None,
               "Y" if kind in (1, 2, 3) else None, birth, rng.choice(["לא ידוע", "נפטר מקורונה"]), dose, None]
        master.append(row)
        if i % 11 == 3:
            master.append(list(row))  # an exact copy
        if i % 13 == 5:
            master.append(row[:8] + ["נפטר כחשוד"] + row[9:])  # the same pair twice
        if i % 17 == 7:
            master.append([pid, index + timedelta(days=40)] + row[2:])  # a later candidate
        death = index + timedelta(days=rng.randrange(80)) if dead == "1" and i % 4 else None
        if rng.random() < 0.6:
            for k in range(rng.randrange(1, 4)):
                arrival = index + timedelta(days=rng.randrange(-4, 24))
                out = None if rng.random() < 0.1 else arrival + timedelta(days=rng.randrange(-1, 15))
                d = death + timedelta(days=k % 2) if death and i % 8 == 1 else death
                stays.append([pid, d, arrival, out, rng.randrange(1, 20), "ייעודית"])
                updates.append([pid, arrival + timedelta(days=1), arrival + timedelta(days=5),
                                rng.choice(list(SITUATIONS)), rng.choice(list(SITUATIONS))])
        elif death:
            stays.append([pid, death, index, None, None, "ייעודית"])
        if rng.random() < 0.2:
            for _ in range(2 if repeat_prior else 1):
                arrival = index - timedelta(days=rng.randrange(0, 290))
                out = None if rng.random() < 0.2 else arrival + timedelta(days=rng.randrange(0, 60))
                stays.append([pid, death, arrival, out, rng.randrange(1, 30), "רגילה"])
    return master, stays, updates


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("src")
    master, stays, updates = make(5, 700)
    return d, save(d, master, stays, updates), (master, stays, updates)


def save(d, master, stays, updates):
    paths = {k: str(d / f"{k}.csv") for k in ("master", "hospitalizations", "monitoring", "quarantine")}
    write(paths["master"], ["patient_id", "first_positive_result_test_date", "gendercodename", "ind_death",
          "positive_pcr_within_5", "positive_pcr_before_vaccine", "positive_pcr_no_vaccine", "new_birthdate",
          "new_reasonofdeathname", "first_vaccincationdatetime", "second_vaccinationdatetime"], master)
    write(paths["hospitalizations"], ["patient_id", "new_deathdate", "new_arrivaldate", "new_releasedate",
          "duration_hospitalization", "new_divisiontypename"], stays)
    write(paths["monitoring"], ["patient_id", "first_datemonitoring", "last_datemonitoring",
          "first_update_medical_situation", "last_update_medical_situation"], updates)
    write(paths["quarantine"], ["new_fever", "isolationstartdaykey"], [("1", 20210101), ("1", 20210101), ("0", 20210230)])
    return paths


def expected(master, stays, updates):
    """One dict per subject, by loops."""
    def dedupe(rows):
        return [list(r) for r in dict.fromkeys(tuple(r) for r in rows)]

    master, stays, updates = dedupe(master), dedupe(stays), dedupe(updates)
    for r in master:
        r[1] = None if r[1] == date(2000, 1, 1) else r[1]
    seen = defaultdict(int)
    for r in master:
        seen[(r[0], r[1])] += 1
    dup = {k[0] for k, c in seen.items() if c > 1}
    dated = {s[0] for s in stays if s[1]}
    bad = lambda r: (r[0] in dup or r[1] is None or r[2] is None or r[7] is None
                     or (r[3] == "1" and r[0] not in dated))
    clean = defaultdict(list)
    for r in master:
        if not bad(r):
            clean[r[0]].append(r[1])
    dates = defaultdict(set)
    for s in stays:
        if s[1]:
            dates[s[0]].add(s[1])
    tagged = []
    for s in stays:
        for ix in clean.get(s[0], [None]):
            err = []
            if len(dates[s[0]]) > 1:
                err.append("diff")
            if s[3] and s[3] < s[2]:
                err.append("release")
            if s[1] and s[1] < s[2]:
                err.append("arrival")
            if s[1] and ix and s[1] < ix:
                err.append("index")
            tagged.append((s, err))
    first = {}
    for r in sorted(master, key=lambda r: (r[1] is None, r[1] or date.min)):
        first.setdefault(r[0], r)
    out = {}
    for pid, r in first.items():
        if bad(r):
            continue
        ix, mine = r[1], [(s, e) for s, e in tagged if s[0] == pid]
        death = {s[1] for s, e in mine if s[1] and "diff" not in e and "index" not in e} if r[3] == "1" else set()
        near = [(s, e) for s, e in mine if s[5] == "ייעודית" and -2 <= (s[2] - ix).days <= 21 and (s[3] is None or ix <= s[3])]
        ind = "0" if not near else "-1" if any(e for _, e in near) else "1"
        whole = sorted((s[2], s[3]) for s, e in near if not e and s[3])
        arrival = min((s[2] for s, e in near if not e), default=None)
        covered = set()
        for a, b in whole:
            covered |= {a + timedelta(days=k) for k in range((b - a).days)}
        days = len(covered) if whole else None
        states = []
        if arrival and days is not None:
            for u in (u for u in updates if u[0] == pid):
                for which, (d, s) in enumerate(((u[1], u[3]), (u[2], u[4]))):
                    if SITUATIONS[s] and 0 <= (d - arrival).days <= days:
                        states.append((d, which, LEVELS.index(SITUATIONS[s])))
        fill = {"1": "unknown", "0": "not_hospitalized", "-1": "hospitalization_unknown"}[ind]
        prior = [s for s, _ in mine if s[5] == "רגילה" and 1 < (ix - s[2]).days < 270]
        during = "0"
        if prior and prior[0][3] and prior[0][3] >= ix:
            during = "1"
        out[pid] = {
            "death_date": death.pop() if death else None, "ind_hospitalized": ind, "first_arrival": arrival,
            "duration_hospitalization": days, "during_prior": during,
            "min_state": LEVELS[min(s[2] for s in states)] if states else fill,
            "max_state": LEVELS[max(s[2] for s in states)] if states else fill,
            "first_state": LEVELS[min(states)[2]] if states else fill,
            "age": 2021.0 - r[7], "arm": "1" if r[4] else "0" if r[6] else None,
        }
    return out


@pytest.fixture(scope="module")
def result(spark, files, tmp_path_factory):
    # candidates with a later date repeat the stay rows, so prior stays may repeat here
    out = str(tmp_path_factory.mktemp("out") / "tables")
    return run(spark, files[1], out, CFG, repeated_prior="latest", keep=True), out


def test_subject_table(result, files):
    want = expected(*files[2])
    got = {r["subject_id"]: r.asDict() for r in result[0].base.collect()}
    assert set(got) == set(want) and len(got) > 400
    for pid, row in want.items():
        for col, value in row.items():
            assert got[pid][col] == value, (pid, col, got[pid][col], value)


def test_pairs_are_valid(result):
    study, pre = result[0].study.collect(), result[0].pre.collect()
    pairs = defaultdict(list)
    for r in study:
        pairs[r["subclass"]].append(r)
    assert len({r["subject_id"] for r in study}) == len(study) > 50
    keys = CFG.exact_keys
    for rows in pairs.values():
        assert sorted(r["arm"] for r in rows) == ["0", "1"]
        assert len({tuple(r[k] for k in keys) for r in rows}) == 1
    strata = defaultdict(lambda: [0, 0])
    for r in pre:
        strata[tuple(r[k] for k in keys)][int(r["arm"])] += 1
    assert len(pairs) == sum(min(c) for c in strata.values())


def test_tables_are_written(result):
    import glob

    tables = {"death", "death2d", "death2t5d", "hosp", "params", "demographic", "attrition", "balance", "km_death", "logrank_hosp"}
    for name in tables:
        parts = glob.glob(f"{result[1]}/{name}/*.csv")
        assert len(parts) == 1, name
        with open(parts[0], encoding="utf-8") as f:
            assert len(list(csv.reader(f))) > 1, name
    for name in ("poisson", "poisson_all", "negbin", "negbin_all", "negbin_status"):
        assert glob.glob(f"{result[1]}/model_{name}/*.parquet") and glob.glob(f"{result[1]}/model_{name}_fit/*.parquet")


def test_attrition_was_counted_while_writing(result):
    from pairwell.operators.cohort import attrition

    study, out = result
    assert sorted(map(tuple, study.tables()["attrition"].collect())) == sorted(map(tuple, attrition(study.base, CFG).collect()))
    assert sum(r["n"] for r in study.tables()["isolation_days"].collect()) == study.quarantine.count()


def test_the_score_and_the_matching_summary_are_written(result, spark):
    study, out = result
    assert study.score.converged and study.score.max_score < 1e-6
    assert {r["term"] for r in spark.read.parquet(f"{out}/model_propensity").collect()} == {"(Intercept)", "age", "index_day"}
    rows = {(r["sample"], r["variable"], r["level"]): r for r in study.tables()["match_balance_summary"].collect()}
    assert ("matched", "distance", "") in rows and ("all", "sex", "male") in rows
    # pairs share their exact keys, and the score is closer than before
    assert all(r["std_mean_diff"] in (None, 0) for (s, v, _), r in rows.items() if s == "matched" and v in CFG.exact_keys)
    assert abs(rows["matched", "distance", ""]["std_mean_diff"]) <= abs(rows["all", "distance", ""]["std_mean_diff"]) + 0.05


def test_subject_tables_share_one_layout_and_go_at_the_end(spark, files, tmp_path):
    import re

    study = build(load(spark, files[1]), CFG, "latest")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        both = study.base.join(study.stays.groupBy("subject_id").count(), "subject_id").join(study.pre.select("subject_id", "distance"), "subject_id", "left")
        assert not re.search(r"Exchange hashpartitioning", both._jdf.queryExecution().executedPlan().toString())
        assert both.count() == study.base.join(study.stays.select("subject_id").distinct(), "subject_id").count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    names, paths = list(study.kept.names), list(study.kept.paths)
    assert len(names) >= 4 and all(spark.catalog.tableExists(n) for n in names)
    study.close()
    assert not any(spark.catalog.tableExists(n) for n in names)
    import os

    assert not any(os.path.exists(p.removeprefix("file:")) for p in paths)


def test_params_count_copies(result, files):
    lines = {r["description"]: r["value"] for r in result[0].tables()["params"].collect()}
    master = files[2][0]
    assert lines["Rows in master source"] == str(len(master))
    assert lines["Duplicated conplete rows rmoved from master"] == str(len(master) - len({tuple(r) for r in master}))
    assert lines["Duplicated conplete rows rmoved from quarantine"] == "1"
    assert lines["Study start"] == "2020-12-20"


def test_repeated_prior_stays_stop_the_run(spark, tmp_path):
    paths = save(tmp_path, *make(6, 120, repeat_prior=True))
    with pytest.raises(ValueError, match="prior stays"):
        build(load(spark, paths), CFG)
