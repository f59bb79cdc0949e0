import datetime as dt

import pytest
from pyspark.sql import functions as F

from lexgrove.operators import calculators as C


@pytest.fixture(scope="module")
def days(spark):
    return C.calendar(spark, 2020, 2031).cache()


@pytest.mark.parametrize("start,amount,unit,nominal,end", [
    ("2025-03-07", 10, "days", "2025-03-21", "2025-03-21"), ("2025-01-31", 3, "months", "2025-04-30", "2025-04-30"), ("2025-02-10", 1, "quarters", "2025-05-31", "2025-06-02"),
    ("2024-02-29", 1, "years", "2025-02-28", "2025-02-28"), ("2025-04-25", 6, "calendar_days", "2025-05-01", "2025-05-02"), ("2025-01-01", 0, "days", None, None), ("2025-01-01", 1, "weeks", None, None),
])
def test_deadlines(spark, days, start, amount, unit, nominal, end):
    r = C.deadlines(spark.createDataFrame([(dt.date.fromisoformat(start), amount, unit)], "start date, amount int, unit string"), days).first()
    assert (r["nominal_end"] and str(r["nominal_end"]), r["end"] and str(r["end"])) == (nominal, end)
    if end and end != nominal:
        assert r["shifted"] and C.TERM_RULES["shift"] in r["applied"]


def test_calendar_overrides(spark):
    moved = spark.createDataFrame([(dt.date(2025, 1, 4), True), (dt.date(2025, 3, 10), False)], "day date, working boolean")
    got = {r["day"]: r["is_working"] for r in C.calendar(spark, 2025, 2025, moved).collect()}
    assert got[dt.date(2025, 1, 4)] and not got[dt.date(2025, 3, 10)] and got[dt.date(2025, 3, 11)] and not got[dt.date(2025, 5, 9)]


def case(spark, *rows):
    return spark.createDataFrame([(i, a, dt.date.fromisoformat(d), dt.date.fromisoformat(p), t) for i, (a, d, p, t) in enumerate(rows)], "case_id int, amount double, due date, paid date, taxpayer string")


def test_penalties(spark):
    rates = spark.createDataFrame([(dt.date(2020, 1, 1), None, 16.0)], "valid_from date, valid_to date, rate double")
    cases = case(spark, (100000.0, "2024-03-01", "2024-03-11", "individual"), (300000.0, "2025-01-31", "2025-05-31", "organization"), (5.0, "2025-01-31", "2025-01-31", "organization"), (9000.0, "2019-12-30", "2020-01-05", "individual"))
    got = {r["case_id"]: r for r in C.penalties(cases, rates).collect()}
    assert got[0]["value"] == 533.33 and got[0]["days"] == 10 and got[2]["value"] == 0.0
    assert got[3]["days"] == 0  # no rate on the first day: nothing after it counts
    runs = C.penalty_segments(cases, rates).where("case_id = 1").orderBy("first").collect()
    assert [(r["denominator"], r["n"]) for r in runs] == [(300, 30), (150, 60), (300, 30)]


def test_fines(spark):
    d = dt.date
    rows = [
        (0, "119", 200000.0, d(2025, 4, 25), d(2025, 7, 1), 0, False, False, 2.0, 30000.0), (1, "119", 500000.0, d(2024, 4, 25), d(2025, 4, 25), 0, False, False, 2.0, 150000.0),
        (2, "119", 0.0, d(2025, 4, 25), d(2025, 4, 26), 0, False, False, 2.0, 1000.0), (3, "126", 0.0, None, None, 7, False, False, 2.0, 1400.0),
        (4, "122", 1000.0, None, None, 0, True, True, 4.0, 100.0), (5, "122_willful", 1000.0, None, None, 0, True, False, 20.0, None),
    ]
    df = spark.createDataFrame(rows, "case_id int, article string, base double, due date, actual date, documents int, mitigating boolean, aggravating boolean, factor double, want double")
    for r in C.fines(df).collect():
        assert r["value"] == r["want"], r


def test_appeals_and_limitation(spark, days):
    df = spark.createDataFrame([(1, dt.date(2026, 3, 10), dt.date(2026, 5, 15), None, None)], "case_id int, act_received date, decision_received date, decision_date date, complaint_decision_date date")
    got = {r["name"]: str(r["until"]) for r in C.appeals(df, days).collect()}
    assert got == {"objections_until": "2026-04-10", "decision_in_force": "2026-06-15", "appeal_until": "2026-06-14"}
    r = C.limitations(spark.createDataFrame([("122", None, dt.date(2022, 12, 31), dt.date(2026, 2, 1))], "article string, offense date, period_end date, decision date")).first()
    assert r["expired"] and str(r["limitation_ends"]) == "2025-12-31"
