"""Deadlines, penalties, fines, appeal terms and limitation, computed for whole tables of cases.

Every result carries the identifiers of the rules applied. Calendars and key rates are small tables whose
size is fixed by the years they cover (366 rows a year; one row a rate), so they may be broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexgrove.functions.temporal import range_join

# Rules of the term article, holidays of the labour code, rules applied by the calculators.
TERM = "nk1.ch1.art6-1"
TERM_RULES = {"start": f"{TERM}.p2", "years": f"{TERM}.p3", "quarters": f"{TERM}.p4", "months": f"{TERM}.p5", "days": f"{TERM}.p6", "calendar_days": f"{TERM}.p6", "shift": f"{TERM}.p7", "until_midnight": f"{TERM}.p8"}
HOLIDAYS = ((1, 1), (1, 2), (1, 3), (1, 4), (1, 5), (1, 6), (1, 7), (1, 8), (2, 23), (3, 8), (5, 1), (5, 9), (6, 12), (11, 4))
PENALTY_DAYS, PENALTY_RATE, PENALTY_2022, PENALTY_2025 = "nk1.ch11.art75.p3", "nk1.ch11.art75.p4", "nk1.ch11.art75.p5", "nk1.ch11.art75.p5-1"
#: Days from which another rule counts a day of delay.
RULE_DAYS = ("2022-03-09", "2025-01-01", "2027-01-01")
FINE_RULES = {"119": "nk1.ch16.art119.p1", "122": "nk1.ch16.art122.p1", "122_willful": "nk1.ch16.art122.p3", "126": "nk1.ch16.art126.p1"}
MITIGATING, AGGRAVATING, REDUCE, INCREASE = "nk1.ch15.art112.p1", "nk1.ch15.art112.p2", "nk1.ch15.art114.p3", "nk1.ch15.art114.p4"
OBJECTIONS, IN_FORCE, APPEAL, COMPLAINT = "nk1.ch14.art100.p6", "nk1.ch14.art101.p9", "nk1.ch19.art139-1.p2", "nk1.ch19.art139.p2"
LIMITATION = "nk1.ch15.art113.p1"
PERIOD_BASED = ("120", "122", "129.3", "129.5")


def calendar(spark: SparkSession, first_year: int, last_year: int, overrides: DataFrame | None = None) -> DataFrame:
    """day, is_working, ordinal (working days up to it), next_working.

    overrides(day, working) moves days: an extra workday wins over everything, an extra holiday over weekdays.
    """
    days = spark.sql(f"select explode(sequence(date'{first_year}-01-01', date'{last_year}-12-31')) day")
    fixed = F.array(*[F.lit(m * 100 + d) for m, d in HOLIDAYS])
    plain = (F.weekday("day") < 5) & ~F.array_contains(fixed, F.month("day") * 100 + F.dayofmonth("day"))
    if overrides is None:
        days = days.withColumn("is_working", plain)
    else:
        moved = overrides.groupBy("day").agg(F.max("working").alias("__moved"))
        days = days.join(moved, "day", "left").withColumn("is_working", F.coalesce("__moved", plain)).drop("__moved")
    order = W.orderBy("day")  # 366 rows a year
    return days.withColumn("ordinal", F.sum(F.col("is_working").cast("int")).over(order)).withColumn("next_working", F.min(F.when(F.col("is_working"), F.col("day"))).over(order.rowsBetween(0, W.unboundedFollowing)))


def deadlines(cases: DataFrame, days: DataFrame, start: str = "start", amount: str = "amount", unit: str = "unit") -> DataFrame:
    """cases with counting_from, nominal_end, end, shifted, applied.

    unit: days (working), calendar_days, months, quarters, years; other units or amounts below one give NULL.
    """
    s, n, u = F.col(start), F.col(amount), F.col(unit)
    months = F.add_months(s, n.cast("int"))
    plain = (
        F.when(u == "calendar_days", F.date_add(s, n.cast("int"))).when(u == "months", months)
        .when(u == "quarters", F.last_day(F.add_months(s, (n * 3).cast("int")))).when(u == "years", F.add_months(s, (n * 12).cast("int")))
    )
    small = F.broadcast(days)
    at = cases.join(small.select(F.col("day").alias("__start"), F.col("ordinal").alias("__from")), s == F.col("__start"), "left").drop("__start")
    working = small.where("is_working").select(F.col("ordinal").alias("__to"), F.col("day").alias("__end"))
    at = at.join(working, F.when(u == "days", F.col("__from") + n) == F.col("__to"), "left").drop("__to", "__from")
    at = at.withColumn("counting_from", F.date_add(s, 1)).withColumn("nominal_end", F.when(n >= 1, F.when(u == "days", F.col("__end")).otherwise(plain))).drop("__end")
    rolled = at.join(small.select(F.col("day").alias("__day"), F.col("next_working").alias("end")), F.col("nominal_end") == F.col("__day"), "left").drop("__day")
    rules = F.create_map(*[F.lit(x) for k in ("days", "calendar_days", "months", "quarters", "years") for x in (k, TERM_RULES[k])])
    applied = F.array_compact(F.array(F.lit(TERM_RULES["start"]), rules[u], F.when(F.col("end") != F.col("nominal_end"), F.lit(TERM_RULES["shift"])), F.lit(TERM_RULES["until_midnight"])))
    return rolled.withColumn("shifted", F.col("end") != F.col("nominal_end")).withColumn("applied", F.when(F.col("end").isNotNull(), applied))


def organization_share(day: Column, late: Column) -> tuple[Column, Column]:
    """(denominator of the key rate, rule) for an organisation on a day of delay."""
    between = lambda a, b: (day >= F.to_date(F.lit(a))) & (day <= F.to_date(F.lit(b)))
    first, second = between("2022-03-09", "2024-12-31"), between("2025-01-01", "2026-12-31")
    middle = (late > 30) & (late <= 90)
    denominator = F.when(first, 300).when(second, F.when(middle, 150).otherwise(300)).otherwise(F.when(late <= 30, 300).otherwise(150))
    return denominator, F.when(first, PENALTY_2022).when(second, PENALTY_2025).otherwise(PENALTY_RATE)


def penalty_days(cases: DataFrame, rates: DataFrame, key: str = "case_id") -> DataFrame:
    """One row per case and day late: day, late, rate, denominator, rule, daily.

    cases(key, amount, due, paid, taxpayer); rates(valid_from, valid_to, rate). A case stops before its
    first day without a rate.
    """
    days = cases.where("paid > due and amount > 0").withColumn("day", F.explode(F.sequence(F.date_add("due", 1), F.col("paid")))).withColumn("late", F.datediff("day", "due"))
    rated = range_join(days, rates, "day")
    gap = F.max(F.col("rate").isNull().cast("int")).over(W.partitionBy(key).orderBy("day"))
    rated = rated.withColumn("__gap", gap).where("__gap = 0").drop("__gap", "valid_from", "valid_to")
    denominator, rule = organization_share(F.col("day"), F.col("late"))
    person = F.col("taxpayer") == "individual"
    rated = rated.withColumn("denominator", F.when(person, 300).otherwise(denominator)).withColumn("rule", F.when(person, PENALTY_RATE).otherwise(rule))
    return rated.withColumn("daily", F.col("amount") * F.col("rate") / 100 / F.col("denominator"))


def penalty_pieces(cases: DataFrame, rates: DataFrame, key: str = "case_id") -> DataFrame:
    """Stretches of a case's delay with one rate, denominator and rule: key, first, last, rate, denominator, rule, amount.

    A delay is cut where a rule may change (six days at most) and then by the rates, whose number the years bound; a
    day is never a row. As with ``penalty_days`` a case stops before its first day without a rate.
    """
    late = cases.where("paid > due and amount > 0").select(key, "amount", "taxpayer", "due", "paid", F.date_add("due", 1).alias("__from"))
    marks = [F.col("__from"), F.date_add("due", 31), F.date_add("due", 91), *[F.to_date(F.lit(d)) for d in RULE_DAYS]]
    starts = F.array_sort(F.array_distinct(F.filter(F.array(*marks), lambda d: (d >= F.col("__from")) & (d <= F.col("paid")))))
    cut = late.withColumn("__s", F.when(F.col("taxpayer") == "individual", F.array("__from")).otherwise(starts)).select("*", F.posexplode("__s").alias("__i", "__first"))
    cut = cut.withColumn("__last", F.coalesce(F.date_sub(F.try_element_at("__s", F.col("__i") + 2), 1), F.col("paid")))
    known = F.broadcast(rates.select("valid_from", "valid_to", "rate"))  # one row a rate
    met = cut.join(known, (F.col("__last") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("__first") < F.col("valid_to"))))
    met = met.withColumn("first", F.greatest("__first", "valid_from")).withColumn("last", F.least("__last", F.coalesce(F.date_sub("valid_to", 1), F.col("__last"))))
    order = W.partitionBy(key).orderBy("first")
    gap = F.col("first") > F.coalesce(F.date_add(F.lag("last").over(order), 1), F.col("__from"))
    met = met.withColumn("__gap", gap.cast("int")).withColumn("__gap", F.max("__gap").over(order)).where("__gap = 0")
    person = F.col("taxpayer") == "individual"
    denominator, rule = organization_share(F.col("first"), F.datediff("first", "due"))
    return met.select(key, "first", "last", "rate", F.when(person, 300).otherwise(denominator).alias("denominator"), F.when(person, PENALTY_RATE).otherwise(rule).alias("rule"), "amount")


def penalties(cases: DataFrame, rates: DataFrame, key: str = "case_id") -> DataFrame:
    """key, value (to the cent), days, applied; cases paid in time have value 0."""
    pieces = penalty_pieces(cases, rates, key).withColumn("__n", F.datediff("last", "first") + 1)
    daily = F.col("amount") * F.col("rate") / 100 / F.col("denominator")
    # amounts are added day by day, as the rule states them, so that half cents round as they do there; a case has few pieces
    listed = F.sort_array(F.collect_list(F.struct("first", daily.alias("daily"), F.col("__n").alias("n"))))
    total = F.aggregate(listed, F.lit(0.0), lambda sum_, piece: F.aggregate(F.sequence(F.lit(1), piece["n"]), sum_, lambda x, _: x + piece["daily"]))
    sums = pieces.groupBy(key).agg(F.round(total, 2).alias("value"), F.sum("__n").alias("days"), F.sort_array(F.collect_set("rule")).alias("__rules"))
    out = cases.select(key).join(sums, key, "left")
    return out.select(key, F.coalesce("value", F.lit(0.0)).alias("value"), F.coalesce("days", F.lit(0)).cast("long").alias("days"), F.concat(F.array(F.lit(PENALTY_DAYS)), F.coalesce("__rules", F.array().cast("array<string>"))).alias("applied"))


def penalty_segments(cases: DataFrame, rates: DataFrame, key: str = "case_id") -> DataFrame:
    """The steps: runs of days with one rate and one denominator: key, rate, denominator, first, last, n."""
    order = W.partitionBy(key).orderBy("first")
    new = ~(F.lag("rate").over(order).eqNullSafe(F.col("rate")) & F.lag("denominator").over(order).eqNullSafe(F.col("denominator")))
    runs = penalty_pieces(cases, rates, key).withColumn("__new", new.cast("int")).withColumn("__run", F.sum("__new").over(order))
    out = runs.groupBy(key, "__run", "rate", "denominator").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return out.select(key, "rate", "denominator", "first", "last", (F.datediff("last", "first") + 1).cast("long").alias("n"))


def months_late(due: Column, actual: Column) -> Column:
    """Full and begun months of delay, at least one when late."""
    months = (F.year(actual) - F.year(due)) * 12 + F.month(actual) - F.month(due) + (F.dayofmonth(actual) > F.dayofmonth(due)).cast("int")
    return F.when(actual <= due, 0).otherwise(F.greatest(months, F.lit(1)))


def fines(cases: DataFrame) -> DataFrame:
    """cases(article, base, due, actual, documents, mitigating boolean, aggravating boolean, factor) with months, value, applied.

    119: 5 % a month, at most 30 %, at least 1000; 122: 20 %; 122_willful: 40 %; 126: 200 a document; twice
    as much when aggravating, then divided by the factor (2 to 10) when mitigating; a factor out of range: NULL.
    """
    a, base = F.col("article"), F.col("base")
    months = months_late(F.col("due"), F.col("actual"))
    plain = (
        F.when(a == "119", F.greatest(F.least(base * 0.05 * months, base * 0.30), F.lit(1000.0))).when(a == "122", base * 0.20)
        .when(a == "122_willful", base * 0.40).when(a == "126", 200.0 * F.col("documents"))
    )
    doubled = F.when(F.col("aggravating"), plain * 2).otherwise(plain)
    cut = F.when(~F.col("mitigating"), doubled).when(F.col("factor").between(2, 10), doubled / F.col("factor"))
    rules = F.create_map(*[F.lit(x) for kv in FINE_RULES.items() for x in kv])
    none = F.array().cast("array<string>")
    applied = F.concat(F.array(rules[a]), F.when(F.col("aggravating"), F.array(F.lit(AGGRAVATING), F.lit(INCREASE))).otherwise(none), F.when(F.col("mitigating"), F.array(F.lit(MITIGATING), F.lit(REDUCE))).otherwise(none))
    return cases.withColumn("months", months).withColumn("value", F.round(cut, 2)).withColumn("applied", applied)


def appeals(cases: DataFrame, days: DataFrame, key: str = "case_id") -> DataFrame:
    """key, act_received, decision_received, decision_date, complaint_decision_date -> key, name, until, applied.

    An appeal is due the day before the decision's nominal entry into force; other terms roll to a working day.
    """
    terms = [
        ("objections_until", "act_received", 1, "months", (OBJECTIONS,)), ("decision_in_force", "decision_received", 1, "months", (IN_FORCE, APPEAL)),
        ("complaint_until", "decision_date", 1, "years", (COMPLAINT,)), ("fns_complaint_until", "complaint_decision_date", 3, "months", (COMPLAINT,)),
    ]
    listed = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).alias("start"), F.lit(k).alias("amount"), F.lit(u).alias("unit"), F.array(*map(F.lit, r)).alias("rules")) for n, c, k, u, r in terms]))
    out = deadlines(cases.select(key, listed.alias("t")).select(key, "t.*").where("start is not null"), days)
    out = out.withColumn("applied", F.array_distinct(F.concat("rules", "applied")))
    appeal = out.where("name = 'decision_in_force'").withColumn("name", F.lit("appeal_until")).withColumn("end", F.date_sub("nominal_end", 1))
    return out.unionByName(appeal).select(key, "name", F.col("end").alias("until"), "applied")


def limitations(cases: DataFrame) -> DataFrame:
    """cases(article, offense, period_end, decision) with limitation_ends (three years) and expired."""
    start = F.when(F.col("article").isin(*PERIOD_BASED), F.col("period_end")).otherwise(F.col("offense"))
    ends = F.add_months(start, 36)
    return cases.withColumn("limitation_ends", ends).withColumn("expired", F.col("decision") > ends).withColumn("applied", F.array(F.lit(LIMITATION), F.lit(TERM_RULES["start"]), F.lit(TERM_RULES["years"])))
