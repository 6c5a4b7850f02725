"""Printed values, folded letters, numbering, queues and read models on small inputs."""

import datetime as dt
import random
import unicodedata

from pyspark.sql import functions as F

from ridgeline.functions import text as tx
from ridgeline.operators import checks, lifecycle, queues, readmodels
from ridgeline.sources import feeds


def test_printed_values(spark):
    long = [(1234.5, "CAD", "$1,234.50"), (-1234.0, "USD", "-$1,234"), (0.0, "CAD", "$0"), (4.6, "CAD", "$4.60"), (12.34, "%", "12.3%"), (100.0, "%", "100%"), (1000000.0, "count", "1,000,000"), (1.255, "count", "1.26"),
            (7.0, "years", "7.0 yrs"), (1234.56, "years", "1234.6 yrs"), (80.5, "CAD/hr", "$80.5/hr"), (33.33, "trips/hr", "33.3"), (5.0, "", "5"), (5.5, "buses", "5.5 buses"), (None, "CAD", None), (2.0, "km", "2 km"), (10.10, "hours", "10.1 hrs")]
    short = [(1420000000.0, "CAD", "$1.42B"), (-521000000.0, "USD", "-$521M"), (99999.0, "count", "99,999"), (100000.0, "count", "100K"), (999994.0, "count", "999.99K"), (999995.0, "count", "1M"), (123456.0, "hours", "123.46K hrs"),
             (-120400.0, "count", "-120.4K"), (3e12, "km", "3T km"), (250000.0, "%", "250,000%"), (85000.0, "CAD", "$85,000")]
    for cases, compact in ((long, False), (short, True)):
        df = spark.createDataFrame(cases, "v double, unit string, want string")
        got = df.select("v", "unit", "want", tx.format_value(F.col("v"), F.col("unit"), compact).alias("got")).collect()
        assert [(r.v, r.unit, r.got) for r in got] == [(r.v, r.unit, r.want) for r in got]
    assert [r.t for r in spark.createDataFrame([(-4.25,), (0.0,), (1234.0,)], "p double").select(tx.format_change(F.col("p")).alias("t")).collect()] == ["4.3%", "0.0%", "1234.0%"]


def test_slugs_of_any_letters(spark):
    import re

    def plain(name):
        text = unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode()
        return re.sub(r"-{2,}", "-", re.sub(r"[^a-z0-9]+", "-", text.lower()).strip("-"))

    rng = random.Random(1)
    names = ["Société de transport de l'Outaouais", "Øst & Vest", "ﬁn № ½ Ⅷ ™", "Ｗｉｄｅ", "日本 Tokyo", "ŁÓDŹ", "straße", "", "--a--", "Ǆ ĳ ŉ", "été", "Ångström"]
    names += ["".join(chr(rng.choice([rng.randrange(32, 0x250), rng.randrange(0x1E00, 0x1F00), rng.randrange(0x2000, 0x2200)])) for _ in range(12)) for _ in range(400)]
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", tx.ascii_slug(F.col("n")).alias("s")).collect()
    assert {r.n: r.s for r in got} == {n: plain(n) for n in names}


def test_numbering_over_all_tasks(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice(["x", "y", "zz", None])) for k in range(3000)]
    df = spark.createDataFrame(rows, "id long, name string").repartition(7)
    got = lifecycle.number_sorted(df, [F.desc_nulls_last("name"), "id"]).orderBy("nth").collect()
    want = sorted(rows, key=lambda r: (r[1] is None, [-ord(c) for c in r[1] or ""], r[0]))
    assert [r.nth for r in got] == list(range(1, 3001)) and [r.id for r in got] == [r[0] for r in sorted(rows, key=lambda r: ({"zz": 0, "y": 1, "x": 2, None: 3}[r[1]], r[0]))] and len(want) == 3000
    assert lifecycle.number_sorted(df.limit(0), ["id"]).count() == 0


def test_doubled_quotes_of_a_feed(spark, tmp_path):
    (tmp_path / "f.csv").write_text('a,b\n"A ""x"", y",1\n', encoding="utf-8")
    assert feeds.read_csv(spark, str(tmp_path / "f.csv"), ["a", "b"]).first().a == 'A "x", y'


def test_queue_views(spark):
    rows = spark.createDataFrame([("b", "m", 1, ["x"]), ("a", "n", 2, []), ("a", "m", 3, None), ("a", "m", 4, ["y", "x"])], "agency string, metric string, id long, flags array<string>")
    order = lambda **k: [r.id for r in queues.review_queue(rows, **k).orderBy("nth").collect()]
    assert order() == [3, 4, 2, 1] and order(show="flagged") == [4, 1] and order(show="clean", agency="a") == [3, 2] and order(agency="c") == []


def test_dictionary_problems(spark):
    entries = spark.createDataFrame([("a", "A", "t1"), ("b", " ", "t9"), ("x", None, None)], "code string, name string, tier string")
    codes = spark.createDataFrame([("a",), ("b",), ("c",)], "code string")
    got = {(r.code, r.problem) for r in queues.dictionary_problems(entries, codes, ["name"], {"tier": ["t1"]}).collect()}
    assert got == {("b", "missing required field name"), ("b", "unknown tier: t9"), ("c", "missing entry"), ("x", "not a known metric")}


def test_series_and_slots(spark):
    d = lambda y, m=12: dt.date(y, m, 28)
    values = [("A", "ridership", "total", "annual_calendar", "2023", d(2023), 80.0), ("A", "ridership", "total", "annual_calendar", "2024", d(2024), 100.0), ("A", "ridership", "total", "monthly", "2025-01", d(2025, 1), 9.0),
              ("A", "ridership", "bus", "annual_calendar", "2025", d(2025), 1.0), ("A", "fleet_size", "bus", "monthly", "2024-05", d(2024, 5), 7.0), ("A", "cost_per_rider", "total", "annual_fiscal", "FY2024-25", d(2024), 2.0),
              ("A", "cost_per_rider", "total", "annual_calendar", "2023", d(2023), 1.0), ("A", "subsidy_per_rider", "a", "annual_calendar", "2024", d(2024), 5.0), ("A", "subsidy_per_rider", "a", "annual_calendar", "2023", d(2023), 0.0)]
    values = spark.createDataFrame([(*v, "u") for v in values], "agency_id string, metric string, scope string, period_type string, period string, end_date date, value double, unit string")
    ranks = [("A", "ridership", "2023", d(2023), 9, 10), ("A", "ridership", "2024", d(2024), 3, 12), ("B", "cost_per_rider", "FY2024-25", d(2024), 1, 8), ("A", "subsidy_per_rider", "2024", d(2024), 2, 4)]
    series = readmodels.metric_series(values, spark.createDataFrame(ranks, "agency_id string, metric string, period string, end_date date, rank int, of int"))
    got = {r.metric: (r.scope, r.value, r.as_of, r["rank"], r.of, r.suppressed, len(r.points)) for r in series.collect()}
    assert got == {
        "ridership": ("total", 9.0, "2025-01", 3, 12, None, 3), "fleet_size": ("bus", 7.0, "2024-05", None, None, "no_comparable_period", 1),
        "cost_per_rider": ("total", 2.0, "FY2024-25", None, None, "pending", 2), "subsidy_per_rider": ("a", 5.0, "2024", None, None, "below_min_denominator", 2),
    }
    slots = {r.metric: (r.section, r.slot, r.value, r.as_of, r["rank"], r.pct, r.vs) for r in readmodels.detail_model(series).collect()}
    assert len(slots) == 14 and slots["ridership"] == ("hero", 1, 100.0, "2024", 3, 25.0, "2023") and slots["fleet_size"] == ("service", 3, 7.0, "2024-05", None, None, None)
    assert slots["cost_per_rider"] == ("hero", 4, 2.0, "FY2024-25", None, None, None)  # no year before of the same kind
    assert slots["subsidy_per_rider"] == ("hero", 5, 5.0, "2024", None, None, None)  # nothing to compare with zero
    assert slots["average_fare"] == ("ratio", 4, None, None, None, None, None)


def test_statements_carry_each_rules_flags(spark):
    base = {"total_liabilities": 100.0, "long_term_debt": 60.0, "ridership": 50.0, "farebox_revenue": 100.0, "average_fare": 2.5, "total_revenue": 500.0, "total_revenue_excluding_subsidy": 200.0, "subsidy": 200.0}
    rows = [(1, "total", "operating", m, v) for m, v in base.items()] + [(2, "total", "operating", "ridership", 5.0)]
    out = checks.reconcile_statement(spark.createDataFrame(rows, "doc long, scope string, basis string, metric string, value double"), ["doc"]).collect()
    flags = {r.metric: r.flags for r in out if r.kind == "read" and r.doc == 1}
    assert flags["average_fare"] == ["cross_source_disagreement"] and flags["ridership"] == ["cross_source_disagreement"] and flags["farebox_revenue"] == ["cross_source_disagreement"]
    assert flags["total_revenue"] == ["sum_mismatch"] and flags["long_term_debt"] == []
    derived = {r.metric: (r.value, r.equation) for r in out if r.kind == "derived"}
    assert derived["other_liabilities"] == (40.0, "liabilities_components") and derived["other_revenue"] == (100.0, "earned_revenue_components") and "cost_per_rider" not in derived
    assert derived["operating_expenses"] == (400.0, "expense_revenue_subsidy")


def test_quotes_of_round_grouped_values(spark):
    rows = [("a 7,000.00 b", "7000.00"), ("7000", "7,000"), ("(1,000,000)", "1000000"), ("1 000", "1000"), ("6,000.00", "7000.00"), ("1,5", "15"), ("7,00", "7.00"), ("about 7", "7000.00"), (" ", "1"), (None, "1")]
    df = spark.createDataFrame(rows, "quote string, printed string")
    got = [r[0] for r in df.select(tx.quote_supports(df.quote, df.printed)).collect()]
    assert got == ["supported"] * 4 + ["mismatch", "supported", "supported", "mismatch", "missing", "missing"]
