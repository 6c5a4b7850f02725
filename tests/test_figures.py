"""Validation, sheets and streams on small inputs with known results."""

import decimal
import random

import pytest
from pyspark.sql import functions as F

from ridgeline.operators import checks, solver
from ridgeline.operators import validation as vd
from ridgeline.plans import figures
from ridgeline.sources import sinks, workbook
from ridgeline.streaming import feeds as streams


def test_rows_are_flagged_strictly_beyond_the_shares(spark):
    d = lambda x: None if x is None else decimal.Decimal(x)
    cases = [
        (("operating_expenses", "150000", "CAD", "CAD", "100000", None, 0), "", "approved"), (("operating_expenses", "150000.01", "CAD", "CAD", "100000", None, 0), "yoy_spike", "pending"),
        (("operating_expenses", "49999", "CAD", None, "100000", None, 0), "yoy_spike", "pending"), (("operating_expenses", "5000000", "CAD", "CAD", "0", None, 0), "", "approved"),
        (("ridership", "98", "count", "CAD", None, "100", 0), "", "approved"), (("ridership", "97.99", "count", "CAD", None, "100", 0), "cross_source_disagreement", "pending"),
        (("ridership", "98", "count", "CAD", None, "100", 1), "", "pending"), (("ridership", "-1", "count", "CAD", None, None, 0), "unit_mismatch", "pending"),
        (("ridership", "5", "trips", "CAD", None, None, 0), "unit_mismatch", "pending"), (("ridership", "5", None, "CAD", None, None, 0), "unit_mismatch", "pending"),
        (("on_time_performance", "1000", "%", "CAD", None, None, 0), "", "approved"), (("on_time_performance", "1000.5", "%", "CAD", None, None, 0), "unit_mismatch", "pending"),
        (("total_assets", "39", "CAD", "CAD", None, None, 0), "unit_mismatch", "pending"), (("total_assets", "0", "CAD", "CAD", None, None, 0), "", "approved"), (("total_assets", "-10000", "CAD", "CAD", None, None, 0), "", "approved"),
        (("average_fare", "2.5", "CAD", "CAD", None, None, 0), "", "approved"), (("average_fare", "2.5", "CAD", "USD", None, None, 0), "unit_mismatch", "pending"), (("cost_per_hour", "80", "USD/hr", "USD", None, None, 0), "", "approved"),
        (("made_up", "1", "?", "CAD", "9", "9", None), "yoy_spike,cross_source_disagreement", "pending"), (("made_up", "1", "?", "CAD", None, None, None), "", "pending"),
    ]
    rows = [(k, m, d(v), u, c, d(p), d(x), t) for k, ((m, v, u, c, p, x, t), _, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, "id long, metric string, value decimal(18,2), unit string, currency string, prior decimal(18,2), crosscheck decimal(18,2), tier int")
    got = {r.id: (",".join(r.flags), r.status) for r in vd.validate_rows(df).collect()}
    assert got == {k: (f, s) for k, (_, f, s) in enumerate(cases)} and len(vd.METRICS) == 41


def test_amortization_belongs_to_every_basis(spark):
    """Amortization on the default basis joins the cohort of expenses on another: the identity is off by half and shows."""
    values = {"labour_cost": 50, "energy_fuel_cost": 20, "materials_services_cost": 10, "other_operating_expenses": 10, "operating_expenses": 50}
    rows = [(1, "total", "psab_total", m, float(v)) for m, v in values.items()] + [(1, "total", "operating", "amortization", 10.0)]
    df = spark.createDataFrame(rows, "k long, scope string, basis string, metric string, value double")
    got = checks.cohort_failures(df, ["k"]).collect()
    assert {(r.basis, r.metric) for r in got} == {("psab_total", m) for m in [*values, "amortization"]}
    closed = df.withColumn("value", F.when(F.col("metric") == "operating_expenses", 100.0).otherwise(F.col("value")))
    assert checks.cohort_failures(closed, ["k"]).count() == 0


def test_total_expenses_have_cohorts_of_their_own(spark):
    rows = [(1, "total", b, "total_expenses", v) for b, v in (("operating", 90.0), ("psab_total", 120.0))] + [(1, "total", "operating", "total_revenue", 100.0), (1, "total", "operating", "annual_surplus_deficit", 10.0)]
    got = checks.cohort_failures(spark.createDataFrame(rows, "k long, scope string, basis string, metric string, value double"), ["k"]).collect()
    assert {(r.basis, r.metric) for r in got} == {("psab_total", m) for m in ("total_expenses", "total_revenue", "annual_surplus_deficit")}


def test_columns_beyond_z():
    assert [sinks.column_letters(n) for n in (1, 26, 27, 52, 53, 702, 703)] == ["A", "Z", "AA", "AZ", "BA", "ZZ", "AAA"]


def test_wide_formulas(spark):
    wide = spark.range(1).select(F.lit("k").alias("k"), *[F.lit(1).alias(f"c{i}") for i in range(30)], F.lit(3).alias("r"))
    assert sinks.formula_grid(wide, ["k"], [f"c{i}" for i in range(30)], "r").first().total == "=SUM(B3:AE3)"
    by = {e.code: e for e in solver.STATEMENT_EQUATIONS}
    rows = F.create_map(*[x for k, m in enumerate(("net_debt", "total_liabilities", "total_financial_assets", "annual_surplus_deficit", "total_revenue"), 4) for x in (F.lit(m), F.lit(k))])
    one = lambda e, m: spark.range(1).select(sinks.equation_formula(by[e], m, rows, F.lit("AB")).alias("f")).first().f
    assert one("net_debt_def", "net_debt") == '=IF(OR(AB5="",AB6=""),"",AB5-AB6)' and one("net_debt_def", "total_liabilities") == '=IF(OR(AB4="",AB6=""),"",AB4+AB6)'
    assert one("net_debt_def", "total_financial_assets") == '=IF(OR(AB4="",AB5=""),"",AB5-AB4)'
    assert one("annual_surplus_deficit_def", "annual_surplus_deficit") is None  # its expenses have no row


def test_year_headers(spark):
    cases = {"2024": 2024, " 2024 ": 2024, "FY2024-25": 2024, "FY2024": None, "2024.0": 2024, "year": None, "": None}
    df = spark.createDataFrame([(k,) for k in cases], "h string")
    assert {r.h: r.y for r in df.select("h", workbook.year_header(F.col("h")).alias("y")).collect()} == cases


def test_a_sparse_sheet(spark):
    at = lambda block, place: workbook.FIRST_COLUMN + workbook.BLOCK * block + place
    cells = [(1, at(0, 0), "2020"), (1, at(1, 0), "FY2021-22"), (1, at(2, 0), "soon"), (1, at(4, 0), "2024"), (3, 1, "ridership"), (4, 1, "fleet_age"), (5, 1, "a separator"), (2, 2, "Jan")]
    cells += [(3, at(0, 0), "5"), (3, at(0, 11), "7.5"), (3, at(0, 12), "99"), (3, at(0, 17), "=SUM(B3)"), (3, at(1, 2), "x"), (3, at(1, 3), "  "), (3, at(2, 0), "1"), (3, at(4, 0), "1")]
    cells += [(4, at(0, 3), "1"), (4, at(0, 17), "12"), (4, at(1, 17), "13"), (5, at(0, 0), "1"), (7, at(0, 0), "1")]
    df = spark.createDataFrame([("s", *c) for c in cells], "sheet string, row int, col int, cell string")
    wide = workbook.grid(df, at(5, 0))
    got = {(r.metric, r.year, r.month, r.value, r.problem) for r in workbook.read_grid(workbook.sheet_cells(wide), ["ridership"], ["fleet_age"]).collect()}
    assert got == {  # the blocks end at the gap before 2024
        ("ridership", 2020, 1, 5.0, None), ("ridership", 2020, 12, 7.5, None), ("ridership", 2021, 3, None, "non-numeric cell: x"), ("fleet_age", 2020, None, 12.0, None), ("fleet_age", 2021, None, 13.0, None),
        (None, None, None, None, "unreadable year header: soon"),
    }


def test_rollups_never_overwrite(spark):
    rolled = spark.createDataFrame([(k, 100.0) for k in range(5)], "k long, value double")
    there = spark.createDataFrame([(0, 101.9, False), (1, 110.0, False), (2, 500.0, True), (4, 0.0, False)], "k long, value double, derived boolean")
    got = {r.k: (r.value, r.action) for r in vd.promote_rollups(rolled, there, ["k"]).collect()}
    assert got == {0: (101.9, "kept"), 1: (110.0, "sum_mismatch"), 2: (500.0, "kept"), 3: (100.0, "filled"), 4: (0.0, "sum_mismatch")}


def test_scopes_and_component_sums(spark):
    rows = spark.createDataFrame([(1, "b"), (1, "a"), (2, "zeta"), (2, "total"), (3, "c")], "k long, scope string")
    assert {(r.k, r.scope) for r in vd.one_scope(rows, ["k"]).collect()} == {(1, "a"), (2, "total"), (3, "c")}
    parts = spark.createDataFrame([(1, "x", 5.0, 0.9, "q1"), (1, "x", 6.0, 0.7, "q2"), (1, "y", 2.0, 0.6, "q3"), (1, "x", 5.0, 0.9, "q0")], "k long, label string, value double, confidence double, quote string")
    (r,) = vd.component_sums(parts, ["k"]).collect()
    assert (r.value, r.confidence, r.quotes, r.n) == (7.0, 0.6, "q0 | q3", 2)


def test_run_report(spark):
    rows = spark.createDataFrame([("a", 0.4, ["x", "y"]), ("a", 0.9, []), ("b", 0.5, ["x"]), ("b", 0.9, None)], "doc string, confidence double, flags array<string>")
    got = {r.doc: (r["values"], r.flagged, r.low_confidence, r.review_rate, r.flags) for r in vd.run_report(rows).collect()}
    assert got == {"a": (2, 1, 1, 0.5, {"x": 1, "y": 1}), "b": (2, 1, 1, 0.5, {"x": 1}), None: (4, 2, 2, 0.5, {"x": 2, "y": 1})}


def _feed(spark, path, parts):
    rng = random.Random(2)
    for part in parts:
        rows = [(rng.randrange(20), part * 100 + k, rng.random()) for k in range(60)]
        spark.createDataFrame(rows, "key long, at long, v double").coalesce(1).write.mode("append").parquet(path)


def test_a_new_checkpoint_loses_nothing(spark, tmp_path):
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    start = lambda n: streams.start_upserts(streams.read_events(spark, src, "key long, at long, v double", 1), ["key"], ["at"], out, f"{tmp_path}/c{n}", compact_every=2).awaitTermination(120)
    now = lambda: sorted(map(tuple, streams.newest(spark, out, ["key"], ["at"]).collect()))

    def true():
        best = {}
        for r in spark.read.parquet(src).collect():
            best[r.key] = max(best.get(r.key, (r.at, r.v)), (r.at, r.v))
        return sorted((k, *v) for k, v in best.items())

    numbers = lambda: [n for side in streams._folders(spark, out) for n in side]
    _feed(spark, src, range(5))
    start(1)
    assert now() == true()
    last = max(numbers())
    _feed(spark, src, [9])
    start(2)  # batch 0 of a new checkpoint stands behind the base that is there
    assert now() == true() and max(numbers()) >= last + 6
    _feed(spark, src, [20])
    start(1)  # the first checkpoint goes on
    assert now() == true()


def test_the_writer_that_started_last_writes(spark, tmp_path):
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    _feed(spark, src, range(2))
    changes = streams.read_events(spark, src, "key long, at long, v double", 1)
    streams.start_upserts(changes, ["key"], ["at"], out, f"{tmp_path}/a").awaitTermination(120)
    held = {p.name for p in (tmp_path / "out").iterdir()}
    _feed(spark, src, [5])
    first = []
    real = streams._best

    def slow(rows, keys, order):  # another query starts while this one is in its batch
        if not first:
            first.append(streams._file(spark, f"{out}/writer", "another"))
        return real(rows, keys, order)

    streams._best = slow
    try:
        _feed(spark, src, [6])
        with pytest.raises(Exception, match="another query writes"):
            streams.start_upserts(changes, ["key"], ["at"], out, f"{tmp_path}/a").awaitTermination(120)
    finally:
        streams._best = real
    assert held <= {p.name for p in (tmp_path / "out").iterdir()}


def test_workbook_reads_its_facts_once(spark):
    got = figures.QUERIES["workbook_read"](spark, "/root/testdata/sf0.001")
    assert got.count() > 0 and not [f for f in got.inputFiles() if "lineitem" in f]  # all cells come from rows that are kept
