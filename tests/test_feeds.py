"""Feeds, sinks, streams and the solver on small inputs with known results."""

import datetime as dt
import random

import pytest

from ridgeline.functions import text as tx
from ridgeline.operators import lifecycle, solver
from ridgeline.sources import feeds, sinks
from ridgeline.streaming import feeds as streams


def test_statistical_feed_scales_and_rejects(spark, tmp_path):
    path = tmp_path / "feed.csv"
    path.write_text(
        '﻿ref_date,label,measure,scale,value,status\n"2024-01","A, city","Trips","thousands","1.5","p"\n'
        '"2024-02","A, city","Trips","units","7",""\n"2024-02","Nowhere","Trips","units","7",""\n"2024-13","A, city","Trips","units","7",""\n"2024-03","A, city","Trips","units","",""\n',
        encoding="utf-8",
    )
    rows = feeds.read_csv(spark, str(path), ["ref_date", "label", "measure", "scale", "value", "status"])
    good, bad = feeds.statistical_feed(rows, spark.createDataFrame([("A, city", 5)], "label string, agency_id long"), spark.createDataFrame([("Trips", "ridership")], "measure string, metric string"))
    assert sorted(tuple(r) for r in good.collect()) == [(5, dt.date(2024, 1, 1), "ridership", 1500.0, "preliminary"), (5, dt.date(2024, 2, 1), "ridership", 7.0, "verified")]
    assert sorted(r.reason for r in bad.collect()) == ["bad month", "no value", "unmapped agency"]


def test_epoch_feed_reasons(spark):
    rows = spark.createDataFrame([("1704067200000", "12"), ("x", "1"), ("1", "y"), ("", "3"), (None, None)], "stamp string, value string")
    good, bad = feeds.epoch_feed(rows, 3)
    assert [tuple(r) for r in good.collect()] == [(3, dt.date(2024, 1, 1), "ridership", 12.0)]
    assert sorted(r.reason for r in bad.collect()) == ["bad timestamp", "bad value", "empty field", "empty field"]


def test_mode_feed_sums_modes_and_skips_reduced_reporters(spark):
    full = "Full Reporter"
    rows = [("1", "2024-01-01", full, "5", "10", ""), ("1", "2024-01-15", full, "7", "", ""), ("1", "2020-01-01", full, "9", "9", "9"), ("1", "2024-01-01", "Reduced Reporter", "9", "9", "9"), ("2", "2024-01-01", full, "9", "9", "9")]
    rows = spark.createDataFrame(rows, "source_id string, month string, reporter_type string, trips string, miles string, hours string")
    got = feeds.mode_feed(rows, spark.createDataFrame([("1", 4)], "source_id string, agency_id long"), since="2023-01").collect()
    assert sorted((r.metric, round(r.value, 5)) for r in got) == [("ridership", 12.0), ("vehicle_km", 16.09344)]


def test_printed_numbers(spark):
    cases = {"(1,234.5)": -1234.5, "1 234": 1234.0, "3,5": 3.5, "3,500": 3500.0, "1,2,3": 123.0, "": None, "n/a": None, "-4": -4.0}
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", tx.parse_number(tx.F.col("t")).alias("v")).collect()
    assert {r.t: r.v for r in got} == cases


def _brute(known, equations, rel=0.02):
    known = dict(known)
    near = lambda a, b: abs(a - b) <= rel * max(abs(a), abs(b))
    while True:
        found = {}
        for e in sorted(equations, key=lambda e: e.code):
            missing = [m for m in e.operands if known.get(m) is None]
            if len(missing) != 1:
                continue
            m, v = missing[0], None
            total, parts = known.get(e.total), [known.get(p) for p in e.parts]
            if e.kind == "sum":
                v = sum(parts) if m == e.total else total - sum(p for p in parts if p is not None)
            elif m == e.total:
                v = parts[0] / parts[1] if parts[1] else None
            elif m == e.parts[0]:
                v = total * parts[1]
            else:
                v = parts[0] / total if total else None
            if v is not None:
                found.setdefault(m, []).append(v)
        new = {m: v[0] for m, v in found.items() if all(near(x, v[0]) for x in v)}
        if not new:
            return known
        known |= new


def test_solver_against_brute_force(spark):
    names = list(dict.fromkeys(m for e in solver.EQUATIONS for m in e.operands))
    rng = random.Random(4)
    rows = [(i, *[rng.choice([None, 0.0, rng.uniform(1, 9)]) for _ in names]) for i in range(300)]
    wide = spark.createDataFrame(rows, "k long, " + ", ".join(f"{n} double" for n in names))
    got = {(r.k, r.metric): r.value for r in solver.fixpoint(wide, ["k"]).filter("value IS NOT NULL").collect()}
    want = {(r[0], m): v for r in rows for m, v in _brute(dict(zip(names, r[1:], strict=True)), solver.EQUATIONS).items() if v is not None}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(v) for k, v in want.items())


def test_promote_null_keys_and_ties(spark):
    schema = "k string, value double, at int"
    current = spark.createDataFrame([("a", 1.0, 1), (None, 2.0, 1), ("c", None, 1)], schema)
    incoming = spark.createDataFrame([("a", 1.0, 2), (None, 3.0, 2), ("c", None, 2), ("d", 4.0, 2)], schema)
    got = sorted((str(r.k), r.action, r.at) for r in lifecycle.promote(current, incoming, ["k"], "value").collect())
    assert got == [("None", "restated", 2), ("None", "superseded", 1), ("a", "kept", 1), ("c", "kept", 1), ("d", "inserted", 2)]
    empty = spark.createDataFrame([], schema)
    assert lifecycle.promote(empty, empty, ["k"], "value").count() == 0


def test_cohorts_are_replaced_alone(spark, tmp_path):
    path = str(tmp_path / "ranks")
    rows = spark.createDataFrame([(1, "a", 1), (2, "a", 2), (1, "b", 1)], "agency int, metric string, rank int")
    sinks.replace_cohorts(rows, path, ["metric"])
    sinks.replace_cohorts(spark.createDataFrame([(3, "a", 1)], rows.schema), path, ["metric"])
    assert sorted((r.agency, r.metric) for r in spark.read.parquet(path).collect()) == [(1, "b"), (3, "a")]


def _events(spark, path, batches):
    for rows in batches:
        spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").coalesce(1).write.mode("append").parquet(path)


def test_streams(spark, tmp_path):
    day = lambda d, h=0: dt.datetime(2024, 1, d, h)
    path = str(tmp_path / "events")
    _events(spark, path, [[(1, day(1), 1, "a", 1.0), (2, day(1, 5), 1, "a", 2.0), (2, day(1, 5), 1, "a", 2.0)], [(3, day(20), 2, "b", 3.0)], [(6, day(20), 2, "b", 3.0)], [(4, day(2), 1, "a", 9.0), (5, day(21), 2, "b", 4.0)]])
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    source = lambda: streams.read_events(spark, path, schema, 1)
    q = streams.windowed_counts(source()).writeStream.format("memory").queryName("daily").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.start, r.n) for r in spark.table("daily").collect() if r.event_type == "a"] == [(day(1), 3)]  # the late one is left out
    q = streams.once(source()).writeStream.format("memory").queryName("once").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.event_id for r in spark.table("once").collect()) == [1, 2, 3, 5, 6]
    out = str(tmp_path / "versions")
    for _ in range(2):  # a second run finds nothing new
        streams.start_upserts(source(), ["user_id", "event_type"], ["ts", "event_id"], out, str(tmp_path / "c3")).awaitTermination(120)
    got = streams.newest(spark, out, ["user_id", "event_type"], ["ts", "event_id"]).collect()
    assert sorted((r.user_id, r.event_id) for r in got) == [(1, 4), (2, 5)]


def test_batches_become_bases(spark, tmp_path):
    path, out, day = str(tmp_path / "events"), str(tmp_path / "versions"), lambda d: dt.datetime(2024, 1, d)
    _events(spark, path, [[(k, day(k), k % 3, "a", float(k))] for k in range(1, 10)])
    keys, order = ["user_id", "event_type"], ["ts", "event_id"]
    changes = streams.read_events(spark, path, "event_id long, ts timestamp, user_id long, event_type string, value double", 1)
    streams.start_upserts(changes, keys, order, out, str(tmp_path / "c"), compact_every=2).awaitTermination(120)
    bases, batches = streams._folders(spark, out)
    assert sorted(bases) == [6, 8] and sorted(batches) == [6, 7, 8]  # one generation stays behind the last base
    want = [(0, 9), (1, 7), (2, 8)]
    assert sorted((r.user_id, r.event_id) for r in streams.newest(spark, out, keys, order).collect()) == want
    (tmp_path / "versions" / "base=8" / "_SUCCESS").unlink()  # a base that was cut short does not count
    assert sorted((r.user_id, r.event_id) for r in streams.newest(spark, out, keys, order).collect()) == want


def test_an_unknown_scale_stops_the_load(spark):
    rows = spark.createDataFrame([("2024-01", "A", "Trips", "dozens", "1", "")], "ref_date string, label string, measure string, scale string, value string, status string")
    good, _ = feeds.statistical_feed(rows, spark.createDataFrame([("A", 5)], "label string, agency_id long"), spark.createDataFrame([("Trips", "ridership")], "measure string, metric string"))
    with pytest.raises(Exception, match="unknown scale: dozens"):
        good.collect()


def test_annual_feed_sums_and_names_the_year_of_its_start(spark):
    rows = [("1", "2023", "5", "10", "7", "1", ""), ("1", "2023", "6", "", "3", "", ""), ("2", "2023", "1", "1", "1", "1", "1"), ("9", "2023", "1", "1", "1", "1", "1"), ("9", "2022", "1", "1", "1", "1", "1")]
    rows = spark.createDataFrame(rows, "source_id string, report_year string, fares string, expenses string, trips string, miles string, hours string")
    good, bad = feeds.annual_feed(rows, spark.createDataFrame([("1", 4, 6), ("2", 5, 12)], "source_id string, agency_id long, fye int"))
    got = {(r.agency_id, r.metric): (r.start_year, round(r.value, 6)) for r in good.collect()}
    assert got[(4, "farebox_revenue")] == (2022, 11.0) and got[(4, "ridership")] == (2022, 10.0) and (4, "revenue_service_hours") not in got
    assert got[(5, "vehicle_km")] == (2023, 1.609344) and [r.source_id for r in bad.collect()] == ["9"]


def test_csv_file_has_a_mark_and_line_ends(spark, tmp_path):
    rows = spark.createDataFrame([('a, "b"', None), ("c", 1.5)], "name string, value double").coalesce(1)
    sinks.write_csv(rows, ["name", "value"], str(tmp_path / "out"))
    text = next((tmp_path / "out").glob("part-*.csv")).read_bytes().decode("utf-8")
    assert text == '\ufeffname,value\r\n"a, ""b""",\r\nc,1.5\r\n'


def test_repository_appends_and_replaces_cohorts(spark, tmp_path):
    from ridgeline.operators.stores import Repository

    store = Repository(spark, str(tmp_path))
    rows = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "v int, k string, p int")
    store.append("values", rows)
    store.append("values", rows)
    assert store.read("values").count() == 4
    store.replace("ranks", rows, ["p", "k"])
    store.replace("ranks", spark.createDataFrame([(9, "a", 1)], "v int, k string, p int"), ["p", "k"])
    assert sorted((r.v, r.k) for r in store.read("ranks").collect()) == [(2, "b"), (9, "a")]


def test_promotion_keeps_rows_with_null_cells(spark):
    schema = "k long, value long, at timestamp, quality string, id long"
    now = spark.createDataFrame([(1, None, None, "a", 10), (2, 5, None, "a", 11), (3, 7, None, "a", 12)], schema)
    new = spark.createDataFrame([(1, None, None, "a", 20), (2, 5, None, "b", 21), (None, None, None, None, 22)], schema)
    got = lifecycle.promote(now, new, ["k"], "value", also=("quality",), id_col="id").collect()
    assert sorted((r.id, r.restates, r.is_current, r.action) for r in got) == [(10, None, True, "kept"), (11, None, False, "superseded"), (12, None, True, "kept"), (21, 11, True, "restated"), (22, None, True, "inserted")]


def test_solver_goes_both_ways_and_reports_conflicts(spark):
    schema = "k int, total_assets double, total_liabilities double, total_financial_assets double, accumulated_surplus double, net_debt double, total_non_financial_assets double"
    rows = [(1, None, 40.0, 30.0, 60.0, None, None), (2, None, 40.0, 30.0, 60.0, None, 10.0), (3, 100.0, None, None, None, None, None)]
    got = {(r.k, r.metric): r for r in solver.solve_all(spark.createDataFrame(rows, schema), ["k"]).collect()}
    assert (got[(1, "total_assets")].value, got[(1, "net_debt")].value, got[(1, "total_non_financial_assets")].value, got[(1, "debt_to_assets")].value) == (100.0, 10.0, 70.0, 0.4)
    assert got[(2, "total_assets")].conflict and got[(2, "total_assets")].value is None
    assert {m for k, m in got if k == 3} == {"total_assets"}


def test_solver_against_passes_by_hand(spark):
    """Random cells of the whole catalog, some of them made to disagree: values, equations, conflicts and weakness."""
    eqs = sorted(solver.STATEMENT_EQUATIONS, key=lambda e: e.code)
    metrics = list(dict.fromkeys(m for e in solver.STATEMENT_EQUATIONS for m in e.operands))

    def proposal(e, m, v):
        if any(v[o] is None for o in e.operands if o != m):
            return None
        if e.kind == "sum":
            off = v.get(e.total) if m != e.total else None
            plus, less = [v[p] for p in e.parts if p != m], [v[p] for p in e.minus if p != m]
            return sum(plus) - sum(less) if m == e.total else off - sum(plus) + sum(less) if m in e.parts else sum(plus) - sum(less) - off
        over, under = e.parts
        if m == over:
            return v[e.total] * v[under]
        by = v[under] if m == e.total else v[e.total]
        return v[over] / by if by else None

    def solve(v, q):
        source, odd = {}, set()
        while True:
            found, odd = {}, set()
            for m in metrics:
                if v[m] is None and m not in solver.ATTRIBUTES:
                    got = [(e, p) for e in eqs if m in e.operands and (p := proposal(e, m, v)) is not None]
                    if got and all(abs(p - got[0][1]) <= 0.02 * max(abs(p), abs(got[0][1])) for _, p in got):
                        found[m] = got[0]
                    elif got:
                        odd.add(m)
            if not found:
                return v, q, source, odd
            weak = {m: max(0, *(q[o] for o in e.operands if o != m)) for m, (e, _) in found.items()}
            for m, (e, p) in found.items():
                v[m], source[m], q[m] = p, e.code, weak[m]

    draw, rows = random.Random(3), []
    for k in range(60):
        cells = [float(draw.choice((0, 2, 3, 10, 50, 1000, -7))) if draw.random() < 0.4 else None for _ in metrics]
        rows.append((k, *cells, *[draw.randrange(4) for _ in metrics]))
    schema = "k long, " + ", ".join(f"{m} double" for m in metrics) + ", " + ", ".join(f"{m}__q int" for m in metrics)
    got = {(r.k, r.metric): r for r in solver.solve_all(spark.createDataFrame(rows, schema), ["k"], quality=True).collect()}
    seen = set()
    for k, *cells in rows:
        v, q, source, odd = solve(dict(zip(metrics, cells)), dict(zip(metrics, cells[len(metrics) :])))
        for m in (m for m in metrics if m not in solver.ATTRIBUTES):
            r = got.get((k, m))
            assert (r is not None) == (v[m] is not None or m in odd)
            if r is not None:
                assert (r.value is None) == (v[m] is None) and (r.value is None or r.value == pytest.approx(v[m], rel=1e-9, abs=1e-6))
                assert (r.equation, r.conflict, r.weakness) == (source.get(m), m in odd, q[m])
                seen.add((r.equation is not None, r.conflict))
    assert {(True, False), (False, True), (False, False)} <= seen
