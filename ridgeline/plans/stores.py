"""Registered queries on versioned stores, queues, staging, checks and derived values; each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline.functions import text as tx
from ridgeline.operators import checks, solver
from ridgeline.operators import facts as op
from ridgeline.operators import lifecycle as life
from ridgeline.operators import review as rv
from ridgeline.operators import stores as st
from ridgeline.plans.catalog import AGENCY_SQL, ANNUAL_SQL, FISCAL_SQL, M_SQL, _annual, fiscal_rollup
from ridgeline.sources import feeds
from ridgeline.sources.frames import agency, monthly, table
from ridgeline.sources.sinks import formula_grid

MODES = ("bus", "rail", "ferry")
STATES = ("pending", "approved", "rejected")
QUALITY = ("verified", "preliminary", "estimated", "odd")
VALUES_SQL = """SELECT event_id AS value_id, user_id AS agency_id, event_type AS metric, CAST(ts AS DATE) AS day, value,
    CASE event_id % 4 WHEN 1 THEN 'bus' WHEN 2 THEN 'rail' WHEN 3 THEN 'ferry' END AS mode, event_id % 11 / 10 AS confidence,
    CASE event_id % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'approved' ELSE 'rejected' END AS status,
    CASE event_id % 4 WHEN 0 THEN 'verified' WHEN 1 THEN 'preliminary' WHEN 2 THEN 'estimated' ELSE 'odd' END AS quality,
    row_number() OVER (PARTITION BY user_id, event_type, event_id % 4 ORDER BY ts DESC, event_id DESC) = 1 AS is_current FROM events"""


def _values(spark: SparkSession, d: str) -> DataFrame:
    """The event table read as versioned values: by agency, metric and mode (null: system-wide) the newest is current."""
    k = F.col("event_id")
    pick = lambda names, at: F.element_at(F.array(*map(F.lit, names)), at.cast("int"))
    rows = table(spark, d, "events").select(
        k.alias("value_id"), F.col("user_id").alias("agency_id"), F.col("event_type").alias("metric"), F.to_date("ts").alias("day"), "ts", "value",
        F.when(k % 4 > 0, pick(MODES, F.greatest(k % 4, F.lit(1)))).alias("mode"), (k % 11 / 10).alias("confidence"),
        pick(STATES, k % 3 + 1).alias("status"), pick(QUALITY, k % 4 + 1).alias("quality"),
    )
    newest = Window.partitionBy("agency_id", "metric", "mode").orderBy(F.desc("ts"), F.desc("value_id"))
    return rows.withColumn("is_current", F.row_number().over(newest) == 1).drop("ts")


def annual_feed(spark: SparkSession, d: str) -> DataFrame:
    cell = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("string")
    rows = table(spark, d, "lineitem").groupBy(F.concat(F.lit("T"), F.col("l_suppkey").cast("string")).alias("source_id"), F.year("l_shipdate").alias("report_year"), "l_returnflag", "l_linestatus")
    rows = rows.agg(cell("l_extendedprice").alias("expenses"), F.when(F.col("l_returnflag") == "N", "").otherwise(cell("l_extendedprice")).alias("fares"), cell("l_quantity").alias("trips"), cell("l_quantity").alias("miles"), F.count("*").cast("string").alias("hours"))
    known = agency(spark, d).select(F.concat(F.lit("T"), F.col("agency_id").cast("string")).alias("source_id"), "agency_id", "fye")
    return feeds.annual_feed(rows, known)[0]


def current_scan(spark: SparkSession, d: str) -> DataFrame:
    return st.current_of(_values(spark, d), ("purchase", "view"), "2024-01-10", "2024-01-20").select("value_id", "agency_id", "metric", "mode", "value")


def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    return st.lookup(_values(spark, d), metric="purchase", mode=None).select("value_id", "agency_id", "value")


def system_wide_values(spark: SparkSession, d: str) -> DataFrame:
    return st.system_wide(_values(spark, d)).select("value_id", "agency_id", "metric", "value")


def pending_queue(spark: SparkSession, d: str) -> DataFrame:
    return _values(spark, d).filter("status = 'pending'").select("value_id", "agency_id", "metric", "confidence").orderBy("value_id")


def period_scan(spark: SparkSession, d: str) -> DataFrame:
    """The months that have orders, in order of their end."""
    start = F.to_date(F.date_trunc("month", "o_orderdate"))
    return table(spark, d, "orders").select(start.alias("start_date"), F.last_day(start).alias("end_date")).distinct().orderBy("end_date")


def document_queue(spark: SparkSession, d: str) -> DataFrame:
    """Documents by their scan state, failed first, then waiting, then done, then any other."""
    state = F.when(F.col("source").isNull(), "lost").when(F.trim(F.coalesce("text", F.lit(""))) == "", "failed").when(F.col("n_chars") < 400, "unscanned").otherwise("scanned")
    rows = table(spark, d, "documents").select("doc_id", state.alias("status"))
    return rows.withColumn("place", st.in_status_order("status", ("failed", "unscanned", "scanned"))).orderBy("place", "doc_id")


def off_statement_drop(spark: SparkSession, d: str) -> DataFrame:
    """Readings whose code is none of the statement's."""
    codes = spark.createDataFrame([("purchase",), ("signup",)], "metric string")
    return _values(spark, d).join(F.broadcast(codes), "metric", "left_semi").groupBy("metric").agg(F.count("*").alias("n"), F.min("value_id").alias("first_id"))  # a fixed list


def review_queue(spark: SparkSession, d: str) -> DataFrame:
    """What waits with flags, sorted by agency, metric and id."""
    low = lambda: F.when(F.col("confidence") < 0.3, "low_confidence")
    odd = lambda: F.when(F.col("quality") == "odd", "odd_quality")
    rows = checks.validate(_values(spark, d).filter("status = 'pending'"), low, odd)
    return rows.filter(F.size("flags") > 0).select("agency_id", "metric", "value_id", F.array_join("flags", ",").alias("flags")).orderBy("agency_id", "metric", "value_id")


def gold_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Readings that may become known values: of no mode or all of bus, surest first, of no planned basis."""
    rows = _values(spark, d).filter(F.coalesce("mode", F.lit("bus")) == "bus").filter("quality <> 'estimated'")
    return op.latest(rows, ["agency_id", "metric"], [F.desc("confidence"), F.col("value_id")]).select("agency_id", "metric", "value_id", "confidence")


def candidate_json(spark: SparkSession, d: str) -> DataFrame:
    """The same as one JSON list an agency."""
    rows = gold_candidates(spark, d).groupBy("agency_id").agg(F.array_sort(F.collect_list(F.struct("metric", "value_id"))).alias("records"))
    return rows.select("agency_id", F.to_json("records").alias("json"))


def gold_scan(spark: SparkSession, d: str) -> DataFrame:
    """Those lists read back into rows."""
    rows = candidate_json(spark, d).select("agency_id", F.from_json("json", "array<struct<metric:string,value_id:bigint>>").alias("r"))
    return rows.select("agency_id", F.inline("r"))


def agency_by_slug(spark: SparkSession, d: str) -> DataFrame:
    """One agency by its slug."""
    return agency(spark, d).withColumn("slug", tx.slug(F.col("agency_name"))).filter("slug = 'supplier-000000003'").orderBy("agency_id").limit(1).select("agency_id", "slug", "currency")


def directory_search(spark: SparkSession, d: str) -> DataFrame:
    return st.search(agency(spark, d), " ASIA ", "agency_name", "subdivision").select("agency_id", "agency_name", "subdivision")


def pending_documents(spark: SparkSession, d: str) -> DataFrame:
    """What waits beside its document; without one it waits as well."""
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return _values(spark, d).filter("status = 'pending'").select("value_id", (F.col("value_id") * 2).alias("doc_id")).join(docs, "doc_id", "left")


def value_sources(spark: SparkSession, d: str) -> DataFrame:
    bridge = _values(spark, d).select("value_id", F.floor(F.col("value_id") / 3).alias("doc_id"))
    return st.provenance(_values(spark, d).select("value_id", "metric"), bridge, table(spark, d, "documents").select("doc_id", "source", "lang")).groupBy("metric", "source").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


def rank_low_is_better(spark: SparkSession, d: str) -> DataFrame:
    return op.competition_ranks(_annual(spark, d), agency(spark, d), lower=("operating_expenses",))


def rated_only_filter(spark: SparkSession, d: str) -> DataFrame:
    return op.competition_ranks(_annual(spark, d), agency(spark, d), rated=("ridership", "farebox_revenue"))


def direction_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = _annual(spark, d).select("metric").distinct()
    lower, neutral = ("operating_expenses",), ("revenue_service_hours",)
    return rows.select("metric", op.direction(F.col("metric"), lower, neutral).alias("direction"), tx.direction_word(F.col("metric"), lower, neutral).alias("words"))


def locale_sorted(spark: SparkSession, d: str) -> DataFrame:
    """Agencies by name as readers sort it, case and accents aside, with their place."""
    rows = agency(spark, d).select("agency_id", "agency_name")
    return life.number_sorted(rows, [F.collate("agency_name", "UNICODE_CI"), "agency_id"]).select("agency_id", "nth")


def periods_seen(spark: SparkSession, d: str) -> DataFrame:
    """Agencies and modes seen at any grain."""
    days = _values(spark, d).select("agency_id", "mode")
    return days.union(agency(spark, d).select("agency_id", F.lit(None).cast("string"))).distinct()


def approved_and_flagged(spark: SparkSession, d: str) -> DataFrame:
    rows = _values(spark, d)
    good = rows.filter("status = 'approved'").select("value_id", F.lit("approved").alias("why"))
    return good.unionByName(rows.filter("status <> 'approved' AND confidence < 0.3").select("value_id", F.lit("flagged").alias("why")))


def staged_ids(spark: SparkSession, d: str) -> DataFrame:
    """New rows are numbered on from the pending table's largest id, in order of their day and id."""
    rows = _values(spark, d).select("value_id", "day")
    before = rows.filter("day < '2024-01-10'").select(F.col("value_id").alias("id"))
    return life.stage(before, rows.filter("day >= '2024-01-10'"), F.col("day"), ["day", "value_id"]).select("value_id", "id", "status")


def feed_run_log(spark: SparkSession, d: str) -> DataFrame:
    """A run an hour and feed: nothing of value is a stall, another set of properties a break."""
    rows = table(spark, d, "events").groupBy(F.col("event_type").alias("feed"), F.date_trunc("hour", "ts").alias("started"))
    runs = rows.agg(F.count_if(F.col("value") > 20).alias("records"), F.sha2(F.when(F.max("event_id") % 5 == 0, "b").otherwise("a"), 256).alias("fingerprint"))
    return st.feed_log(runs, F.sha2(F.lit("a"), 256)).select("feed", "started", "records", "status")


def dictionary_lines(spark: SparkSession, d: str) -> DataFrame:
    """A reference page: a heading a type, and its entries as a list."""
    rows = table(spark, d, "part").groupBy("p_type", "p_brand").agg(F.count("*").alias("n"))
    entry = F.concat(F.lit("- "), "p_brand", F.lit(": "), F.col("n").cast("string"))
    rows = rows.groupBy("p_type").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    return rows.select("p_type", F.concat(F.lit("## "), "p_type", F.lit("\n"), F.array_join("entries", "\n")).alias("page"))


def export_grid(spark: SparkSession, d: str) -> DataFrame:
    """An agency's quarters side by side, and the formula that sums them on the sheet."""
    q = lambda k: F.sum(F.when(F.quarter("month") == k, F.col("ridership"))).alias(f"q{k}")
    wide = monthly(spark, d).groupBy("agency_id", F.year("month").alias("year")).agg(*map(q, (1, 2, 3, 4))).withColumn("row", F.col("year") - 1990)
    return formula_grid(wide, ["agency_id", "year"], ["q1", "q2", "q3", "q4"], "row")


def _loads(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "events").select("user_id", "event_type", "ts", "event_id", F.floor(F.col("value") / 25).cast("long").alias("value"), (F.col("event_id") % 2).alias("quality"))
    sides = (op.latest(rows.filter(c), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]) for c in ("ts < '2024-01-15'", "ts >= '2024-01-15'"))
    return tuple(s.select("user_id", "event_type", "value", F.col("ts").alias("at"), "quality", F.col("event_id").alias("id")) for s in sides)


PROMOTED_SQL = """e AS (SELECT user_id, event_type, ts, event_id, CAST(floor(value / 25) AS BIGINT) AS value, event_id % 2 AS quality FROM events),
    o AS (SELECT * FROM e WHERE ts < TIMESTAMP '2024-01-15' QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1),
    n AS (SELECT * FROM e WHERE ts >= TIMESTAMP '2024-01-15' QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1),
    j AS (SELECT o.event_id AS oid, n.event_id AS nid, o.event_id IS NOT NULL AND n.event_id IS NOT NULL AND (o.value IS DISTINCT FROM n.value OR o.quality <> n.quality) AS changed
          FROM o FULL JOIN n ON o.user_id IS NOT DISTINCT FROM n.user_id AND o.event_type IS NOT DISTINCT FROM n.event_type)"""


def promote_quality_change(spark: SparkSession, d: str) -> DataFrame:
    """A load in which a changed quality alone supersedes; the new row names the one it restates."""
    return life.promote(*_loads(spark, d), ["user_id", "event_type"], "value", also=("quality",), id_col="id").select("id", "restates", "is_current", "action")


def load_counters(spark: SparkSession, d: str) -> DataFrame:
    current, incoming = _loads(spark, d)
    return life.load_counts(life.promote(current, incoming, ["user_id", "event_type"], "value", also=("quality",)), incoming)


def slow_promote(spark: SparkSession, d: str) -> DataFrame:
    return life.slow_promote(_values(spark, d).withColumn("promoted", F.col("mode") == "bus")).select("value_id", "promoted")


def reset_half_done(spark: SparkSession, d: str) -> DataFrame:
    rows = _values(spark, d)
    current = rows.filter("is_current AND confidence >= 0.5").select("agency_id", "metric", "mode")
    return life.reset_half_done(rows.select("value_id", "agency_id", "metric", "mode", "status"), current, ["agency_id", "metric", "mode"]).select("value_id", "status", "note")


def reclassify_split(spark: SparkSession, d: str) -> DataFrame:
    rows = fiscal_rollup(spark, d).select("agency_id", "metric", "start_year", "period_type")
    return life.reclassify(rows, "metric", "ridership", {"annual": "ridership_year", "ytd": "ridership_so_far"})


def wipe_dry_run(spark: SparkSession, d: str) -> DataFrame:
    chain = Window.partitionBy("user_id").orderBy("event_id")
    values = table(spark, d, "events").select("event_id", F.col("event_type").alias("source"), F.lag("event_id").over(chain).alias("restates"))
    return life.wipe_counts(values, spark.createDataFrame([("error",), ("signup",)], "source string"), "source", "restates", "event_id")


def catalog_sync(spark: SparkSession, d: str) -> DataFrame:
    """Files by their names: kind by exact stem or longest prefix, year, the key they are stored under, or why they are skipped."""
    stem = F.concat_ws("-", tx.slug(F.col("p_name")), F.col("p_brand"), (F.col("p_size") + 1970).cast("string"))
    rows = table(spark, d, "part").select("p_partkey", stem.alias("stem"))
    kind, year = tx.file_kind(F.col("stem"), FILE_RULES, {}), tx.file_year(F.col("stem"))
    out = rows.withColumns({"kind": kind, "year": year})
    why = F.when(F.col("kind").isNull(), "unknown name").when(F.col("year").isNull(), "no year")
    return out.select("p_partkey", "kind", "year", F.when(why.isNull(), F.concat_ws("/", "kind", F.col("year").cast("string"), F.concat("stem", F.lit(".pdf")))).alias("key"), why.alias("skipped"))


FILE_RULES = {"small": "report", "small-r": "service_plan", "large": "statement", "eco": "budget"}


def feeds_left_join(spark: SparkSession, d: str) -> DataFrame:
    """Feeds with their newest run; those that never ran are listed too."""
    known = spark.createDataFrame([("view",), ("purchase",), ("never",)], "feed string")
    runs = table(spark, d, "events").groupBy(F.col("event_type").alias("feed")).agg(F.max("event_id").alias("last_run"))
    return known.join(runs, "feed", "left")


def orphan_rows(spark: SparkSession, d: str) -> DataFrame:
    """Broken references by kind: what a foreign key or a check would refuse."""
    lines, parts = table(spark, d, "lineitem"), table(spark, d, "part").filter("p_size > 5")
    fk = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"), "left_anti").agg(F.count("*").alias("n")).select(F.lit("fk_part").alias("rule"), "n")
    return fk.unionByName(lines.filter("NOT (l_discount BETWEEN 0 AND 0.05)").agg(F.count("*").alias("n")).select(F.lit("check_discount").alias("rule"), "n"))


def relative_gaps(spark: SparkSession, d: str) -> DataFrame:
    return monthly(spark, d).select("agency_id", "month", checks.relative_gap(F.col("farebox_revenue"), F.col("operating_expenses")).alias("gap"))


def _known(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("agency_id") % 3
    return monthly(spark, d).select("agency_id", "month", (F.col("ridership") * F.when(k == 0, 1.03).otherwise(1.0)).alias("true_value"), F.lit(0.02).alias("tolerance"), (k == 1).alias("should_flag"))


def gold_tolerance(spark: SparkSession, d: str) -> DataFrame:
    rows = _known(spark, d).join(monthly(spark, d).select("agency_id", "month", "ridership"), ["agency_id", "month"])
    return rows.select("agency_id", "month", checks.within(F.col("ridership"), F.col("true_value"), F.col("tolerance")).alias("good"))


def staged_evaluation(spark: SparkSession, d: str) -> DataFrame:
    staged = monthly(spark, d).select("agency_id", "month", F.when(F.month("month") != 5, F.col("ridership")).alias("value"), (F.col("agency_id") % 2 == 1).alias("flagged"))
    return checks.assess(staged, _known(spark, d), ["agency_id", "month"])


def lenient_digits(spark: SparkSession, d: str) -> DataFrame:
    printed = F.col("l_extendedprice").cast("decimal(18,2)").cast("string")
    quote = F.concat(F.lit("total "), F.when(F.col("l_linenumber") % 2 == 0, F.replace(printed, F.lit("."), F.lit(" "))).when(F.col("l_linenumber") % 3 == 0, "none").otherwise(printed))
    return table(spark, d, "lineitem").groupBy("l_linenumber").agg(F.count_if(tx.printed_digits(quote, printed)).alias("held"), F.count("*").alias("n"))


def province_names(spark: SparkSession, d: str) -> DataFrame:
    """Codes as names; an unknown code stands for itself, none for 'Other'."""
    names = spark.createDataFrame([("PROMO", "Promotion"), ("SMALL", "Small goods")], "p_type string, name string")
    rows = table(spark, d, "part").withColumn("p_type", F.when(F.col("p_size") > 3, F.col("p_type"))).join(F.broadcast(names), "p_type", "left")  # a fixed list
    return rows.groupBy(F.coalesce("name", "p_type", F.lit("Other")).alias("name")).agg(F.count("*").alias("n"))


def conflict_notes(spark: SparkSession, d: str) -> DataFrame:
    """The readings that a conflict note lists; a note with anything else in it gives none."""
    second = F.when(F.col("p_size") % 3 == 0, "n/a").otherwise((F.col("p_size") * 1000).cast("string"))
    note = F.when(F.col("p_size") % 7 != 0, F.concat(F.lit("page 3; conflict: 1,200 | "), second, F.lit("; end")))
    got = tx.conflict_candidates(note)
    return table(spark, d, "part").select("p_partkey", F.size(got).alias("n"), F.array_max(got).alias("largest"))


def scale_declarations(spark: SparkSession, d: str) -> DataFrame:
    head = F.when(F.col("p_size") % 3 == 0, "# Statement (in thousands)").when(F.col("p_size") % 3 == 1, "Amounts in MILLIONS of dollars").otherwise("## Notes")
    return table(spark, d, "part").select("p_partkey", tx.declared_scale(head).cast("long").alias("scale"), tx.is_heading(head).alias("heading"))


def array_edits(spark: SparkSession, d: str) -> DataFrame:
    """Sets of types by user: one renamed, without twins, in alphabetical order."""
    rows = table(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("t"))
    new = F.when(F.array_contains("t", "click"), F.array_append(F.array_remove("t", "click"), F.lit("tap"))).otherwise(F.col("t"))
    return rows.select("user_id", F.array_join(F.array_sort(F.array_distinct(new)), ",").alias("types"))


def json_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Records as JSON and back: amounts as text, days as ISO."""
    rows = table(spark, d, "orders").select("o_orderkey", F.to_json(F.struct(F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("amount"), F.to_date("o_orderdate").alias("day"))).alias("j"))
    back = F.from_json("j", "amount string, day date")
    return rows.select("o_orderkey", back["amount"].cast("double").alias("amount"), back["day"].alias("day"))


def row_to_value(spark: SparkSession, d: str) -> DataFrame:
    """A printed row as a value: number, scale, sign, and confidence capped where the quote does not bear it out."""
    k = F.col("l_linenumber") % 3
    printed = F.col("l_extendedprice").cast("decimal(18,2)").cast("string")
    quote = F.when(k == 0, F.concat(F.lit("cost "), printed)).when(k == 1, F.lit("cost 1")).otherwise(F.lit(None))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *rv.row_value(printed, F.when(k == 1, "thousands").otherwise("units"), k == 2, quote, F.lit(0.9)))


def replay_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("doc"), F.concat_ws("-", "l_partkey", "l_returnflag").alias("key"), F.col("l_quantity").alias("value"), F.round(1 - F.col("l_tax") * 10, 2).alias("confidence"),
        F.when(F.col("l_linenumber") % 3 == 0, "supported").when(F.col("l_linenumber") % 3 == 1, "mismatch").otherwise("missing").alias("support"),
    )
    return checks.replay(rows, "doc")


def _statement_rows(spark: SparkSession, d: str) -> DataFrame:
    """A month's printed figures: fares and other revenue, expenses in two parts that are off at every sixth agency."""
    m = monthly(spark, d).withColumn("total_revenue_excluding_subsidy", F.col("farebox_revenue") + 1000)
    m = m.withColumn("other_revenue", F.when(F.col("agency_id") % 6 == 0, F.col("farebox_revenue") + 500000).otherwise(1000.0))
    return m.unpivot(["agency_id", "month"], ["farebox_revenue", "other_revenue", "total_revenue_excluding_subsidy", "operating_expenses"], "metric", "value")


STATEMENT_SQL = f"""m AS (SELECT *, farebox_revenue + 1000 AS total, CASE WHEN agency_id % 6 = 0 THEN farebox_revenue + 500000 ELSE 1000.0 END AS other FROM ({M_SQL})),
    s AS (SELECT agency_id, month, 'farebox_revenue' AS metric, farebox_revenue AS value FROM m UNION ALL SELECT agency_id, month, 'other_revenue', other FROM m
          UNION ALL SELECT agency_id, month, 'total_revenue_excluding_subsidy', total FROM m UNION ALL SELECT agency_id, month, 'operating_expenses', operating_expenses FROM m)"""


def cohort_failures(spark: SparkSession, d: str) -> DataFrame:
    rows = _statement_rows(spark, d).select("agency_id", "month", F.lit("total").alias("scope"), F.lit("operating").alias("basis"), "metric", "value")
    return checks.cohort_failures(rows, ["agency_id", "month"])


def document_reconcile(spark: SparkSession, d: str) -> DataFrame:
    return checks.reconcile_document(_statement_rows(spark, d), ["agency_id", "month"])


def _hidden(spark: SparkSession, d: str) -> DataFrame:
    """Months of which every third prints the cost per rider instead of the expenses."""
    hide = F.month("month") % 3 == 0
    return monthly(spark, d).select(
        "agency_id", "month", "ridership", "farebox_revenue", "revenue_service_hours", (F.col("farebox_revenue") + 1000).alias("total_revenue_excluding_subsidy"),
        F.when(~hide, F.col("operating_expenses")).alias("operating_expenses"), F.when(hide, F.col("operating_expenses") / F.col("ridership")).alias("cost_per_rider"),
    )


SOLVED_SQL = f"""h AS (SELECT *, farebox_revenue + 1000 AS t, month(month) % 3 = 0 AS hide, CASE WHEN month(month) % 3 = 0 THEN operating_expenses / ridership * ridership ELSE operating_expenses END AS e FROM ({M_SQL})),
    r AS (SELECT agency_id, month, 'operating_expenses' AS metric, e AS value, 'cost_per_rider_def' AS equation FROM h WHERE hide
          UNION ALL SELECT agency_id, month, 'cost_per_rider', e / ridership, 'cost_per_rider_def' FROM h WHERE NOT hide
          UNION ALL SELECT agency_id, month, 'subsidy', e - t, 'expense_revenue_subsidy' FROM h
          UNION ALL SELECT agency_id, month, 'other_revenue', t - farebox_revenue, 'earned_revenue_components' FROM h
          UNION ALL SELECT agency_id, month, 'total_revenue', t + (e - t), 'total_revenue_def' FROM h
          UNION ALL SELECT agency_id, month, 'average_fare', farebox_revenue / ridership, 'average_fare_def' FROM h
          UNION ALL SELECT agency_id, month, 'cost_per_hour', e / revenue_service_hours, 'cost_per_hour_def' FROM h
          UNION ALL SELECT agency_id, month, 'farebox_recovery_ratio', farebox_revenue / e, 'farebox_recovery_def' FROM h
          UNION ALL SELECT agency_id, month, 'subsidy_per_rider', (e - t) / ridership, 'subsidy_per_rider_def' FROM h
          UNION ALL SELECT agency_id, month, 'trips_per_revenue_hour', ridership / revenue_service_hours, 'trips_per_revenue_hour_def' FROM h)"""


def solve_backsolve(spark: SparkSession, d: str) -> DataFrame:
    """The whole catalog of equations on what is printed: forwards, and backwards where expenses are not."""
    out = solver.solve_all(_hidden(spark, d), ["agency_id", "month"]).filter("equation IS NOT NULL")
    return out.select("agency_id", "month", "metric", "value", "equation")


def lineage_edges(spark: SparkSession, d: str) -> DataFrame:
    solved = solver.solve_all(_hidden(spark, d), ["agency_id", "month"])
    return solver.edges(solved, ["agency_id", "month"]).groupBy("metric", "equation", "input").agg(F.count("*").alias("n"))


def psab_normalize(spark: SparkSession, d: str) -> DataFrame:
    """Recomputed costs per rider: total-basis expenses lose their amortization, or else taint what comes of them."""
    m, k = monthly(spark, d), F.col("agency_id") % 4
    total, known = k >= 2, k == 2
    cells = F.array(*[F.struct(F.lit(a).alias("metric"), v.alias("value"), F.lit(q).alias("quality"), b.alias("cost_basis")) for a, v, q, b in (
        ("operating_expenses", F.col("operating_expenses"), "preliminary", F.when(total, "psab_total").otherwise("operating")),
        ("amortization", F.when(known, F.lit(100.0)), "verified", F.lit("operating")),
        ("ridership", F.col("ridership"), "verified", F.lit("operating")),
    )])
    rows = m.select("agency_id", "month", F.inline(cells)).filter("value IS NOT NULL").withColumn("derived", F.lit(False))
    out = solver.recompute(rows, ["agency_id", "month"], rated=("cost_per_rider",))
    return out.select("agency_id", "month", "metric", "value", "quality", "comparable")


def weakest_of_inputs(spark: SparkSession, d: str) -> DataFrame:
    """The weakest quality by agency: unknown ones count as the strongest, and none at all is verified."""
    rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for q in solver.QUALITIES.items() for x in q]), F.col("quality")), F.lit(0))
    rows = agency(spark, d).select("agency_id").join(_values(spark, d).select("agency_id", "quality"), "agency_id", "left")
    names = F.array(*map(F.lit, solver.QUALITIES))
    return rows.groupBy("agency_id").agg(F.element_at(names, F.coalesce(F.max(rank), F.lit(0)) + 1).alias("quality"))


RANKS_SQL = """WITH v AS (SELECT v.*, subdivision, CASE WHEN metric IN ('farebox_revenue', 'operating_expenses') AND currency = 'CAD' THEN value * CAST(0.7 AS DOUBLE) ELSE value END AS basis
        FROM ({annual}) v JOIN ({agency}) a USING (agency_id) {where}),
    o AS (SELECT *, CASE WHEN {lower} THEN basis ELSE -basis END AS k FROM v),
    r AS (SELECT agency_id, metric, start_year, 'all' AS comparison, rank() OVER (PARTITION BY metric, start_year ORDER BY k) AS rank, count(*) OVER (PARTITION BY metric, start_year) AS "of", basis FROM o
          UNION ALL SELECT agency_id, metric, start_year, 'subdivision', rank() OVER (PARTITION BY metric, start_year, subdivision ORDER BY k), count(*) OVER (PARTITION BY metric, start_year, subdivision), basis FROM o)
    SELECT * FROM r WHERE "of" >= 5"""
GOLD_SQL = f"""SELECT agency_id, metric, value_id, confidence FROM ({VALUES_SQL}) WHERE coalesce(mode, 'bus') = 'bus' AND quality <> 'estimated'
    QUALIFY row_number() OVER (PARTITION BY agency_id, metric ORDER BY confidence DESC, value_id) = 1"""
KNOWN_SQL = f"SELECT agency_id, month, ridership, ridership * CAST(CASE WHEN agency_id % 3 = 0 THEN 1.03 ELSE 1.0 END AS DOUBLE) AS true_value FROM ({M_SQL})"

SQL = {
    "annual_feed": f"""WITH a AS ({AGENCY_SQL}), f AS (SELECT l_suppkey AS agency_id, fye, CAST(year(l_shipdate) - CASE WHEN fye <> 12 THEN 1 ELSE 0 END AS BIGINT) AS start_year, l_returnflag AS f,
            CAST(l_extendedprice AS DECIMAL(18,2)) AS e, CAST(l_quantity AS DECIMAL(18,2)) AS q FROM lineitem JOIN a ON l_suppkey = agency_id),
        g AS (SELECT agency_id, start_year, CAST(sum(e) FILTER (f <> 'N') AS DOUBLE) AS fares, CAST(sum(e) AS DOUBLE) AS expenses, CAST(sum(q) AS DOUBLE) AS trips, CAST(count(*) AS DOUBLE) AS hours FROM f GROUP BY ALL)
        SELECT agency_id, 'farebox_revenue' AS metric, start_year, fares AS value FROM g WHERE fares IS NOT NULL UNION ALL SELECT agency_id, 'operating_expenses', start_year, expenses FROM g
        UNION ALL SELECT agency_id, 'ridership', start_year, trips FROM g UNION ALL SELECT agency_id, 'vehicle_km', start_year, trips * CAST(1.609344 AS DOUBLE) FROM g UNION ALL SELECT agency_id, 'revenue_service_hours', start_year, hours FROM g""",
    "current_scan": f"SELECT value_id, agency_id, metric, mode, value FROM ({VALUES_SQL}) WHERE is_current AND metric IN ('purchase', 'view') AND day BETWEEN DATE '2024-01-10' AND DATE '2024-01-20'",
    "point_lookup": f"SELECT value_id, agency_id, value FROM ({VALUES_SQL}) WHERE is_current AND metric = 'purchase' AND mode IS NULL",
    "system_wide_values": f"SELECT value_id, agency_id, metric, value FROM ({VALUES_SQL}) WHERE is_current AND mode IS NULL",
    "pending_queue": f"SELECT value_id, agency_id, metric, confidence FROM ({VALUES_SQL}) WHERE status = 'pending' ORDER BY value_id",
    "period_scan": "SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS start_date, last_day(o_orderdate) AS end_date FROM orders ORDER BY end_date",
    "document_queue": """WITH s AS (SELECT doc_id, CASE WHEN source IS NULL THEN 'lost' WHEN trim(coalesce(text, '')) = '' THEN 'failed' WHEN n_chars < 400 THEN 'unscanned' ELSE 'scanned' END AS status FROM documents)
        SELECT *, CASE status WHEN 'failed' THEN 0 WHEN 'unscanned' THEN 1 WHEN 'scanned' THEN 2 ELSE 3 END AS place FROM s ORDER BY place, doc_id""",
    "off_statement_drop": "SELECT event_type AS metric, count(*) AS n, min(event_id) AS first_id FROM events WHERE event_type IN ('purchase', 'signup') GROUP BY 1",
    "review_queue": f"""SELECT agency_id, metric, value_id, concat_ws(',', CASE WHEN confidence < 0.3 THEN 'low_confidence' END, CASE WHEN quality = 'odd' THEN 'odd_quality' END) AS flags
        FROM ({VALUES_SQL}) WHERE status = 'pending' AND (confidence < 0.3 OR quality = 'odd') ORDER BY agency_id, metric, value_id""",
    "gold_candidates": GOLD_SQL,
    "candidate_json": f"""SELECT agency_id, '[' || string_agg('{{"metric":"' || metric || '","value_id":' || value_id || '}}', ',' ORDER BY metric) || ']' AS json FROM ({GOLD_SQL}) GROUP BY agency_id""",
    "gold_scan": f"SELECT agency_id, metric, value_id FROM ({GOLD_SQL})",
    "agency_by_slug": f"SELECT agency_id, slug, currency FROM (SELECT *, regexp_replace(regexp_replace(lower(agency_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM ({AGENCY_SQL})) WHERE slug = 'supplier-000000003' ORDER BY agency_id LIMIT 1",
    "directory_search": f"SELECT agency_id, agency_name, subdivision FROM ({AGENCY_SQL}) WHERE contains(lower(agency_name), 'asia') OR contains(lower(subdivision), 'asia')",
    "pending_documents": f"SELECT value_id, value_id * 2 AS doc_id, lang FROM ({VALUES_SQL}) v LEFT JOIN documents d ON d.doc_id = value_id * 2 WHERE status = 'pending'",
    "value_sources": f"SELECT metric, source, count(*) AS n, count(DISTINCT doc_id) AS docs FROM ({VALUES_SQL}) JOIN documents ON doc_id = value_id // 3 GROUP BY ALL",
    "rank_low_is_better": RANKS_SQL.format(annual=ANNUAL_SQL, agency=AGENCY_SQL, where="", lower="metric = 'operating_expenses'"),
    "rated_only_filter": RANKS_SQL.format(annual=ANNUAL_SQL, agency=AGENCY_SQL, where="WHERE metric IN ('ridership', 'farebox_revenue')", lower="false"),
    "direction_labels": """SELECT * FROM (VALUES ('ridership', 'higher', 'higher is better'), ('farebox_revenue', 'higher', 'higher is better'), ('operating_expenses', 'lower', 'lower is better'),
        ('revenue_service_hours', 'neutral', 'no better end')) v(metric, direction, words)""",
    "locale_sorted": f"SELECT agency_id, row_number() OVER (ORDER BY lower(agency_name), agency_id) AS nth FROM ({AGENCY_SQL})",
    "periods_seen": f"SELECT agency_id, mode FROM ({VALUES_SQL}) UNION SELECT agency_id, NULL FROM ({AGENCY_SQL})",
    "approved_and_flagged": f"SELECT value_id, 'approved' AS why FROM ({VALUES_SQL}) WHERE status = 'approved' UNION ALL SELECT value_id, 'flagged' FROM ({VALUES_SQL}) WHERE status <> 'approved' AND confidence < 0.3",
    "staged_ids": f"""WITH v AS ({VALUES_SQL}) SELECT value_id, (SELECT coalesce(max(value_id), 0) FROM v WHERE day < DATE '2024-01-10') + row_number() OVER (ORDER BY day, value_id) AS id, 'pending' AS status
        FROM v WHERE day >= DATE '2024-01-10'""",
    "feed_run_log": """WITH r AS (SELECT event_type AS feed, date_trunc('hour', ts) AS started, count(*) FILTER (value > 20) AS records, max(event_id) % 5 = 0 AS odd FROM events GROUP BY ALL)
        SELECT feed, started, records, CASE WHEN odd THEN 'schema_break' WHEN records = 0 THEN 'stalled' ELSE 'ok' END AS status FROM r""",
    "dictionary_lines": """WITH g AS (SELECT p_type, '- ' || p_brand || ': ' || count(*) AS entry FROM part GROUP BY p_type, p_brand)
        SELECT p_type, '## ' || p_type || '\n' || string_agg(entry, '\n' ORDER BY entry) AS page FROM g GROUP BY p_type""",
    "export_grid": "SELECT agency_id, year(month) AS year, " + ", ".join(f"sum(ridership) FILTER (quarter(month) = {k}) AS q{k}" for k in (1, 2, 3, 4)) + f", '=SUM(C' || (year(month) - 1990) || ':F' || (year(month) - 1990) || ')' AS total FROM ({M_SQL}) GROUP BY agency_id, year(month)",
    "promote_quality_change": f"""WITH {PROMOTED_SQL} SELECT oid AS id, CAST(NULL AS BIGINT) AS restates, NOT changed AS is_current, CASE WHEN changed THEN 'superseded' ELSE 'kept' END AS action FROM j WHERE oid IS NOT NULL
        UNION ALL SELECT nid, CASE WHEN changed THEN oid END, true, CASE WHEN changed THEN 'restated' ELSE 'inserted' END FROM j WHERE oid IS NULL OR changed""",
    "load_counters": f"WITH {PROMOTED_SQL} SELECT count(*) FILTER (oid IS NULL) AS inserted, count(*) FILTER (changed) AS superseded, count(*) FILTER (oid IS NOT NULL AND nid IS NOT NULL AND NOT changed) AS skipped FROM j",
    "slow_promote": f"SELECT value_id, true AS promoted FROM ({VALUES_SQL}) WHERE status = 'approved' AND coalesce(mode, '') <> 'bus'",
    "reset_half_done": f"""WITH v AS ({VALUES_SQL}), c AS (SELECT DISTINCT agency_id, metric, mode FROM v WHERE is_current AND confidence >= 0.5),
        l AS (SELECT v.*, status = 'approved' AND NOT EXISTS (SELECT 1 FROM c WHERE c.agency_id = v.agency_id AND c.metric = v.metric AND c.mode IS NOT DISTINCT FROM v.mode) AS lost FROM v)
        SELECT value_id, CASE WHEN lost THEN 'pending' ELSE status END AS status, CASE WHEN lost THEN 'reset: approved but not promoted' END AS note FROM l""",
    "reclassify_split": f"""WITH f AS ({FISCAL_SQL}) SELECT agency_id, CASE WHEN metric = 'ridership' THEN CASE period_type WHEN 'annual' THEN 'ridership_year' ELSE 'ridership_so_far' END ELSE metric END AS metric, start_year, period_type FROM f""",
    "wipe_dry_run": """WITH v AS (SELECT event_id, event_type AS source, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS restates FROM events), g AS (SELECT * FROM v WHERE source IN ('error', 'signup')),
        u AS (SELECT g.source, count(*) AS n FROM v JOIN g ON v.restates = g.event_id WHERE v.source NOT IN ('error', 'signup') GROUP BY 1)
        SELECT source, count(*) AS deleted, coalesce(max(u.n), 0) AS unlinked FROM g LEFT JOIN u USING (source) GROUP BY source""",
    "catalog_sync": """WITH s AS (SELECT p_partkey, concat_ws('-', regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), p_brand, CAST(p_size + 1970 AS VARCHAR)) AS stem FROM part),
        k AS (SELECT *, CASE WHEN starts_with(stem, 'small-r') THEN 'service_plan' WHEN starts_with(stem, 'small') THEN 'report' WHEN starts_with(stem, 'large') THEN 'statement' WHEN starts_with(stem, 'eco') THEN 'budget' END AS kind,
              TRY_CAST(regexp_extract(stem, '(19|20)[0-9]{2}', 0) AS INT) AS year FROM s)
        SELECT p_partkey, kind, year, CASE WHEN kind IS NOT NULL AND year IS NOT NULL THEN kind || '/' || year || '/' || stem || '.pdf' END AS key, CASE WHEN kind IS NULL THEN 'unknown name' WHEN year IS NULL THEN 'no year' END AS skipped FROM k""",
    "feeds_left_join": "SELECT feed, max(event_id) AS last_run FROM (VALUES ('view'), ('purchase'), ('never')) f(feed) LEFT JOIN events ON event_type = feed GROUP BY feed",
    "orphan_rows": """SELECT 'fk_part' AS rule, count(*) AS n FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size > 5)
        UNION ALL SELECT 'check_discount', count(*) FROM lineitem WHERE NOT (l_discount BETWEEN 0 AND 0.05)""",
    "relative_gaps": f"SELECT agency_id, month, abs(farebox_revenue - operating_expenses) / nullif(abs(operating_expenses), 0) AS gap FROM ({M_SQL})",
    "gold_tolerance": f"SELECT agency_id, month, CASE WHEN true_value = 0 THEN ridership = 0 ELSE abs(ridership - true_value) <= CAST(0.02 AS DOUBLE) * abs(true_value) END AS good FROM ({KNOWN_SQL})",
    "staged_evaluation": f"""WITH k AS (SELECT *, month(month) <> 5 AS has_reading, abs(ridership - true_value) <= CAST(0.02 AS DOUBLE) * abs(true_value) AS good FROM ({KNOWN_SQL}))
        SELECT count(*) AS known, coalesce(count(*) FILTER (has_reading AND good) / nullif(count(*) FILTER (has_reading), 0), 1.0) AS precision,
        coalesce(count(*) FILTER (agency_id % 3 = 1 AND agency_id % 2 = 1) / nullif(count(*) FILTER (agency_id % 3 = 1), 0), 1.0) AS flag_recall FROM k""",
    "lenient_digits": "SELECT l_linenumber, count(*) FILTER (l_linenumber % 2 = 0 OR l_linenumber % 3 <> 0) AS held, count(*) AS n FROM lineitem GROUP BY 1",
    "province_names": "SELECT CASE WHEN p_size <= 3 OR p_type IS NULL THEN 'Other' WHEN p_type = 'PROMO' THEN 'Promotion' WHEN p_type = 'SMALL' THEN 'Small goods' ELSE p_type END AS name, count(*) AS n FROM part GROUP BY 1",
    "conflict_notes": """SELECT p_partkey, CASE WHEN p_size % 7 <> 0 AND p_size % 3 <> 0 THEN 2 END AS n,
        CASE WHEN p_size % 7 <> 0 AND p_size % 3 <> 0 THEN CAST(greatest(1200, p_size * 1000) AS DOUBLE) END AS largest FROM part""",
    "scale_declarations": "SELECT p_partkey, CAST(CASE p_size % 3 WHEN 0 THEN 1000 WHEN 1 THEN 1000000 ELSE 1 END AS BIGINT) AS scale, p_size % 3 <> 1 AS heading FROM part",
    "array_edits": "SELECT user_id, string_agg(DISTINCT CASE event_type WHEN 'click' THEN 'tap' ELSE event_type END, ',' ORDER BY CASE event_type WHEN 'click' THEN 'tap' ELSE event_type END) AS types FROM events GROUP BY user_id",
    "json_round_trip": "SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS amount, CAST(o_orderdate AS DATE) AS day FROM orders",
    "row_to_value": """SELECT l_orderkey, l_linenumber, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) * CASE l_linenumber % 3 WHEN 1 THEN 1000 WHEN 2 THEN -1 ELSE 1 END AS value,
        CAST(CASE l_linenumber % 3 WHEN 0 THEN 0.9 WHEN 1 THEN 0.3 ELSE 0.5 END AS DOUBLE) AS confidence FROM lineitem""",
    "replay_counts": """WITH r AS (SELECT l_suppkey AS doc, l_partkey || '-' || l_returnflag AS key, l_quantity AS value, round(1 - l_tax * 10, 2) AS confidence, l_linenumber % 3 AS s FROM lineitem),
        k AS (SELECT doc, key, count(*) AS n, count(DISTINCT value) > 1 AS odd, max(confidence) AS best FROM r GROUP BY doc, key),
        a AS (SELECT doc, CAST(sum(n) AS BIGINT) AS readings, count(*) FILTER (odd) AS conflicts, count(*) FILTER (CASE WHEN odd THEN least(best, 0.5) ELSE best END <= 0.5) AS low_after FROM k GROUP BY doc),
        q AS (SELECT doc, count(*) FILTER (confidence <= 0.5) AS low_before, count(*) FILTER (s = 0) AS supported, count(*) FILTER (s = 1) AS mismatch, count(*) FILTER (s = 2) AS missing FROM r GROUP BY doc)
        SELECT * FROM a JOIN q USING (doc)""",
    "cohort_failures": f"""WITH {STATEMENT_SQL}, w AS (SELECT agency_id, month FROM m WHERE abs(farebox_revenue + other - total) > abs(total) * 0.02)
        SELECT agency_id, month, 'total' AS scope, 'operating' AS basis, metric FROM w CROSS JOIN (VALUES ('total_revenue_excluding_subsidy'), ('farebox_revenue'), ('other_revenue')) v(metric)""",
    "document_reconcile": f"""WITH {STATEMENT_SQL}, bad AS (SELECT agency_id, month FROM m WHERE abs(farebox_revenue + other - total) > 0.02 * greatest(abs(total), abs(farebox_revenue + other)))
        SELECT agency_id, month, metric, value, CASE WHEN metric <> 'operating_expenses' AND EXISTS (SELECT 1 FROM bad WHERE bad.agency_id = s.agency_id AND bad.month = s.month) THEN 'flagged' ELSE 'read' END AS kind, NULL AS equation FROM s
        UNION ALL SELECT agency_id, month, 'subsidy', operating_expenses - total, 'derived', 'expense_revenue_subsidy' FROM m
        UNION ALL SELECT agency_id, month, 'total_revenue', total + (operating_expenses - total), 'derived', 'total_revenue_def' FROM m""",
    "solve_backsolve": f"WITH {SOLVED_SQL} SELECT agency_id, month, metric, value, equation FROM r",
    "lineage_edges": f"""WITH {SOLVED_SQL}, o AS (SELECT * FROM (VALUES {', '.join(f"('{e.code}', '{m}')" for e in solver.STATEMENT_EQUATIONS for m in e.operands)}) v(equation, input))
        SELECT metric, equation, input, count(*) AS n FROM r JOIN o USING (equation) WHERE input <> metric GROUP BY ALL""",
    "psab_normalize": f"""SELECT agency_id, month, 'cost_per_rider' AS metric, (operating_expenses - CASE WHEN agency_id % 4 = 2 THEN 100 ELSE 0 END) / ridership AS value, 'preliminary' AS quality, agency_id % 4 <> 3 AS comparable FROM ({M_SQL})""",
    "weakest_of_inputs": f"""SELECT a.agency_id, CASE coalesce(max(CASE quality WHEN 'preliminary' THEN 1 WHEN 'estimated' THEN 2 ELSE 0 END), 0) WHEN 0 THEN 'verified' WHEN 1 THEN 'preliminary' ELSE 'estimated' END AS quality
        FROM ({AGENCY_SQL}) a LEFT JOIN ({VALUES_SQL}) v ON v.agency_id = a.agency_id GROUP BY a.agency_id""",
}
QUERIES = {name: globals()[name] for name in SQL}
