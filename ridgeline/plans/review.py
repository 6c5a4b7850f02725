"""Registered queries on feeds, review, readings, documents and directory views; each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.functions import text as tx
from ridgeline.operators import facts as op
from ridgeline.operators import lifecycle as life
from ridgeline.operators import review as rv
from ridgeline.plans.catalog import AGENCY_SQL, ANNUAL_SQL, FISCAL_SQL, LONG_SQL, M_SQL, SQL as BASE_SQL, _annual, _facts
from ridgeline.plans.extended import KEY, LOADS_SQL, _two_loads
from ridgeline.sources.frames import METRICS, agency, monthly, table

#: Month names as labels print them.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
LABELS = [("ECONOMY", "bus"), ("LARGE", "subway"), ("MEDIUM", "light_rail"), ("PROMO", "ferry"), ("STANDARD", "bus")]
LABELS_SQL = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in LABELS) + ") l(label, mode)"
READINGS_SQL = """SELECT l_orderkey AS order_id, l_linenumber AS line, l_extendedprice AS value, round(1 - l_tax * 5, 2) AS confidence,
    CASE l_returnflag WHEN 'R' THEN 'restated' WHEN 'N' THEN 'budget' ELSE 'actual' END AS basis FROM lineitem"""


def _labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LABELS, "label string, mode string")


def _readings(spark: SparkSession, d: str) -> DataFrame:
    basis = F.when(F.col("l_returnflag") == "R", "restated").when(F.col("l_returnflag") == "N", "budget").otherwise("actual")
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), F.col("l_extendedprice").alias("value"),
        F.round(1 - F.col("l_tax") * 5, 2).alias("confidence"), basis.alias("basis"),
    )


def label_mapping(spark: SparkSession, d: str) -> DataFrame:
    """A feed's labels with their mode; unmapped ones are reported with what they would have brought."""
    parts = table(spark, d, "part").join(F.broadcast(_labels(spark)), F.col("p_type") == F.col("label"), "left")  # a fixed list
    return parts.groupBy(F.col("p_type").alias("label"), "mode").agg(F.count("*").alias("n"), F.bool_or(F.col("mode").isNull()).alias("skipped"))


def scaled_amounts(spark: SparkSession, d: str) -> DataFrame:
    """Values in units, thousands or millions (an unknown scale counts as units), and preliminary ones marked."""
    k = F.col("o_orderkey") % 4
    scale = F.when(k == 1, 1000.0).when(k == 2, 1000000.0).otherwise(1.0)
    quality = F.when(F.lower("o_orderstatus") == "p", "preliminary").otherwise("verified")
    return table(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") * scale).alias("value"), quality.alias("quality"))


def since_cutoff(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").filter(F.date_format("ts", "yyyy-MM-dd") >= "2024-01-10").groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


def stamp_parts(spark: SparkSession, d: str) -> DataFrame:
    """Year and month of stamps of which some are blank or no dates."""
    k = F.col("o_orderkey") % 5
    stamp = F.when(k == 0, "unknown").when(k == 1, "").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, d, "orders").select("o_orderkey", *[F.substring(stamp, a, n).try_cast("bigint").alias(c) for c, a, n in (("year", 1, 4), ("month", 6, 2))])


def period_labels(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "orders").select(F.to_date(F.date_trunc("month", "o_orderdate")).alias("start")).distinct()
    quarter = F.concat(F.lit("Q"), F.quarter("start").cast("string"), F.lit(" "), F.year("start").cast("string"))
    return m.select("start", F.last_day("start").alias("end_day"), F.date_format("start", "MMM yyyy").alias("label"), quarter.alias("quarter"))


def ytd_labels(spark: SparkSession, d: str) -> DataFrame:
    """Running fiscal years name the months that they cover."""
    names = F.array(*map(F.lit, MONTHS))
    rows = op.fiscal_rollup(_facts(spark, d), agency(spark, d)).filter("period_type = 'ytd'").join(agency(spark, d).select("agency_id", "fye"), "agency_id")
    first, last = F.element_at(names, F.col("fye") % 12 + 1), F.element_at(names, ((F.col("fye") + F.col("months") - 1) % 12 + 1).cast("int"))
    return rows.select("agency_id", "metric", "start_year", F.concat("label", F.lit(" YTD ("), first, F.lit("–"), last, F.lit(")")).alias("label"))


def normalized_costs(spark: SparkSession, d: str) -> DataFrame:
    """Total-basis costs without amortization; where that is not published the total stands and is no comparable figure."""
    more = F.sum((F.col("l_extendedprice") * F.col("l_tax")).cast("decimal(22,4)")).cast("double")
    rows = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("agency_id")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("total"), more.alias("amortization"))
    total, known = F.col("agency_id") % 3 == 0, F.col("agency_id") % 2 == 0
    return rows.select("agency_id", F.when(total & known, F.col("total") - F.col("amortization")).otherwise(F.col("total")).alias("operating"), (~total | known).alias("comparable"))


def derived_quality(spark: SparkSession, d: str) -> DataFrame:
    """A ratio is as good as the weakest of its inputs."""
    q = F.element_at(F.array(*map(F.lit, ("verified", "preliminary", "estimated", "imputed"))), (F.max(F.col("l_linenumber") % 4) + 1).cast("int"))
    rows = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("agency_id"), F.to_date(F.date_trunc("month", "l_shipdate")).alias("month"))
    return rows.agg(q.alias("quality"), F.count("*").alias("inputs"))


def cohort_identities(spark: SparkSession, d: str) -> DataFrame:
    """Totals that their parts do not add up to; the wider tolerance lets the same error pass."""
    rows = monthly(spark, d).withColumn("deficit", (F.col("operating_expenses") - F.col("farebox_revenue")) * F.when(F.col("agency_id") % 6 == 0, 3.0).otherwise(1.0))
    rows = rows.withColumn("double_hours", F.col("revenue_service_hours") * F.when(F.col("agency_id") % 5 == 0, 2.1).otherwise(2.0))
    both = ("revenue_service_hours", "revenue_service_hours")
    identities = [("expenses", "operating_expenses", ("farebox_revenue", "deficit"), 0.02), ("hours", "double_hours", both, 0.02), ("hours_wide", "double_hours", both, 0.1)]
    return rv.identity_failures(rows, ["agency_id", "month"], identities)


def surest_per_key(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(*KEY, "event_id", (F.col("event_id") % 11 / 10).alias("confidence"))
    return op.latest(rows, KEY, [F.desc("confidence"), F.desc("event_id")])


def blast_radius(spark: SparkSession, d: str) -> DataFrame:
    """What goes if an agency goes: its values, ranks and open rows."""
    open_rows = table(spark, d, "lineitem").filter("l_returnflag = 'N'").groupBy(F.col("l_suppkey").alias("agency_id")).agg(F.count("*").alias("n_open"))
    annual = _annual(spark, d)
    ranks = op.competition_ranks(annual, agency(spark, d)).groupBy("agency_id").agg(F.count("*").alias("n_ranks"))
    held = annual.groupBy("agency_id").agg(F.count("*").alias("n_annual"))
    out = agency(spark, d).select("agency_id").join(held, "agency_id", "left").join(ranks, "agency_id", "left").join(open_rows, "agency_id", "left")
    return out.na.fill(0)


def remap_guard(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(*KEY).distinct()
    return rv.remap(rows, spark.createDataFrame([("signup", "view"), ("error", "fault")], "old string, new string"), ["user_id"], "event_type")


def suppression_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Why an agency's metric has no rank in a year: no comparable period, then pending (no population), then too small a cohort."""
    annual = _annual(spark, d)
    of = annual.join(agency(spark, d).select("agency_id", "subdivision"), "agency_id").groupBy("metric", "subdivision", "start_year").agg(F.count("*").alias("of"))
    years = annual.select("start_year").distinct()
    base = agency(spark, d).select("agency_id", "subdivision", "population", F.explode(F.array(*map(F.lit, METRICS))).alias("metric")).crossJoin(F.broadcast(years))  # some tens of years
    out = base.join(annual.select("agency_id", "metric", "start_year", "value"), ["agency_id", "metric", "start_year"], "left").join(of, ["metric", "subdivision", "start_year"], "left")
    reason = F.when(F.col("value").isNull(), "no_comparable_period").when(F.col("population").isNull(), "pending").when(F.col("of") < op.LEAST_COHORT, "below_min")
    return out.select("agency_id", "metric", "start_year", reason.alias("reason"))


def display_points(spark: SparkSession, d: str) -> DataFrame:
    """The point that a page shows: the last full year, else the last of any kind."""
    rows = op.fiscal_rollup(_facts(spark, d), agency(spark, d))
    best = F.max_by(F.struct("label", "value"), F.struct((F.col("period_type") == "annual").cast("int"), "start_year"))
    return rows.groupBy("agency_id", "metric").agg(best.alias("b")).select("agency_id", "metric", "b.*")


def directory_cards(spark: SparkSession, d: str) -> DataFrame:
    """Two metrics of a fixed order for each agency, as text, and the last year of any."""
    last = _annual(spark, d).groupBy("agency_id", "metric").agg(F.max_by("value", "start_year").alias("value"), F.max("start_year").alias("year"))
    wide = last.groupBy("agency_id").agg(F.max("year").cast("long").alias("as_of"), *[F.max(F.when(F.col("metric") == m, tx.compact(F.col("value")))).alias(m) for m in METRICS])
    shown = F.array_compact(F.array(*[F.concat(F.lit(f"{m} "), F.col(m)) for m in METRICS]))
    return wide.select("agency_id", "as_of", F.get(shown, F.lit(0)).alias("first_card"), F.get(shown, F.lit(1)).alias("second_card"))


def agency_search(spark: SparkSession, d: str) -> DataFrame:
    needle = "r#0000000"
    text = F.concat_ws(" ", "agency_name", tx.slug(F.col("agency_name")), "subdivision")
    return agency(spark, d).filter(F.lower(text).contains(needle) | F.lower("subdivision").contains("asia")).select("agency_id", "agency_name", "subdivision")


def mode_groups(spark: SparkSession, d: str) -> DataFrame:
    """An order's group by the first of its modes in a fixed order."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).join(F.broadcast(_labels(spark)), F.col("p_type") == F.col("label"), "left")
    has = lambda m: F.bool_or(F.col("mode") == m)
    group = F.when(has("subway"), "subway").when(has("commuter_rail"), "commuter_rail").when(has("light_rail"), "light_rail").when(has("ferry"), "ferry").otherwise("bus")
    return rows.groupBy("l_orderkey").agg(group.alias("mode_group"))


def attribution_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
    return rows.select("source", "lang", F.concat("source", F.lit(" ("), "lang", F.lit("): "), F.col("n").cast("string"), F.lit(" documents, "), F.col("a").cast("string"), F.lit(" to "), F.col("b").cast("string")).alias("line"))


def entitled_users(spark: SparkSession, d: str) -> DataFrame:
    """Whether a customer's newest event is a purchase; without any event it is not."""
    newest = op.latest(table(spark, d, "events").select("user_id", "event_type", "ts", "event_id"), ["user_id"], [F.desc("ts"), F.desc("event_id")])
    out = table(spark, d, "customer").join(newest, F.col("c_custkey") == F.col("user_id"), "left")
    return out.select("c_custkey", F.coalesce(F.col("event_type") == "purchase", F.lit(False)).alias("entitled"))


def good_feeds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.col("event_type").alias("feed")).agg(F.bool_or(F.col("event_id") % 4 == 0).alias("ever_good"), F.count_if(F.col("event_id") % 4 == 3).alias("errors"))


def restated_readings(spark: SparkSession, d: str) -> DataFrame:
    out = rv.prefer_restated(_readings(spark, d), ["order_id"]).groupBy("order_id", "basis")
    return out.agg(F.count("*").alias("n"), F.max("value").alias("largest"))


def sieve_counts(spark: SparkSession, d: str) -> DataFrame:
    return rv.sieve(_readings(spark, d), 0.7).groupBy(F.coalesce("drop", F.lit("kept")).alias("outcome")).agg(F.count("*").alias("n"), F.min("confidence").alias("least"))


def verified_readings(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("value"), F.lit(0.8).alias("confidence"))
    seen = rows.filter("o_orderkey % 3 <> 0").select("o_orderkey", (F.col("o_orderkey") % 7 != 0).alias("supported"), (F.col("o_orderkey") % 10 / 10).alias("seen_confidence"), F.when(F.col("o_orderkey") % 5 == 0, F.col("value") * 2).alias("corrected"))
    return rv.apply_verdicts(rows, seen, "o_orderkey")


def quote_checks(spark: SparkSession, d: str) -> DataFrame:
    """Prices quoted as they stand, with a decimal comma, grouped, not at all, or wrongly."""
    price, k = F.col("l_extendedprice").cast("decimal(18,2)"), F.col("l_orderkey") % 5
    printed = price.cast("string")
    quote = F.when(k == 1, F.concat(F.lit("Total "), printed)).when(k == 2, F.replace(printed, F.lit("."), F.lit(","))).when(k == 3, F.concat(F.lit("a "), F.format_number(price, 2), F.lit(" b"))).when(k == 4, F.lit("about 7"))
    return table(spark, d, "lineitem").groupBy(k.alias("kind"), tx.quote_supports(quote, printed).alias("support")).agg(F.count("*").alias("n"))


def file_classes(spark: SparkSession, d: str) -> DataFrame:
    """Kind and number of a page by its name."""
    url = F.col("url")
    kind = F.when(url.contains("?page="), "paged").when(url.contains("#"), "anchor").otherwise("plain")
    number = F.regexp_extract("url", "/([0-9]+)", 1).try_cast("bigint")
    return table(spark, d, "pages").select("page_id", kind.alias("kind"), number.alias("number"))


def schema_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """Digest of the sorted fields of an event type's properties: a feed whose fields change shows."""
    rows = table(spark, d, "events").select("event_type", F.explode(F.json_object_keys("props")).alias("field")).distinct()
    fields = rows.groupBy("event_type").agg(F.array_join(F.sort_array(F.collect_list("field")), "\n").alias("f"))  # a feed's fields
    return fields.select(F.col("event_type").alias("name"), F.sha2("f", 256).alias("fingerprint"))


def statement_routes(spark: SparkSession, d: str) -> DataFrame:
    """Pages to the statement whose cue they hold, to both, or to the general route."""
    text = F.lower(F.coalesce("text", F.lit("")))
    a, b = text.contains("sha"), text.contains("rin")
    return table(spark, d, "documents").select("doc_id", F.when(a & b, "both").when(a, "operations").when(b, "position").otherwise("general").alias("route"))


def paragraph_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = rv.paragraph_chunks(table(spark, d, "documents"), "doc_id", "text")
    return rows.groupBy("doc_id", "chunk").agg(F.count("*").alias("paragraphs"), F.sum(F.length("body")).alias("chars"), F.min("paragraph").cast("long").alias("first"))


def load_totals_delta(spark: SparkSession, d: str) -> DataFrame:
    """Counts and totals by type before and after a load."""
    rows = table(spark, d, "events").select("event_type", (F.col("ts") < "2024-01-15").alias("old"), F.col("value").cast("decimal(18,2)").alias("v"))
    side = lambda c, o: [F.count_if(c).alias(f"n_{o}"), F.sum(F.when(c, F.col("v"))).cast("double").alias(f"total_{o}")]
    out = rows.groupBy("event_type").agg(*side(F.col("old"), "before"), *side(~F.col("old"), "after"))
    return out.withColumn("n_delta", F.col("n_after") - F.col("n_before"))


def brand_sets(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part")
    return rv.code_sets(parts.filter("p_size < 8"), parts.filter("p_size >= 8"), "p_brand")


def upload_integrity(spark: SparkSession, d: str) -> DataFrame:
    """Stored digests against those of the texts: ok, mismatch or missing."""
    docs = table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("now"))
    stored = docs.filter("doc_id % 5 <> 0").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "0").otherwise(F.col("now")).alias("stored"))
    out = docs.join(stored, "doc_id", "left")
    return out.select("doc_id", F.when(F.col("stored").isNull(), "missing").when(F.col("stored") == F.col("now"), "ok").otherwise("mismatch").alias("state"))


def star_totals(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).join(agency(spark, d), F.col("l_suppkey") == F.col("agency_id"))
    return rows.groupBy("p_type", "subdivision", F.year("l_shipdate").cast("long").alias("year")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("total"), F.count("*").alias("n"))


def listed_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = spark.createDataFrame([("Brand#2", "SMALL"), ("Brand#4", "PROMO"), ("Brand#17", "LARGE")], "p_brand string, p_type string")
    return table(spark, d, "part").join(F.broadcast(pairs), ["p_brand", "p_type"], "left_semi").select("p_partkey", "p_brand", "p_type")


def paired_readers(spark: SparkSession, d: str) -> DataFrame:
    """Two readers' totals side by side by order, whoever has one."""
    rows = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linestatus").agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("q"))
    a, b = (rows.filter(F.col("l_linestatus") == s).select("l_orderkey", F.col("q").alias(n)) for s, n in (("F", "first_reader"), ("O", "second_reader")))
    return a.join(b, "l_orderkey", "full_outer")


def review_moves(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 5
    action = F.when(k == 0, "approve").when(k == 1, "reject").when(k == 2, "edit")
    rows = table(spark, d, "events").select("event_id", F.lit("pending").alias("status"), (F.col("user_id") % 4 == 0).alias("promoted"))
    return rv.transition(rows, action)


def scan_states(spark: SparkSession, d: str) -> DataFrame:
    state = F.when(F.col("doc_id") % 4 == 0, "unscanned").when(F.trim(F.coalesce("text", F.lit(""))) == "", "failed").otherwise("scanned")
    return table(spark, d, "documents").groupBy(state.alias("state")).agg(F.count("*").alias("n"), F.max("doc_id").alias("last_id"))


def user_contexts(spark: SparkSession, d: str) -> DataFrame:
    """What is live and what waits, by user, as ordered lists; users without anything waiting are left out."""
    live, waits = F.col("ts") < "2024-01-15", F.col("ts") >= "2024-01-28"
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c, F.col("event_id")))), lambda x: x.cast("string")), ",")
    rows = table(spark, d, "events").groupBy("user_id").agg(listed(live).alias("live"), listed(waits).alias("waiting"))
    return rows.filter("waiting <> ''")


def spread_checks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("part")).agg(F.min("l_discount").alias("lo"), F.max("l_discount").alias("hi"), F.count("*").alias("n"))
    return rows.withColumn("narrow", F.coalesce(F.try_divide(F.col("hi") - F.col("lo"), F.col("hi")) <= 0.5, F.lit(True)))


def first_rejects(spark: SparkSession, d: str) -> DataFrame:
    reason = F.when(F.col("value").isNull(), "empty field").when(F.col("value") < 20, "bad value").when(F.col("event_type") == "error", "bad type")
    rows = table(spark, d, "events").select("user_id", "event_id", reason.alias("reason")).filter("reason IS NOT NULL")
    return rows.groupBy("user_id").agg(F.min_by("reason", "event_id").alias("reason"), F.min("event_id").alias("event_id"))


def tokens_by_lang(spark: SparkSession, d: str) -> DataFrame:
    """Words and their cost at 5 a million, by language."""
    rows = table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.regexp_count("text", F.lit("[A-Za-z0-9]+")), F.lit(0))).cast("long").alias("tokens"))
    return rows.withColumn("cost", F.col("tokens") * 5.0 / 1000000)


def statement_unpivoted(spark: SparkSession, d: str) -> DataFrame:
    """The wide statement back as rows; empty cells are no rows, and headers give the year."""
    wide = op.statement(_annual(spark, d))
    years = wide.columns[2:]
    wide = wide.select("agency_id", "metric", *[F.col(y).alias(f"FY{y}-{(int(y) + 1) % 100:02d}") for y in years])
    rows = wide.unpivot(["agency_id", "metric"], wide.columns[2:], "header", "value").filter("value IS NOT NULL")
    return rows.select("agency_id", "metric", F.regexp_extract("header", "([0-9]{4})", 1).cast("long").alias("start_year"), "value")


def latest_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy("p_brand").agg(F.max_by("p_name", "p_partkey").alias("name"), F.max("p_size").alias("size"))


def ordered_flags(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("f"))
    return rows.select("user_id", F.array_join(rv.ordered_flags(F.col("f"), ("purchase", "signup")), ",").alias("flags"))


def period_ids(spark: SparkSession, d: str) -> DataFrame:
    months = table(spark, d, "orders").select(F.to_date(F.date_trunc("month", "o_orderdate")).alias("month")).distinct()
    known = months.filter("month < '1998-01-01'").select("month", ((F.year("month") - 1995) * 12 + F.month("month")).cast("long").alias("id"))
    return rv.get_or_create(known, months, "month")


def units_and_notes(spark: SparkSession, d: str) -> DataFrame:
    note = F.concat_ws("; ", F.when(F.col("population").isNull(), "no population"), F.when(F.col("fye") != 12, F.concat(F.lit("year ends in month "), F.col("fye").cast("string"))))
    return agency(spark, d).select("agency_id", F.replace(F.lit("CAD per trip"), F.lit("CAD"), F.col("currency")).alias("unit"), note.alias("note"))


def page_windows(spark: SparkSession, d: str) -> DataFrame:
    """Pages of a source in windows of 100, with their place in the window."""
    rows = life.number_in_order(table(spark, d, "documents").select("doc_id", "source"), ["source"], F.floor(F.col("doc_id") / 4096), ["doc_id"])
    nth = F.col("nth") - 1
    return rows.select("doc_id", "source", F.floor(nth / 100).cast("long").alias("window_no"), (nth % 100).cast("long").alias("place"))


def suite_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Precision and recall of a rule by language and over all; nothing to find counts as 1."""
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("lang", (F.col("n_chars") >= 400).alias("guess"), (F.col("quality") == 1).alias("truth"))
    hit, said, true = F.count_if(F.col("guess") & F.col("truth")), F.count_if("guess"), F.count_if("truth")
    out = rows.rollup("lang").agg(F.grouping("lang").cast("int").alias("total_row"), F.coalesce(F.try_divide(hit, said), F.lit(1.0)).alias("precision"), F.coalesce(F.try_divide(hit, true), F.lit(1.0)).alias("recall"))
    return out.select("total_row", F.when(F.col("total_row") == 0, F.col("lang")).alias("lang"), "precision", "recall")


def load_result(spark: SparkSession, d: str) -> DataFrame:
    """One row: what a load did, as JSON, and whether its counts add up to the incoming rows."""
    current, incoming = _two_loads(spark, d)
    done = life.promote(current, incoming, KEY, "value")
    counts = done.agg(*[F.count_if(F.col("action") == a).alias(a) for a in ("inserted", "restated", "superseded")])
    return counts.select(F.to_json(F.struct("inserted", "restated", "superseded")).alias("result"), (F.col("restated") == F.col("superseded")).alias("adds_up"))


def merged_maps(spark: SparkSession, d: str) -> DataFrame:
    """Two id maps as one; a code of both keeps the first map's name."""
    a = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit(1).alias("nth"))
    b = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit(2).alias("nth"))
    return a.unionByName(b).groupBy("id").agg(F.min_by("name", "nth").alias("name"), F.count("*").alias("n"))


def weird_years(spark: SparkSession, d: str) -> DataFrame:
    """Lines whose year lies outside of the three years up to their document's."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    odd = ~F.year("l_shipdate").between(F.year("o_orderdate") - 3, F.year("o_orderdate"))
    return rows.groupBy(odd.alias("odd"), F.year("o_orderdate").cast("long").alias("year")).agg(F.count("*").alias("n"))


def record_problems(spark: SparkSession, d: str) -> DataFrame:
    """Records outside of their enumerations and ranges, with all their problems."""
    bad = F.array_compact(F.array(F.when(~F.col("event_type").isin("view", "signup", "click", "purchase"), "bad enum"), F.when(~F.col("value").between(0, 50), "out of range"), F.when(F.col("user_id") < 0, "bad key")))
    return table(spark, d, "events").select("event_id", F.array_join(bad, ", ").alias("problems")).filter("problems <> ''")


def daily_events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.window("ts", "1 day").start.alias("day"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"))


_FYE = f"SELECT f.*, a.fye FROM ({FISCAL_SQL}) f JOIN ({AGENCY_SQL}) a USING (agency_id)"
_MONTH_LIST = "[" + ", ".join(f"'{m}'" for m in MONTHS) + "]"
_COMPACT = """CASE WHEN {v} >= 1000000 THEN CAST(floor({v} / 100000) / 10 AS VARCHAR) || 'M' WHEN {v} >= 100000 THEN CAST(CAST(floor({v} / 1000) AS BIGINT) AS VARCHAR) || 'K'
    ELSE CAST(CAST(floor({v} * 100 + 0.5) / 100 AS DECIMAL(18,2)) AS VARCHAR) END"""

SQL = {
    "label_mapping": f"SELECT p_type AS label, mode, count(*) AS n, mode IS NULL AS skipped FROM part LEFT JOIN {LABELS_SQL} ON p_type = label GROUP BY ALL",
    "scaled_amounts": """SELECT o_orderkey, o_totalprice * CAST(CASE o_orderkey % 4 WHEN 1 THEN 1000 WHEN 2 THEN 1000000 ELSE 1 END AS DOUBLE) AS value,
        CASE WHEN lower(o_orderstatus) = 'p' THEN 'preliminary' ELSE 'verified' END AS quality FROM orders""",
    "since_cutoff": "SELECT event_type, count(*) AS n, min(event_id) AS first_id FROM events WHERE strftime(ts, '%Y-%m-%d') >= '2024-01-10' GROUP BY event_type",
    "stamp_parts": """WITH s AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'unknown' WHEN 1 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS t FROM orders)
        SELECT o_orderkey, TRY_CAST(substr(t, 1, 4) AS BIGINT) AS year, TRY_CAST(substr(t, 6, 2) AS BIGINT) AS month FROM s""",
    "period_labels": """WITH m AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS start FROM orders)
        SELECT start, last_day(start) AS end_day, strftime(start, '%b %Y') AS label, 'Q' || CAST(quarter(start) AS VARCHAR) || ' ' || CAST(year(start) AS VARCHAR) AS quarter FROM m""",
    "ytd_labels": f"""SELECT agency_id, metric, start_year, label || ' YTD (' || list_extract({_MONTH_LIST}, fye % 12 + 1) || '–' || list_extract({_MONTH_LIST}, (fye + months - 1) % 12 + 1) || ')' AS label
        FROM ({_FYE}) WHERE period_type = 'ytd'""",
    "normalized_costs": """WITH t AS (SELECT l_suppkey AS agency_id, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total, CAST(sum(CAST(l_extendedprice * l_tax AS DECIMAL(22,4))) AS DOUBLE) AS more FROM lineitem GROUP BY 1)
        SELECT agency_id, CASE WHEN agency_id % 6 = 0 THEN total - more ELSE total END AS operating, agency_id % 3 <> 0 OR agency_id % 2 = 0 AS comparable FROM t""",
    "derived_quality": """SELECT l_suppkey AS agency_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, CASE max(l_linenumber % 4) WHEN 0 THEN 'verified' WHEN 1 THEN 'preliminary' WHEN 2 THEN 'estimated' ELSE 'imputed' END AS quality,
        count(*) AS inputs FROM lineitem GROUP BY ALL""",
    "cohort_identities": f"""WITH m AS (SELECT *, farebox_revenue + (operating_expenses - farebox_revenue) * CASE WHEN agency_id % 6 = 0 THEN 3 ELSE 1 END AS parts FROM ({M_SQL}))
        SELECT agency_id, month, 'expenses' AS identity FROM m WHERE abs(operating_expenses - parts) > 0.02 * greatest(abs(operating_expenses), abs(parts))
        UNION ALL SELECT agency_id, month, 'hours' FROM m WHERE agency_id % 5 = 0""",
    "surest_per_key": "SELECT user_id, event_type, event_id, event_id % 11 / 10 AS confidence FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id % 11 DESC, event_id DESC) = 1",
    "blast_radius": f"""WITH v AS (SELECT agency_id, count(*) AS n FROM ({ANNUAL_SQL}) GROUP BY 1), r AS (SELECT agency_id, count(*) AS n FROM ({BASE_SQL['competition_ranks']}) GROUP BY 1),
        o AS (SELECT l_suppkey AS agency_id, count(*) AS n FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1)
        SELECT a.agency_id, coalesce(v.n, 0) AS n_annual, coalesce(r.n, 0) AS n_ranks, coalesce(o.n, 0) AS n_open FROM ({AGENCY_SQL}) a LEFT JOIN v USING (agency_id) LEFT JOIN r USING (agency_id) LEFT JOIN o USING (agency_id)""",
    "remap_guard": """WITH e AS (SELECT DISTINCT user_id, event_type FROM events),
        m AS (SELECT *, CASE event_type WHEN 'signup' THEN 'view' WHEN 'error' THEN 'fault' END AS new FROM e)
        SELECT user_id, event_type, CASE WHEN h THEN event_type ELSE coalesce(new, event_type) END AS new_code, h AS collides
        FROM (SELECT m.*, EXISTS (SELECT 1 FROM e WHERE e.user_id = m.user_id AND e.event_type = m.new) AS h FROM m)""",
    "suppression_reasons": f"""WITH v AS ({ANNUAL_SQL}), a AS ({AGENCY_SQL}), m AS (SELECT unnest({list(METRICS)}) AS metric), y AS (SELECT DISTINCT start_year FROM v),
        o AS (SELECT metric, subdivision, start_year, count(*) AS n FROM v JOIN a USING (agency_id) GROUP BY ALL)
        SELECT a.agency_id, m.metric, y.start_year, CASE WHEN v.value IS NULL THEN 'no_comparable_period' WHEN population IS NULL THEN 'pending' WHEN o.n < 5 THEN 'below_min' END AS reason
        FROM a CROSS JOIN m CROSS JOIN y LEFT JOIN v ON v.agency_id = a.agency_id AND v.metric = m.metric AND v.start_year = y.start_year
        LEFT JOIN o ON o.metric = m.metric AND o.subdivision = a.subdivision AND o.start_year = y.start_year""",
    "display_points": f"SELECT agency_id, metric, label, value FROM ({FISCAL_SQL}) QUALIFY row_number() OVER (PARTITION BY agency_id, metric ORDER BY period_type, start_year DESC) = 1",
    "directory_cards": f"""WITH l AS (SELECT agency_id, metric, max_by(value, start_year) AS v, max(start_year) AS year FROM ({ANNUAL_SQL}) GROUP BY ALL),
        n AS (SELECT agency_id, year, metric || ' ' || {_COMPACT.format(v='v')} AS card, row_number() OVER (PARTITION BY agency_id ORDER BY list_position({list(METRICS)}, metric)) AS nth FROM l)
        SELECT agency_id, max(year) AS as_of, max(card) FILTER (nth = 1) AS first_card, max(card) FILTER (nth = 2) AS second_card FROM n GROUP BY agency_id""",
    "agency_search": f"SELECT agency_id, agency_name, subdivision FROM ({AGENCY_SQL}) WHERE agency_name ILIKE '%r#0000000%' OR subdivision ILIKE '%asia%'",
    "mode_groups": f"""SELECT l_orderkey, CASE min(CASE mode WHEN 'subway' THEN 1 WHEN 'commuter_rail' THEN 2 WHEN 'light_rail' THEN 3 WHEN 'ferry' THEN 4 ELSE 5 END) WHEN 1 THEN 'subway' WHEN 2 THEN 'commuter_rail'
        WHEN 3 THEN 'light_rail' WHEN 4 THEN 'ferry' ELSE 'bus' END AS mode_group FROM lineitem JOIN part ON l_partkey = p_partkey LEFT JOIN {LABELS_SQL} ON p_type = label GROUP BY l_orderkey""",
    "attribution_lines": "SELECT source, lang, source || ' (' || lang || '): ' || CAST(count(*) AS VARCHAR) || ' documents, ' || CAST(min(doc_id) AS VARCHAR) || ' to ' || CAST(max(doc_id) AS VARCHAR) AS line FROM documents GROUP BY source, lang",
    "entitled_users": """WITH n AS (SELECT user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
        SELECT c_custkey, coalesce(event_type = 'purchase', false) AS entitled FROM customer LEFT JOIN n ON c_custkey = user_id""",
    "good_feeds": "SELECT event_type AS feed, bool_or(event_id % 4 = 0) AS ever_good, count(*) FILTER (event_id % 4 = 3) AS errors FROM events GROUP BY event_type",
    "restated_readings": f"""WITH r AS ({READINGS_SQL}), f AS (SELECT *, bool_or(basis = 'restated') OVER (PARTITION BY order_id) AS has_new FROM r)
        SELECT order_id, basis, count(*) AS n, max(value) AS largest FROM f WHERE NOT has_new OR basis = 'restated' GROUP BY ALL""",
    "sieve_counts": f"""SELECT CASE WHEN confidence < 0.7 THEN 'low_confidence' WHEN basis IN ('budget', 'forecast') THEN 'planned' ELSE 'kept' END AS outcome, count(*) AS n, min(confidence) AS least FROM ({READINGS_SQL}) GROUP BY 1""",
    "verified_readings": """SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 5 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS value,
        CASE WHEN o_orderkey % 3 <> 0 THEN least(CAST(0.8 AS DOUBLE), o_orderkey % 10 / 10) ELSE CAST(0.8 AS DOUBLE) END AS confidence FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 7 <> 0""",
    "quote_checks": """SELECT l_orderkey % 5 AS kind, CASE l_orderkey % 5 WHEN 0 THEN 'missing' WHEN 4 THEN 'mismatch' ELSE 'supported' END AS support, count(*) AS n FROM lineitem GROUP BY ALL""",
    "file_classes": """SELECT page_id, CASE WHEN contains(url, '?page=') THEN 'paged' WHEN contains(url, '#') THEN 'anchor' ELSE 'plain' END AS kind, TRY_CAST(regexp_extract(url, '/([0-9]+)', 1) AS BIGINT) AS number FROM pages""",
    "schema_fingerprints": """SELECT event_type AS name, sha256(string_agg(field, chr(10) ORDER BY field)) AS fingerprint
        FROM (SELECT DISTINCT event_type, unnest(json_keys(props)) AS field FROM events) GROUP BY event_type""",
    "statement_routes": """WITH t AS (SELECT doc_id, contains(lower(coalesce(text, '')), 'sha') AS a, contains(lower(coalesce(text, '')), 'rin') AS b FROM documents)
        SELECT doc_id, CASE WHEN a AND b THEN 'both' WHEN a THEN 'operations' WHEN b THEN 'position' ELSE 'general' END AS route FROM t""",
    "paragraph_chunks": """WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL), u AS (SELECT doc_id, unnest(p) AS body, generate_subscripts(p, 1) - 1 AS i FROM s),
        c AS (SELECT *, CAST(floor(coalesce(sum(length(body)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 2000) AS BIGINT) AS chunk FROM u)
        SELECT doc_id, chunk, count(*) AS paragraphs, CAST(sum(length(body)) AS BIGINT) AS chars, CAST(min(i) AS BIGINT) AS "first" FROM c GROUP BY doc_id, chunk""",
    "load_totals_delta": """WITH e AS (SELECT event_type, ts < TIMESTAMP '2024-01-15' AS old, CAST(value AS DECIMAL(18,2)) AS v FROM events)
        SELECT event_type, count(*) FILTER (old) AS n_before, CAST(sum(v) FILTER (old) AS DOUBLE) AS total_before, count(*) FILTER (NOT old) AS n_after, CAST(sum(v) FILTER (NOT old) AS DOUBLE) AS total_after,
        count(*) FILTER (NOT old) - count(*) FILTER (old) AS n_delta FROM e GROUP BY event_type""",
    "brand_sets": """WITH a AS (SELECT DISTINCT p_brand FROM part WHERE p_size < 8), b AS (SELECT DISTINCT p_brand FROM part WHERE p_size >= 8)
        SELECT coalesce(a.p_brand, b.p_brand) AS p_brand, CASE WHEN b.p_brand IS NULL THEN 'missing' WHEN a.p_brand IS NULL THEN 'extra' ELSE 'both' END AS place FROM a FULL JOIN b ON a.p_brand = b.p_brand""",
    "upload_integrity": "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'missing' WHEN doc_id % 3 = 0 THEN 'mismatch' ELSE 'ok' END AS state FROM documents",
    "star_totals": f"""SELECT p_type, subdivision, year(l_shipdate) AS year, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total, count(*) AS n
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN ({AGENCY_SQL}) ON l_suppkey = agency_id GROUP BY ALL""",
    "listed_pairs": "SELECT p_partkey, p_brand, p_type FROM part WHERE (p_brand, p_type) IN (('Brand#2', 'SMALL'), ('Brand#4', 'PROMO'), ('Brand#17', 'LARGE'))",
    "paired_readers": """SELECT l_orderkey, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) FILTER (l_linestatus = 'F') AS DOUBLE) AS first_reader, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) FILTER (l_linestatus = 'O') AS DOUBLE) AS second_reader
        FROM lineitem WHERE l_linestatus IN ('F', 'O') GROUP BY l_orderkey""",
    "review_moves": """SELECT event_id, CASE WHEN user_id % 4 = 0 THEN 'pending' ELSE CASE event_id % 5 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' WHEN 2 THEN 'needs_edit' ELSE 'pending' END END AS status,
        user_id % 4 = 0 AS promoted, user_id % 4 = 0 AND event_id % 5 < 3 AS refused FROM events""",
    "scan_states": """SELECT CASE WHEN doc_id % 4 = 0 THEN 'unscanned' WHEN trim(coalesce(text, '')) = '' THEN 'failed' ELSE 'scanned' END AS state, count(*) AS n, max(doc_id) AS last_id FROM documents GROUP BY 1""",
    "user_contexts": """SELECT user_id, coalesce(string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) FILTER (ts < TIMESTAMP '2024-01-15'), '') AS live,
        string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) FILTER (ts >= TIMESTAMP '2024-01-28') AS waiting FROM events GROUP BY user_id HAVING waiting IS NOT NULL""",
    "spread_checks": """SELECT l_partkey AS part, min(l_discount) AS lo, max(l_discount) AS hi, count(*) AS n, coalesce((max(l_discount) - min(l_discount)) / nullif(max(l_discount), 0) <= 0.5, true) AS narrow FROM lineitem GROUP BY 1""",
    "first_rejects": """WITH r AS (SELECT user_id, event_id, CASE WHEN value IS NULL THEN 'empty field' WHEN value < 20 THEN 'bad value' WHEN event_type = 'error' THEN 'bad type' END AS reason FROM events)
        SELECT user_id, reason, event_id FROM r WHERE reason IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1""",
    "tokens_by_lang": """SELECT lang, count(*) AS n, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+'))) AS BIGINT) AS tokens, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+'))) AS DOUBLE) * 5 / 1000000 AS cost FROM documents GROUP BY lang""",
    "statement_unpivoted": f"SELECT agency_id, metric, CAST(start_year AS BIGINT) AS start_year, value FROM ({ANNUAL_SQL})",
    "latest_names": "SELECT p_brand, max_by(p_name, p_partkey) AS name, max(p_size) AS size FROM part GROUP BY p_brand",
    "ordered_flags": """SELECT user_id, string_agg(event_type, ',' ORDER BY CASE event_type WHEN 'purchase' THEN '0' WHEN 'signup' THEN '1' ELSE event_type END) AS flags
        FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY user_id""",
    "period_ids": """WITH m AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM orders), k AS (SELECT month, (year(month) - 1995) * 12 + month(month) AS id FROM m WHERE month < DATE '1998-01-01')
        SELECT month, id, false AS created FROM k UNION ALL SELECT month, (SELECT coalesce(max(id), 0) FROM k) + row_number() OVER (ORDER BY month), true FROM m WHERE month >= DATE '1998-01-01'""",
    "units_and_notes": f"""SELECT agency_id, currency || ' per trip' AS unit, concat_ws('; ', CASE WHEN population IS NULL THEN 'no population' END, CASE WHEN fye <> 12 THEN 'year ends in month ' || CAST(fye AS VARCHAR) END) AS note FROM ({AGENCY_SQL})""",
    "page_windows": """WITH n AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS k FROM documents) SELECT doc_id, source, k // 100 AS window_no, k % 100 AS place FROM n""",
    "suite_accuracy": """WITH r AS (SELECT lang, n_chars >= 400 AS guess, quality = 1 AS truth FROM documents JOIN labels USING (doc_id))
        SELECT CAST(grouping(lang) AS INT) AS total_row, lang, coalesce(count(*) FILTER (guess AND truth) / nullif(count(*) FILTER (guess), 0), 1.0) AS precision, coalesce(count(*) FILTER (guess AND truth) / nullif(count(*) FILTER (truth), 0), 1.0) AS recall
        FROM r GROUP BY ROLLUP (lang)""",
    "load_result": f"""WITH {LOADS_SQL} SELECT '{{"inserted":' || CAST(count(*) FILTER (action = 'inserted') AS VARCHAR) || ',"restated":' || CAST(count(*) FILTER (action = 'restated') AS VARCHAR) || ',"superseded":' ||
        CAST(count(*) FILTER (action = 'superseded') AS VARCHAR) || '}}' AS result, count(*) FILTER (action = 'restated') = count(*) FILTER (action = 'superseded') AS adds_up FROM p""",
    "merged_maps": """SELECT coalesce(s_suppkey, c_custkey) AS id, coalesce(s_name, c_name) AS name, CAST((s_suppkey IS NOT NULL) AS BIGINT) + CAST((c_custkey IS NOT NULL) AS BIGINT) AS n FROM supplier FULL JOIN customer ON s_suppkey = c_custkey""",
    "weird_years": """SELECT NOT (year(l_shipdate) BETWEEN year(o_orderdate) - 3 AND year(o_orderdate)) AS odd, year(o_orderdate) AS year, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL""",
    "record_problems": """SELECT event_id, concat_ws(', ', CASE WHEN event_type NOT IN ('view', 'signup', 'click', 'purchase') THEN 'bad enum' END, CASE WHEN value NOT BETWEEN 0 AND 50 THEN 'out of range' END, CASE WHEN user_id < 0 THEN 'bad key' END) AS problems
        FROM events WHERE problems <> ''""",
    "daily_events": "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY ALL",
}
QUERIES = {name: globals()[name] for name in SQL}
