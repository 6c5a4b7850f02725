"""Queries over queues, scopes, the dictionary and statements as text, with their SQL twins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.operators import queues
from ridgeline.operators import validation as vd
from ridgeline.plans.figures import _STATED, CELLS, YEARS_SQL, _as, _cells, _years
from ridgeline.sources.frames import table

_SCOPE = "CASE l_linenumber WHEN 1 THEN 'total' WHEN 2 THEN 'mode_subset' WHEN 3 THEN 'city_wide' WHEN 4 THEN 'conventional' END"
_BASIS = "CASE WHEN l_returnflag = 'A' THEN 'actual' WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'restated' WHEN l_tax > 0.04 THEN 'budget' WHEN l_tax > 0.02 THEN 'forecast' END"
_COLUMNS = ["l_orderkey", "l_linenumber", f"{_SCOPE} AS scope", f"{_BASIS} AS basis", "year(l_shipdate) AS year", "CASE WHEN l_linestatus = 'F' THEN 'annual' ELSE 'ytd' END AS period_kind", "CASE WHEN l_quantity <> 7 THEN l_quantity END AS value"]
_READINGS = ", ".join(_COLUMNS)


def _readings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").selectExpr(*_COLUMNS)


def scope_drops(spark: SparkSession, d: str) -> DataFrame:
    """Readings kept, and dropped for their scope or their basis, by year."""
    return queues.out_of_scope(_readings(spark, d)).groupBy("year", F.coalesce("drop", F.lit("kept")).alias("what")).agg(F.count("*").alias("n"))


def known_matches(spark: SparkSession, d: str) -> DataFrame:
    """Of each order the readings that its known value, of its own year's kind, is compared with."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.year("o_orderdate").alias("of_year"), F.when(F.col("o_orderstatus") == "F", "annual").otherwise("ytd").alias("of_kind"))
    rows = _readings(spark, d).join(orders, "l_orderkey")
    return queues.known_candidates(rows, F.col("of_year"), F.col("of_kind")).select("l_orderkey", "l_linenumber", "value")


def queue_views(spark: SparkSession, d: str) -> DataFrame:
    """The queue of waiting events as reviewers list it: all, flagged, clean, and one agency's flagged ones."""
    flags = F.array_compact(F.array(F.when(F.col("value") > 80, "high"), F.when(F.col("value") < 10, "low")))
    rows = table(spark, d, "events").select(F.format_string("user %05d", "user_id").alias("agency"), F.col("event_type").alias("metric"), F.col("event_id").alias("id"), flags.alias("flags"))
    views = [("all", "all", None), ("flagged", "flagged", None), ("clean", "clean", None), ("one", "flagged", "user 00007")]
    out = [queues.review_queue(rows, show, agency).select(F.lit(name).alias("view"), "id", F.col("nth").cast("long").alias("nth")) for name, show, agency in views]
    return reduce(DataFrame.unionByName, out)


def dictionary_problems(spark: SparkSession, d: str) -> DataFrame:
    """Parts' brands as a dictionary's entries, against the brands of large parts: missing, unknown, empty and odd ones."""
    p = table(spark, d, "part")
    entries = p.filter("p_size <= 25").groupBy(F.col("p_brand").alias("code")).agg(F.max(F.when(F.col("p_retailprice") > 1800, F.col("p_name"))).alias("display_name"), F.min("p_type").alias("statement"), F.max(F.when(F.col("p_size") > 24, "1")).alias("source_tier"))
    return queues.dictionary_problems(entries, p.filter("p_size > 48").select(F.col("p_brand").alias("code")), ["display_name", "source_tier"], {"statement": ["ECONOMY"]})


def statement_text(spark: SparkSession, d: str) -> DataFrame:
    """Each agency's statements as the lines of a CSV file."""
    annual = _cells(_years(spark, d), {m: CELLS[m] for m in _STATED}, "total", "operating").withColumn("value", F.floor("value").cast("bigint"))
    return queues.statement_csv(vd.statements(annual, ["a"], "y"), ["a"], {"operations": "Statement of Operations", "position": 'Statement of "Position", financial'})


QUERIES = {f.__name__: f for f in (scope_drops, known_matches, queue_views, dictionary_problems, statement_text)}

_LINES = ", ".join(f"('{s}', {b + k}, '{m}')" for s, b, ms in (("Statement of Operations", 0, vd.OPERATIONS), ('"Statement of ""Position"", financial"', 100, vd.POSITION)) for k, m in enumerate(ms, 1))

SQL = {
    "scope_drops": f"""
        WITH r AS (SELECT {_READINGS} FROM lineitem)
        SELECT year, CASE WHEN scope IN ('mode_subset', 'city_wide') THEN 'scope' WHEN basis IN ('budget', 'forecast') THEN 'basis' ELSE 'kept' END AS what, count(*) AS n FROM r GROUP BY ALL""",
    "known_matches": f"""
        WITH r AS (SELECT {_READINGS} FROM lineitem)
        SELECT l_orderkey, l_linenumber, value FROM r JOIN orders ON o_orderkey = l_orderkey
        WHERE year = year(o_orderdate) AND period_kind = CASE WHEN o_orderstatus = 'F' THEN 'annual' ELSE 'ytd' END AND coalesce(scope, 'total') = 'total' AND coalesce(basis, 'actual') = 'actual' AND value IS NOT NULL""",
    "queue_views": """
        WITH e AS (SELECT printf('user %05d', user_id) AS agency, event_type AS metric, event_id AS id, coalesce(value > 80 OR value < 10, false) AS flagged FROM events),
        v AS (SELECT 'all' AS view, * FROM e UNION ALL SELECT 'flagged', * FROM e WHERE flagged UNION ALL SELECT 'clean', * FROM e WHERE NOT flagged UNION ALL SELECT 'one', * FROM e WHERE flagged AND agency = 'user 00007')
        SELECT view, id, row_number() OVER (PARTITION BY view ORDER BY agency, metric, id) AS nth FROM v""",
    "dictionary_problems": """
        WITH e AS (SELECT p_brand AS code, max(p_name) FILTER (p_retailprice > 1800) AS display_name, min(p_type) AS statement, max('1') FILTER (p_size > 24) AS source_tier FROM part WHERE p_size <= 25 GROUP BY 1),
        c AS (SELECT DISTINCT p_brand AS code FROM part WHERE p_size > 48), b AS (SELECT e.* FROM e JOIN c USING (code))
        SELECT code, 'missing entry' AS problem FROM c WHERE code NOT IN (SELECT code FROM e) UNION ALL SELECT code, 'not a known metric' FROM e WHERE code NOT IN (SELECT code FROM c)
        UNION ALL SELECT code, 'missing required field display_name' FROM b WHERE coalesce(trim(display_name), '') = '' UNION ALL SELECT code, 'missing required field source_tier' FROM b WHERE source_tier IS NULL
        UNION ALL SELECT code, 'unknown statement: ' || statement FROM b WHERE statement <> 'ECONOMY'""",
    "statement_text": f"""
        WITH w AS ({YEARS_SQL}), c AS (SELECT a, y, {_as({m: CELLS[m] for m in _STATED})} FROM w), v AS (SELECT a, y, metric, floor(value)::BIGINT AS value FROM c UNPIVOT (value FOR metric IN ({', '.join(_STATED)}))),
        l AS (SELECT * FROM (VALUES {_LINES}) AS l(section, line_no, metric))
        SELECT w.a, line_no::BIGINT AS line_no, section || ',' || l.metric || ',' || string_agg(coalesce(v.value::VARCHAR, ''), ',' ORDER BY w.y) AS text
        FROM w CROSS JOIN l LEFT JOIN v ON v.a = w.a AND v.y = w.y AND v.metric = l.metric GROUP BY w.a, line_no, section, l.metric
        UNION ALL SELECT a, 0, 'Section,Line,' || string_agg(y::VARCHAR, ',' ORDER BY y) FROM w GROUP BY a""",
}
