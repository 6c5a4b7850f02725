"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm import ann, bpe, decontaminate, fingerprint, mixture, neardup, periods, pii, quality, repeats, shard, spelling, warc
from ridgeline.llm.common import WORD, table


def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.filter("vec_id % 20 = 0"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = warc.round_trip(table(spark, sf_dir, "pages"))
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.shard_documents(table(spark, sf_dir, "documents"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_pairs(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), ids=False, decoded=False, digests=True)


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def misspelt(doc: Column, run: Column) -> Column:
    """The run, or, for one in 97 by crc32 of `<id>:<run>`, the run without the letter at crc32 % length."""
    h = F.crc32(F.concat(doc, F.lit(":"), run))
    at = (h % F.length(run)).cast("int")
    return F.when(h % 97 == 0, F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))).otherwise(run)


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(table(spark, sf_dir, "documents"), misspelt))


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return got.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")


def repeating(docs: DataFrame) -> DataFrame:
    """Documents of which one in ten, by crc32 of the id, repeats its words from some place on with some period."""
    h = F.crc32(F.col("doc_id").cast("string"))
    rows = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"))
    words = F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(f"{WORD}+"), F.lit(0)))
    rows = rows.withColumn("w", words).withColumn("n", F.size(F.coalesce("w", F.expr("array()"))))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    told = F.expr("array_join(transform(sequence(0, n - 1), i -> w[cast(if(i < a, i, a + (i - a) % p) as int)]), ' ')")
    return rows.select("doc_id", F.when(F.col("n") > 0, told).otherwise(F.col("text")).alias("text"))


def op13_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = periods.runs(repeating(table(spark, sf_dir, "documents")))
    got = got.withColumn("top", F.expr("get(array_sort(transform(runs, r -> struct(-r.length as less, r.start as start, r.period as period))), 0)"))
    length = -F.col("top.less")
    listed = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return got.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("top.start").alias("start"), length.alias("length"), F.col("top.period").alias("period"),
        F.floor(1000 * length / F.col("top.period")).cast("long").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


ORACLES = {
    "op4_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
             q AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS payload_digest,
                          max(page_id) OVER (PARTITION BY body) AS head FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND head <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND head <> page_id THEN head END AS refers_to
        FROM q""",
    "op12_decontaminate": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
             b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
             k AS (SELECT item_id, w, least(len(w), 10) AS k FROM b WHERE len(w) > 0),
             g AS (SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS g FROM (SELECT item_id, k, w, unnest(range(1, (len(w) - k + 2)::BIGINT)) AS i FROM k)),
             d AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS g
                   FROM (SELECT doc_id, w, k, unnest(range(1, (len(w) - k + 2)::BIGINT)) AS i FROM w, (SELECT DISTINCT k FROM g) WHERE len(w) >= k)),
             h AS (SELECT d.doc_id, d.i, d.k, g.item_id FROM d JOIN g USING (k, g)),
             n AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS pos FROM (SELECT DISTINCT doc_id, i, k FROM h)) GROUP BY 1),
             t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY 1)
        SELECT w.doc_id, coalesce(len(w.w), 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN t ON t.doc_id = w.doc_id""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
