"""Documents in pages, lines and files: chunks with carried context, cue scores, page selection, windows, file rules."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.functions.cues import longest_cues, overlaps_itself
from ridgeline.operators.lifecycle import number_in_order

#: A heading line, and a line's declared scale, in English or French.
HEADING = r"(?md)^(#{1,6}[^\S\n]+\S.*)$"
SCALE = r"(?imd)^.*?(\((?:in[^\S\n]+|en[^\S\n]+)?(?:\$?[^\S\n]*000s?|thousands|milliers|millions)[^)\n]*\)).*$"
#: A number with separators, how much a cue and at most how many numbers count.
NUMBER, CUE_WEIGHT, MOST_NUMBERS = r"[0-9][0-9,.]*[0-9]", 5, 40
#: Words of a page that holds figures of an agency's services and statements.
METRIC_CUES = [
    "ridership", "rider", "boarding", "revenue ride", "passenger", "trip", "journey", "revenue", "fare", "farebox",
    "expenditure", "expense", "operating cost", "operating budget", "budget", "subsidy", "funding", "service hour", "revenue hour", "vehicle hour",
    "service kilom", "service km", "vehicle kilom", "vehicle km", "fleet", "buses", "vehicle", "streetcar", "train",
    "on-time", "on time", "punctual", "reliabilit", "performance", "employee", "position", "staff", "headcount", "fte",
    "statement of financial position", "etat de la situation financiere", "état de la situation financière",
    "statement of operations", "état des résultats", "etat des resultats", "net debt", "dette nette", "tangible capital", "immobilisations corporelles",
    "financial assets", "actifs financiers", "liabilities", "passif", "accumulated surplus", "excédent accumulé", "excedent accumule",
    "achalandage", "heures de service", "kilomètres parcourus", "kilometres parcourus",
]


def context_chunks(
    docs: DataFrame, id_col: str, text_col: str, target_lines: int = 350, heading: str = HEADING, scale: str = SCALE, blank: str = r"\s", ends: str | None = "\r\n?"
) -> DataFrame:
    """(id, chunk, heading, scale, context, lines, body): a text's paragraphs packed greedily, each chunk with the last
    heading and the last declared scale before it.

    Paragraphs (runs of lines that are not blank) are never cut: a chunk has at most `target_lines` lines, counted before the
    blank line that joins the next paragraph, unless one paragraph has more. The packing is a fold over one text's
    paragraphs, so nothing is shuffled. Null and blank texts have no chunk. A line ends at a line feed and at what `ends`
    matches, and is blank if all its characters are of the class `blank`; patterns see line feeds as the only line ends.
    """
    lines = F.concat(F.lit("\n"), F.col(text_col), F.lit("\n"))
    lines = F.regexp_replace(lines, ends, "\n") if ends else lines
    rows = docs.select(id_col, F.transform(F.split(lines, rf"\n[{blank}\n]*\n"), lambda b: F.regexp_replace(b, r"\A\n|\n\z", "")).alias("_all"))
    rows = rows.select(id_col, F.filter("_all", lambda b: b.rlike(rf"[^{blank}\n]")).alias("_b")).filter(F.size("_b") > 0)
    rows = rows.withColumn("_n", F.transform("_b", lambda b: F.regexp_count(b, F.lit("\n")) + 1))
    said = lambda pattern: F.transform("_b", lambda b, i: F.struct(i.alias("i"), F.try_element_at(F.regexp_extract_all(b, F.lit(pattern), F.lit(1)), F.lit(-1)).alias("said")))
    rows = rows.withColumns({c: F.filter(said(p), lambda x: x["said"].isNotNull()) for c, p in (("_heads", heading), ("_scales", scale))})
    fits = f"a.held > 0 and a.held + n > {target_lines}"
    step = f"struct(a.i + 1 as i, if({fits} or a.held = 0, n, a.held + 1 + n) as held, if({fits}, concat(a.starts, array(a.i)), a.starts) as starts)"
    rows = rows.withColumn("_starts", F.expr(f"aggregate(_n, struct(0 as i, 0 as held, array(0) as starts), (a, n) -> {step}, a -> a.starts)"))
    rows = rows.select("*", F.posexplode("_starts").alias("chunk", "_from")).withColumn("_size", F.coalesce(F.try_element_at("_starts", F.col("chunk") + 2), F.size("_b")) - F.col("_from"))
    before = lambda c: F.try_element_at(F.filter(c, lambda x: x["i"] < F.col("_from")), F.lit(-1))["said"]
    rows = rows.withColumns({"heading": F.regexp_replace(before("_heads"), rf"[{blank}]+\z", ""), "scale": before("_scales")})
    parts = F.concat_ws("; ", F.concat(F.lit('section: "'), "heading", F.lit('"')), F.concat(F.lit('scale declaration: "'), "scale", F.lit('"')))
    body = F.slice("_b", F.col("_from") + 1, F.col("_size"))
    return rows.select(
        id_col, "chunk", "heading", "scale", F.when(parts != "", F.concat(F.lit("Context from earlier in the document — "), parts)).otherwise("").alias("context"),
        (F.aggregate(F.slice("_n", F.col("_from") + 1, F.col("_size")), F.lit(-1), lambda a, n: a + n + 1)).alias("lines"), F.array_join(body, "\n\n").alias("body"),
    )


def cue_hits(rows: DataFrame, keys: list[str], text: Column, cues: list[str]) -> DataFrame:
    """(keys, cue, hits): how often each cue stands in a text (in any case, without overlapping itself); none is no row.

    At each place the longest cue is found; the cues that it begins with stand there too and come from a table of chains. A
    cue that can overlap itself is counted by itself.
    """
    spark, low = rows.sparkSession, F.lower(F.coalesce(text, F.lit("")))
    cues = list(dict.fromkeys(cues))
    alone, free = ([c for c in cues if overlaps_itself(c) == own] for own in (True, False))
    found = spark.createDataFrame([], rows.select(*keys).schema.add("cue", "string").add("hits", "long"))
    if free:
        chains = spark.createDataFrame([(m, c) for m in free for c in free if m.startswith(c)], "_match string, cue string")
        seen = rows.select(*keys, F.explode(longest_cues(low, free)).alias("_match")).groupBy(*keys, "_match").agg(F.count("*").alias("_n"))
        found = seen.join(F.broadcast(chains), "_match").groupBy(*keys, "cue").agg(F.sum("_n").alias("hits"))  # the caller's list of cues
    if alone:
        each = F.explode(F.array(*[F.struct(F.lit(c).alias("cue"), ((F.length(low) - F.length(F.replace(low, F.lit(c), F.lit("")))) / len(c)).cast("long").alias("hits")) for c in alone])).alias("_c")
        found = found.unionByName(rows.select(*keys, each).select(*keys, "_c.cue", "_c.hits").filter("hits > 0"))
    return found


def page_scores(pages: DataFrame, keys: list[str], text_col: str, cues: list[str] | None = None) -> DataFrame:
    """(keys, score): cue hits, weighted, and the numbers of a page up to a limit."""
    hits = cue_hits(pages, keys, F.col(text_col), METRIC_CUES if cues is None else cues).groupBy(*keys).agg(F.sum("hits").alias("_hits"))
    numbers = F.least(F.coalesce(F.regexp_count(text_col, F.lit(NUMBER)), F.lit(0)), F.lit(MOST_NUMBERS))
    rows = pages.select(*keys, numbers.alias("_numbers")).join(hits, keys, "left")
    return rows.select(*keys, (CUE_WEIGHT * F.coalesce("_hits", F.lit(0)) + F.col("_numbers")).cast("long").alias("score"))


def select_pages(scored: DataFrame, doc: str, page: str, most: int, head: int = 3) -> DataFrame:
    """The pages of each document worth reading: all if there are at most `most`; else the first ones, and of the others those
    of the best scores (zeros only where nothing scores), up to `most`. Adds `place`, from 1 in page order."""
    of, by = Window.partitionBy(doc), Window.partitionBy(doc).orderBy(page)
    rows = scored.withColumns({"_n": F.count("*").over(of), "_nth": F.row_number().over(by)})
    front = F.col("_nth") <= min(head, most)
    rows = rows.withColumns({"_front": front, "_any": F.max(F.when(~front, F.col("score"))).over(of) > 0})
    fair = ~F.col("_front") & ((F.col("score") > 0) | ~F.col("_any"))
    rows = rows.withColumn("_fair", fair).withColumn("_rank", F.row_number().over(Window.partitionBy(doc, "_fair").orderBy(F.desc("score"), page)))
    kept = rows.filter((F.col("_n") <= most) | F.col("_front") | (F.col("_fair") & (F.col("_rank") <= most - min(head, most))))
    return kept.withColumn("place", F.row_number().over(by)).select(*scored.columns, "place")


def page_windows(pages: DataFrame, doc: str, page: str, size: str, most_pages: int = 100, most_bytes: int = 32 << 20) -> DataFrame:
    """pages (doc, page from 0 without gaps, size) with first, n_pages and n_bytes of the window each is in.

    Windows of `most_pages` pages are halved while they are over `most_bytes` and have more than one page, so a page's place
    in its window plus `first` is its number in the document. All passes work on one partitioning by document.
    """
    of = Window.partitionBy(doc)
    rows = pages.withColumn("first", (F.floor(F.col(page) / most_pages) * most_pages).cast("long"))
    rows = rows.withColumn("n_pages", F.least(F.lit(most_pages), F.max(page).over(of) + 1 - F.col("first")).cast("long"))
    within = F.sum(size).over(Window.partitionBy(doc, "first"))
    for _ in range(math.ceil(math.log2(max(2, most_pages)))):
        half = F.floor(F.col("n_pages") / 2)
        rows = rows.withColumn("n_bytes", within).withColumn("_cut", (F.col("n_bytes") > most_bytes) & (F.col("n_pages") > 1)).withColumn("_late", F.col(page) >= F.col("first") + half)
        rows = rows.withColumns({
            "first": F.when(F.col("_cut") & F.col("_late"), F.col("first") + half).otherwise(F.col("first")),
            "n_pages": F.when(F.col("_cut"), F.when(F.col("_late"), F.col("n_pages") - half).otherwise(half)).otherwise(F.col("n_pages")),
        })
    return rows.withColumn("n_bytes", within).select(*pages.columns, "first", "n_pages", "n_bytes")


def sliding_batches(pages: DataFrame, doc: str, page: str, bucket: Column, batch: int = 5, overlap: int = 0) -> DataFrame:
    """pages with batch_no: each document's pages in order in batches of `batch`, each sharing `overlap` with the one before;
    the last batch is the first that reaches the end. A shared page is two rows. `bucket`: as for `number_in_order`."""
    step = max(1, batch - overlap)
    rows = number_in_order(pages, [doc], bucket, [page], "_nth")
    total = rows.groupBy(F.col(doc).alias("_of")).agg(F.count("*").alias("_n"))
    rows = rows.join(total, F.col(doc).eqNullSafe(F.col("_of"))).withColumn("_k", F.col("_nth") - 1)
    first = F.greatest(F.lit(0), F.ceil((F.col("_k") - batch + 1) / step))
    last = F.least(F.floor(F.col("_k") / step), F.greatest(F.lit(0), F.ceil((F.col("_n") - batch) / step)))
    return rows.select(*pages.columns, F.explode(F.sequence(first.cast("long"), last.cast("long"))).alias("batch_no"))


def file_specs(files: DataFrame, rules: DataFrame, exact: DataFrame, name: str = "file_name") -> DataFrame:
    """files with stem, year, and the columns of the rule that holds: an exact stem's, else that of the longest prefix.

    rules: prefix and columns; exact: stem and the same columns. A stem's prefixes are joined with the rules, however many
    there are; the first year from 1900 to 2099 in the name counts. Without a year or a rule, `skipped` says why.
    """
    spec = [c for c in rules.columns if c != "prefix"]
    told = F.struct(*spec)
    rows = files.withColumn("stem", F.regexp_replace(F.col(name), "(?i)[.]pdf$", ""))
    stems = rows.select("stem").distinct()
    ways = stems.select("stem", F.explode(F.expr("transform(sequence(1, length(stem)), k -> left(stem, k))")).alias("prefix")).join(rules, "prefix")
    best = ways.groupBy("stem").agg(F.max_by(told, F.struct(F.length("prefix"), "prefix")).alias("_best"))
    rows = rows.join(best, "stem", "left").join(exact.select("stem", told.alias("_exact")), "stem", "left")
    rows = rows.withColumns({"year": F.regexp_extract("stem", "(?:19|20)[0-9]{2}", 0).try_cast("int"), "_spec": F.coalesce("_exact", "_best")})
    skipped = F.when(F.col("year").isNull(), "no launch year in name").when(F.col("_spec").isNull(), "no rule for name")
    return rows.select(*files.columns, "stem", "year", *[F.when(skipped.isNull(), F.col(f"_spec.{c}")).alias(c) for c in spec], skipped.alias("skipped"))


def sync_catalog(catalog: DataFrame, files: DataFrame, agencies: DataFrame) -> DataFrame:
    """The catalog after files (of `file_specs`, with agency, file_hash, file_bytes) were stored: storage_key, agency, year,
    file_hash, file_bytes, scan_status, action.

    A key that is there has its hash and size refreshed and keeps its scan_status; a new one is pending; the rest is kept. Of
    files with one key that of the greatest hash counts. Files that are skipped, or whose agency is not known, come last with why.
    """
    known = agencies.select("agency").distinct().withColumn("_known", F.lit(True))
    rows = files.join(known, "agency", "left")
    rows = rows.withColumn("skipped", F.coalesce("skipped", F.when(F.col("_known").isNull(), F.concat(F.lit("agency not seeded: "), "agency"))))
    rows = rows.withColumn("storage_key", F.when(F.col("skipped").isNull(), F.concat_ws("/", "agency", "file_name")))
    new = rows.filter("skipped IS NULL").groupBy("storage_key").agg(F.max_by(F.struct("agency", "year", "file_hash", "file_bytes"), F.struct("file_name", "file_hash", "file_bytes")).alias("n"))
    old = catalog.select("storage_key", F.struct("agency", "year", "file_hash", "file_bytes").alias("o"), F.col("scan_status").alias("_status"))
    both = old.join(new, "storage_key", "full_outer")
    same = F.col("o.file_hash").eqNullSafe(F.col("n.file_hash"))
    action = F.when(F.col("n").isNull(), "kept").when(F.col("o").isNull(), "inserted").when(same, "unchanged").otherwise("refreshed")
    stored = both.select("storage_key", F.coalesce("n", "o").alias("v"), F.when(F.col("o").isNull(), "pending").otherwise(F.col("_status")).alias("scan_status"), action.alias("action"))
    stored = stored.select("storage_key", "v.*", "scan_status", "action")
    left = rows.filter("skipped IS NOT NULL").select(F.col("file_name").alias("storage_key"), "agency", "year", "file_hash", "file_bytes", F.lit(None).cast("string").alias("scan_status"), F.concat(F.lit("skipped: "), "skipped").alias("action"))
    return stored.unionByName(left)
