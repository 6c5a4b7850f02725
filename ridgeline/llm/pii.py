"""Personal data: base kinds by pattern, and terms that reveal them by corpus co-occurrence; DataFrame functions only.

Base kinds (email, ip, card, phone) are found by patterns and checks. Each distinct value is a protected entity. A word
that stands on an entity's lines, or up to `window` lines above or below (None: anywhere in its documents), reveals it by
PMI(entity; term) / IC(entity) = 1 + ln p(entity | term) / -ln p(entity), with p counted over the documents of the whole
corpus, of which a row that repeats id and text is one; terms that share at least `SUPPORT` documents with an entity (copies of a line count in each) and whose disclosure
is `DISCLOSURE` or more are spans too, wherever they occur, and are removed with the entities.
Words within base spans are not counted, so a name beside its address is scored like any other word.

A match's place comes from the pieces between matches: their lengths add up to its start. The patterns below match as
the plain ones do, but possessively and only at the start of a run, so that very long runs take linear time and no stack.

Entities in fewer than `SUPPORT` documents have no terms: a smaller `support` protects them, at the price of terms by chance.

Defined cases: null texts are empty (sanitised: null stays null); very long texts are taken whole; equal disclosures tie by
kind; repeated rows (of equal id and text) count as one document, so they change no term, and get equal results each; rows
of equal ids and different texts are documents of their own; empty tables give empty results; extra columns are ignored by `find` and kept
by `sanitize`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import blank, cut, nested, small_broadcast

PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What every text with a match of the kind holds; spares the pattern for most texts.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
SUPPORT = 3
#: Lines above and below an entity's own that count as beside it, unless another `window` is given.
WINDOW = 3
DISCLOSURE = 0.9
TERM = r"\p{L}++"
_EMPTY = "cast(array() as array<struct<s:int,e:int,m:string>>)"


def _digits(match: str) -> str:
    return f"regexp_replace({match}, '[^0-9]', '')"


def _valid(kind: str) -> str:
    """SQL over x.m, the match."""
    if kind == "ip":
        return "forall(split(x.m, '[.]'), p -> coalesce(try_cast(p as int) <= 255, false))"
    if kind == "phone":
        return f"length({_digits('x.m')}) between 9 and 15"
    if kind == "card":
        d = _digits("x.m")
        digit = "cast(substr(d, i, 1) as int)"
        luhn = f"aggregate(sequence(1, length(d)), 0, (a, i) -> a + if((length(d) - i) % 2 = 0, {digit}, if({digit} > 4, 2 * {digit} - 9, 2 * {digit}))) % 10 = 0"
        return f"exists(array({d}), d -> if(length(d) between 13 and 19, {luhn}, false))"
    return "true"


def _spans(text: str, matches: str, pieces: str, valid: str = "true") -> Column:
    """array<struct<s, e, m>> of the valid matches, from columns with the matches and the pieces between them."""
    step = "struct(a.pos + length(x.p) + length(x.m) as pos, concat(a.found, array(struct(a.pos + length(x.p) as s, a.pos + length(x.p) + length(x.m) as e, x.m as m))) as found)"
    walk = f"aggregate(zip_with({matches}, slice({pieces}, 1, size({matches})), (m, p) -> struct(m as m, p as p)), struct(0 as pos, {_EMPTY} as found), (a, x) -> {step}, a -> a.found)"
    return F.expr(f"if(size({matches}) = 0, {_EMPTY}, filter({walk}, x -> {valid}))")


def _quoted(pattern: str) -> Column:
    return F.lit(pattern)


def _with_base(docs: DataFrame, text: Column) -> DataFrame:
    """Adds _text and, for each kind, _email, _ip, _card, _phone."""
    out = docs.withColumn("_text", text)
    none = F.expr("cast(array() as array<string>)")
    found = {}
    for kind, pattern in PATTERNS.items():
        m = F.regexp_extract_all("_text", F.lit(pattern), F.lit(0))
        found[f"_m_{kind}"] = F.when(F.contains(F.col("_text"), F.lit(NEEDS[kind])), m).otherwise(none) if NEEDS[kind] else m
    out = out.withColumns(found)
    out = out.withColumns({f"_p_{k}": F.when(F.size(f"_m_{k}") > 0, F.split("_text", p)).otherwise(none) for k, p in PATTERNS.items()})
    out = out.withColumns({f"_{k}": _spans("_text", f"_m_{k}", f"_p_{k}", _valid(k)) for k in PATTERNS})
    return out.drop(*[f"_{x}_{k}" for k in PATTERNS for x in "mp"])


def _words(text: Column) -> Column:
    """The distinct words in lower case that stand outside of base spans; of these, only emails hold letters."""
    rest = F.when(F.contains(text, F.lit("@")), F.regexp_replace(text, PATTERNS["email"], " ")).otherwise(text)
    return F.array_distinct(F.regexp_extract_all(F.lower(rest), F.lit(TERM), F.lit(0)))


def revealing_terms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, disclosure: float = DISCLOSURE, window: int | None = WINDOW) -> DataFrame:
    """(term, kind, disclosure): words that reveal a protected entity somewhere in the corpus."""
    text = blank(F.col(text_col))
    hit = F.lit(False)
    for k, p in PATTERNS.items():
        hit = hit | (F.contains(text, F.lit(NEEDS[k])) & text.rlike(p) if NEEDS[k] else text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"))
    around = "array_join(_l, '\\n')" if window is None else f"array_join(slice(_l, greatest(i + 1 - {window}, 1), i + 1 + {window} - greatest(i - {window}, 0)), '\\n')"
    near = F.expr(f"filter(transform(_l, (x, i) -> struct(x as _line, if(x rlike '[0-9@]', {around}, null) as _around)), x -> x._around is not null)")
    key = F.xxhash64(F.col(id_col), text).alias("_key")
    lines = docs.filter(hit).select(key, F.split(text, "\n").alias("_l"))
    lines = _with_base(lines.select("_key", F.inline(near)), F.col("_line"))
    kinds = F.concat(*[F.expr(f"transform(_{k}, x -> struct('{k}' as kind, lower(x.m) as value))") for k in PATTERNS])
    near = lines.select("_key", "_around", F.explode(F.array_distinct(kinds)).alias("_entity"))
    seen = near.groupBy("_entity").agg(F.count("*").alias("_few")).filter(F.col("_few") >= support)  # a first sieve; documents are counted below
    near = cut(near.join(small_broadcast(seen.select("_entity")), "_entity", "left_semi"), "pii-lines")
    of = near.groupBy("_entity").agg(F.count_distinct("_key").alias("_n_entity"))
    both = near.select("_entity", "_key", _words(F.col("_around")).alias("_words"))
    both = both.groupBy("_entity", "_key").agg(F.array_distinct(F.flatten(F.collect_list("_words"))).alias("_words"))  # a document counts once
    both = both.select("_entity", F.explode("_words").alias("term")).groupBy("_entity", "term").agg(F.count("*").alias("_n_both")).filter(F.col("_n_both") >= support)
    both = cut(both.join(of, "_entity"), "pii-pairs")
    copies = cut(docs.select(key).groupBy("_key").agg(F.count("*").alias("_rows")).groupBy(F.when(F.col("_rows") > 1, F.col("_key")).alias("_key")).agg(F.sum("_rows").alias("_rows"), F.count("*").alias("_n")), "pii-rows")
    n = copies.agg(F.sum("_n")).first()[0]  # documents
    again = copies.filter("_key IS NOT NULL").select("_key", (F.col("_rows") - 1).alias("_more"))  # rows that repeat one
    df = docs.select(F.explode(_words(text)).alias("term")).groupBy("term").agg(F.count("*").alias("_n_term"))
    more = docs.select(key, text.alias("_t")).join(small_broadcast(again), "_key").dropDuplicates(["_key"])
    more = more.select("_more", F.explode(_words(F.col("_t"))).alias("term")).groupBy("term").agg(F.sum(-F.col("_more")).alias("_n_term"))
    df = df.unionByName(more).groupBy("term").agg(F.sum("_n_term").alias("_n_term"))
    ic = F.log(F.lit(float(n or 1)) / F.col("_n_entity"))
    share = F.when(ic > 0, 1 + F.log(F.least(F.lit(1.0), F.col("_n_both") / F.col("_n_term"))) / ic).otherwise(0.0)
    out = both.join(df, "term").withColumn("disclosure", share).filter(F.col("disclosure") >= disclosure)
    return out.groupBy("term").agg(F.max_by("_entity.kind", F.struct("disclosure", "_entity.kind")).alias("kind"), F.max("disclosure").alias("disclosure"))


def _with_terms(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """Adds _terms, the spans of revealing terms, to rows of _id and _text; documents without any are not joined by id unless
    many have some. The words of a document that are terms make up its pattern, so that is no longer than its text."""
    terms = cut(terms, "pii-terms")
    if terms.limit(1).count() == 0:
        return rows.withColumn("_terms", F.expr(_EMPTY))
    words = rows.select("_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("_text"), F.lit(TERM), F.lit(0)))).alias("term"))
    mine = words.join(small_broadcast(terms), "term").groupBy("_id").agg(F.array_join(F.sort_array(F.collect_set("term")), "|").alias("_any"))
    mine = cut(mine, "pii-documents").withColumnRenamed("_id", "_of")
    out = rows.join(small_broadcast(mine), F.col("_id").eqNullSafe(F.col("_of")), "left").drop("_of")
    out = out.withColumn("_pattern", F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), "_any", F.lit(r")(?!\p{L})")))
    out = out.withColumn("_m", F.coalesce(F.regexp_extract_all("_text", F.col("_pattern"), F.lit(0)), F.expr("cast(array() as array<string>)")))
    out = out.withColumn("_p", F.when(F.size("_m") > 0, F.split("_text", F.col("_pattern"))))
    return out.withColumn("_terms", _spans("_text", "_m", "_p")).drop("_any", "_pattern", "_m", "_p")


def _marked(docs: DataFrame, own: Column, id_col: str, text_col: str, window: int | None) -> DataFrame:
    """_doc (own), _id, _text, and the spans of each kind and of terms; no column of docs stands beside them."""
    rows = docs.select(own.alias("_doc"), F.col(id_col).alias("_id"), blank(F.col(text_col)).alias("_text"))
    return _with_terms(_with_base(rows, F.col("_text")), revealing_terms(docs, id_col, text_col, window=window))


def _joined(kind: str, spans: str) -> str:
    return f"transform({spans}, x -> concat('{kind}:', x.s, ':', x.e))"


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int | None = WINDOW) -> DataFrame:
    """Per document: id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term."""
    rows = _marked(docs, F.lit(None), id_col, text_col, window)
    base = ", ".join(_joined(k, f"_{k}") for k in PATTERNS)
    return rows.select(
        F.col("_id").alias(id_col),
        *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in PATTERNS],
        F.expr(f"sha2(array_join(concat({base}), ','), 256)").alias("base_sha256"),
        F.expr(f"array_join(concat({base}, {_joined('term', '_terms')}), ',')").alias("spans"),
        F.size("_terms").cast("long").alias("n_term"),
    )


def sanitize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int | None = WINDOW) -> DataFrame:
    """The documents with base spans generalised to their kind, as [EMAIL], and revealing terms removed."""
    rows = _marked(docs, nested(docs), id_col, text_col, window)
    tagged = ", ".join(f"transform({s}, x -> struct(x.s as s, x.e as e, '{w}' as w))" for s, w in [*((f"_{k}", f"[{k.upper()}]") for k in PATTERNS), ("_terms", "")])
    rows = rows.withColumn("_all", F.expr(f"array_sort(concat({tagged}))"))
    last = "element_at(a, -1)"
    merge = f"case when size(a) = 0 or {last}.e <= x.s then concat(a, array(x)) else concat(slice(a, 1, size(a) - 1), array(struct({last}.s as s, greatest({last}.e, x.e) as e, if({last}.w = '', x.w, {last}.w) as w))) end"
    rows = rows.withColumn("_all", F.expr(f"aggregate(_all, cast(array() as array<struct<s:int,e:int,w:string>>), (a, x) -> {merge})"))
    before = "if(i = 0, 0, element_at(_all, i).e)"
    parts = f"transform(_all, (x, i) -> concat(substr(_text, {before} + 1, x.s - {before}), x.w))"
    clean = F.expr(f"if(size(_all) = 0, _text, concat(array_join({parts}, ''), substr(_text, element_at(_all, -1).e + 1)))")
    own = lambda c: F.col("_doc").getField(c)
    new = F.when(own(text_col).isNotNull(), clean)
    return rows.select(*[new.alias(c) if c == text_col else F.length(new).cast("long").alias(c) if c == "n_chars" else own(c).alias(c) for c in docs.columns])
