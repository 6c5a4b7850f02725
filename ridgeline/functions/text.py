"""Printed numbers, labels and slugs as column expressions (no Python in the path)."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_number(text: Column) -> Column:
    """A printed number as a double: parentheses are negative; a lone comma before one or two digits is a decimal comma,
    any other comma groups thousands. What is no number gives null."""
    bare = F.regexp_replace(text, "[\\s\\u00A0\\u202F]", "")
    negative = bare.rlike("^\\(.*\\)$")
    bare = F.regexp_replace(bare, "^\\(|\\)$", "")
    decimal_comma = ~bare.contains(".") & bare.rlike("^-?[0-9]+,[0-9]{1,2}$")
    plain = F.when(decimal_comma, F.replace(bare, F.lit(","), F.lit("."))).otherwise(F.replace(bare, F.lit(","), F.lit("")))
    value = F.when(plain.rlike("^-?[0-9]+([.][0-9]+)?$"), plain.cast("double"))
    return F.when(negative, -value).otherwise(value)


def significant_digits(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "[^0-9]", ""), "^0+|0+$", "")


def ordinal(n: Column) -> Column:
    last = n % 10
    end = F.when((n % 100).between(11, 13), "th").when(last == 1, "st").when(last == 2, "nd").when(last == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), end)


def rank_label(rank: Column, of: Column, least: int = 5) -> Column:
    """'3rd of 12', or 'not yet ranked' for small cohorts and ranks outside of them."""
    good = (of >= least) & (rank >= 1) & (rank <= of)
    return F.when(good, F.concat(ordinal(rank), F.lit(" of "), of.cast("string"))).otherwise("not yet ranked")


#: Letters with accents and what stands for them in slugs.
ACCENTS = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.translate(F.lower(text), *ACCENTS), "[^a-z0-9]+", "-"), "^-|-$", "")


def csv_cell(text: Column) -> Column:
    """A cell quoted where it holds a quote, comma or line end; null is empty."""
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.coalesce(F.when(text.rlike('[",\\r\\n]'), quoted).otherwise(text), F.lit(""))


def quote_supports(quote: Column, printed: Column) -> Column:
    """supported, mismatch or missing: whether a quote holds a printed value as it stands, with a decimal comma, without
    either's commas between thousands, or by its significant digits (two at least) in one of its numbers."""
    bare = F.regexp_replace(quote, "[\\s\\u00A0\\u202F]", "")
    digits = significant_digits(printed)
    tokens = F.transform(F.regexp_extract_all(bare, F.lit("[0-9][0-9.,]*"), F.lit(0)), significant_digits)
    plain = lambda c: F.regexp_replace(c, "(?<=[0-9]),(?=[0-9]{3}(?![0-9]))", "")
    held = bare.contains(printed) | plain(bare).contains(plain(printed)) | bare.contains(F.replace(printed, F.lit("."), F.lit(","))) | ((F.length(digits) >= 2) & F.array_contains(tokens, digits))
    return F.when(quote.isNull() | (bare == ""), "missing").when(held, "supported").otherwise("mismatch")


def compact(value: Column) -> Column:
    """'1.2M' and '120K' from 100,000 on, else two decimals, halves up."""
    million = F.concat((F.floor(value / 100000) / 10).cast("string"), F.lit("M"))
    thousand = F.concat(F.floor(value / 1000).cast("string"), F.lit("K"))
    return F.when(value >= 1000000, million).when(value >= 100000, thousand).otherwise((F.floor(value * 100 + 0.5) / 100).cast("decimal(18,2)").cast("string"))


def _decimals(value: Column, most: int, least: int = 0) -> Column:
    """Digits with grouped thousands, rounded half away from zero to `most` decimals; zeros beyond `least` are left out."""
    out = F.format_number(F.round(value.cast("decimal(30,9)"), most), most)
    if most == least:
        return out
    return F.regexp_replace(F.regexp_replace(out, "(?<=[.][0-9]{%d}[0-9]{0,9})0+$" % least, ""), "[.]$", "")


def short_number(value: Column) -> Column:
    """120K, 1.42M, 3B: the largest of thousands to trillions that leaves one or more, to two decimals."""
    size, out = F.abs(value), F.concat(_decimals(value / 1e3, 2), F.lit("K"))
    for least, by, letter in ((999_995.0, 1e6, "M"), (999_995e3, 1e9, "B"), (999_995e6, 1e12, "T")):  # what rounds up to the next
        out = F.when(size >= least, F.concat(_decimals(value / by, 2), F.lit(letter))).otherwise(out)
    return out


#: From this size on numbers are shortened.
SHORT_FROM = 100_000


def format_value(value: Column, unit: Column, short: bool = False) -> Column:
    """A value as its unit is printed; with `short`, numbers and money of 100,000 or more are shortened. Null stays null.

    CAD and USD are both $, with cents only if there are any; percentages and trips an hour have one decimal at most, years
    always one; other numbers have two at most.
    """
    size = F.abs(value)
    number = F.when(F.lit(short) & (size >= SHORT_FROM), short_number(value)).otherwise(_decimals(value, 2))
    sign = F.when(value < 0, "-").otherwise("")
    money = F.when(F.lit(short) & (size >= SHORT_FROM), short_number(size)).when(size == F.floor(size), _decimals(size, 0)).otherwise(_decimals(size, 2, 2))
    return (
        F.when(unit.isin("CAD", "USD"), F.concat(sign, F.lit("$"), money)).when(unit == "%", F.concat(_decimals(value, 1), F.lit("%"))).when(unit == "count", number)
        .when(unit == "hours", F.concat(number, F.lit(" hrs"))).when(unit == "km", F.concat(number, F.lit(" km"))).when(unit == "years", F.concat(F.replace(_decimals(value, 1, 1), F.lit(","), F.lit("")), F.lit(" yrs")))
        .when(unit.isin("CAD/hr", "USD/hr"), F.concat(F.lit("$"), _decimals(value, 2), F.lit("/hr"))).when(unit == "trips/hr", _decimals(value, 1))
        .otherwise(F.concat_ws(" ", _decimals(value, 2), F.nullif(unit, F.lit(""))))
    )


def format_change(percent: Column) -> Column:
    """4.2%: the size alone, with one decimal; an arrow beside it tells the sign."""
    return F.concat(F.replace(_decimals(F.abs(percent), 1, 1), F.lit(","), F.lit("")), F.lit("%"))


def _folds() -> tuple[dict[str, str], dict[str, str]]:
    """Letters whose compatible decomposition has one ASCII character, and those whose has several, by rule."""
    one, several = {}, {}
    for code in [*range(0xA0, 0x2200), *range(0x2460, 0x2500), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F)]:
        plain = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
        if plain:
            (one if len(plain) == 1 else several)[chr(code)] = plain
    return one, several


def ascii_fold(text: Column) -> Column:
    """A text in ASCII: letters by their compatible decomposition (é is e, ﬁ is fi), everything that has none is left out."""
    one, several = _folds()
    rare = f"[{''.join(several)}]"
    spelt = F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in several.items() for x in kv]), c), c)), "")
    text = F.translate(F.when(text.rlike(rare), spelt).otherwise(text), "".join(one), "".join(one.values()))
    return F.regexp_replace(text, "[^\\x00-\\x7F]", "")


def ascii_slug(text: Column) -> Column:
    """`slug` for any text: folded to ASCII first, so a letter without decomposition is left out and cuts no word."""
    return F.regexp_replace(F.regexp_replace(F.lower(ascii_fold(text)), "[^a-z0-9]+", "-"), "^-|-$", "")


def printed_digits(quote: Column, printed: Column) -> Column:
    """Whether a quote holds a value's digits, first as printed, then without points and spaces."""
    bare = lambda c: F.regexp_replace(c, "[^0-9]", "")
    return quote.contains(printed) | ((F.length(bare(printed)) >= 2) & bare(quote).contains(bare(printed)))


def conflict_candidates(note: Column) -> Column:
    """The values that a note 'conflict: 1200 | 1300' lists, as doubles; null unless all of them are numbers."""
    listed = F.regexp_extract(note, "conflict: ([^;]*)", 1)
    values = F.transform(F.split(listed, "[|]"), lambda x: F.replace(F.trim(x), F.lit(","), F.lit("")).try_cast("double"))
    return F.when((listed != "") & ~F.exists(values, lambda x: x.isNull()), values)


def declared_scale(text: Column) -> Column:
    """1000 or 1000000 where a text declares its amounts to be in thousands or millions, else 1."""
    low = F.lower(text)
    return F.when(low.rlike("in thousands|[(]000s?[)]|000s omitted"), 1000).when(low.rlike("in millions"), 1000000).otherwise(1)


def is_heading(line: Column) -> Column:
    return line.rlike("^#{1,6} ")


def direction_word(metric: Column, lower: tuple[str, ...], neutral: tuple[str, ...] = ()) -> Column:
    """'higher is better', 'lower is better' or 'no better end'."""
    return F.when(metric.isin(*neutral), "no better end").when(metric.isin(*lower), "lower is better").otherwise("higher is better")


def file_kind(stem: Column, rules: dict[str, str], exact: dict[str, str]) -> Column:
    """What a file's stem tells: an exact stem first, then the longest prefix of the rules, else null."""
    out = F.lit(None).cast("string")
    for prefix in sorted(rules, key=len):  # the longest is tested first
        out = F.when(stem.startswith(prefix), rules[prefix]).otherwise(out)
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in exact.items() for x in kv]), stem), out)


def file_year(stem: Column) -> Column:
    return F.regexp_extract(stem, "(19|20)[0-9]{2}", 0).try_cast("int")
