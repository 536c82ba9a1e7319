"""Scalar column functions. Everything stays in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space at the ends, as Unicode counts it.
_ENDS = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
#: Line ends that split a text into lines.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, _ENDS, "")


def lines_of(text: Column) -> Column:
    """Lines without their ends; no empty last line."""
    return F.filter(F.split(text, LINE_END), lambda x, i: (x != "") | (i < F.size(F.split(text, LINE_END)) - 1))


def lines_with_ends(text: Column) -> Column:
    """Lines with their ends kept, so that joining them gives the text back."""
    return F.regexp_extract_all(text, F.lit(rf"(?s)((?:(?!{LINE_END}).)*(?:{LINE_END})|(?:(?!{LINE_END}).)+$)"), 1)


def alnum(c: Column) -> Column:
    """Lower case, everything but ASCII letters and digits removed."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def query_terms(query: str) -> list[str]:
    """Distinct lower-case terms of a literal query, in order."""
    return list(dict.fromkeys(t for t in re.split(r"\W+", query.lower()) if t))


def terms_of(query: Column) -> Column:
    """``query_terms`` of a column."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(query, F.lit(""))), r"(?U)\W+"), lambda t: t != ""))


def term_share(text: Column, terms: list[str] | Column) -> Column:
    """Share of the terms, a list or an array column, that occur in the text as substrings."""
    low = F.lower(text)
    if isinstance(terms, Column):
        return F.size(F.filter(terms, lambda t: F.contains(low, t))) / F.greatest(F.size(terms), F.lit(1)).cast("double")
    hits = sum((F.contains(low, F.lit(t)).cast("int") for t in terms), F.lit(0))
    return hits / F.lit(float(max(len(terms), 1)))


def tokens(c: Column) -> Column:
    """Distinct runs of ASCII letters and digits, lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), 1))


def title_case(c: Column) -> Column:
    """First letter of every run of letters upper case, the others lower."""
    parts = F.regexp_extract_all(c, F.lit(r"(\p{L}+|\P{L}+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, F.lit(2), F.length(p))))), "")


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once; a plain column is copied into every use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 for unequal lengths or a zero norm."""

    def of(v: Column) -> Column:
        dot = F.aggregate(F.zip_with(v["a"], v["b"], lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
        norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
        parts = F.struct(dot.alias("dot"), norm(v["a"]).alias("na"), norm(v["b"]).alias("nb"))
        return F.when(F.size(v["a"]) != F.size(v["b"]), F.lit(0.0)).otherwise(let(parts, lambda p: F.when((p["na"] == 0) | (p["nb"] == 0), F.lit(0.0)).otherwise(p["dot"] / (p["na"] * p["nb"]))))

    return let(F.struct(a.alias("a"), b.alias("b")), of)


def hash_embedding(text: Column, dim: int = 64) -> Column:
    """Unit vector from chained SHA-256 digests, read as big-endian 32-bit numbers.

    Every round appends the digest of all bytes so far.
    """
    rounds = -(-4 * dim // 32) - 1
    first = F.sha2(F.encode(text, "UTF-8"), 256)
    grown = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), first, lambda acc, _: F.concat(acc, F.sha2(F.unhex(acc), 256))) if rounds > 0 else first

    def numbers(g: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.conv(F.substring(g, i * 8 + 1, F.lit(8)), 16, 10).cast("double") / 2147483648.0 - 1.0)

    def unit(v: Column) -> Column:
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
        return let(norm, lambda n: F.transform(v, lambda x: x / F.when(n == 0, F.lit(1.0)).otherwise(n)))

    return let(grown, lambda g: let(numbers(g), unit))


#: Date patterns by place of use; each list is tried in order.
POSTPROCESS_DATES = ["MMMM d, yyyy", "MMMM d yyyy", "MMM d, yyyy", "MMM d yyyy", "M/d/yyyy", "M/d/yy", "yyyy-M-d", "M-d-yyyy", "d MMMM yyyy", "d MMM yyyy"]
REVIEW_DATES = ["yyyy-M-d", "M/d/yyyy", "M-d-yyyy", "MMMM d, yyyy", "MMM d, yyyy"]
EVALUATION_DATES = ["MMMM d, yyyy", "MMMM d yyyy", "M/d/yyyy", "M/d/yy", "yyyy-M-d", "MMM d, yyyy", "d MMMM yyyy"]


_PARTS = re.compile(r"MMMM|MMM|yyyy|yy|[Md]")


def _shape(pattern: str) -> str:
    """A pattern that all texts of a date pattern fit: words for month names, digits for the rest."""
    out, at = "", 0
    for m in _PARTS.finditer(pattern):
        out += re.escape(pattern[at : m.start()]) + (r"[\p{L}.]+" if m[0].startswith("MMM") else r"[+-]?\d+")
        at = m.end()
    return f"^{out}{re.escape(pattern[at:])}$"


def parse_date(value: Column, patterns: list[str]) -> Column:
    """First pattern that fits, as a date; null if none does.

    The patterns are the optional parts of one, so a text is parsed once, and only where it
    has the shape of any: a failed parse costs far more than the test.
    """
    shaped = F.initcap(value)  # month names in any case
    fits = (F.length(value) <= 40) & value.rlike("|".join(map(_shape, patterns)))
    return F.try_to_timestamp(F.when(fits, shaped), F.lit("".join(f"[{p}]" for p in patterns))).cast("date")


def amount(value: Column) -> Column:
    """A number after dropping thousands separators and the currency sign."""
    return F.regexp_replace(value, r"[$,\s]", "").try_cast("double")


def review_amount(value: Column) -> Column:
    """First number in the value; a sign before it is not part of it."""
    return F.regexp_replace(F.regexp_extract(value, r"-?\$?\s*([\d,]+(?:\.\d+)?)", 1), ",", "").try_cast("double")


def needle_snippet(text: Column, needle: Column, limit: int = 160) -> Column:
    """40 characters before to 60 after the needle, else the first ``limit``; cut ends are marked."""
    at = F.when(F.length(strip(needle)) > 0, F.instr(F.lower(text), F.lower(strip(needle)))).otherwise(0)
    start = F.greatest(F.lit(0), at - 1 - 40)
    end = F.least(F.length(text), at - 1 + F.length(needle) + 60)
    around = F.concat(
        F.when(start > 0, "…").otherwise(""),
        strip(F.substring(text, start + 1, end - start)),
        F.when(end < F.length(text), "…").otherwise(""),
    )
    head = F.concat(strip(F.substring(text, 1, limit)), F.when(F.length(text) > limit, "…").otherwise(""))
    return F.when(at > 0, around).otherwise(head)


def percent(c: Column) -> Column:
    return F.concat(F.format_string("%.0f", c * 100), F.lit("%"))
