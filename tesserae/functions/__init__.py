"""Column functions: text terms, checked arithmetic, two-valued comparison, vectors and intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A run of Han characters, or a run of other letters and digits; all else separates.
RUN = r"\p{IsHan}+|[\p{L}\p{Nd}&&[^\p{IsHan}]]+"
#: The script is asked for only from its first character on.
HAN, ANY_HAN, WORD = r"^\p{IsHan}", r"[\x{2E80}-\x{10FFFF}&&\p{IsHan}]", r"[\p{L}\p{Nd}]++"
NUMBER = r"[-+]?[0-9]+(?:\.[0-9]+)?%?"
WILSON_Z = 1.959963984540054


def lowered(text: Column) -> Column:
    """Letter by letter: a capital sigma gives the same small one at a word's end as elsewhere, a dotted capital I gives an i."""
    return F.when(text.contains("\u03a3") | text.contains("\u0130"), F.lower(F.translate(text, "\u03a3\u0130", "\u03c3i"))).otherwise(F.lower(text))


def terms(text: Column) -> Column:
    """Lower-cased words; a Han run gives its overlapping pairs, or itself if single. Repeats stay. Null text: null."""
    low = lowered(text)
    pairs = lambda r: F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(r) - 1, F.lit(1))), lambda i: F.substr(r, i, F.lit(2)))
    mixed = F.flatten(F.transform(F.regexp_extract_all(low, F.lit(RUN), F.lit(0)), lambda r: F.when(r.rlike(HAN), pairs(r)).otherwise(F.array(r))))
    return F.when(low.rlike(ANY_HAN), mixed).otherwise(F.regexp_extract_all(low, F.lit(WORD), F.lit(0)))


def unique_terms(text: Column) -> Column:
    """Terms in order of first appearance."""
    return F.array_distinct(terms(text))


def normalize_words(text: Column) -> Column:
    """Lower-cased runs of letters and digits, joined by one blank."""
    return F.array_join(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), " ")


def canonical(name: Column) -> Column:
    return F.lower(F.trim(name))


def numeric_tokens(text: Column) -> Column:
    """Numbers with sign, fraction and per cent mark as written."""
    return F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))


def digest(*columns: Column | str) -> Column:
    """SHA-256 of the columns as canonical JSON."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def two_valued(comparison: Column) -> Column:
    """A comparison that is false, not null, where a side is null."""
    return F.coalesce(comparison, F.lit(False))


def must_hold(value: Column, message: str) -> Column:
    """A boolean operand; null is an error."""
    return F.when(value.isNull(), F.raise_error(F.lit(message)).cast("boolean")).otherwise(value)


def int_divide(a: Column, b: Column) -> Column:
    """Truncating division of 64-bit integers; a zero divisor and the overflowing case are errors."""
    overflow = F.raise_error(F.lit("integer overflow")).cast("long")
    exact = a - F.call_function("mod", a, b)
    return F.when((a == F.lit(-(1 << 63))) & (b == -1), overflow).otherwise(F.call_function("div", exact, b))


def int_remainder(a: Column, b: Column) -> Column:
    """Remainder with the dividend's sign; zero divisor and the overflowing case are errors."""
    return F.when((a == F.lit(-(1 << 63))) & (b == -1), F.raise_error(F.lit("integer overflow")).cast("long")).otherwise(F.call_function("mod", a, b))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, summed from the left."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def wilson(successes: Column, trials: Column) -> tuple[Column, Column]:
    """Bounds of Wilson's 95 % interval within [0, 1]; nulls without trials."""
    n, z = trials.cast("double"), WILSON_Z
    p = successes / n
    middle = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    bound = lambda x: F.when(trials > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)))
    return bound(middle - half), bound(middle + half)


def join_path(parent: Column, name: Column) -> Column:
    return F.when(parent == "/", F.concat(F.lit("/"), name)).otherwise(F.concat(parent, F.lit("/"), name))
