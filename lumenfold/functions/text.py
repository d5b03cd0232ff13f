"""Normalisation of headers, cells and null classes, as Spark column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

# What counts as a placeholder, an asserted absence, a null or an ambiguous mark.
PLACEHOLDERS = [
    "na", "n/a", "n.a.", "n.a", "none", "null", "nil", "-", "--", "---", "nan", "not available", "notavailable",
    "not applicable", "notapplicable", "unknown", "tbd", "to be decided", "?", "n/f", "not found", "not specified", "blank",
]
ABSENCE = [
    "none", "nil", "not applicable", "notapplicable", "not required", "none required", "no", "nothing", "not needed",
    "does not apply", "no data", "not mandatory", "zero", "0 nos", "absent",
]
EXPLICIT_NULL = ["null", "nan", "(null)", "blank", "empty"]
AMBIGUOUS = [
    "na", "n/a", "n.a.", "n.a", "-", "--", "---", "?", "??", "tbd", "to be decided", "to be determined", "unknown",
    "not available", "notavailable", "not found", "n/f", "not specified", "not mentioned", "unspecified", "pending",
    "under review", "refer document", "as above", "same as above", "-do-", "do", "see above", "—", "–",
]
STOPWORDS = ["the", "a", "an", "of", "for", "and", "or", "in", "with", "type", "types", "other", "general", "all", "its", "to", "on", "by", "s"]
SEARCH_STOPWORDS = [
    "what", "which", "who", "where", "when", "is", "are", "the", "a", "an", "of", "for", "to", "and", "apply", "applies",
    "required", "require", "relevant", "can", "perform", "do", "them", "my", "me", "tell", "show", "give", "this", "that",
    "these", "those", "with", "how", "does",
]

def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is made once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


BLANK = " \\t\\r\\n\\f\\x0B"


def strip(c: Column) -> Column:
    """Trim all ASCII blanks, not only spaces."""
    return F.regexp_replace(c, f"^[{BLANK}]+|[{BLANK}]+$", "")


def squeeze(c: Column) -> Column:
    """Unify wide spaces, delete zero-width marks, make runs of blanks one space, trim; null becomes empty."""
    c = F.translate(F.coalesce(c.cast("string"), F.lit("")), "   ﻿​‌‍⁠", "   ")
    return F.trim(F.regexp_replace(c, f"[{BLANK}]+", " "))


def norm_header(c: Column) -> Column:
    c = F.lower(strip(F.translate(F.coalesce(c, F.lit("")), " ﻿", " ")))
    return F.regexp_replace(F.regexp_replace(c, "[^0-9a-z]+", "_"), "^_+|_+$", "")


def is_empty(c: Column) -> Column:
    return c.isNull() | (strip(c.cast("string")) == "") | (c.cast("string") == "NaN")


def is_placeholder(c: Column) -> Column:
    return F.coalesce(~is_empty(c) & F.lower(strip(c.cast("string"))).isin(PLACEHOLDERS), F.lit(False))


INTEGER = "^[+-]?[0-9]+$"
NUMBER = "^[+-]?([0-9]+\\.[0-9]*|\\.[0-9]+|[0-9]+)([eE][+-]?[0-9]+)?$"


def norm_cell(c: Column) -> Column:
    """Comparable text of a cell: placeholders are empty, integers canonical, fractions plain decimals of ten places, else lower case."""

    def of(s: Column) -> Column:
        digits = F.regexp_replace(s, "^\\+?(-?)0*([0-9])", "$1$2")
        plain = F.regexp_replace(F.round(s.try_cast("double"), 10).try_cast("decimal(38,10)").cast("string"), "\\.?0+$", "")
        return (
            F.when((s == "") | F.lower(s).isin(PLACEHOLDERS), "")
            .when(s.rlike(INTEGER), F.when(digits == "-0", "0").otherwise(digits))
            .when(s.rlike(NUMBER), F.coalesce(F.when(plain == "-0", "0").otherwise(plain), F.lower(s)))
            .otherwise(F.lower(s))
        )

    # an array of one, so that the stripped text is made once and not in every branch
    s = F.regexp_replace(strip(F.translate(F.coalesce(c.cast("string"), F.lit("")), "\u00a0", " ")), f"[{BLANK}]+", " ")
    return F.element_at(F.transform(F.array(s), of), 1)


def norm_of(df: DataFrame, name: str) -> Column:
    """``norm_cell`` of a column; whole numbers are comparable as they are."""
    c = F.col(name)
    return F.coalesce(c.cast("string"), F.lit("")) if isinstance(df.schema[name].dataType, IntegralType) else norm_cell(c)


def null_class(c: Column) -> Column:
    """POPULATED, NULL_UNKNOWN, ASSERTED_ABSENCE or AMBIGUOUS_REQUIRES_REVIEW."""

    def of(s: Column, t: Column) -> Column:
        return (
            F.when((s == "") | t.isin(EXPLICIT_NULL), "NULL_UNKNOWN")
            .when(t.isin(ABSENCE), "ASSERTED_ABSENCE")
            .when(t.isin(AMBIGUOUS), "AMBIGUOUS_REQUIRES_REVIEW")
            .otherwise("POPULATED")
        )

    return let(squeeze(c), lambda s: let(F.trim(F.regexp_replace(F.lower(s), "\\.+$", "")), lambda t: of(s, t)))


def populated(c: Column) -> Column:
    return null_class(c) == "POPULATED"


def value(c: Column) -> Column:
    """The squeezed value, empty unless populated."""
    return let(squeeze(c), lambda s: F.when(populated(s), s).otherwise(""))


def missing_reason(cls: Column) -> Column:
    return (
        F.when(cls == "NULL_UNKNOWN", "SOURCE_CELL_EMPTY")
        .when(cls == "ASSERTED_ABSENCE", "SOURCE_ASSERTS_ABSENCE")
        .when(cls == "AMBIGUOUS_REQUIRES_REVIEW", "SOURCE_PLACEHOLDER_AMBIGUOUS")
        .otherwise("")
    )


def h16(c: Column) -> Column:
    return F.substring(F.sha1(c.cast("binary")), 1, 16)


def row_hash(columns: list[Column]) -> Column:
    """First 16 hex digits over the cells, unit-separated; missing cells are empty."""
    return h16(F.concat_ws("\u001f", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]))


def cap(values: Column, n: int = 12) -> Column:
    """The first ``n`` of the sorted array, joined, with a note of how many more there are."""
    ordered = F.array_sort(values)
    more = F.when(F.size(ordered) > n, F.concat(F.lit(" …(+"), (F.size(ordered) - n).cast("string"), F.lit(")"))).otherwise("")
    return F.concat(F.array_join(F.slice(ordered, 1, n), "; "), more)


def stem(t: Column) -> Column:
    long = F.length(t) > 4
    return (
        F.when(long & t.endswith("ies"), F.concat(F.substring(t, F.lit(1), F.length(t) - 3), F.lit("y")))
        .when(long & t.endswith("ses"), F.substring(t, F.lit(1), F.length(t) - 3))
        .when(long & t.endswith("es"), F.substring(t, F.lit(1), F.length(t) - 2))
        .when(long & t.endswith("s"), F.substring(t, F.lit(1), F.length(t) - 1))
        .otherwise(t)
    )


def tokens(c: Column) -> Column:
    """The set of stemmed words, without stopwords."""
    parts = F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^0-9a-z]+"), lambda t: (t != "") & ~t.isin(STOPWORDS))
    return F.array_distinct(F.transform(parts, stem))


def significant_tokens(c: Column, least: int = 3) -> Column:
    parts = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(parts, lambda t: (F.length(t) >= least) & ~t.isin(SEARCH_STOPWORDS))


def punctuation_free(c: Column) -> Column:
    """Lower case with punctuation as single spaces: two values with the same form are the same to a merge."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^0-9a-zऀ-ॿ]+", " "))


def detect_language(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")).rlike("[ऀ-ॿ]"), "hi").otherwise("en")


def safe_name(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9._-]+", "_"), "^_+|_+$", "")


def digits(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), "[^0-9]", "")


def name_family(c: Column) -> Column:
    """A file name without extension, copy marks, versions and dates."""
    c = F.regexp_replace(F.lower(c), "\\.[a-z0-9]{1,5}$", "")
    c = F.regexp_replace(c, "\\([0-9]+\\)|[_ -]*(?:copy|final|v(?:er(?:sion)?)?[_ -]?[0-9.]+|[0-9]{4}[-_]?[0-9]{2}[-_]?[0-9]{2})", "")
    return F.regexp_replace(F.regexp_replace(c, "[^a-z0-9]+", "_"), "^_+|_+$", "")


def redact_url(c: Column) -> Column:
    """Hide user and password of a URL."""
    return F.regexp_replace(c, "^([A-Za-z][A-Za-z0-9+.-]*://)[^/@\\s]*@", "$1***@")
