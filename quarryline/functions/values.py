"""Column expressions with the value semantics that the rules rely on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that suggest a missing value, names that suggest a target, boolean words.
MISSING_TOKENS = ("na", "n/a", "null", "none", "?", "-", "--", "unknown")
TARGET_NAMES = ("target", "label", "class", "outcome", "y")
BOOLEAN_TOKENS = ("true", "false", "yes", "no", "y", "n", "1", "0")
#: Fixed value: what looks like a calendar date inside a text.
DATE_PATTERN = r"(?:\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}[-/]\d{1,2}[-/]\d{2,4})"
#: Names that imply values of zero or more, and names of identifiers.
NON_NEGATIVE_NAME = r"(?:^|_)(?:age|selling_?price|price|fare|cost|amount|count|quantity|distance|mileage)(?:$|_)"
IDENTIFIER_NAME = r"(?:^|_)(?:id|identifier|key|ticket|code|reference|ref|name)(?:$|_)"
#: Numbers as text; a cast alone would also take 1d and 1f.
NUMBER_TEXT = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity)\s*$"
#: Formats that date texts are tried in, in this order.
DATE_FORMATS = ("yyyy-M-d", "yyyy/M/d", "M/d/yyyy", "M-d-yyyy")
#: A time of day behind a date.
TIME_FORMAT = "[ H:m[:s]]"


def strip(text: Column) -> Column:
    """The text without white space of any script at both ends.  A run inside the text is passed once:
    what follows white space doesn't begin another match."""
    return F.regexp_replace(text, r"(?U)^\s+|(?<!\s)\s+$", "")


def finite(value: Column) -> Column:
    """The value as a double, null where it is null, NaN or infinite; minus zero as zero."""
    x = value.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x + F.lit(0.0))


def number_in(text: Column) -> Column:
    """The number that a text spells, null where it spells none; ``nan`` is none."""
    plain = F.regexp_replace(F.trim(text), "(?i)^([+-]?)inf(inity)?$", "$1Infinity")
    return F.when(text.rlike(NUMBER_TEXT), plain.try_cast("double"))


def date_in(text: Column) -> Column:
    """The date that a text spells in one of DATE_FORMATS, with or without a time of day, or as an
    ISO time; null where it spells none."""
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f + TIME_FORMAT)) for f in DATE_FORMATS), text.try_cast("timestamp")).cast("date")


def is_missing_token(stripped: Column) -> Column:
    return F.lower(stripped).isin(*MISSING_TOKENS)


def case_fold(text: Column) -> Column:
    """The text with full case folding: ß as ss, all sigmas as σ, ligatures as their letters.

    Upper case spells out what lower case keeps apart; before it ẞ becomes ß, and dotless ı, which
    has no case to fold, is put aside.  What stands between the two also keeps the optimizer from
    taking them for one.
    """
    aside = "\uffff"
    upper = F.upper(F.translate(F.lower(text), "ı", aside))
    return F.translate(F.lower(F.translate(upper, aside, "ı")), "ς", "σ")


def corrected_skewness(x: Column) -> Column:
    """Bias-corrected sample skewness, null for under three values or no spread."""
    n = F.count(x).cast("double")
    g = F.skewness(x)
    return F.when((n > 2) & ~F.isnan(g), g * F.sqrt(n * (n - 1)) / (n - 2))


def sample_text(value: Column) -> Column:
    """A value as shown in reports: texts over 160 characters are cut to 157 and an ellipsis."""
    return F.when(F.length(value) > 160, F.concat(F.substring(value, 1, 157), F.lit("…"))).otherwise(value)
