"""String and list expressions with Python's notion of whitespace."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = "N/A"

# The characters str.strip() removes.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def py_strip(c: Column) -> Column:
    """``str.strip()``: Spark's plain ``trim`` removes U+0020 only."""
    return F.btrim(c, F.lit(SPACES))


def normalise_string(c: Column) -> Column:
    """Stripped text; empty becomes null."""
    return F.nullif(py_strip(c.cast("string")), F.lit(""))


def normalise_list(c: Column) -> Column:
    """Stripped entries of a string array without nulls and blanks; null is empty."""
    stripped = F.transform(F.coalesce(c, F.array().cast("array<string>")), py_strip)
    return F.filter(stripped, lambda x: x.isNotNull() & (x != ""))


def list_of_scalar(c: Column) -> Column:
    """A plain string as a list of one; null or blank is the empty list."""
    return normalise_list(F.when(c.isNotNull(), F.array(c.cast("string"))))


def api_list(c: Column) -> Column:
    """List as it is; null becomes a list holding one null."""
    return F.coalesce(c, F.array(F.lit(None).cast("string")))


def compact_list(c: Column) -> Column:
    """List without nulls; null is the empty list."""
    return F.array_compact(F.coalesce(c, F.array().cast("array<string>")))


def safe_join(c: Column, sep: str = ", ", default: str = MISSING) -> Column:
    """Entries joined, nulls skipped; null or empty list gives ``default``."""
    return F.when(F.coalesce(F.size(c), F.lit(0)) <= 0, F.lit(default)).otherwise(
        F.array_join(c, sep)
    )


def or_missing(c: Column) -> Column:
    """Null and the empty string become "N/A"; blanks stay."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(MISSING))


def keyword_list(keywords: Column, *blocked: Column) -> Column:
    """Distinct keywords in first-seen order without those equal to an id."""

    def allowed(x: Column) -> Column:
        keep = F.lit(True)
        for other in blocked:
            keep = keep & ~x.eqNullSafe(other)
        return keep

    return F.filter(F.array_distinct(keywords), allowed)


# Section headings inside a dump description.  "." stops at \n
# only and the full text runs to the very end of the value.
SHORT_SECTION = r"(?Ud)<h3>\s*Kurztext\s*</h3>(.*?)<h3>\s*Volltext\s*</h3>"
FULL_SECTION = r"(?Ud)<h3>\s*Volltext\s*</h3>(.*)\z"


def section(description: Column, pattern: str) -> Column:
    """First capture of ``pattern``; null when absent or empty."""
    return F.nullif(F.regexp_extract(description, pattern, 1), F.lit(""))


def percent(score: Column) -> Column:
    """Score as a percentage with one decimal.

    Rounds the exact binary value, half to even, as Python does;
    ``format_string`` would round the printed decimal digits, half up.
    """
    x = F.abs(score * 100)
    whole = F.floor(x)
    scale = 57  # enough bits for every value that can round to 0.1
    scaled = ((x - whole) * F.lit(2.0**scale)).cast("long") * 10
    tenths = F.shiftright(scaled, scale)
    rest, half = scaled - F.shiftleft(tenths, scale), 1 << (scale - 1)
    up = (rest > half) | ((rest == half) & (tenths % 2 == 1))
    total = whole * 10 + tenths + up.cast("long")
    return F.concat(
        F.when(score < 0, F.lit("-")).otherwise(F.lit("")),
        F.floor(total / 10).cast("string"),
        F.lit("."),
        (total % 10).cast("string"),
        F.lit(" %"),
    )
