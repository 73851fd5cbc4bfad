"""Timestamp parsing and display.  Offsets are checked, then dropped: the wall
clock of the source is what the catalogue stores and shows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from semcat.functions.text import py_strip

_OFFSET = r"(?:Z|[+-](?:[01]\d|2[0-3]):?[0-5]\d(?::?[0-5]\d(?:\.\d{1,6})?)?)"
_DAY = r"\d{4}-\d{1,2}-\d{1,2}"
_CALL_TIME = rf"^({_DAY}T\d{{1,2}}:\d{{1,2}}:\d{{1,2}}\.\d{{1,6}}){_OFFSET}\z"
_ISO_TIME = (
    r"^(\d{4}-\d\d-\d\d(?:[T ]\d\d:\d\d(?::\d\d(?:\.\d{1,9})?)?)?)"
    rf"(?:{_OFFSET})?\z"
)
DISPLAY = "dd MMM yyyy, HH:mm"


def _wall_clock(text: Column, pattern: str) -> Column:
    wall = F.regexp_extract(text, pattern, 1)
    return F.nullif(wall, F.lit("")).try_cast("timestamp_ntz")


def parse_call_time(c: Column) -> Column:
    """``YYYY-MM-DDTHH:MM:SS.f`` with a mandatory fraction and offset, else null."""
    return _wall_clock(py_strip(c), _CALL_TIME)


def parse_iso(c: Column) -> Column:
    """Lenient ISO date or date-time for display, else null."""
    return _wall_clock(py_strip(c), _ISO_TIME)


def display_time(c: Column) -> Column:
    return F.date_format(c, DISPLAY)
