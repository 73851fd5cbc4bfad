"""HTML to text.

Every text node is stripped, blank nodes vanish, the rest is joined by single
spaces, entities are decoded, and script, style, template, ruby annotations,
comments and declarations do not count as text.  A value without both "<" and
">" is only stripped; null and "" become "N/A".

Well-formed markup with common entities never leaves the JVM: one regular
expression cuts the value at its markup.  A value the expression
cannot fully account for (a stray "<", unbalanced quotes, raw-text elements,
other entities) goes through ``html.parser`` in an Arrow UDF instead; all
other rows send that UDF a null.
"""

from __future__ import annotations

from collections.abc import Iterator
from html import unescape
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semcat.functions.text import or_missing, py_strip
from semcat.schema import string_columns
from semcat.session import spread

# Elements whose text is not page text, and elements that never
# have content.
_HIDDEN = ("script", "style", "template", "rt", "rp")
_VOID = (
    "area base basefont bgsound br col command embed frame hr image img input isindex "
    "keygen link menuitem meta nextid param source spacer track wbr"
).split()

# Entities decoded natively.
_ENTITIES = {
    "lt": "<", "gt": ">", "quot": '"', "nbsp": "\u00a0", "copy": "\u00a9", "middot": "\u00b7",
    "auml": "ä", "ouml": "ö", "uuml": "ü", "Auml": "Ä", "Ouml": "Ö", "Uuml": "Ü", "szlig": "ß",
    "euro": "€", "ndash": "–", "mdash": "—", "hellip": "…", "bull": "•", "rsquo": "’",
    "amp": "&",
}

# A tag ends at the first ">" unless quotes are unbalanced; possessive
# quantifiers keep the match linear and free of recursion.
_ATTRS = r"[^<>\"']*+(?:(?:\"[^\"<>]*+\"|'[^'<>]*+')[^<>\"']*+)*+"
_NOT_PLAIN = "|".join((*_HIDDEN, "textarea", "plaintext", "xmp", "iframe", "noembed", "noframes"))
_MARKUP = (
    r"(?s)<(?:"
    rf"(?!/?(?i:{_NOT_PLAIN})[\s/>])(?!/(?i:{'|'.join(_VOID)})[\s/>])/?[A-Za-z]{_ATTRS}>"
    r"|!--.*?--\s*+>"
    r"|!(?i:doctype)[^<>]*+>"
    rf"|((?i:script|style))(?=[\s>]){_ATTRS}(?<!/)>.*?</\s*(?i:\1)\s*>"
    r")"
)
_CUT = "\u0001"
_UNKNOWN_ENTITY = rf"&(?!(?:{'|'.join(_ENTITIES)});)[A-Za-z#]"


class _TextNodes(HTMLParser):
    """Collects the visible text nodes of one document."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.nodes: list[str] = []
        self._pending: list[str] = []
        self._open: list[str] = []
        self._closed_void: list[str] = []

    def flush(self, visible: bool = True) -> None:
        text = "".join(self._pending).strip()
        self._pending.clear()
        if text and visible and not any(tag in _HIDDEN for tag in self._open):
            self.nodes.append(text)

    def handle_starttag(self, tag, attrs):
        self.flush()
        if tag in _VOID:
            self._closed_void.append(tag)
        else:
            self._open.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.flush()

    def handle_endtag(self, tag):
        if tag in self._closed_void:
            self._closed_void.remove(tag)
            return
        self.flush()
        if tag in self._open:
            while self._open.pop() != tag:
                pass

    def handle_data(self, data):
        self._pending.append(data)

    def handle_charref(self, name):
        self._pending.append(unescape(f"&#{name};"))

    def handle_entityref(self, name):
        self._pending.append(html5.get(f"{name};") or html5.get(name) or f"&{name}")

    def _invisible(self, data):
        self.flush()

    handle_comment = handle_decl = handle_pi = _invisible

    def unknown_decl(self, data):
        self.flush()
        if data.upper().startswith("CDATA["):
            text = data[len("CDATA["):].strip()
            if text:
                self.nodes.append(text)


def parse_html(value: str) -> str:
    parser = _TextNodes()
    parser.feed(value)
    parser.close()
    parser.flush()
    return " ".join(parser.nodes)


def _hard_html_udf():
    # Marked non-deterministic so that no filter on the text is pushed below
    # it, which would run the cleaning twice.
    @F.arrow_udf("array<string>")
    def hard_html(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = [
                None if row is None else [None if v is None else parse_html(v) for v in row]
                for row in batch.to_pylist()
            ]
            yield pa.array(rows, pa.list_(pa.string()))

    return hard_html.asNondeterministic()


def _has_markup(c: Column) -> Column:
    return c.contains("<") & c.contains(">")


def _decode(c: Column) -> Column:
    """Known entities decoded, in one pass over the pieces between ampersands."""
    table = F.create_map(*[F.lit(x) for item in _ENTITIES.items() for x in item])

    def piece(text: Column, position: Column) -> Column:
        name = F.substring_index(text, ";", 1)
        decoded = F.concat(
            F.try_element_at(table, name), F.substring(text, F.length(name) + 2, F.length(text))
        )
        return F.when(position == 0, text).otherwise(
            F.coalesce(F.when(text.contains(";"), decoded), F.concat(F.lit("&"), text))
        )

    return F.when(
        c.contains("&"), F.array_join(F.transform(F.split(c, "&"), piece), "")
    ).otherwise(c)


def _join_nodes(flat: Column) -> Column:
    nodes = F.transform(F.split(_decode(flat), _CUT), py_strip)
    return F.array_join(F.filter(nodes, lambda node: node != ""), " ")


def _needs_parser(flat: Column, value: Column) -> Column:
    return flat.contains("<") | flat.rlike(_UNKNOWN_ENTITY) | value.contains(_CUT)


def with_html_text(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add or replace ``target: source`` columns by the text of the source.

    The values travel as one array, so a table with many string columns still
    has one expression per step.  Separate steps keep each from being computed
    once per reference.  The parser comes last: a filter on the result stops
    above it, where only the choice between two finished texts is left.
    """
    targets = list(columns)
    values, flat, left, native, hard = "__values", "__flat", "__left", "__native", "__hard"
    c = F.col

    steps = spread(df).select("*", F.array(*[or_missing(c(s)) for s in columns.values()]).alias(values))
    steps = steps.select(
        "*",
        F.transform(
            values, lambda v: F.when(_has_markup(v), F.regexp_replace(v, _MARKUP, _CUT))
        ).alias(flat),
    )
    steps = steps.select(
        "*", F.zip_with(values, flat, lambda v, f: F.when(_needs_parser(f, v), v)).alias(left)
    )
    steps = steps.select(
        "*",
        F.transform(
            flat,
            lambda f, i: F.when(f.isNull(), py_strip(F.get(values, i))).when(
                F.get(left, i).isNull(), _join_nodes(f)
            ),
        ).alias(native),
    )
    steps = steps.select(
        "*", _hard_html_udf()(F.when(F.exists(left, F.isnotnull), c(left))).alias(hard)
    )
    cleaned = {
        t: F.coalesce(F.get(native, F.lit(i)), F.get(hard, F.lit(i))).alias(t)
        for i, t in enumerate(targets)
    }
    kept = [cleaned.get(name, c(name)) for name in df.columns]
    return steps.select(*kept, *[cleaned[t] for t in targets if t not in df.columns])


def clean_strings(df: DataFrame) -> DataFrame:
    """Missing-value default and HTML cleaning over every string column."""
    return with_html_text(df, {c: c for c in string_columns(df)})
