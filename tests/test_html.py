"""The native way and the parser must agree; odd markup must reach the parser."""

import random

import pytest
from pyspark.sql import functions as F

from semcat.functions.html import clean_strings, parse_html, with_html_text

CASES = [
    (None, "N/A"), ("", "N/A"), ("  ", ""), ("a &amp; b", "a &amp; b"), ("<p></p>", ""), ("x<p", "x<p"),
    ("<p>a <b>b</b></p><script>x</script>", "a b"), ("<i>a &amp; b</i>", "a & b"), ("a<!-- c -->b", "a b"),
    ("<p>&nbsp;x&nbsp;</p> <p>&nbsp;</p>", "x"), ('<a title="a>b">t</a>', "t"), ("<script>if (a<b) { x='</p>' }</script >t", "t"),
    ("<style>p{}</style>z<br/>w<br>q", "z w q"), ("<template><p>x</p></template>y", "y"), ("<rt>a</rt>b", "b"),
    ("<p>&eacute;&#150;&#x41; &foo; &copy</p>", "é–A &foo ©"), ("<![CDATA[ hi ]]><p>x</p>", "hi x"), ("<?xml x?><p>x</p>", "x"),
    ("<!DOCTYPE html><p>a</p>", "a"), ("<p>&amp;lt;b&amp;gt;</p>", "&lt;b&gt;"), ("<p>&lt;b&gt;</p>", "<b>"),
    ("<script/>x<p>y</p>", "x y"), ("<p>a\n\n b</p> <p> c\x1c</p>", "a\n\n b c"), ("<p>\u0001x</p>", "\u0001x"),
    ("<template>a</div>b<div></template>c", "c"),
]


def cleaned(spark, values):
    frame = spark.createDataFrame(list(enumerate(values)), "i int, h string")
    return [r["t"] for r in with_html_text(frame, {"t": "h"}).orderBy("i").collect()]


def test_cases(spark):
    assert cleaned(spark, [v for v, _ in CASES]) == [e for _, e in CASES]


def test_random_markup_agrees_with_parser(spark):
    rng = random.Random(7)
    pieces = [
        "<p>", "</p>", "<br>", "<br/>", "</br>", "<b class='x'>", '<a href="u?a=1&b=2">', "</a>", "text", " ", "\n", "&amp;", "&lt;",
        "&nbsp;", "&", "&x", "<", ">", "<!-- n -->", "<script>a<b</script>", "<STYLE>q</STYLE>", "<template>", "</template>", "<rt>", "</rt>",
        "&eacute;", "&#65;", "<!doctype html>", "<?pi?>", "ä", " ", "\"", "'", "<div", "</",
    ]
    values = ["".join(rng.choices(pieces, k=rng.randint(1, 12))) for _ in range(3000)]
    expected = [parse_html(v) if "<" in v and ">" in v else v.strip() or ("" if v else "N/A") for v in values]
    got = cleaned(spark, values)
    assert [(v, g, e) for v, g, e in zip(values, got, expected) if g != e] == []


def test_cleaning_twice_strips_decoded_tags(spark):
    frame = spark.createDataFrame([("<p>&lt;b&gt;x&lt;/b&gt;</p>",)], "h string")
    once = clean_strings(frame)
    assert once.first()["h"] == "<b>x</b>"
    assert clean_strings(once).first()["h"] == "x"


def test_only_strings_change(spark):
    frame = spark.createDataFrame([(1, None, ["<b>"], " x ")], "i int, s string, l array<string>, t string")
    assert clean_strings(frame).first().asDict() == {"i": 1, "s": "N/A", "l": ["<b>"], "t": "x"}


@pytest.mark.parametrize("n", [200_000])
def test_long_values_are_linear(spark, n):
    value = "<p>" + " " * n + "<" + "a" * n + "'" + "</p>" * 1000
    assert cleaned(spark, [value]) == [parse_html(value)]


def test_filter_on_text_cleans_once(spark):
    frame = spark.createDataFrame([("<p>x</p>",)], "h string")
    plan = with_html_text(frame, {"t": "h"}).filter(F.length("t") > 0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hard_html(") == 1
    assert plan.count("regexp_replace") == 1
