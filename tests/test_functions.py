"""Case tables for the scalar functions."""

import datetime as dt
import hashlib
import json
import uuid

import pytest
from pyspark.sql import functions as F

from semcat.functions import dates, facet, ids, jsonx, text
from semcat.functions.vector import cosine_with
from semcat.operators import normalise


def column(spark, values, kind, expr):
    """The expression over a column of values, in order."""
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    rows = frame.select("i", expr(F.col("v")).alias("out")).collect()
    return [r["out"] for r in sorted(rows)]


def test_strip_equals_python(spark):
    spaces = [chr(i) for i in range(0x3100) if chr(i).isspace()]
    values = [f"{s} a{s}b {s}{s}" for s in spaces] + ["", " ", "​a​"]
    assert column(spark, values, "string", text.py_strip) == [v.strip() for v in values]


def test_normalise_string(spark):
    assert column(spark, [None, "", " \t", " a "], "string", text.normalise_string) == [None, None, None, "a"]


def test_lists(spark):
    lists = [None, [], ["a ", None, " "], [None]]
    assert column(spark, lists, "array<string>", text.normalise_list) == [[], [], ["a"], []]
    assert column(spark, lists, "array<string>", text.compact_list) == [[], [], ["a ", " "], []]
    assert column(spark, lists, "array<string>", text.api_list) == [[None], [], ["a ", None, " "], [None]]
    joined = column(spark, [None, [], ["a", None, "b"], [None]], "array<string>", text.safe_join)
    assert joined == ["N/A", "N/A", "a, b", ""]
    assert column(spark, [None, " ", " a "], "string", text.list_of_scalar) == [[], [], ["a"]]


def test_keywords(one):
    arrays, s = "array<string>", "string"
    assert one(lambda k, i, c: text.keyword_list(k, i, c), k=(arrays, ["b", "a", "b", "c"]), i=(s, "a"), c=(s, None)) == ["b", "c"]


def test_or_missing(spark):
    assert column(spark, [None, "", " ", "x"], "string", text.or_missing) == ["N/A", "N/A", " ", "x"]


@pytest.mark.parametrize(
    "score", [0.7345, 0.0, 1.0, 0.000625, 0.0625, 0.35449999999999998, 0.9999999, 0.1235, 0.1245, -0.25, -0.00001, 0.0005, 0.0015, 1e-9]
)
def test_percent_rounds_like_python(one, score):
    assert one(text.percent, s=("double", score)) == f"{score * 100:.1f} %"


def test_percent_many(spark):
    scores = [i / 10_000 for i in range(-200, 10_001)] + [i / 8192 for i in range(8193)]
    assert column(spark, scores, "double", text.percent) == [f"{s * 100:.1f} %" for s in scores]


@pytest.mark.parametrize(
    "value, short, full",
    [
        ("<h3>Kurztext</h3><p>a</p><h3>Volltext</h3><p>b</p>", "<p>a</p>", "<p>b</p>"),
        ("<h3> Kurztext </h3>a\nb<h3>Volltext</h3>c", None, "c"),
        ("<h3>Kurztext</h3>a<h3>Volltext</h3>b\n", "a", None),
        ("<h3>Kurztext</h3>a b<h3>Volltext</h3>c\rd", "a b", "c\rd"),
        ("<h3>kurztext</h3>a<h3>Volltext</h3>", None, None),
        (None, None, None),
    ],
)
def test_sections(one, value, short, full):
    assert one(lambda d: text.section(d, text.SHORT_SECTION), d=("string", value)) == short
    assert one(lambda d: text.section(d, text.FULL_SECTION), d=("string", value)) == full


def python_call_time(value):
    try:
        return dt.datetime.strptime(value.strip(), "%Y-%m-%dT%H:%M:%S.%f%z").replace(tzinfo=None)
    except ValueError:
        return None


def test_call_times_equal_python(spark):
    values = [
        "2024-05-01T17:00:00.000+0200", "2024-05-01T17:00:00.5Z", "2024-05-01T17:00:00Z", "2024-13-01T17:00:00.0Z",
        "2024-02-30T17:00:00.0Z", "2024-05-01T17:00:00.123456-05:30", "2024-05-01T17:00:00.1234567Z", " 2024-05-01T17:00:00.1Z\n",
        "2024-5-1T7:0:0.1Z", "2024-05-01T17:00:00.1", "2024-05-01T25:00:00.1Z", "2024-05-01T17:00:61.1Z", "2024-05-01 17:00:00.1Z",
        "2024-05-01T17:00:00.1+02:00:30", "2024-05-01T17:00:00.1+9900", "", "x",
    ]
    assert column(spark, values, "string", dates.parse_call_time) == [python_call_time(v) for v in values]
    assert column(spark, [None], "string", dates.parse_call_time) == [None]


def python_iso(value):
    try:
        return dt.datetime.fromisoformat(value.strip().replace("Z", "+00:00")).replace(tzinfo=None)
    except ValueError:
        return None


def test_iso_times_equal_python(spark):
    values = [
        "2024-05-01", "2024-05-01T10:11", "2024-05-01 10:11:12", "2024-05-01T10:11:12.5", "2024-05-01T10:11:12.123456+02:00",
        "2024-05-01T10:11:12Z", "2024-02-30", "nonsense", "", " 2024-05-01T10:11:12 ",
    ]
    assert column(spark, values, "string", dates.parse_iso) == [python_iso(v) for v in values]


def test_display_time(one):
    assert one(dates.display_time, t=("timestamp_ntz", dt.datetime(2024, 3, 5, 7, 8, 9))) == "05 Mar 2024, 07:08"


def test_uuid5_equals_python(spark):
    names = ["", "a", "ä€😀", "doc/1", "x" * 5000, None]
    space = uuid.UUID(ids.NAMESPACE)
    assert column(spark, names, "string", ids.uuid5) == [None if n is None else str(uuid.uuid5(space, n)) for n in names]


def test_id_source_and_hash(one):
    s = "string"
    pick = lambda **kw: one(lambda a, b, c, d: ids.id_source(a, b, c, d), **{k: (s, v) for k, v in kw.items()})
    assert pick(a=" call ", b="id", c="u", d="t") == "call"
    assert pick(a=" ", b=None, c="u", d="t") == "u"
    assert pick(a=None, b=None, c="", d="t") == "t"
    assert one(ids.id_hash, a=(s, "ä")) == hashlib.md5("ä".encode()).hexdigest()


def test_topic_url(spark):
    build = lambda c: ids.topic_url(c, "p/")
    assert column(spark, [None, "", "X-1"], "string", build) == [None, None, "p/X-1"]


JSON_CASES = [
    (None, None), (" x ", "x"), ("", None), (0, "0"), (True, "True"), (False, "False"), (1.0, "1.0"), (1e20, "1e+20"),
    ([None, "", {"label": "L", "id": " "}], "L"), ({"name": "n", "code": {"value": 7}}, "7"), ({"other": 1}, None), ([[], [[" y "]]], "y"),
    ({"code": [], "id": {}, "content": "z"}, "z"),
]


def test_json_first(spark):
    texts = [json.dumps(v) for v, _ in JSON_CASES]
    assert column(spark, texts, "string", jsonx.json_first) == [e for _, e in JSON_CASES]
    assert column(spark, [None], "string", jsonx.json_first) == [None]


def test_json_lists(spark):
    texts = ['["a",null,"a",{"id":"b"}]', '"z"', "null", None]
    assert column(spark, texts, "string", jsonx.json_scalars) == [["a", "a", "b"], ["z"], [], []]


def test_json_fields(one):
    item = json.dumps({"language": ["en"], "metadata": {"id": {"value": 5}, "kw": ["a", " "]}})
    got = one(lambda i: jsonx.json_fields(i, {"a": "metadata.id", "b": "language", "c": "x.y"}, {"d": "metadata.kw"}), i=("string", item))
    assert got.asDict() == {"a": "5", "b": "en", "c": None, "d": ["a"]}


def test_english(one):
    cases = [("EN-gb", [], True), (None, ["de", "en"], True), ("de", [], False), (None, [], False), (None, None, False), ("de", [None, "En"], True)]
    for language, others, expected in cases:
        assert one(normalise.is_english, l=("string", language), o=("array<string>", others)) is expected


def test_status(spark):
    codes = ["31094501", "31094502", "31094503", "31094509", None]
    assert column(spark, codes, "string", normalise.allowed_status) == [True, True, True, False, False]
    assert column(spark, codes, "string", normalise.is_withdrawn) == [False, False, True, True, True]


def test_facet_key():
    cases = {
        "Forschung & Entwicklung": "forschung_entwicklung", "Öffentlich": "oeffentlich", "énergie": "energie", "N/A": "n_a",
        " a - b ": "a_b", "ß": "ss", "_x_": "x", "!!": "", "ﬁne": "fine",
    }
    assert {v: facet.key_of(v) for v in cases} == cases


def python_score(v):
    return (2 if any(ch.isupper() for ch in v) else 0) + (2 if " " in v else 0) - ("_" in v) - v.islower()


def test_facet_score_equals_python(spark):
    values = ["Ab C", "ab", "a_b", "AB", "1 2", "ǅ", "ǆ", "ª", "Ⅷ", "ⅷ", "Σ", "ß", "", "12", "a1", "É", "日本"]
    assert column(spark, values, "string", facet.facet_score) == [python_score(v) for v in values]


def test_facet_invalid(spark):
    values = ["ab", "None", "abc", "N/A", " NULL ", "nan", "", "a b", "!!!"]
    check = lambda c: facet.facet_invalid(c, facet.facet_key(c))
    assert column(spark, values, "string", check) == [True, True, False, False, True, True, True, False, True]


def test_cosine(one):
    got = one(lambda v: cosine_with(v, [3.0, 4.0]), v=("array<float>", [4.0, 3.0]))
    assert got == pytest.approx(0.96)
    assert one(lambda v: cosine_with(v, [3.0, 4.0]), v=("array<float>", [0.0, 0.0])) == 0.0


# Values that the variant cannot stand for as they are, beside plain ones.
ODD_JSON = [
    '{"a": 1.5, "b": [1, 2]}', '{"a": 1e2, "b": 1.0}', '{"a": true, "b": [false, "x"]}', '{"a": [[["deep"]], "x"], "b": [["p"], "q"]}',
    '{"a": "one", "a": "two", "b": {"code": "x", "code": "y"}}', '{"a": {"code": {"id": " ", "value": 7}}, "b": [{"label": ["l"]}]}',
    '{"a": 123456789012345678901234567890, "b": -0}', '{"a": [null, 1, "t"], "b": ["s", 3]}', '{"a": [], "b": {}}', '{"a": {"x": "no"}, "b": [{}]}', '[{"a": "list"}]', '"text"', "null", "5",
    '{"a": NaN, "b": "x"}', '{"a": "\\u00a0 pad\\u2003", "b": [" ", "\\t", "z "]}', '{"a": {"code": 7, "id": "i"}, "b": [{"name": " "}, {"text": "t", "other": 1}]}',
    '{"b": ["only"]}', '{"a": {"we ird: STRING, code": "k", "content": "c"}, "b": null}', '{"a": {"code": null, "label": "l"}, "b": [null, null]}', "{}",
]


def test_variant_lookup_equals_the_walk(spark):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate([*ODD_JSON, None])], "i long, t string")
    scalars, lists = {"x": "a", "y": "a.code"}, {"z": "b", "w": "a"}
    native = jsonx.with_json_fields(frame, "t", scalars, lists).orderBy("i").collect()
    walked = frame.select("i", "t", jsonx.json_fields(F.col("t"), scalars, lists).alias("f")).select("i", "t", "f.*").orderBy("i").collect()
    assert native == walked
    alone = frame.select("i", jsonx.json_first(F.col("t")).alias("x"), jsonx.json_scalars(F.col("t")).alias("z")).orderBy("i").collect()
    for row, text in zip(alone, [*ODD_JSON, None]):
        value = None if text is None else json.loads(text)
        assert (row["x"], row["z"]) == (jsonx.first_scalar(value), jsonx.scalar_list(value))


def test_broken_json_raises(spark):
    broken = spark.createDataFrame([('{"a": ',)], "t string")
    with pytest.raises(Exception, match="JSONDecodeError"):
        jsonx.with_json_fields(broken, "t", {"x": "a"}, {}).collect()


def test_plain_items_stay_in_the_jvm(spark):
    """Nothing but odd objects reaches the worker: a walk that fails on anything else is never called."""
    plain = '{"a": {"value": " v", "label": " "}, "b": ["x", null, "y"], "n": 5}'
    frame = spark.createDataFrame([(plain,), (None,)], "t string")
    found = jsonx.with_json_fields(frame, "t", {"x": "a", "n": "n"}, {"z": "b"})
    sent = found._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN" in sent and "ArrowEvalPython" in sent
    assert [tuple(r)[1:] for r in found.collect()] == [("v", "5", ["x", "y"]), (None, None, None)]
