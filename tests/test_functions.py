"""The lenient helpers against Spark's own non-ANSI behaviour."""

import json

from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trialmart.functions import flag, json_texts, loose_bool, loose_double, loose_int, percent, ratio
from trialmart.session import session_conf

TEXTS = [
    "3", "3.9", "-3.9", "-0.9", "+5", "+5.5", ".5", "-.5", "3.", ".", "-.", "", " ", "-", " 7 ", " 7.5 ",
    "1e2", "1E+2", "1.5e1", "99999999999", "99999999999.5", "2147483647.9", "-2147483648.9", "2147483648",
    "NaN", "Infinity", "-inf", "1d", "2f", "1.0f", "0x10", "1,000", "1_000", "3.9.1", "3 .9", "--3", "abc",
    "true", "TRUE", " true ", "t", "yes", "y", "1", "false", "f", "no", "n", "0", "on", "null", None,
]
KEYS = ("a", "b.c", "d")


def check_texts(spark, texts):
    frame = spark.createDataFrame([(i, text) for i, text in enumerate(texts)], "i int, text string")
    with session_conf(spark, {"spark.sql.ansi.enabled": "false"}):
        wanted = rows(
            frame.selectExpr(
                "i", "CAST(text AS INT)", "CAST(CAST(text AS DOUBLE) AS STRING)", "CAST(text AS BOOLEAN)"
            )
        )
    text = F.col("text")
    found = frame.select("i", loose_int(text), loose_double(text).cast("string"), loose_bool(text))
    assert rows(found) == wanted


def test_lenient_casts_equal_non_ansi_casts(spark):
    check_texts(spark, TEXTS)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text("0123456789+-. eE", max_size=12), min_size=50, max_size=200))
def test_lenient_casts_of_random_texts(spark, texts):
    check_texts(spark, texts)


def test_one_parse_gives_the_same_texts_as_path_lookups(spark):
    payloads = [
        '{"a": 1, "b.c": "x", "d": true}',
        '{"a": null, "b.c": {"e": [1, 2.50]}, "d": [1, "y"]}',
        '{"a": 1.10, "b.c": 1e2, "d": 12345678901234567890}',
        '{"a": "quo\\"ted", "b": {"c": 5}, "d": ""}',
        '{"A": 1, "d": -0.0}',
        '{"a": 1, "d": ',
        '{"a": 1} trailing',
        '{"a": NaN}',
        "[1]", "{}", "", "null", "text", None,
    ]
    frame = spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "i int, p string")
    parsed = frame.select("i", json_texts("p", KEYS).alias("t"))
    found = parsed.select("i", *[F.col("t").getField(key) for key in KEYS])
    wanted = frame.select("i", *[F.get_json_object("p", f"$['{key}']") for key in KEYS])
    assert rows(found) == rows(wanted)


def test_divisions_and_flags(spark):
    frame = spark.createDataFrame([(1, 4), (1, 0), (None, 2), (3, None)], "a long, b long")
    a, b = F.col("a"), F.col("b")
    found = [tuple(row) for row in frame.select(ratio(a, b), percent(a, b), flag(a < b)).collect()]
    assert found == [(0.25, 25.0, 1), (None, None, 0), (None, None, 0), (None, None, 0)]


def test_control_characters_do_not_empty_a_payload(spark):
    payloads = ['{"a": "x\ty", "d": 5}', '{"d": 5, "a": "x\ny"}', '{"e": "\x01", "d": 5}']
    frame = spark.createDataFrame([(p,) for p in payloads], "p string")
    parsed = frame.select(json_texts("p", KEYS)["d"].alias("d"), F.get_json_object("p", "$.d").alias("want"))
    assert rows(parsed) == [("5", "5")] * 3


def json_values():
    plain = st.one_of(st.none(), st.booleans(), st.integers(-99, 99), st.sampled_from(["x", "1.5", "a\\tb", ""]))
    return st.one_of(plain, st.lists(plain, max_size=2), st.just({"a": 1, "z": [None]}))


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.tuples(st.sampled_from([*KEYS, "e", "b"]), json_values()), max_size=7),
                min_size=30, max_size=60))
def test_first_value_of_every_key(spark, objects):
    """Payloads with repeated keys, against reading one key at a time."""
    texts = [
        "{" + ", ".join(f'"{key}": {json.dumps(value, separators=(",", ":"))}' for key, value in members) + "}"
        for members in objects
    ]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    parsed = frame.select("i", json_texts("text", KEYS).alias("v"))
    found = parsed.select("i", *[F.col("v").getField(key).alias(key) for key in KEYS])
    wanted = frame.select("i", *[F.get_json_object("text", f"$['{key}']").alias(key) for key in KEYS])
    assert rows(found) == rows(wanted)


def test_repeated_keys_and_control_characters(spark):
    texts = [
        '{"a": 1, "a": 2}', '{"a": 1, "a": null}', '{"a": null, "a": 2}', '{"a": null, "a": null}',
        '{"x": 1, "x": 2, "a": 3, "b.c": 4}', '{"d": {"a": 1, "a": 2}, "a": 5}', '{"a": "p\tq", "a": 1}',
        '{"a": 1, "a": 2', "", None, "[1]", '{"a": "\n"}',
    ]
    frame = spark.createDataFrame([(i, text) for i, text in enumerate(texts)], "i int, text string")
    v = json_texts("text", KEYS)
    assert [tuple(r) for r in frame.orderBy("i").select(v.getField("a"), v.getField("b.c")).collect()] == [
        ("1", None), ("1", None), ("2", None), (None, None), ("3", "4"), ("5", None), ("p\tq", None),
        (None, None), (None, None), (None, None), (None, None), ("\n", None),
    ]
