"""Edge values of the coercions and text functions, against Python where it can say the answer."""

import ipaddress

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from logweir.functions import coerce as c
from logweir.functions import gramwise
from logweir.functions.ngrams import char_ngrams
from logweir.functions.sql import capture, json_text
from logweir.functions.textual import mask_template


def apply(spark, expression, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in df.selectExpr("i", f"{expression} AS y").orderBy("i").collect()]


TIMESTAMPS = {
    "1715688013.17": "2024-05-14T12:00:13.170+00:00", "999": "999", "14/May/2024:12:00:42 +0230": "2024-05-14T09:30:42.000+00:00",
    "May 14 12:00:43": "2024-05-14T12:00:43.000+00:00", "may  4 2:00:43": "2024-05-04T02:00:43.000+00:00",
    "05/14-12:02:39.796669": "2024-05-14T12:02:39.796+00:00", "2024/5/14 12:00:01": "2024-05-14T12:00:01.000+00:00",
    "2024-05-14T12:00:39.083920Z": "2024-05-14T12:00:39.083+00:00", "20240514T120039": "2024-05-14T12:00:39.000+00:00",
    "2024-05-14T12:30+02": "2024-05-14T10:30:00.000+00:00", "T12:00": "T12:00", "31/Feb/2024:12:00:42 +0000": "31/Feb/2024:12:00:42 +0000",
    "2024/05-14 12:00:01": "2024/05-14 12:00:01", "": None,
}


def test_timestamps(spark):
    assert dict(zip(TIMESTAMPS, apply(spark, c.coerce_timestamp("x", 2024), list(TIMESTAMPS)))) == TIMESTAMPS


def test_timestamp_without_year_never_lies_ahead(spark):
    now = "timestamp'2026-01-03 00:00:00Z'"
    assert apply(spark, c.coerce_timestamp("x", None, now), ["Jan 3 23:00:00", "Jan 5 00:00:01"]) == [
        "2026-01-03T23:00:00.000+00:00", "2025-01-05T00:00:01.000+00:00"]


@pytest.mark.parametrize("expression,values", [
    (c.coerce_duration_ns("x"), {"0:00:30": 30 * 10**9, "12:30": 750 * 10**9, "0.000956": 956000, "a:b": None, "x": None, "1.047": 1046999999}),
    (c.coerce_long("x"), {"12.7": 12, "-": None, " 5 ": 5, "1e3": 1000, "inf": None, "3d": None, "-2.9": -2}),
    (c.coerce_bool("x"), {"YES": True, "t": True, "no": False}),
    (c.coerce_double("x"), {"1.5": 1.5, "x": None, "1f": None}),
])
def test_scalars(spark, expression, values):
    assert dict(zip(values, apply(spark, expression, list(values)))) == values


def _python_ip(text):
    try:
        ip = ipaddress.ip_address(text.strip())
    except ValueError:
        return None
    if ip.version == 6 and ip.ipv4_mapped and "%" not in text:
        # Mapped addresses are written in hex groups.
        n = int(ip)
        return f"::ffff:{n >> 16 & 0xffff:x}:{n & 0xffff:x}"
    return str(ip)


_groups = st.lists(st.sampled_from(["0", "00", "1", "ab", "0DB8", "ffff", "0000"]), min_size=1, max_size=9)
_ipv6 = st.one_of(_groups.map(":".join), st.tuples(_groups, _groups).map(lambda g: ":".join(g[0]) + "::" + ":".join(g[1])),
                  _groups.map(lambda g: "::" + ":".join(g)), _groups.map(lambda g: ":".join(g) + "::"))
_ipv4 = st.lists(st.integers(0, 300), min_size=3, max_size=5).map(lambda p: ".".join(map(str, p)))


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
@given(st.lists(st.one_of(_ipv6, _ipv4, st.sampled_from(["::", ":::", "1.2.3.4 ", "::1.2.3.4", "fe80::1%eth0", "01.2.3.4"])),
                min_size=60, max_size=120))
def test_addresses_agree_with_python(spark, values):
    assert apply(spark, c.coerce_ip("x"), values) == [_python_ip(v) for v in values]


def test_capture_survives_the_separator(spark):
    assert apply(spark, capture("x", r"^(\S+) (\S+)(?: (\S+))?$", 3), ["a b c", "a\u0001b c", "a"]) == [
        ["a", "b", "c"], ["a\u0001b", "c", ""], ["a"]]


def test_json_text(spark):
    assert apply(spark, json_text("x"), ['a"b\\c\n', "", None]) == ['"a\\"b\\\\c\\n"', '""', None]


def test_mask(spark):
    assert apply(spark, mask_template("x"), ["at 10.0.0.1:80  id deadbeefdeadbeef #7", "1" * 200]) == [
        "at <IP>:<N> id <HEX> #<N>", "<HEX>"]


def _python_grams(text, low, high):
    out = []
    for word in text.lower().split():
        word = f" {word} "
        for n in range(low, high + 1):
            if n > len(word):
                break
            out += [word[i:i + n] for i in range(len(word) - n + 1)]
    return out


def test_ngrams(spark):
    texts = ["ab c", "Ünï  GET /x?y=1 aaaa\taaaa", "", "   "]
    assert [sorted(g) for g in apply(spark, char_ngrams("x"), texts)] == [sorted(_python_grams(t, 2, 5)) for t in texts]
    assert len(_python_grams("ab c", 2, 5)) == 9
    # The batch form says the same as the SQL form.
    for t in texts:
        grams, counted = _python_grams(t, 2, 5), gramwise.counted([t])
        assert dict(zip(counted.column(0).to_pylist(), counted.column(1).to_pylist())) == {g: grams.count(g) for g in grams}


def test_values_out_of_range_are_null(spark):
    from logweir.functions import coerce, sql

    row = spark.range(1).selectExpr(
        f"{coerce.coerce_duration_ns(sql.text('9999999:00:00'))} AS a", f"{coerce.coerce_duration_ns(sql.text('99999999999999999:00'))} AS b",
        f"{sql.code_table({0: 'x', 1: 'y'}, sql.text('99999999999'))} AS c", f"{coerce.coerce_long(sql.text(' 12.7 '))} AS d",
        f"{coerce.coerce_timestamp(sql.text(' 2024-05-14T12:00:00Z '))} AS e", f"{coerce.coerce_timestamp(sql.text(' 1715688013.5 '))} AS f",
        f"{coerce.coerce_double(sql.text(' 1.5 '))} AS g").first()
    assert (row.a, row.b, row.c, row.d, row.g) == (None, None, None, 12, 1.5)
    assert row.e.startswith("2024-05-14T12:00:00.000") and row.f.startswith("2024-05-14T12:00:13.500")
