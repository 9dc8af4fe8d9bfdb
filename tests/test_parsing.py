"""Literal lines and values to literal results."""

import time

import pytest
from pyspark.sql import functions as F

from logweir.functions.binding import bind
from logweir.functions.levels import level_from_number, level_from_text, parse_level_map
from logweir.functions.strptime import compile_time_format
from logweir.functions.text import contains_folded, format_bucket, format_bytes, format_count, format_date, format_date_time, format_time, signature
from logweir.functions.timestamps import find_timestamp, text_timestamp
from logweir.operators.parsers import configure, is_continuation, with_line_record

T = 1_762_158_031_000  # 2025-11-03 08:20:31 UTC
NOW = T + 36 * 3_600_000
LINES = [
    ('{"ts":1762158031005,"severity":60,"text":"disk gone","logger":"store"}', (0, T + 5, 0, "store", "disk gone")),
    ('{"@timestamp":"2025-11-03T08:20:31.250Z","lvl":"warning","event":"queue is long","module":"mail"}', (0, T + 250, 1, "mail", "queue is long")),
    ('{"width":3,"height":4}', (0, None, 5, None, '{"width":3,"height":4}')),
    ('{"severity":"30","body":"text level of digits"}', (0, None, 5, None, "text level of digits")),
    ('{"open": [1, 2', (5, None, 5, None, '{"open": [1, 2')),
    ('{"k":0} and more', (5, None, 5, None, '{"k":0} and more')),
    ('time=2025-11-03T08:20:31Z severity=critical event="lease lost" component=raft', (1, T, 0, "raft", "lease lost")),
    ('text="a \\"b\\" c" n=7', (1, None, 5, None, 'a "b" c')),
    ("so n=7 holds", (5, None, 5, None, "so n=7 holds")),
    ('2001:db8::7 - ada [03/Nov/2025:08:20:31 +0000] "PUT /items/9 HTTP/2" 404 31 "-" "agent"', (2, T, 1, None, "404 PUT /items/9")),
    ("Nov  3 08:20:31 edge7 dhcpd[44]: lease renewed", (3, T, 2, "dhcpd", "lease renewed")),
    ("2025-11-03 08:20:31,250 SEVERE net.example.Pump - valve stuck", (4, T + 250, 0, "net.example.Pump", "2025-11-03 08:20:31,250 SEVERE net.example.Pump - valve stuck")),
    ("2025-11-03T08:20:31Z [pool-2] NOTICE drained", (4, T, 2, "pool-2", "2025-11-03T08:20:31Z [pool-2] NOTICE drained")),
    ("2025-11-03T08:20:31Z [DEBUG] tick", (4, T, 3, None, "2025-11-03T08:20:31Z [DEBUG] tick")),
    ("nothing to tell here", (5, None, 5, None, "nothing to tell here")),
]


def values(spark, rows, kind, *columns):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(rows)], f"k int, v {kind}")
    return [tuple(r)[1:] for r in df.select("k", *columns).orderBy("k").collect()]


def test_lines(spark):
    configure(spark)
    df = spark.createDataFrame([(k, line) for k, (line, _) in enumerate(LINES)], "k int, v string")
    got = with_line_record(df, F.col("v"), NOW).orderBy("k").select("kind", "ts_ms", "level", "service", "message").collect()
    for (line, want), r in zip(LINES, got, strict=True):
        assert tuple(r) == want, line


def test_timestamps(spark):
    cases = [
        ("2025-11-03T08:20:31.250Z", T + 250), ("2025/11/03 08:20:31 and on", T), ("2025-11-03 13:50:31+05:30", T), ("2025-11-03T08:20:31.0004Z", T),
        ("2025-09-64T08:20:31Z", T), ("on 03/Nov/2025:08:20:31 +0000", T), ("Nov  3 08:20:31 x", T), ("1762158031 x", T), ("1762158031250", T + 250),
        ("1762158031.25", T + 250), ("17621580310", None), ("no time", None),
    ]
    assert [g[0] for g in values(spark, [c[0] for c in cases], "string", find_timestamp(F.col("v"), F.lit(NOW))["ts"])] == [c[1] for c in cases]
    fields = [("1762158031", T), ("1762158031250.4", T + 250), ("31", None), ("2025-11-03", T - 30_031_000), ("later", None), (None, None)]
    assert [g[0] for g in values(spark, [c[0] for c in fields], "string", text_timestamp(F.col("v"), F.lit(NOW)))] == [c[1] for c in fields]


@pytest.mark.parametrize(
    "text, value, want",
    [
        ("%Y/%m/%d %H.%M.%S,%L", "2025/11/03 08.20.31,250", T + 250), ("%d %b %Y %I:%M %p", "03 Nov 2025 08:20 PM", T - 31_000 + 43_200_000), ("%d.%m.%y %H:%M:%S %z", "03.11.25 13:50:31 +0530", T),
        ("%s", "1762158031", T), ("%Q", "1762158031250", T + 250), ("%H:%M:%S.%f", "00:00:02.9999", 2999), ("%Y", "soon", None), ("%B %d %Y", "November 3 2025", T - 30_031_000),
    ],
)
def test_time_formats(spark, text, value, want):
    assert values(spark, [value], "string", compile_time_format(text).parse(F.col("v")))[0][0] == want


def test_refused_time_formats():
    assert compile_time_format("%K") is None and compile_time_format("%Y%") is None


def test_levels(spark):
    words = ["ERROR", " warn ", "Notice", "fine", "finest", "panic", "e", "what", ""]
    assert [g[0] for g in values(spark, words, "string", level_from_text(F.col("v")))] == [0, 1, 2, 3, 4, 0, 0, 5, 5]
    assert [g[0] for g in values(spark, [60.0, 50.0, 40.0, 35.0, 20.0, 10.0, 9.0], "double", level_from_number(F.col("v")))] == [0, 0, 1, 2, 3, 4, 5]
    assert parse_level_map("error=A,B what=C warn=D error=E") == {"error": ["E"], "warn": ["D"]}


def test_text(spark):
    lines = ["\tat net.Pump", "Caused by: valve", "... 3 common frames", "Traceback (innermost", "goroutine 9 [idle]", "", "words", "attend", "--> pump.c:4"]
    assert [g[0] for g in values(spark, lines, "string", is_continuation(F.col("v")))] == [True] * 6 + [False, False, True]
    found = values(spark, ["ABC é", "É", None], "string", contains_folded(F.col("v"), "abc"), contains_folded(F.col("v"), "é"), contains_folded(F.col("v"), ""))
    assert found == [(True, True, True), (False, False, True), (None, None, True)]
    assert signature(None, "a 12 b 345") == "line:a # b #" and signature("x,y", "") == "csv:x,y"
    assert [g[0] for g in values(spark, [5, 2048, 3 << 20], "bigint", format_bytes(F.col("v")))] == ["5 B", "2.0 KB", "3.0 MB"]
    assert [g[0] for g in values(spark, [5000, 60_000, 21_600_000], "bigint", format_bucket(F.col("v")))] == ["5s", "1m", "6h"]


def test_white_space_and_numbers(spark):
    words = ["error\t", "error\r", " warn　", "﻿info", "err​or"]
    assert [g[0] for g in values(spark, words, "string", level_from_text(F.col("v")))] == [0, 0, 1, 2, 5]
    assert values(spark, ["\t2025.11.03\r"], "string", compile_time_format("%Y.%m.%d").parse(F.col("v")))[0][0] == T - 30_031_000
    fields = [("1762158031d", T), ("1762158031250.4 ", T + 250), ("\t1762158031.5e0\r", T + 500), ("1762158031f", T), ("x1762158031", None), ("17621580310d", None), ("1.762158031e9d", None), ("1.762158031e9", T), ("0x69087c5f", None), ("NaN", None)]
    assert [g[0] for g in values(spark, [f for f, _ in fields], "string", text_timestamp(F.col("v"), F.lit(NOW)))] == [None if f in ("1762158031d", "1762158031f") else t for f, t in fields]
    df = spark.createDataFrame([('{"level":"error\t","msg":"x"}'.replace("\t", "\\t"),), ("level=warn\tmsg=x b=2",)], "v string")
    assert [r.level for r in with_line_record(df, F.col("v"), NOW).collect()] == [0, 1]


def test_written_dates(spark):
    day = 1762128000000  # 2025-11-03
    clock = day + 8 * 3_600_000 + 20 * 60_000
    known = {
        "2025-11-03": day, "2025/11/3": day, "11/3/2025": day, "3 Nov 2025": day, "03-Nov-2025": day, "Nov 3, 2025": day, "November 3 2025": day, "Monday, November 3, 2025": day,
        "2025-11-03T08:20": clock, "2025-11-03 08:20": clock, "11/3/2025, 8:20 AM": clock, "11/3/2025 8:20:00 PM": clock + 12 * 3_600_000, "Nov 3, 2025 12:20 am": clock - 8 * 3_600_000,
        "Mon, 03 Nov 2025 08:20:31 GMT": T, "Mon, 03 Nov 2025 09:20:31 +0100": T, "Mon Nov 03 2025 09:20:31 GMT+0100 (CET)": T, " 3 November 2025 08:20:31.250\t": T + 250,
        "Feb 30 2025": 1740873600000,
    }
    wrong = ["13/3/2025", "Nov 32 2025", "Now 3 2025", "3 Nov 2025 24:10", "3 Nov 2025 13:10 pm", "3 Nov 2025 8:60", "2025-11", "Nov 2025", "3 Nov 20255", "", "yesterday", "3 Nov 2025 later", "2025|11|3"]
    assert [g[0] for g in values(spark, [*known, *wrong, None], "string", text_timestamp(F.col("v"), F.lit(NOW)))] == [*known.values(), *[None] * (len(wrong) + 1)]


def test_displayed_times_and_counts(spark):
    shown = lambda f: [g[0] for g in values(spark, [T + 250, None], "bigint", f(F.col("v")))]
    assert shown(format_time) == ["08:20:31.250", "—"] and shown(format_date)[0] == "2025-11-03" and shown(format_date_time)[0] == "2025-11-03 08:20:31"
    assert [g[0] for g in values(spark, [1234567, 12], "bigint", format_count(F.col("v")))] == ["1,234,567", "12"]


def test_filters_stay_above_the_stages(spark):
    df = spark.createDataFrame([(line,) for line, _ in LINES], "v string")
    found = with_line_record(df, F.col("v"), NOW).where(F.col("ts_ms").isNotNull() & (F.col("level") == 0))
    assert found.count() == sum(r[1] is not None and r[2] == 0 for _, r in LINES)
    assert len(found._jdf.queryExecution().optimizedPlan().toString()) < 200_000


def test_nested_bindings_cost_no_more_than_their_number(spark):
    """A nested binding's type was worked out twice by the one around it for each row, so that each further one doubled the time."""
    out = F.col("v")
    for _ in range(22):
        out = bind(out + 1, lambda x: x * 2 - x)
    nested = lambda k, x: x if k == 0 else bind(x + 1, lambda y: nested(k - 1, y))
    begin = time.monotonic()
    assert values(spark, [*range(20), None], "bigint", out, nested(27, F.col("v"))) == [*[(k + 22, k + 27) for k in range(20)], (None, None)]
    assert time.monotonic() - begin < 60
