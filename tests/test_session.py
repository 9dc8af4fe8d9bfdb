"""Files, rows and questions through the session."""

import random

import pytest
from pyspark.sql import functions as F

from logweir.operators import delimited, rows
from logweir.operators.custom import ColumnSpec, FormatError, PatternSpec, compile_pattern_format
from logweir.operators.parsers import json_object, record
from logweir.operators.query import FilterSpec, bucket_range, histogram_step
from logweir.session import LogSession
from logweir.sources.lines import read_lines, tagged_lines
from logweir.sources.registry import FormatRegistry

NOW = 1_785_100_000_000


@pytest.fixture()
def session(spark):
    return LogSession(spark, now_ms=NOW)


def test_sample_incident(session):
    session.load_sample()
    found = session.query(FilterSpec(levels=frozenset({0})))
    assert found.total_rows > 2000 and found.count == sum(b["errors"] for b in found.histogram) > 30
    base = found.histogram[0]["bucket_start_ms"]
    assert all(b["bucket_start_ms"] >= base + 13 * 60_000 for b in found.histogram if b["errors"])
    full = session.rows(FilterSpec(query="no space left"), 0, 5).collect()
    assert len(full) == 1 and full[0].folded == 3
    refused = session.rows(FilterSpec(query="503 get"), 0, 20).collect()
    assert len(refused) > 10 and refused[0].ts_ms > full[0].ts_ms
    assert session.position_for_time(FilterSpec(), base) == 0


def test_merge_clamp_and_seek(session):
    session.add_text("a", "1970-01-01T00:00:05Z a1\n1970-01-01T00:00:03Z late\n1970-01-01T00:00:09Z a2\n")
    session.add_text("b", "intro\n1970-01-01T00:00:05Z b1\n1970-01-01T00:00:06Z b2")
    rows_ = session.rows(FilterSpec(), 0, 9).collect()
    assert [(r.file, r.row_seq) for r in rows_] == [("b", 0), ("a", 0), ("a", 1), ("b", 1), ("b", 2), ("a", 2)]
    assert session.position_for_time(FilterSpec(), 5000) == 1 and session.position_for_time(FilterSpec(files=frozenset({0})), 9000) == 2
    assert session.rows(FilterSpec(), 4, 2).count() == 0
    assert [(s["file"], s["first_ts"]) for s in session.query().files] == [("a", 3000), ("b", 5000)]
    session.reset()
    assert session.logs().count() == 0 and session.query().histogram is None


def test_delimited_file(session):
    text = 'eventTime,severity,description,httpStatus,component\r\n1804195807123,error,"a ""q"", b\nsecond",500,f1\r\n\r\n1804195807999,,,404,\n'
    file = session.add_text("x.csv", text)
    got = session.rows(FilterSpec(), 0, 9).collect()
    assert [(r.ts_ms, r.level, r.service, r.message, r.line_no) for r in got] == [(1804195807123, 0, "f1", 'a "q", b\nsecond', 1), (1804195807999, 1, None, "404", 2)]
    assert session.detail(1)["fields"] == {"eventTime": "1804195807999", "httpStatus": "404"}
    assert session.file_info(0)["head_lines"][0] == file.dialect.header_line
    session.reparse(0, ColumnSpec(message="component", level="(none)"))
    assert [(r.level, r.message) for r in session.rows(FilterSpec(), 0, 9).collect()] == [(0, "f1"), (1, "404")]


def test_taught_format(session, tmp_path):
    session.registry = FormatRegistry(str(tmp_path / "formats.json"))
    text = "04/03/2027 21h30m07 # MELTED # pump-3 # coil is gone\nseal and valve too\n04/03/2027 21h30m09 # STEADY # pump-3 # spare took over\n"
    session.add_text("inv.log", text)
    spec = PatternSpec((r"^(?<timestamp>[\d/]+ [\dhm]+) # (?<level>\w+) # (?<my_device>[\w-]+) # (?<message>.*)$",), ("%d/%m/%Y %Hh%Mm%S",), {"error": ("MELTED",), "info": ("steady",)})
    assert [p["matched"] for p in session.preview(0, spec)] == [True, False, True]
    session.teach(0, spec)
    got = session.rows(FilterSpec(), 0, 9).collect()
    assert [(r.level, r.message, r.folded, r.line_no) for r in got] == [(0, "coil is gone", 1, 1), (2, "spare took over", 0, 2)]
    assert session.detail(0)["fields"]["my_device"] == "pump-3"
    assert session.add_text("again", text).spec == spec
    (tmp_path / "formats.json").write_text("{damaged")
    assert session.registry.known() == {}
    for bad in (PatternSpec(()), PatternSpec(("(",)), PatternSpec(("a",), ("%K",)), PatternSpec(("a",), (), {"loud": ("x",)})):
        with pytest.raises(FormatError):
            compile_pattern_format(bad, session.spark)


@pytest.mark.parametrize("size", ["24", "1k", "128m"])
def test_splits_do_not_matter(spark, tmp_path, size):
    rng = random.Random(5)
    lines = [rng.choice(["", "\tat x", "2027-03-04T21:30:07Z INFO é", "plain " * rng.randint(1, 9), "tail\r"]) for _ in range(200)]
    (tmp_path / "f.log").write_bytes(("﻿" + "\n".join(lines) + "\n").encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        got = [r.value for r in read_lines(spark, [str(tmp_path / "f.log")]).orderBy("line_no").select("value", "line_no").collect()]
        assert got == [x.rstrip("\r") for x in lines]
        folded = rows.fold(read_lines(spark, [str(tmp_path / "f.log")])).orderBy("row_seq").collect()
        want: list[list[str]] = []
        for x in got:
            if want and (x == "" or x.startswith("\tat ")):
                want[-1].append(x)
            else:
                want.append([x])
        assert [r.raw for r in folded] == ["\n".join(w) for w in want]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_one_pass_over_splits_gives_the_same_rows(spark, tmp_path):
    rng = random.Random(11)
    lines = ["up 5"] + rng.choices(["", "\tat x", "  more", "a 31", "é 7", "plain 19"], k=60) + ["\tat y"] * 9
    simple = lambda line: record(4, F.regexp_extract(line, r"(\d+)$", 1).try_cast("bigint"), F.length(line), F.substring(line, 1, 1), line)
    one = lambda lines, line: rows.with_record(lines, simple(line), ts="ts")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40")
    try:
        for first in ("up 5", "\tat first", "\ufeffup 5"):
            path = tmp_path / f"{len(first)}.log"
            path.write_bytes(("\n".join([first, *lines[1:]]) + "\n").encode())
            made = rows.split_rows(tagged_lines(spark, [str(path)]), one)
            assert (made is None) == (first == "\tat first")
            if made:
                plain = rows.with_effective_time(rows.with_record(rows.fold(read_lines(spark, [str(path)])), simple(F.col("text")))).select(*rows.COLUMNS)
                assert sorted(map(repr, made[0].collect())) == sorted(map(repr, plain.collect()))
        assert rows.split_rows(tagged_lines(spark, [str(tmp_path / "4.log")]), one, most=40) is None
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_json_objects_alone(spark):
    good = ['{"a":1}', '{"a":[1,2]}', '{"a":"]"}', '{"a":1} ', "{}"]
    bad = ['{"a":1}]', '{"a":1}}', '{"a":1},{"b":2}', '{"a":1},null', '{"a":1},"v":{"b":2}', '{"a":1}]x}', '{"a":1}],[{"b":1}', '{"a":1} x', "[1]", '{"a"']
    df = spark.createDataFrame([(x,) for x in good + bad], "line string")
    got = [r.x for r in df.select(json_object(F.col("line")).isNotNull().alias("x")).collect()]
    assert got == [True] * len(good) + [False] * len(bad)


def greedy_cuts(sizes, most):
    """Numbers of the lines that begin a row, one after the other."""
    held, heads = 0, []
    for k, size in enumerate(sizes):
        if k == 0 or held + size + 1 > most:
            heads.append(k)
            held = size
        else:
            held += size + 1
    return heads


@pytest.mark.parametrize("most", [26, 1, 200])
def test_long_rows_are_cut(spark, most):
    """Several files whose rows span many chunks, with empty lines, lines longer than the bound and a last line that is."""
    made = random.Random(most)
    rows_of = {
        0: [5, *([9] * 30)], 1: [0] * 400, 2: [made.choice((0, 1, 3, 9, 25, 26, 27, 80)) for _ in range(700)], 3: [most * 90, 3, 3, most * 40], 4: [most, most, 1],
        5: [made.randrange(1, most + 2) for _ in range(300)],
    }
    lines = [(f, "f", k // 37, k + 1, ("h" if k == 0 else " ")[:size] + "x" * (size - 1)) for f, sizes in rows_of.items() for k, size in enumerate(sizes)]
    df = spark.createDataFrame(lines, "file_id int, file string, part int, line_no bigint, value string")
    got = {}
    for r in rows.fold(df, head=F.col("line_no") == 1, most=most).orderBy("file_id", "row_seq").collect():
        got.setdefault(r.file_id, []).append(r)
    for f, sizes in rows_of.items():
        heads = greedy_cuts(sizes, most)
        assert [r.line_no - 1 for r in got[f]] == heads
        assert [r.folded + 1 for r in got[f]] == [b - a for a, b in zip(heads, [*heads[1:], len(sizes)], strict=True)]


def line_turn(line, delimiter, quoted):
    """Whether a quoted field is open after the line, character by character."""
    empty, at = not quoted, 0
    while at < len(line):
        char = line[at]
        if quoted and char == '"' and line[at + 1 : at + 2] == '"':
            at += 1
        elif quoted and char == '"':
            quoted, empty = False, False
        elif not quoted and char == '"' and empty:
            quoted = True
        elif not quoted:
            empty = char == delimiter
        at += 1
    return quoted


def test_records_match_a_plain_reader(spark):
    rng = random.Random(3)
    for trial in range(6):
        text = "".join(rng.choice('ab,"\n') for _ in range(120)) + "\n"
        lines = text.split("\n")[:-1]
        state, want, raw = False, [], []
        for line in lines:
            raw.append(line)
            state = line_turn(line, ",", state)
            if not state:
                want.append("\n".join(raw))
                raw = []
        want = [w for w in want + (["\n".join(raw)] if raw else []) if delimited.split_fields(w, ",") != [""]][1:]
        df = spark.createDataFrame([(0, "f", k // 5, k + 1, x) for k, x in enumerate(lines)], "file_id int, file string, part int, line_no bigint, value string")
        got = delimited.records(df, ",").orderBy("rec_no").select("rec_no", "raw", "fields").collect()
        assert [(r.rec_no, r.raw, r.fields) for r in got] == [(k, w, delimited.split_fields(w, ",")) for k, w in enumerate(want, 1)], trial


def test_sniffing_and_helpers():
    assert delimited.sniff("a,b\n1,2\n") and delimited.sniff("time\tlevel\tmessage\n1\t2\t3\n").delimiter == "\t"
    assert delimited.sniff('{"a":1,"b":2}\nx,y\n') is None and delimited.sniff("a,b\n") is None
    assert delimited.split_fields('a,"b ""c"", d",5" x', ",") == ["a", 'b "c", d', '5" x']
    assert delimited.tokens_of("timestampInMs2") == ["timestamp", "in", "ms", "2"]
    assert histogram_step(169_000) == 5000 and histogram_step(10**12) == 86_400_000
    assert bucket_range(0, 10, 2) == (20, 29) and bucket_range(0, 10, 2, (20, 29)) is None


def test_search_rules(session):
    session.add_text("t", '{"msg":"Ünïcode ÉCLAIR"}\nplain É line\n')
    hits = lambda q: session.query(FilterSpec(query=q)).count
    assert hits("éclair") == 1 and hits("É") == 1 and hits("PLAIN") == 1 and hits("") == 2


def test_optional_groups(session):
    made = compile_pattern_format(PatternSpec((r"^(?<timestamp>\S+)(?: svc=(?<service>\w+))?(?: msg=(?<message>.+))?$",)), session.spark)
    df = session.spark.createDataFrame([("2027-03-04T21:30:00Z",), ("2027-03-04T21:30:00Z svc=a msg=b",)], "v string")
    got = [(r.r.service, r.r.message) for r in df.select(made.parse(F.col("v")).alias("r")).collect()]
    assert got == [(None, "2027-03-04T21:30:00Z"), ("a", "b")]


def test_all_problems_of_a_spec_are_told(session):
    with pytest.raises(FormatError) as told:
        compile_pattern_format(PatternSpec(("", "(", "(?<a>x)(?<a>y)"), ("%K",), {"loud": ("x",)}), session.spark)
    assert str(told.value).count(";") == 4


def test_blank_lines_above_the_header(session):
    session.add_text("x.csv", "\n\nmessage,level\n\nfirst,error\nsecond,info\n")
    got = session.rows(FilterSpec(), 0, 9).collect()
    assert [(r.message, r.level, r.line_no) for r in got] == [("first", 0, 1), ("second", 2, 2)]


def test_carriage_returns_and_invalid_bytes(spark, tmp_path):
    (tmp_path / "f.log").write_bytes(b"a\r\nb\r\r\nc\r\r\r\nd\rd\n\xff\xfee\xc3\n\xe2\x82")
    got = [r.value for r in read_lines(spark, [str(tmp_path / "f.log")]).orderBy("line_no").collect()]
    assert got[:4] == ["a", "b", "c\r", "d\rd"] and got[4] == "\ufffd\ufffde\ufffd" and got[5] == "\ufffd"


def test_access_detail_and_export(session, tmp_path):
    line = '198.51.100.9 - ada [04/Mar/2027:21:30:00 +0000] "PUT /items/7 HTTP/2" 503 77 "-" "x"'
    session.add_text("edge", f"{line}\n\tat more\n")
    assert session.detail(0)["fields"] == {"remote": "198.51.100.9", "user": "ada", "time": "04/Mar/2027:21:30:00 +0000", "method": "PUT", "path": "/items/7", "status": "503", "bytes": "77"}
    session.export_text(0, str(tmp_path / "out"))
    assert session.spark.read.text(str(tmp_path / "out")).count() == 2
