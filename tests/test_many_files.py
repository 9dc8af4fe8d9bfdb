"""Many files added in one pass."""

import gzip

import pytest

from logweir.operators.custom import PatternSpec
from logweir.operators.query import FilterSpec
from logweir.session import LogSession
from logweir.sources.lines import head_and_files

NOW = 1_785_100_000_000
TEXTS = {
    "plain one.log": "2027-03-04T21:30:07Z INFO up\n\tat a.B\n\tat c.D\n2027-03-04T21:30:05Z ERROR late\n",
    "objects.log": '{"ts":"2027-03-04T21:30:08Z","level":"warn","service":"s1","msg":"é"}\r\n{"ts":1804195807123,"msg":"x"}\n',
    "marked.log": "﻿level=error msg=first ts=2027-03-04T21:30:07Z\n  more\n",
    "continues.log": "\tat the.Top\nERROR then\n",
    "export.csv": 'time,level,message\n2027-03-04T21:30:07Z,error,"a\nb"\n2027-03-04T21:30:09Z,info,c\n',
    "empty.log": "",
    "ünï.log": "only line without end",
}


@pytest.fixture()
def paths(tmp_path):
    for name, text in TEXTS.items():
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "folder.log").mkdir()
    for k in range(3):
        (tmp_path / "folder.log" / f"part-{k}").write_text(f"2027-03-04T21:30:0{k}Z INFO piece {k}\n  of it\n" * 4)
    made = [str(tmp_path / name) for name in [*TEXTS, "folder.log"]]
    return [*made, made[0]]  # a file may be given twice


def rows_of(session):
    return [repr(r) for r in session.logs().orderBy("row_id").collect()]


def folded_rows(text):
    """(row_seq, line_no, raw, folded), line after line."""
    lines = [x.rstrip("\r") for x in text.removeprefix("\ufeff").removesuffix("\n").split("\n")] if text else []
    out = []
    for k, line in enumerate(lines):
        if out and (line == "" or line[0] in " \t"):
            out[-1] = (*out[-1][:2], out[-1][2] + "\n" + line, out[-1][3] + 1)
        else:
            out.append((len(out), k + 1, line, 0))
    return out


def test_many_files_in_one_pass(spark, paths):
    """Splits of some lines; files of all kinds, some of which can't be read together."""
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "60")
    session, told = LogSession(spark, now_ms=NOW), []
    try:
        session.add_files(paths, on_progress=lambda at, size: told.append((at, size)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = {name: folded_rows(text) for name, text in TEXTS.items()}
    want["folder.log"] = folded_rows("".join(f"2027-03-04T21:30:0{k}Z INFO piece {k}\n  of it\n" * 4 for k in range(3)))
    want["export.csv"] = [(0, 1, '2027-03-04T21:30:07Z,error,"a\nb"', 0), (1, 2, "2027-03-04T21:30:09Z,info,c", 0)]
    names = [*TEXTS, "folder.log", "plain one.log"]
    got = session.logs().orderBy("row_id").collect()
    assert [(r.file_id, r.file, r.row_seq, r.line_no, r.raw, r.folded) for r in got] == [(k, n, *row) for k, n in enumerate(names) for row in want[n]]
    assert [r.row_id for r in got] == list(range(len(got)))
    assert [(r.level, r.eff_ts) for r in got[:4]] == [(2, 1804195807000), (0, 1804195807000), (1, 1804195808000), (5, 1804195808000)]
    assert told[-1][0] == told[-1][1] > 0 and told == sorted(told)
    together = {f.name for f in session.files if "/of=" in f.table}
    assert {"objects.log", "ünï.log", "folder.log"} <= together and not together & {"continues.log", "export.csv", "empty.log"}


def test_files_of_one_pass_are_read_anew_alone(spark, paths):
    session = LogSession(spark, now_ms=NOW)
    session.add_text("before", "INFO earlier")
    session.add_files(paths[:2], ["a", "b"])
    assert [(f.file_id, f.name) for f in session.files] == [(0, "before"), (1, "a"), (2, "b")]
    before = [r for r in rows_of(session) if "file='b'" in r]
    session.teach(1, PatternSpec((r"^(?<timestamp>\S+) (?<level>\w+) (?<message>.*)$",)))
    got = session.rows(FilterSpec(files=frozenset({1})), 0, 9).collect()
    assert [(r.file, r.message, r.folded) for r in got] == [("a", "up", 2), ("a", "late", 0)]
    assert [r for r in rows_of(session) if "file='b'" in r] == before
    again = session.add_files(paths[:2])  # what was taught holds for files of the same signature
    assert again[0].pattern and not again[1].pattern and session.detail(3)["full_text"].startswith('{"ts"')
    session.reset()
    assert session.add_files([]) == [] and session.logs().count() == 0


def test_nothing_is_added_if_a_file_is_missing(spark, paths):
    session = LogSession(spark, now_ms=NOW)
    with pytest.raises(Exception, match="(?i)not.exist|not_found"):
        session.add_files([paths[0], paths[0] + ".missing"])
    assert session.files == []


def test_a_head_is_where_the_first_file_begins(spark, tmp_path):
    """Not what a job over its splits gives first; a folder's first file may be empty."""
    (tmp_path / "part-0").write_text("")
    (tmp_path / "part-1").write_text("first é\r\n" + "".join(f"line {k}\n" for k in range(5000)))
    with gzip.open(tmp_path / "part-2.gz", "wt") as packed:
        packed.write("\ufeffpacked\n")
    spark.sparkContext.setJobGroup("heads", "heads")
    head, files = head_and_files(spark, str(tmp_path))
    assert head.startswith("first é\r\nline 0\n") and head.count("\n") == 2048 and head.endswith("line 2046\n") and len(files) == 3
    assert head_and_files(spark, str(tmp_path / "part-2.gz"))[0] == "packed\n" and head_and_files(spark, str(tmp_path / "part-0"))[0] == ""
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("heads")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
