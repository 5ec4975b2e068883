import gzip
import json
import random

import pytest

from sievelog.config import SettingError
from sievelog.sources import detect, external
from sievelog.sources.formats import FORMATS, PlainFormat, RegexFormat, from_pattern, register, resolve
from sievelog.sources.lines import lines_of, read_lines
from sievelog.sources.log4j import log4j_format
from sievelog.sources.records import TimeWindow, admitted, counters, parse


def lines_frame(spark, lines):
    return spark.createDataFrame([(0, 0, k, x) for k, x in enumerate(lines)], "run int, file int, ord long, line string").repartition(3)


def parsed(spark, lines, spec):
    rows = parse(lines_frame(spark, lines), spec).orderBy("ord").collect()
    return [(r.message, r.ts_micros, r.level) if r.good else None for r in rows]


T = 1_704_164_645_000_000  # 2024-01-02T03:04:05Z
EXAMPLES = [
    ("app", "2024-01-02T03:04:05Z [main] WARN - disk full", ("disk full", T, "WARN")),
    ("app", "no time here", None),
    ("k8s", "2024-01-02T03:04:05.5Z stdout F hello", ("hello", T + 500_000, None)),
    ("nginx", '1.2.3.4 - - [02/Jan/2024:05:04:05 +0200] "GET /x HTTP/1.1" 200 5', ('"GET /x HTTP/1.1" 200', T, None)),
    ("nginx-error", "2024/01/02 03:04:05 [crit] bad gateway", ("bad gateway", T, "FATAL")),
    ("syslog", "Jan  2 03:04:05 host sshd[1]: open", ("sshd[1]: open", 97_445 * 1_000_000, None)),
    ("syslog", "2024-01-02T03:04:05+00:00 host cron: run", ("cron: run", T, None)),
    ("logfmt", 'ts=2024-01-02T03:04:05Z caller=a.go:1 level=debug msg="x y" n=2', ('msg="x y" n=2', T, "DEBUG")),
    ("haproxy", "haproxy[12]: 1.2.3.4:80 [02/Jan/2024:03:04:05.250] fe be/s 0/0 200", ("fe be/s 0/0 200", T + 250_000, None)),
    ("postgresql", "2024-01-02 03:04:05.000 UTC [12] ERROR:  deadlock", ("deadlock", T, "ERROR")),
    ("postgresql-csv", '2024-01-02 03:04:05.000 UTC,"u","d",1,"h",2,3,"SELECT",4,5,6,FATAL,57P03,"the system ""x"" stops"', ('the system ""x"" stops', T, "FATAL")),
    ("github-actions", "2024-01-02T03:04:05.0000000Z ##[error]failed", ("failed", T, "ERROR")),
    ("log4j", "2024-01-02 03:04:05,000 ERROR [pool 1] a.B - lost", ("lost", T, "ERROR")),
    ("jsonl", '{"msg": "a b\\n", "ts": 1704164645, "lvl": "warning"}', ("a b", T, "WARN")),
    ("jsonl", '{"message": {"k": [1, 2]}, "time": "1704164645000", "log.level": "info"}', ('{"k":[1,2]}', T, "INFO")),
    ("jsonl", '{"log": "x", "timestamp": 1704164645.5, "level": 3}', ("x", T + 500_000, None)),
    ("jsonl", '{"other": 1}', None),
    ("jsonl", "[1]", None),
    ("jsonl", '{"msg": "x", "time": true}', ("x", None, None)),
    ("journald", '{"MESSAGE": "m", "__REALTIME_TIMESTAMP": "1704164645000000", "PRIORITY": "4"}', ("m", T, "WARN")),
    ("serilog-clef", '{"@mt": "User {N}", "@t": "2024-01-02T03:04:05Z", "@l": "Warning"}', ("User {N}", T, "WARN")),
    ("plain", "anything 1", ("anything 1", None, None)),
]


@pytest.mark.parametrize(("name", "line", "want"), EXAMPLES)
def test_formats(spark, name, line, want):
    assert parsed(spark, [line], resolve(name)) == [want]


def test_continuation_lines(spark):
    lines = ["lost", "2024-01-02T03:04:05Z ERROR boom", "  at a", "", "  at b", "2024-01-02T03:04:06Z INFO ok"]
    spec = resolve("app", True)
    assert parsed(spark, lines, spec) == [None, ("boom\n  at a\n  at b", T, "ERROR"), ("ok", T + 1_000_000, "INFO")]
    frame = lines_frame(spark, lines)
    row = counters(frame, parse(frame, spec)).first()
    assert (row["lines"], row.records, row.unparsed) == (6, 2, 1)
    with pytest.raises(SettingError):
        parse(frame, PlainFormat(multiline=True))


def test_random_framing_against_a_loop(spark):
    pick = random.Random(2)
    lines = [pick.choice(["A start", "A other", "  more", "x", "", " "]) for _ in range(300)]
    want, open_ = [], None
    for line in lines:
        if not line.strip():
            continue
        if line.startswith("A"):
            open_ = [line]
            want.append(open_)
        elif open_ is None:
            want.append(None)
        else:
            open_.append(line)
    assert parsed(spark, lines, PlainFormat(record_start="^A", multiline=True)) == [("\n".join(w), None, None) if w else None for w in want]


def test_docker_entries_are_joined(spark):
    entry = lambda log, s: json.dumps({"log": log, "stream": "stdout", "time": f"2024-01-02T03:04:0{s}Z"})
    lines = [entry("a\n", 5), entry("b1 ", 6), entry("b2\n", 7), "junk", entry("c", 8)]
    assert parsed(spark, lines, FORMATS["docker-json"]) == [("a", T, None), ("b1 b2", T + 1_000_000, None), None, ("c", T + 3_000_000, None)]


def test_time_window(spark):
    lines = [f"2024-01-02T03:04:0{k}Z INFO n{k}" for k in range(5, 9)] + ["2024-13-02T03:04:05Z INFO bad time", "junk"]
    frame = lines_frame(spark, lines)
    found, window = parse(frame, FORMATS["app"]), TimeWindow(T + 1_000_000, T + 3_000_000)
    assert [r.message for r in admitted(found, window).orderBy("ord").collect()] == ["n6", "n7"]
    row = counters(frame, found, window).first()
    assert (row["lines"], row.records, row.unparsed, row.out_of_range, row.untimed, row.tz_aware) == (6, 2, 1, 2, 1, True)
    assert admitted(found).count() == 5


def test_lines_keep_file_order(spark, tmp_path):
    first, second = tmp_path / "b.log", tmp_path / "a.log"
    first.write_bytes(b"\xef\xbb\xbfone\r\ntwo\rstill\n\nlast")
    with gzip.open(second, "wb") as out:
        out.write(b"x\ny\n")
    got = [r.line for r in read_lines(spark, [str(first), str(second)]).orderBy("ord").collect()]
    assert got == ["one", "two\rstill", "", "last", "x", "y"]
    table = spark.createDataFrame([(2, "c\nd"), (1, "a"), (3, None)], "k long, t string")
    assert [r.line for r in lines_of(table, "t", ["k"]).orderBy("ord").collect()] == ["a", "c", "d"]


def test_files_of_a_folder_come_by_name(spark, tmp_path):
    for name in "cab":
        (tmp_path / f"{name}.log").write_text(f"{name}1\n{name}2\n")
    got = [r.line for r in read_lines(spark, [str(tmp_path), str(tmp_path / "c.log")]).orderBy("ord").collect()]
    assert got[:4] == ["a1", "a2", "b1", "b2"]


def test_many_splits_keep_order(spark, tmp_path):
    path = tmp_path / "big.log"
    path.write_text("\n".join(f"line {k}" for k in range(200_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300k")
    spark.conf.set("spark.sql.files.openCostInBytes", "64k")
    try:
        got = [r.line for r in read_lines(spark, str(path)).orderBy("ord").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == [f"line {k}" for k in range(200_000)]


def test_detection(spark, tmp_path):
    cases = {
        "app": ["2024-01-02T03:04:05Z INFO a"] * 5, "jsonl": ['{"msg": "x"}'] * 5, "journald": ['{"MESSAGE": "x"}'] * 5,
        "docker-json": ['{"log": "x\\n", "stream": "stdout", "time": "2024-01-02T03:04:05Z"}'] * 5, "k8s": ["2024-01-02T03:04:05Z stdout F a"] * 3,
        "nginx": ['h - - [02/Jan/2024:05:04:05 +0200] "G" 200'] * 2, "plain": [],
    }
    for name, lines in cases.items():
        assert detect.detect(lines).spec.name == name
    assert detect.detect(["2024-01-02T03:04:05Z ERROR a", "  at x", "  at y", "  at z"]).multiline
    with pytest.raises(SettingError):
        detect.detect(["what", "is", "this"])
    path = tmp_path / "x.log"
    path.write_text("2024-01-02T03:04:05Z INFO a\n  more\n2024-01-02T03:04:06Z ERROR b\n")
    found = detect.inspect(spark, str(path))
    assert (found["format"], found["multiline"], found["records"], found["levels"]) == ("app", True, 2, {"INFO": 1, "ERROR": 1})


def test_log4j_patterns(spark):
    spec = log4j_format("%d{HH:mm:ss.SSS} [%thread] %-5level %logger{36} - %msg%n%ex")
    assert parsed(spark, ["03:04:05.250 [main] INFO  a.b.C - hi there"], spec) == [("hi there", 11_045_250_000, "INFO")]
    assert parsed(spark, ["20240102T030405,000 x"], log4j_format("%d{ISO8601_BASIC} %m")) == [("x", T, None)]
    assert log4j_format("100%% %m").pattern.startswith("^100%")
    for bad in ("%q", "%m%n%m", "", "%d{GGG} %m"):
        with pytest.raises(SettingError):
            log4j_format(bad)


def test_patterns_and_registry():
    spec = from_pattern(r"(?P<time>\d+) (?P<lvl>\w+) (?P<msg>.*)")
    assert (spec.message_group, spec.time_group, spec.level_group) == ("msg", "time", "lvl")
    assert resolve("regex:(?P<message>.*)").message_group == "message" and resolve(spec, True).multiline
    register(spec)
    assert resolve("regex") is spec
    for bad in ("nothing", "regex:("):
        with pytest.raises((SettingError, Exception)):
            resolve(bad)
    with pytest.raises(SettingError):
        RegexFormat("x", "(a)", "msg")


def test_external_programs(tmp_path, monkeypatch):
    tool = tmp_path / "docker"
    tool.write_text('#!/bin/sh\necho "$@"\n')
    tool.chmod(0o755)
    monkeypatch.setenv("PATH", str(tmp_path) + ":/bin:/usr/bin")
    with external.fetch("docker:web", tail=5) as path:
        assert open(path).read() == "logs --tail 5 -- web\n"
    assert external.kubectl("ns/pod/c", external.Options(since="1h", previous=True)).argv == ["kubectl", "logs", "--namespace=ns", "--container=c", "--since=1h", "--previous", "--", "pod"]
    assert external.journalctl("nginx", external.Options()).argv[1:3] == ["--unit=nginx", "--output=short-iso"]
    tool.write_text("#!/bin/sh\necho no >&2; exit 3\n")
    for bad in ("docker:-x", "docker:web; ls", "kubectl:pod", "other:x"):
        with pytest.raises(SettingError), external.fetch(bad):
            pass
    assert external.is_source("docker:web") and not external.is_source("/a/b:c")
