import json
import random
import xml.etree.ElementTree as ET

import pytest

from sievelog import api, cli
from sievelog.config import DiffConfig, MiningConfig, SettingError
from sievelog.reporters import documents as reports
from sievelog.reporters import text as t


def log(path, n, more=(), start=0):
    pick = random.Random(n)
    lines = [f"2024-01-02T03:{k // 60 % 60:02d}:{k % 60:02d}Z {pick.choice(['INFO', 'WARN'])} user u{k} logged in from 10.0.0.{k % 9}" for k in range(start, start + n)]
    path.write_text("\n".join([*lines, *more]) + "\n")
    return str(path)


@pytest.fixture
def logs(spark, tmp_path):
    odd = [f"2024-01-02T04:00:{k:02d}Z ERROR <b>disk|`full`</b> @channel {k}" for k in range(20)]
    return log(tmp_path / "a.log", 200), log(tmp_path / "b.log", 200, odd)


def test_analyze(logs, tmp_path):
    found = api.analyze(logs[1], values=True)
    assert (found.format, found.run.records, found.run.lines, found.run.tz_aware) == ("app", 220, 220, True)
    assert [(r["count"], r.level) for r in found.top()] == [(200, "WARN"), (20, "ERROR")]
    assert [r.level for r in found.filtered(min_level="ERROR").top()] == ["ERROR"]
    assert found.level_totals()["ERROR"] == 20
    assert api.analyze(logs[1], since="2024-01-02T04:00:00Z").run.records == 20
    with pytest.raises(SettingError):
        api.analyze(logs[1], format="plain", since="2024-01-02")
    masked = api.analyze(logs[1], examples="masked").top()
    assert "<NUM>" in masked[1].example and api.analyze(logs[1], examples="none").top()[0].example is None


def test_diff_check_match(logs, tmp_path):
    found = api.diff(*logs)
    assert found.counts() == {"new": 1, "disappeared": 0, "changed": 0, "unchanged": 1} and found.new_alerts().count() == 1
    state = tmp_path / "m.json"
    api.analyze(logs[0], save_state=state)
    checked = api.check(state, logs[1])
    assert [f.kind for f in checked.findings] == ["unmatched", "new"] and api.check(state, logs[0]).passed
    assert api.match(state, logs[1]).run.unmatched_records == 20
    again = api.analyze(logs[0], load_state=state, save_state=state)
    assert again.top()[0]["count"] == 200 and again.model.history[0][0] == 400
    with pytest.raises(SettingError):
        api.check(state, logs[1], depth=5)


def test_split_baselines_and_saved(logs, tmp_path):
    cut = api.diff(logs[1], split_at="2024-01-02T04:00:00Z")
    assert (cut.before.records, cut.after.records, cut.counts()["new"], cut.counts()["disappeared"]) == (200, 20, 1, 1)
    pooled = api.diff(logs[0], logs[1], baselines=[logs[0]])
    assert pooled.before.records == 400 and pooled.counts()["new"] == 1
    for k, path in enumerate(logs):
        api.save_analysis(api.analyze(path), tmp_path / f"{k}.json")
    saved = api.diff(tmp_path / "0.json", tmp_path / "1.json")
    assert saved.counts() == api.diff(*logs, recount=False).counts()
    assert api.load_analysis(tmp_path / "1.json").top()[0]["count"] == 200 and not api.is_saved_analysis(logs[0])
    with pytest.raises(SettingError):
        api.diff(logs[0])


@pytest.mark.parametrize("name", list(reports.REPORTERS))
def test_reports(logs, name):
    found = api.diff(*logs)
    text = api.render(found, name)
    assert text.endswith("\n") and ("20" in text)
    if name == "json":
        data = json.loads(text)
        assert data["summary"] == {"new": 1, "changed": 0, "disappeared": 0, "new_alerts": 1, "unchanged": 1}
    if name == "junit":
        suite = ET.fromstring(text).find("testsuite")
        assert suite.get("failures") == "1" and "<b>" in suite.find("testcase").get("name")
        with pytest.raises(SettingError):
            api.render(api.analyze(logs[0]), name)
    else:
        assert api.render(api.analyze(logs[0]), name)
    if name == "html":
        assert "<b>disk" not in text and "&lt;b&gt;disk" in text
    if name == "chat-message":
        assert "@channel" not in text and len(api.render(found, name, max_chars=400)) <= 400
    if name == "github-summary":
        assert "`<b>disk|'full'</b> @channel <NUM>`" in text
        assert "shortened" in api.render(found, name, max_bytes=200)


def test_text_rules():
    assert t.flatten(" a\x01b\t c ") == "a\\x01b c" and t.clip("abcdefgh", 5) == "ab..." and t.clip("abcdefgh", 5, True) == "...gh"
    assert t.guarded("=1+1") == "'=1+1" and t.guarded("a") == "a" and t.guarded("") == ""
    assert t.label('a"\\', 9) == 'a\\"\\\\' and t.xml("a<b\ufffe", 9) == "a&lt;bU+FFFE" and t.cell("a|b") == "a\\|b"
    assert t.defused("<!here> @all allx @allx") == "<\u200b!here> @\u200ball allx @allx"


def test_written_reports(logs, tmp_path):
    found = api.analyze(logs[0])
    path = tmp_path / "r.md"
    api.write(found, path)
    api.write(found, path, append=True)
    assert path.read_text().count("# ") == 2
    for bad in ({"path": tmp_path / "x.bin"}, {"path": tmp_path / "x.csv", "append": True}):
        with pytest.raises(SettingError):
            api.write(found, **bad)
    reports.write_bulk(found.templates, str(tmp_path / "bulk"))
    assert api.session().read.parquet(str(tmp_path / "bulk")).count() == 1


def test_command_line(logs, tmp_path, capsys, monkeypatch):
    run = lambda *argv: (cli.run([str(a) for a in argv]), capsys.readouterr().out)
    assert run("analyze", logs[0], "--top", 3)[1].startswith(logs[0])
    assert run("diff", *logs, "--fail-on", "new-alerts")[0] == 2 and run("diff", *logs)[0] == 0
    state = tmp_path / "m.json"
    assert run("learn", logs[0], "--save-state", state)[0] == 0
    assert run("check", logs[1], "--state", state)[0] == 2 and run("check", logs[0], "--state", state, "--json")[0] == 0
    assert "user" in run("match", logs[0], "--state", state, "--report", "csv")[1]
    assert json.loads(run("params", "took <NUM> ms", "took 5 ms")[1]) == [{"position": 1, "name": "num", "value": "5"}]
    assert run("params", "a", "b c")[0] == 1
    assert json.loads(run("inspect", logs[0])[1])["format"] == "app"
    assert "nginx" in run("formats")[1] and "payment" in run("masks")[1] and "<CARD>" in run("masks", "payment")[1] and "jaccard" in run("info")[1]
    monkeypatch.setattr("sys.stdin", iter(["job 1 done\n", "job 2 done\n"]))
    assert "2         job <NUM> done" in run("stream", "--save-state", tmp_path / "s.json")[1]
    settings = tmp_path / "c.toml"
    settings.write_text("[mining]\ndepth = 5\n[masks]\nsets = ['pii']\n")
    assert run("--config", settings, "analyze", logs[0])[0] == 0
    monkeypatch.setattr("sys.argv", ["x", "analyze", str(tmp_path / "none.log"), "--format", "nothing"])
    with pytest.raises(SystemExit) as stop:
        cli.main()
    assert stop.value.code == 1


def test_settings():
    assert MiningConfig().fingerprint() == MiningConfig().fingerprint() != MiningConfig(sim_th=0.5).fingerprint()
    assert MiningConfig(on_full="evict").fingerprint() != MiningConfig().fingerprint() and MiningConfig.high_cardinality().max_templates == 5000
    for bad in ({"depth": 2}, {"sim_th": 2}, {"max_children": 0}, {"on_full": "x"}, {"delimiters": "é"}):
        with pytest.raises(SettingError):
            MiningConfig(**bad)
    with pytest.raises(SettingError):
        DiffConfig(threshold_ratio=0.5)
    assert api.time_bound("1970-01-01T00:00:01+00:00") == 1_000_000 and api.time_bound(None) is None
    with pytest.raises(SettingError):
        api.time_bound("soon")
