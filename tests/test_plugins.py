import json
import threading

import pytest

from sievelog import observer, plugins
from sievelog.config import SettingError
from sievelog.functions.mask_sets import SETS
from sievelog.sources.formats import FORMATS, PlainFormat


@pytest.fixture(autouse=True)
def clean():
    before = dict(plugins._KNOWN)
    yield
    for kind, name in set(plugins._KNOWN) - set(before):
        del plugins._KNOWN[kind, name]
        FORMATS.pop(name, None)
        SETS.pop(name, None)


class Good:
    name = "good"

    def spec(self):
        return PlainFormat(self.name)


def test_plugins_have_to_be_what_they_say():
    assert plugins.add("formats", Good()).origin == "call" and FORMATS["good"].name == "good"
    assert plugins.Plugin("formats", "good", "call") in plugins.catalogue()

    class NoSpec:
        name = "nothing"

    class Odd(Good):
        name = "odd"

        def spec(self):
            return "a line"

    for kind, plugin in (("formats", NoSpec()), ("formats", Odd()), ("reports", NoSpec()), ("matchers", NoSpec()), ("sources", NoSpec()), ("mask_sets", NoSpec()), ("colours", Good())):
        with pytest.raises(SettingError):
            plugins.add(kind, plugin)
    Good.name = "app"
    try:
        with pytest.raises(SettingError):
            plugins.add("formats", Good())
    finally:
        Good.name = "good"


def test_folders(tmp_path):
    (tmp_path / "set.json").write_text(json.dumps({"name": "mine", "rules": [{"name": "x", "pattern": "q+", "token": "<Q>"}]}))
    (tmp_path / "own.py").write_text("from sievelog.sources.formats import PlainFormat\n\nclass F:\n    name = 'own'\n    def spec(self):\n        return PlainFormat('own')\n\nPLUGINS = {'formats': [F()]}\n")
    (tmp_path / "_hidden.py").write_text("raise RuntimeError")
    assert [(p.kind, p.name) for p in plugins.folder(tmp_path)] == [("formats", "own"), ("mask_sets", "mine")]
    with pytest.raises(SettingError):
        plugins.add("formats", type("F", (Good,), {"name": "own"})())
    with pytest.raises(SettingError):
        plugins.folder(tmp_path / "nowhere")
    assert plugins.installed() == []


def test_progress_and_cancelling(spark):
    told = []
    with observer.observed(spark, told.append, every=0.05):
        spark.range(1000).repartition(3).count()
    assert told[-1].jobs >= 1 and 0 < told[-1].done <= told[-1].tasks
    stop = threading.Event()
    stop.set()
    with pytest.raises(observer.Cancelled):
        with observer.observed(spark, cancel=stop, every=0.05):
            spark.range(0, 200_000_000_000, 1, 2).selectExpr("sum(hash(id) % 7)").collect()
    assert spark.range(5).count() == 5
    with pytest.raises(ZeroDivisionError):
        with observer.observed(spark):
            1 / 0
