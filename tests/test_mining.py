import random

import pytest
from pyspark.sql import functions as F

from sievelog.config import LEVELS, WILDCARD, CheckConfig, DiffConfig, MiningConfig, SettingError
from sievelog.functions.masking import Masker
from sievelog.functions.tokens import tokens_of
from sievelog.operators.train import train
from sievelog.operators.tree import Tree, has_digit, key_of
from sievelog.plans import model as models
from sievelog.plans import pipeline
from sievelog.sources.records import split_at
from sievelog.streaming.session import Session, StreamMiner

RECORDS = "run int, ord long, message string, ts_micros long, tz_aware boolean, level string"
WORDS = ["get", "put", "user", "x1", "y2", "disk", "<*>", "of", "9", "full", "cache", "miss"]


def corpus(seed, n=300, runs=1):
    pick = random.Random(seed)
    return [
        (k * runs // n, k, " ".join(pick.choice(WORDS) for _ in range(pick.randint(0, 6))), pick.choice([None, 10 * k]), False, pick.choice([None, *LEVELS]))
        for k in range(n)
    ]


class Plain:
    """The rules read word by word: one tree, linear scans, no memo, no index."""

    def __init__(self, config):
        self.config, self.root, self.clusters = config, {}, []

    def layers(self, tokens):
        return tokens[: self.config.layers(len(tokens))]

    def leaf(self, tokens):
        node = self.root.get(len(tokens))
        for t in self.layers(tokens):
            node = node and (node["kids"].get(key_of(t)) or node["kids"].get(WILDCARD))
        return node

    def best(self, ids, tokens):
        def score(c):
            pairs = list(zip(self.clusters[c][0], tokens, strict=True))
            return sum(a == b != WILDCARD for a, b in pairs), sum(a == WILDCARD for a, _ in pairs), -c

        found = max(ids, key=score, default=None)
        return found if found is not None and (not tokens or score(found)[0] * 10**6 >= self.config.threshold * len(tokens)) else None

    def add(self, tokens, record):
        leaf = self.leaf(tokens)
        c = self.best(leaf["ids"], tokens) if leaf else None
        if c is None:
            if len(self.clusters) >= self.config.max_templates:
                return None
            node = self.root.setdefault(len(tokens), {"kids": {}, "ids": []})
            for t in self.layers(tokens):
                k, kids = key_of(t), node["kids"]
                if k not in kids and k != WILDCARD:
                    if WILDCARD in kids:
                        k = k if len(kids) < self.config.max_children else WILDCARD
                    elif len(kids) + 1 >= self.config.max_children:
                        k = WILDCARD
                node = kids.setdefault(k, {"kids": {}, "ids": []})
            c = len(self.clusters)
            self.clusters.append((list(tokens), []))
            node["ids"].append(c)
        own, records = self.clusters[c]
        own[:] = [a if a == b else WILDCARD for a, b in zip(own, tokens, strict=True)]
        records.append(record)
        return c


def plain_result(rows, config):
    tree, pooled, masker = Plain(config), {}, Masker()
    for row in rows:
        tokens = tokens_of(masker.mask(row[2]))
        if tree.add(tokens, row) is None:
            pooled.setdefault(len(tokens), []).append(row)
    out = {}
    for tokens, records in [*tree.clusters, *(([WILDCARD] * n, r) for n, r in pooled.items())]:
        out.setdefault((" ".join(tokens)), []).extend(records)
    return out, tree


def check_rows(frame, want):
    got = {r.text: r for r in frame.collect()}
    assert got.keys() == {t for t, rows in want.items() if rows}
    for text, rows in want.items():
        if not rows:
            continue
        r, times = got[text], [x[3] for x in rows if x[3] is not None]
        assert r["count"] == len(rows) and r["first"] == min(times, default=None) and r["last"] == max(times, default=None)
        assert [r[f"n_{n.lower()}"] for n in LEVELS] == [sum(x[5] == n for x in rows) for n in LEVELS]
        assert r["example"] == min(rows, key=lambda x: x[1])[2]


@pytest.mark.parametrize(
    "options",
    [{}, {"sim_th": 0.0}, {"sim_th": 1.0}, {"depth": 6, "sim_th": 0.7, "max_children": 2}, {"max_children": 1}, {"max_templates": 1}, {"max_templates": 4}, {"depth": 3, "max_templates": 20}],
)
def test_training_equals_one_plain_tree(spark, options):
    config = MiningConfig(**options)
    rows = corpus(len(str(options)))
    frame = spark.createDataFrame(rows, RECORDS).repartition(7)
    found, _, tree = pipeline.trained(pipeline.prepare(frame, config), config)
    want, plain = plain_result(rows, config)
    check_rows(found, want)
    assert tree.clusters == [tokens for tokens, _ in plain.clusters]


def test_exact_threshold_is_a_group_by(spark):
    from sievelog.plans.catalogue import exact_templates

    frame = spark.createDataFrame(corpus(5), RECORDS)
    config = MiningConfig(sim_th=1.0)
    trained, _, _ = pipeline.trained(pipeline.prepare(frame, config), config)
    pick = lambda f: sorted((r.text, r["count"], r.example) for r in f.collect())
    assert pick(exact_templates(frame)) == pick(trained)


def test_index_gives_the_linear_answer():
    pick, config = random.Random(1), MiningConfig(sim_th=0.5, depth=3)
    tree, plain = Tree(config), Plain(config)
    for k in range(1500):
        tokens = [pick.choice("abcdefghij") for _ in range(5)]
        assert tree.learn(tokens, k) == plain.add(tokens, k)
    assert tree.clusters == [t for t, _ in plain.clusters] and len(tree.clusters) > 16
    copy = Tree.from_rows(config, tree.to_rows())
    assert Tree.joined(config, [tree.part(5).to_rows()]).to_rows() == copy.to_rows()


def test_damaged_trees_are_refused():
    config = MiningConfig()
    tree = Tree(config)
    tree.create(["a", "b"], 0)
    good = tree.to_rows()
    for change in ({"roots": [[2, 5]]}, {"roots": []}, {"clusters": [["a", ""]]}, {"clusters": [["a"]]}, {"nodes": good["nodes"] + [{"c": [], "k": []}]}):
        with pytest.raises(ValueError):
            Tree.from_rows(config, good | change)


def test_recount_conserves_records_and_ignores_order(spark):
    rows = corpus(8, runs=2)
    frame = spark.createDataFrame(rows, RECORDS)
    result = pipeline.diff(frame, options=DiffConfig(matcher="exact", significance=None))
    counts = result.entries.agg(F.sum("before_count"), F.sum("after_count")).first()
    assert tuple(counts) == (150, 150)


def test_identical_runs_do_not_differ(spark):
    rows = corpus(9, n=120)
    both = rows + [(1, k + 1000, m, t, z, lv) for _, k, m, t, z, lv in rows]
    result = pipeline.diff(spark.createDataFrame(both, RECORDS))
    assert result.counts()["new"] == result.counts()["changed"] == result.counts()["disappeared"] == 0


def test_values_and_changes(spark):
    rows = [(0, k, f"user u took {k % 3} ms", 1, False, None) for k in range(9)] + [(1, 20 + k, f"user u took {k % 4} ms", 1, False, None) for k in range(8)]
    frame = spark.createDataFrame(rows, RECORDS)
    found = pipeline.diff(frame, new_values=True).value_changes.collect()
    assert [(r.name, r.n_new, r.n_gone, r.n_shared, [(x.value, x["count"]) for x in r.new]) for r in found] == [("num", 1, 0, 3, [("3", 2)])]
    one = pipeline.analyze(frame.where("run = 0"), with_values=True)
    assert [(x.value, x["count"]) for x in one.values.first().top] == [("0", 3), ("1", 3), ("2", 3)]
    assert one.numbers.first()["count"] == 9


def test_baselines(spark):
    rows = [(r, 100 * r + k, m, None, False, None) for r in range(3) for k, m in enumerate(["steady line here"] * 4 + (["odd other thing"] * 3 if r in (1, 2) else []))]
    counts = pipeline.diff(spark.createDataFrame(rows, RECORDS), options=DiffConfig(matcher="exact")).counts()
    assert counts == {"new": 0, "disappeared": 0, "changed": 0, "unchanged": 2}


def test_split_at(spark):
    rows = [(0, k, "tick tock", 10 * k, False, None) for k in range(10)] + [(0, 50, "late only", 90, False, None)]
    entries = pipeline.diff(split_at(spark.createDataFrame(rows, RECORDS), 45), options=DiffConfig(matcher="exact")).entries
    assert {r.text: (r.before_count, r.after_count) for r in entries.collect()} == {"tick tock": (5, 5), "late only": (0, 1)}


def test_eviction_conserves_records_and_bounds_templates(spark):
    config = MiningConfig(max_templates=10, on_full="evict", sim_th=0.9)
    rows = corpus(11)
    found, clusters, tree = pipeline.trained(pipeline.prepare(spark.createDataFrame(rows, RECORDS), config), config)
    assert found.agg(F.sum("count")).first()[0] == len(rows) and len(tree.clusters) <= 10
    live = Session(config)
    live.add_many(m for _, _, m, *_ in rows)
    assert sorted((t.text, t.count) for t in live.result()) == sorted((r.text, r["count"]) for r in found.collect())


@pytest.mark.parametrize("options", [{}, {"max_templates": 8}, {"max_templates": 8, "on_full": "evict"}])
def test_saved_and_continued_is_uninterrupted(spark, tmp_path, options):
    config = MiningConfig(sim_th=0.7, **options)
    rows = corpus(12, n=200)
    first, second = rows[:90], rows[90:]
    frame = lambda part: spark.createDataFrame(part, RECORDS)
    whole = pipeline.analyze(frame(rows), config, keep_model=True)
    models.save(pipeline.analyze(frame(first), config, keep_model=True).model, tmp_path / "m.gz")
    again = pipeline.analyze(frame(second), config, start=models.load(tmp_path / "m.gz", config), keep_model=True)
    assert again.model.tree.clusters == whole.model.tree.clusters
    assert again.model.history == whole.model.history and again.model.overflow == whole.model.overflow


def test_bad_states(tmp_path):
    config = MiningConfig()
    tree = Tree(config)
    tree.create(["a"], 0)
    raw = models.dumps(models.Model(config, tree, [models.empty_history()]))
    assert models.loads(raw, config).tree.clusters == [["a"]]
    for bad in (raw.replace(b'"a"', b'"b"'), raw[:-20], b"{}\n{}\n{}\n", b"\x00"):
        with pytest.raises(SettingError):
            models.loads(bad, config)
    with pytest.raises(SettingError):
        models.loads(raw, MiningConfig(depth=5))


def test_match_and_check(spark):
    config = MiningConfig()
    known = [(0, k, f"job {k} done", None, False, "INFO") for k in range(10)]
    model = pipeline.analyze(spark.createDataFrame(known, RECORDS), config, keep_model=True).model
    log = [(0, k, "job 7 done", None, False, "INFO") for k in range(97)] + [(0, 97 + k, "disk sda is broken now", None, False, "ERROR") for k in range(3)]
    frame = spark.createDataFrame(log, RECORDS)
    matched = pipeline.match(frame, model)
    assert matched.run.unmatched == ((5, 3),) and [(r.text, r["count"]) for r in matched.top()] == [("job <NUM> done", 97)]
    exact = pipeline.match(frame, model, exact=True)
    assert exact.run.unmatched_records == 3
    checked = pipeline.check(frame, model)
    assert not checked.passed and [f.kind for f in checked.findings] == ["unmatched", "new"]
    assert pipeline.check(frame, model, CheckConfig(5.0, "none")).passed
    assert [f.kind for f in pipeline.check(frame.limit(0), model).findings] == ["empty"]


@pytest.mark.parametrize("cut", [1, 7, 50, 300])
def test_any_batch_cut_is_one_run(spark, cut):
    rows = corpus(13)
    live = Session()
    for k in range(0, len(rows), cut):
        live.add_many(m for _, _, m, *_ in rows[k : k + cut])
        live.new_templates()
    frame = spark.createDataFrame([(r, k, m, None, False, None) for r, k, m, *_ in rows], RECORDS)
    want = pipeline.analyze(frame).top()
    assert [(t.id, t.text, t.count, t.example) for t in live.result()] == [(r.id, r.text, r["count"], r.example) for r in want]


def test_stream_query_survives_a_restart(spark, tmp_path):
    source, state = tmp_path / "in", tmp_path / "state"
    source.mkdir()
    (source / "a.txt").write_text("job 1 done\njob 2 done\n")

    def run():
        miner = StreamMiner(state)
        query = miner.start(spark.readStream.text(str(source)), str(tmp_path / "check"), availableNow=True)
        query.awaitTermination(60)
        return miner

    run()
    (source / "b.txt").write_text("job 3 done\n")
    miner = run()
    assert miner.session.model().history[0][0] == 3
    assert [t.text if t else None for t in miner.session.match_many(["job 9 done", "x"])] == ["job <NUM> done", None]


@pytest.mark.parametrize("every", [2, 3])
def test_no_batch_is_lost_between_saves(spark, tmp_path, every):
    """Files one by one, a restart after each: whatever was not saved is mined again from its journal."""
    source = tmp_path / "in"
    source.mkdir()
    for k in range(5):
        (source / f"{k}.txt").write_text("".join(f"job {k}{i} done\n" for i in range(3)))
        miner = StreamMiner(tmp_path / "state", save_every=every)
        assert sum(h[0] for h in miner.session.model().history) == 3 * k
        miner.start(spark.readStream.text(str(source)), str(tmp_path / "check"), availableNow=True).awaitTermination(60)
        assert sum(h[0] for h in miner.session.model().history) == 3 * (k + 1)
    rows = spark.createDataFrame([("a 1", 5, "ERROR"), (None, 1, None), ("a 2", 3, None)], "m string, t long, l string")
    miner = StreamMiner(tmp_path / "other", message="m", ts="t", level="l", order="t")
    miner._take(rows, 0)
    (found,) = miner.session.result()
    assert (found.count, found.first, found.last, found.level) == (2, 3, 5, "ERROR")


def test_live_times_are_those_of_a_batch(spark, tmp_path):
    from sievelog.sources import records as rec
    from sievelog.sources.formats import FORMATS

    stamps = ["2024-01-02T03:04:05Z", "2024-02-30T00:00:00Z", "2024-01-02 03:04:05,678+02:00", "2024-12-31 23:59:59.9", "2024-01-02T25:04:05Z", "2024-01-02T03:04:60Z"]
    cases = {"app": [f"{s} ERROR boom {i}" for i, s in enumerate(stamps)], "nginx": ['1 - - [02/Jan/2024:03:04:05 +0300] "GET /" 200', '1 - - [32/Jan/2024:03:04:05 +0300] "GET /" 200']}
    cases["syslog"] = ["Jan  2 03:04:05 h a", "Feb 30 03:04:05 h a", "2024-01-02T03:04:05 h a"]
    cases["jsonl"] = ['{"msg": "a", "ts": 1704164645}', '{"msg": "a", "ts": 1704164645.25}', '{"msg": "a", "ts": "1704164645000"}', '{"msg": "a", "ts": true}', '{"msg": "a", "time": "2024-01-02T03:04:05Z"}', '{"msg": "a", "ts": -5}']
    for name, lines in cases.items():
        frame = spark.createDataFrame([(0, 0, k, x) for k, x in enumerate(lines)], "run int, file int, ord long, line string")
        want = [r.ts_micros for r in rec.parse(frame, FORMATS[name]).orderBy("ord").collect()]
        live = Session(format=name)
        assert [live.parse([x])[1] for x in lines] == want, name


def test_chunk_trees_are_merged_in_order(spark):
    """The merge read word by word: clusters of each stretch, in order, are messages of one more tree."""
    rows, config = corpus(21, n=240), MiningConfig(sim_th=0.5)
    frame = spark.createDataFrame(rows, RECORDS).repartition(5)
    clusters, tree = train(pipeline.prepare(frame, config), config, chunks=3)
    masker, merged = Masker(), Plain(config)
    bounds = sorted({r.chunk_start for r in pipeline.prepare(frame, config).select("ord").repartitionByRange(3, "ord").groupBy(F.spark_partition_id()).agg(F.min("ord").alias("chunk_start")).collect()})
    for a, b in zip(bounds, [*bounds[1:], len(rows)], strict=True):
        part = Plain(config)
        for row in rows[a:b]:
            part.add(tokens_of(masker.mask(row[2])), row)
        for tokens, records in part.clusters:
            merged.add(tokens, records)
    want = {}
    for tokens, parts in merged.clusters:
        want.setdefault(" ".join(tokens), []).extend(r for records in parts for r in records)
    got = clusters.groupBy(F.array_join("tokens", " ").alias("text")).agg(F.sum("count").alias("n"), F.min_by("example", "first_ord").alias("e")).collect()
    assert {r.text: (r.n, r.e) for r in got} == {t: (len(r), min(r, key=lambda x: x[1])[2]) for t, r in want.items()}
    assert sorted(tree.clusters) == sorted(t for t, _ in merged.clusters)


def test_mining_of_documents_equals_one_plain_tree(spark, sf):
    from sievelog.plans import catalogue

    rows = [(0, r.ord, r.message, None, False, None) for r in catalogue.document_records(spark, sf).orderBy("ord").collect()]
    want, _ = plain_result(rows, MiningConfig())
    got = {r.text: r["count"] for r in catalogue.drain_documents(spark, sf).collect()}
    assert got == {t: len(r) for t, r in want.items() if r} and any(WILDCARD in t for t in got)


def test_binary_states(tmp_path):
    config = MiningConfig()
    tree = Tree(config)
    for k, tokens in enumerate((["a", "<*>", "é"], ["b"], [], ["a", "b", "c"])):
        tree.create(tokens, k)
    model = models.Model(config, tree, [[k, None, k, [0] * 6] for k in range(4)], {3: models.empty_history()})
    for name in ("m.bin", "m.bin.gz", "m.json"):
        models.save(model, tmp_path / name)
        again = models.load(tmp_path / name, config)
        assert (again.tree.clusters, again.history, again.overflow) == (tree.clusters, model.history, model.overflow)
    raw = models.to_binary(models.dumps(model))
    assert raw.startswith(models.MAGIC)
    for bad in (raw[:-1], raw[:40] + b"x" + raw[41:], raw[: len(models.MAGIC)], models.MAGIC):
        with pytest.raises(SettingError):
            models.loads(bad, config)


def test_lines_and_open_records():
    live = Session(format="app", multiline=True)
    live.add_lines(["lost\n", "2024-01-02T03:04:05Z ERROR boom\r\n", "  at x\n", "\n"])
    assert live.records == 0 and live.unparsed == 1
    live.add_lines(["2024-01-02T03:04:06Z INFO fine\n"])
    live.flush()
    assert [(t.text, t.level) for t in live.result()] == [("boom at x", "ERROR"), ("fine", "INFO")]


def test_has_digit():
    assert has_digit("a1") and not has_digit("a") and key_of("x9") == WILDCARD


def test_eviction_leaves_other_leaves_alone():
    """Dropping a cluster rebuilds its own leaf only; the others are renumbered."""
    tree = Tree(MiningConfig(max_templates=10, on_full="evict"))
    for k, first in enumerate("abcab"):
        tree.create([first, "x", str(k), "y", "z"], k)
    leaves = [tree.leaf_of[c] for c in range(5)]
    untouched = leaves[1].wild
    assert tree.drop({0, 2}) == {1: 0, 3: 1, 4: 2} and leaves[1].wild is untouched
    assert [tree.find([f, "x", k, "y", "z"]) for f, k in (("b", "1"), ("a", "3"), ("b", "4"), ("c", "2"))] == [0, 1, 2, None]
    assert tree.create(["c", "x", "9", "y", "z"], 9) == 3 and tree.find(["c", "x", "9", "y", "z"]) == 3
