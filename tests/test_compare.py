import functools
import math
import operator
import random

import pytest
from pyspark.sql import functions as F

from sievelog.config import WILDCARD, DiffConfig, SettingError
from sievelog.operators import compare, matchers, values, wordsets
from sievelog.operators.stats import LEVEL_COLUMNS

WORDS = ["a", "b", "c", "d", "e", "<*>", "fail", "user"]


def templates(spark, texts):
    zero = [F.lit(0).cast("long").alias(c) for c in LEVEL_COLUMNS]
    frame = spark.createDataFrame([(t, n) for t, n in texts], "text string, count long")
    return frame.select("text", "count", F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("last"), *zero, F.lit(None).cast("string").alias("example"))


def sides(seed, size=(0, 7)):
    pick = random.Random(seed)
    make = lambda: sorted({" ".join(pick.choice(WORDS) for _ in range(pick.randint(*size))) for _ in range(12)})
    before = make()
    return before, [t for t in make() if t not in before]


def indexed(spark, texts):
    return spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "text string, i int")


def greedy(scored):
    used_b, used_a, out = set(), set(), []
    for _, b, a in sorted((-s, b, a) for b, a, s in scored):
        if b not in used_b and a not in used_a:
            used_b.add(b)
            used_a.add(a)
            out.append((b, a))
    return sorted(out)


def quadratic(kind, before, after, least):
    every = before + after
    sets = [sorted(set(t.split())) for t in every]
    n = {w: sum(w in s for s in sets) for s in sets for w in s}
    rank = {w: i for i, w in enumerate(sorted(n, key=lambda w: (n[w], w)))}
    out = []
    for b, x in enumerate(sets[: len(before)]):
        for a, y in enumerate(sets[len(before) :]):
            both, any_ = set(x) & set(y), set(x) | set(y)
            if kind == "jaccard":
                s = len(both) / len(any_) if any_ else 0.0
            elif kind == "overlap":
                if min(len(x), len(y)) < 3:
                    continue
                s = len(both) / min(len(x), len(y))
            else:
                total = lambda ws: functools.reduce(operator.add, (1.0 / n[w] for w in sorted(ws, key=rank.get)), 0.0)
                s = total(both) / total(any_) if any_ else 0.0
            if s >= least:
                out.append((b, a, s))
    return out


@pytest.mark.parametrize("kind", ["jaccard", "jaccard-idf", "overlap"])
@pytest.mark.parametrize(("seed", "least"), [(1, 0.3), (2, 0.6), (3, 0.8), (4, 1.0), (5, 0.01)])
def test_scores_equal_the_quadratic_definition(spark, kind, seed, least):
    before, after = sides(seed, (1, 7))
    scored = matchers.SCORES[kind][0](indexed(spark, before), indexed(spark, after), least)
    want = quadratic(kind, before, after, least)
    assert sorted((r.b, r.a, r.score) for r in scored.collect()) == sorted(want)
    for few in (0, 1000):
        assert sorted((r.b, r.a) for r in matchers.take_best(scored, few).collect()) == greedy(want)


@pytest.mark.parametrize("kind", ["jaccard", "jaccard-idf", "overlap"])
def test_a_threshold_of_zero_takes_every_pair(spark, kind):
    before, after = sides(8)
    pairs = matchers.match(spark, templates(spark, [(t, 100 - i) for i, t in enumerate(before)]), templates(spark, [(t, 100 - i) for i, t in enumerate(after)]), kind, 0.0)
    assert sorted((r.before_text, r.after_text) for r in pairs.collect()) == sorted((before[b], after[a]) for b, a in greedy(quadratic(kind, before, after, 0.0)))


def test_rounds_take_what_one_by_one_would(spark):
    pick = random.Random(2)
    scored = [(b, a, pick.choice([0.5, 0.6, 0.7])) for b in range(25) for a in range(25) if pick.random() < 0.3]
    frame = spark.createDataFrame(scored, "b int, a int, score double")
    assert sorted((r.b, r.a) for r in matchers.take_best(frame, 0).collect()) == greedy(scored)


def test_subset_matcher(spark):
    before, after = sides(7)
    fits = lambda x, y: len(x) == len(y) and all(p in (WILDCARD, q) for p, q in zip(x, y, strict=True))
    split = lambda t: t.split(" ") if t else []
    used, want = set(), []
    for a, y in enumerate(map(split, after)):
        near = [(abs(x.count(WILDCARD) - y.count(WILDCARD)), b) for b, x in enumerate(map(split, before)) if b not in used and (fits(x, y) or fits(y, x))]
        if near:
            used.add(min(near)[1])
            want.append((min(near)[1], a))
    candidates = matchers.subset_candidates(indexed(spark, before), indexed(spark, after))
    every = {(b, a) for b, x in enumerate(map(split, before)) for a, y in enumerate(map(split, after)) if fits(x, y) or fits(y, x)}
    assert {(r.b, r.a) for r in candidates.collect()} == every and every
    got = [sorted((r.b, r.a) for r in matchers.take_subset(candidates, few).collect()) for few in (0, 1000)]
    assert got[0] == got[1]
    got = got[0]
    assert got == want


def test_rules(tmp_path, spark):
    path = tmp_path / "r.txt"
    path.write_text("# comment\n\nuser <*> in <=> login of <*>\n")
    rules = matchers.load_rules(path)
    assert matchers.pair_by_rules(["user bob in", "x"], ["y", "login of bob"], rules) == [(0, 1)]
    assert matchers.pair_by_rules(["login of x"], ["user y in"], rules) == [(0, 0)]
    pairs = matchers.match(spark, templates(spark, [("user bob in", 3)]), templates(spark, [("login of bob", 2)]), f"rules:{path}")
    assert [tuple(r) for r in pairs.collect()] == [("user bob in", "login of bob")]
    path.write_text("nothing\n")
    with pytest.raises(SettingError):
        matchers.load_rules(path)
    with pytest.raises(SettingError):
        matchers.match(spark, templates(spark, [("a", 1)]), templates(spark, [("b", 1)]), "odd")


def test_own_matcher(spark):
    class Crossed:
        def match(self, before, after):
            return [(0, 1)]

    pairs = matchers.match(spark, templates(spark, [("p", 3)]), templates(spark, [("q", 2), ("r", 1)]), Crossed())
    assert [tuple(r) for r in pairs.collect()] == [("p", "r")]


def plain_g(a, b, na, nb):
    cells = [[a, b], [na - a, nb - b]]
    total = na + nb
    return 2 * sum(x * math.log(x * total / (sum(row) * (na, nb)[k])) for row in cells for k, x in enumerate(row) if x)


@pytest.mark.parametrize("options", [{}, {"significance": None}, {"min_count": 1, "threshold_ratio": 1.0}, {"min_new_count": 5}])
def test_classification(spark, options):
    pick = random.Random(6)
    before = [(f"t{k}", pick.choice([1, 9, 10, 200])) for k in range(14)]
    after = [(f"t{k}", pick.choice([1, 9, 30, 200])) for k in range(4, 18)]
    config, left, right = DiffConfig(**options), dict(before), dict(after)
    nb, na = sum(left.values()), sum(right.values())
    rows = compare.with_p(compare.classify(compare.joined(templates(spark, before), templates(spark, after)), nb, na, config)).collect()
    assert len(rows) == 18
    for r in rows:
        b, a = left.get(r.text, 0), right.get(r.text, 0)
        ratio = (a / na) / (b / nb) if a and b else None
        assert r.ratio == ratio and (r.before_count, r.after_count) == (b, a)
        if a and b:
            g = plain_g(b, a, nb, na)
            p = math.erfc(math.sqrt(max(g, 0) / 2))
            big = max(a, b) >= config.min_count and max(ratio, 1 / ratio) >= config.threshold_ratio
            assert r.category == ("changed" if big and (config.significance is None or p <= config.significance) else "unchanged")
            if r.category == "changed" and config.significance:
                assert r.score == pytest.approx(g, abs=1e-6) and r.p == pytest.approx(p, rel=1e-4)
        else:
            assert r.category == (None if max(a, b) < config.min_new_count else "new" if a else "disappeared")


def test_paired_templates_count_as_one(spark):
    before, after = templates(spark, [("old words here now", 50)]), templates(spark, [("old words here", 50)])
    pairs = matchers.match(spark, before, after, "jaccard")
    rows = compare.classify(compare.joined(before, after, pairs), 50, 50).collect()
    assert [(r.text, r.category) for r in rows] == [("old words here", "unchanged")]


def test_runs_without_records(spark):
    empty = templates(spark, [("x", 0)])
    rows = compare.classify(compare.joined(empty, templates(spark, [("y", 4)])), 0, 4).collect()
    assert [(r.text, r.category, r.before_share, r.factor) for r in rows] == [("y", "new", 0.0, 1.0)]


def test_critical_value():
    assert compare.critical_g(0.01) == pytest.approx(6.634896601)


def test_buckets_hold_their_numbers(spark):
    up, down = values.bucket_limits()
    pick = random.Random(4)
    xs = [*up, *down, *(10 ** pick.uniform(-12, 17) for _ in range(2000)), *(-(10 ** pick.uniform(-9, 15)) for _ in range(200)), 0.0]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", values.bucket(F.col("x")).alias("c")).collect()
    limit = {i: v for i, v in enumerate(up)} | {-i: v for i, v in enumerate(down)}
    for x, c in rows:
        if abs(x) <= values.TINY:
            assert c == 0
            continue
        i = abs(c) - 100_000
        assert (c < 0) == (x < 0)
        size = min(abs(x), values.HUGE)
        assert size <= limit[i] and (i - 1 not in limit or size > limit[i - 1]), x


def test_quantiles_are_near(spark):
    pick = random.Random(8)
    xs = sorted(pick.randint(1, 5000) for _ in range(999))
    frame = spark.createDataFrame([("t", 0, "num", str(x)) for x in xs] + [("t", 0, "num", "x1")], "text string, position int, name string, value string")
    row = values.numeric_summary(frame).first()
    assert (row["count"], row["min"], row["max"]) == (999, xs[0], xs[-1]) and row["mean"] == pytest.approx(sum(xs) / 999)
    for q, name in ((0.5, "p50"), (0.9, "p90"), (0.99, "p99")):
        assert row[name] == pytest.approx(xs[int(q * 998)], rel=0.025)


def test_many_values_are_capped(spark):
    frame = spark.createDataFrame([(k, "t", 0, "num", str(k % 1500)) for k in range(3000)], "ord long, text string, position int, name string, value string")
    row = values.distribution(frame).first()
    assert (row["distinct"], row["capped"], row["other"], len(row["top"])) == (1000, True, 1000, 10)
    assert row["top"][0]["count"] == 2


def test_all_values_count_without_a_limit(spark):
    rows = [(k, "t", 0, "num", str(k % 1500)) for k in range(3000)] + [(3000 + k, "t", 0, "num", "1499") for k in range(3)]
    row = values.distribution(spark.createDataFrame(rows, "ord long, text string, position int, name string, value string"), limit=None).first()
    assert (row["distinct"], row["capped"], row["other"], len(row["top"])) == (1500, False, 0, 10)
    assert [tuple(x) for x in row["top"][:3]] == [("1499", 5), ("0", 2), ("1", 2)]


@pytest.mark.parametrize("least", [0.6, 0.8])
def test_word_sets_of_all_sizes_meet(spark, least):
    """Small sets meet by words, larger ones by pairs of words: the same pairs as all against all."""
    from sievelog.operators import matchers, wordsets

    pick, sides = random.Random(4), ([], [])
    for n in [*range(1, 60), *range(60, 150, 5)]:
        base = [f"w{pick.randrange(60 if n < 20 else 900)}" for _ in range(n)]
        for side in sides:
            for change in (0.0, 0.1, 0.2, 0.3):
                own = [f"x{pick.randrange(500)}" if pick.random() < change else w for w in base]
                pick.shuffle(own)
                side.append(pick.choice([" ", "\xa0", "  "]).join(own))
    before, after = (spark.createDataFrame(list(enumerate(side)), "i int, text string") for side in sides)
    want, sets = {}, [[set(t.split()) for t in side] for side in sides]
    for b, x in enumerate(sets[0]):
        for a, y in enumerate(sets[1]):
            if x & y and len(x & y) / len(x | y) >= least:
                want[b, a] = len(x & y) / len(x | y)
    got = {(r.b, r.a): r.score for r in matchers.jaccard_scores(before, after, least).collect()}
    assert got == want and len(want) > 200
    # so few candidates that not all pairs with a rare word in common travel
    assert wordsets.jaccard_candidates(before, after, least).count() < 3 * len(want)


@pytest.mark.parametrize("signed", [True, False])
def test_overlap_candidates_lose_nothing_and_are_few(spark, monkeypatch, signed):
    """Small sets among large ones of common words: a rare word alone makes many times more pairs than overlap."""
    if not signed:
        monkeypatch.setattr(wordsets, "SIGNED", 0)
    monkeypatch.setattr(wordsets, "PAIRS_AT_ONCE", 500)
    rng = random.Random(11)
    pool = [f"w{k}" for k in range(150)]
    make = lambda n: list(dict.fromkeys(" ".join(rng.sample(pool, rng.choice((1, 2, 3, 4, 5, 6, 9, 30, 60)))) for _ in range(n)))
    left, right = make(300), make(300)
    left += [" ".join(t.split()[:5]) + " x" for t in right[:40]]
    right += [t.replace(" ", "\t", 1) + " y" for t in left[40:80]]
    sides = [spark.createDataFrame(list(enumerate(x)), "i int, text string") for x in (left, right)]
    sets = [[set(t.split()) for t in x] for x in (left, right)]
    want = {(b, a) for b, x in enumerate(sets[0]) for a, y in enumerate(sets[1]) if min(len(x), len(y)) >= 3 and len(x & y) / min(len(x), len(y)) >= 0.8}
    assert {(r.b, r.a) for r in matchers.overlap_scores(*sides).collect()} == want and len(want) > 80
    found = {(r.b, r.a) for r in wordsets.overlap_candidates(*sides, 0.8, 3).collect()}
    assert want <= found and (not signed or len(found) < 8 * len(want)), (len(found), len(want))


def test_overlap_of_many_blocks_without_moving_texts(spark, monkeypatch):
    """Blocks of both sides meet each other: every pair once, texts in no shuffle, and few candidates to large sets."""
    monkeypatch.setattr(wordsets, "BLOCK", 20_000, raising=False)
    monkeypatch.setattr(wordsets, "PAIRS_AT_ONCE", 500)
    rng = random.Random(5)
    pool = [f"w{k}" for k in range(3000)]
    make = lambda n: list(dict.fromkeys(" ".join(rng.sample(pool[: rng.choice((60, 3000))], rng.choice((1, 2, 3, 5, 8, 30)))) for _ in range(n)))
    left, right = make(300), [*make(250), "", "a b"]
    large = [rng.sample(pool, 250) for _ in range(60)]
    left += [" ".join(rng.sample(x, 20)) + " \u00e4" for x in large[:40]] + [" ".join(x) for x in large[40:]]
    right += [" ".join(x) for x in large[:40]] + ["\u2003".join(rng.sample(x, 30)) for x in large[40:]] + ["a b"]
    before, after = (spark.createDataFrame(list(enumerate(x)), "i int, text string").repartition(3) for x in (left, right))
    sets = [[set(t.split()) for t in x] for x in (left, right)]
    score = lambda x, y: len(x & y) / min(len(x), len(y))
    want = sorted((b, a, score(x, y), left[b], right[a]) for b, x in enumerate(sets[0]) for a, y in enumerate(sets[1]) if min(len(x), len(y)) >= 3 and score(x, y) >= 0.8)
    found = matchers.overlap_texts(before, after)
    assert sorted(map(tuple, found.select("b", "a", "score", "before_text", "after_text").collect())) == want and len(want) > 60
    assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    assert wordsets.overlap_candidates(before, after, 0.8, 3).count() < 3 * len(want)
