import struct
import zlib

import numpy as np
import pytest
from brute import documents, frame
from pyspark.sql import functions as F

from sievelog.llm import decontaminate as leaks
from sievelog.llm import language_id as lid
from sievelog.llm import packing, quality, sharding, textscan, warc
from sievelog.llm.queries import tokenizer_path
from sievelog.llm.textscan import trimmed

ROWS = documents(2)


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    odd = ["don't STOP<|endoftext|>now", "<|ENDOFTEXT|> a,b.", "Ünïcödé ÀÉ× ÷ é ﬁ Σσς", "x,. y.. 1,2 &&& q%%%", " a b\x1cc", "İstanbul ǅ"]
    rows = ROWS + [(900 + i, t, None, None, None) for i, t in enumerate(odd)]
    pieces = packing.pack(frame(spark, rows), tokenizer_path(), capacity=512, with_ids=True).toPandas()
    for doc, text, *_ in rows:
        want = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        own = pieces[pieces.doc_id == doc].sort_values("start")
        got = np.frombuffer(b"".join(own.ids), dtype="<u4").tolist()
        assert got == want, text
        assert (own.doc_tokens == len(want)).all() and own.start.tolist() == [0, *np.cumsum(own.length)[:-1]]
        assert own.ids_crc32.tolist() == [zlib.crc32(x) for x in own.ids]
    for _, own in pieces.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == [0, *np.cumsum(own.length)[:-1]] and own.length.sum() <= 512
    assert pieces.length.sum() / (pieces.sequence_id.nunique() * 512) > 0.9
    whole = packing.sequences(spark.createDataFrame(pieces), capacity=512).toPandas()
    assert all(len(x) == (4 * n if n & (n - 1) == 0 else 2048) for x, n in zip(whole.ids, whole.tokens, strict=True))
    assert packing.pack(frame(spark, []), tokenizer_path()).count() == 0


def test_packing_worker_stays_small():
    """What a worker holds of 4 MB of words that never repeat: known words and one stretch of text."""
    import tracemalloc

    import pyarrow as pa

    letters = np.random.default_rng(5).integers(97, 123, (1000, 500, 8), dtype=np.uint8)
    texts = [" ".join(bytes(w).decode() for w in t) for t in letters]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(texts)], names=["doc_id", "text"])
    cut = trimmed(packing._cutter(tokenizer_path(), 2, 4096, False))
    tracemalloc.start()
    rows = sum(b.num_rows for b in cut(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 1000 and peak < 90e6, peak


def test_powers_go_with_the_task():
    assert list(trimmed(lambda batches: iter([len(textscan.powers(3, 10)[0])]))(iter([]))) == [10] and not textscan._powers


@pytest.mark.parametrize("seed", range(3))
def test_word_encoder_equals_the_tokenizer(seed, monkeypatch):
    import random

    import pyarrow as pa
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "CACHED_BYTES", [0, 2000, 64 << 20][seed])  # no word, few words and all words are kept
    pick, tokenizer = random.Random(seed), Tokenizer.from_file(tokenizer_path())
    letters = ["abcdefgh", "ABCXYZ", "àÉßÿ×÷", "0123456789", "!.,'\"<|>-_&", "日本語", " \t\n\x0b\x0c\r", "\x1c\u2003ﬁΣς", "e\u0301\x00"]
    text = lambda: "".join(pick.choice(pick.choice(letters[: pick.choice([1, 3, 5, 9])] + letters[6:7])) for _ in range(pick.randint(0, 60)))
    texts = [text() for _ in range(1500)] + ["<|startoftext|> A<|endoftext|>b", "", " "]
    encoder = packing.WordEncoder(tokenizer_path())
    for part in (texts[:700], texts[700:], texts[:50]):
        ids, first = encoder.encode(pa.array(part, pa.large_string()), 2)
        for t, a, b in zip(part, first[:-1], first[1:], strict=True):
            assert ids[a:b].tolist() == [*tokenizer.encode(t, add_special_tokens=False).ids, 2], t
        assert encoder.size <= packing.CACHED_BYTES + 1_000_000


def test_one_long_word_and_text_without_spaces(spark):
    import pyarrow as pa
    from tokenizers import Tokenizer

    tokenizer, encoder = Tokenizer.from_file(tokenizer_path()), packing.WordEncoder(tokenizer_path())
    texts = ["abcde" * 1_000_000, "".join(chr(0x4E00 + (i * i) % 5000) for i in range(200_000)), "x,y;" * 100_000]
    for t in texts:
        ids, first = encoder.encode(pa.array([t], pa.large_string()), 2)
        assert ids[:-1].tolist() == tokenizer.encode(t, add_special_tokens=False).ids and first.tolist() == [0, len(ids)]
    assert encoder.size < 1000  # none of them is kept
    got = packing.pack(frame(spark, [(i, t[:300_000], None, None, None) for i, t in enumerate(texts)]), tokenizer_path()).toPandas()
    assert set(got.doc_id) == {0, 1, 2} and got.length.max() <= 4096


def test_repeated_rows_are_packed_each(spark):
    rows = [(1, "a b", None, None, None)] * 3 + [(None, None, None, None, None)]
    got = packing.pack(frame(spark, rows), tokenizer_path()).collect()
    assert sorted(r.length for r in got) == [1, 3, 3, 3] and len({(r.sequence_id, r.offset) for r in got}) == 4


@pytest.mark.parametrize("seed", range(6))
def test_fill_is_the_best_subset_sum(seed):
    rng = np.random.default_rng(seed)
    counts = {int(x): int(n) for x, n in zip(rng.integers(1, 60, 6), rng.integers(1, 4, 6), strict=True)}
    sums = {0}
    for x, n in counts.items():
        sums = {s + k * x for s in sums for k in range(n + 1)}
    for room in (1, 17, 50, 100):
        found = packing.fill(counts, room)
        assert sum(x * n for x, n in found) == max(s for s in sums if s <= room)
        assert all(0 < n <= counts[x] for x, n in found)


def test_plan_uses_every_length_once():
    counts = {7: 5, 11: 3, 20: 1, 64: 2}
    used = {}
    for windows, pattern in packing.plan_windows(counts, 64):
        assert sum(x * n for x, n in pattern) <= 64
        for x, n in pattern:
            used[x] = used.get(x, 0) + n * windows
    assert used == counts


def test_struct_ids_are_little_endian():
    assert struct.pack("<I", 2) == b"\x02\0\0\0"


def test_shards(spark):
    got = sharding.assign_shards(frame(spark, ROWS), shards=5).toPandas()
    by_text = {}
    for doc, text, *_ in ROWS:
        row = got[got.doc_id == doc].iloc[0]
        assert row["size"] == len((text or "").encode()) + 8 and row.text_crc32 == zlib.crc32((text or "").encode())
        by_text.setdefault(text or "", set()).add(row.shard)
    assert all(len(s) == 1 for s in by_text.values())
    for _, own in got.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    # the loads are those of a plain heap over whole groups
    sizes = {}
    for _, text, *_ in ROWS:
        sizes[text or ""] = sizes.get(text or "", 0) + len((text or "").encode()) + 8
    loads = [0] * 5
    for size in sorted(sizes.values(), reverse=True):
        loads[loads.index(min(loads))] += size
    assert got.groupby("shard")["size"].sum().tolist() == loads
    assert sharding.assign_shards(frame(spark, [])).count() == 0
    same = sharding.assign_shards(frame(spark, [(1, "x", None, None, None)] * 4 + [(None, None, None, None, None)])).toPandas()
    assert len(same) == 5 and sorted(same[same.text_crc32 == zlib.crc32(b"x")].slot) == [0, 1, 2, 3]


@pytest.mark.parametrize("seed", range(30))
def test_turns_are_those_of_a_heap(seed):
    import random

    pick = random.Random(seed)
    loads = [pick.randint(0, 10 ** pick.randint(0, 4)) for _ in range(pick.randint(1, 7))]
    size, count = pick.randint(1, 50), pick.choice([0, 1, 5, 100, 1000])
    want, now = [0] * len(loads), list(loads)
    for _ in range(count):
        shard = now.index(min(now))
        want[shard] += 1
        now[shard] += size
    assert sharding.turns(loads, size, count) == want


def test_longest_first():
    assert sharding.longest_first([(3, 3), (5, 1), (4, 1)], 2) == [(5, [1, 0]), (4, [0, 1]), (3, [1, 2])]


def test_registered_sharding_against_a_heap(spark, sf):
    from sievelog.llm.queries import op4_sharding

    got = op4_sharding(spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    sizes = docs.text.fillna("").map(lambda t: len(t.encode()) + 8)
    loads = [0] * 24
    for size in sorted(sizes.groupby(docs.text.fillna("")).sum(), reverse=True):
        loads[loads.index(min(loads))] += size
    assert got.groupby("shard")["size"].sum().reindex(range(24), fill_value=0).tolist() == loads
    assert got.merge(docs, on="doc_id").groupby("text").shard.nunique().max() == 1 and set(got.doc_id) == set(docs.doc_id)
    assert all(sorted(own.slot) == list(range(len(own))) for _, own in got.groupby("shard"))


def test_warc_round_trip(spark):
    rows = [(1, "http://a/x y\r\nz", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://c", ""), (4, "http://d", None), (5, "http://e", "WARC/1.1\r\n\r\n" * 50), (None, "http://n", "<p>é</p>"), (6, "u", "x" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("rep", F.lit(2)).repartition(3)
    folder, index = warc.write_warc(pages)
    found = {r.page_id: r for r in warc.read_warc(folder, index).collect()}
    assert {k: (r.record_type, r.refers_to) for k, r in found.items()} == {1: ("response", None), 2: ("revisit", 1), 3: ("response", None), 4: ("revisit", 3), 5: ("response", None), None: ("revisit", 1), 6: ("response", None)}
    assert bytes(found[5].payload) == ("WARC/1.1\r\n\r\n" * 50).encode() and found[2].payload_bytes == len("<p>é</p>".encode())
    assert found[1].url == "http://a/x%20y%0D%0Az"
    one = warc.read_warc(folder, index.where("page_id = 5"))
    assert [r.page_id for r in one.collect()] == [5]
    _, all_first = warc.write_warc(pages, least=10_000)
    assert all_first.where("record_type = 'revisit'").count() == 0
    twice = spark.createDataFrame([(1, "u", "x"), (1, "v", "x"), (None, "w", "y"), (None, "w", "y"), (1, "z", "q")], "page_id long, url string, html string")
    folder, index = warc.write_warc(twice)
    found = warc.read_warc(folder, index, task_bytes=100)
    assert found.rdd.getNumPartitions() > 3
    assert sorted((str(r.page_id), r.record_type, r.refers_to) for r in found.collect()) == [("1", "response", None), ("1", "response", None), ("1", "revisit", 1), ("None", "response", None), ("None", "response", None)]
    folder, index = warc.write_warc(pages.limit(0))
    assert warc.read_warc(folder, index).count() == 0


def test_ranges_are_joined(tmp_path):
    import pyarrow.fs as pafs

    (tmp_path / "f").write_bytes(bytes(range(200)))
    got = list(warc.read_ranges(pafs.LocalFileSystem(), str(tmp_path), [("f", 0, 3), ("f", 5, 2), ("f", 190, 10)]))
    assert got == [bytes([0, 1, 2]), bytes([5, 6]), bytes(range(190, 200))]


def test_language_id(spark):
    en, de = "the cat sat on the mat with that hat ", "der hund und die katze sind nicht hier "
    rows = [(i, (en if i % 2 else de) * (1 + i % 4), "en" if i % 2 else "de", None, None) for i in range(60)]
    prototypes = lid.learn_prototypes(frame(spark, rows))
    ask = [(1, "that cat and the hat", None, None, None), (2, "die katze und der hund", None, None, None), (3, None, None, None, None), (4, " 12 !! ", None, None, None), (5, "x", None, None, None), (6, "", None, None, None), (7, en * 30_000, None, None, None)]
    got = {r.doc_id: (r.lang_pred, r.score) for r in lid.identify(frame(spark, ask).withColumn("lang_pred", F.lit(1)), prototypes).collect()}
    assert {k: v[0] for k, v in got.items() if k != 5} == {1: "en", 2: "de", 3: "und", 4: "und", 6: "und", 7: "en"}
    assert all(0 <= s <= 1 for _, s in got.values()) and got[3][1] == 0
    assert [r.doc_id for r in lid.identified(frame(spark, ask), prototypes).orderBy("doc_id").collect() if r.doc_id != 5] == [1, 2, 7]
    assert lid.learn_prototypes(frame(spark, [(1, "x", None, None, None)])) == {}
    assert {r.lang_pred for r in lid.identify(frame(spark, ask), {}).collect()} == {"und"}
    assert lid.identify(frame(spark, []), prototypes).count() == 0


def plain_bundle(text, dims, seed):
    """The method letter by letter, in whole numbers."""
    vector = {}
    symbols = []
    for c in f"\n{text.lower()}\n":
        point = ord(c) if c.isalpha() else 0
        if point or not symbols or symbols[-1]:
            symbols.append(point)
    for point in set(symbols):
        vector[point] = lid.letter_vectors(np.array([point]), dims, seed)[0].astype(int).tolist()
    total = [0] * dims
    for a, b, c in zip(symbols, symbols[1:], symbols[2:], strict=False):
        for i in range(dims):
            total[i] += vector[a][i - 2] * vector[b][i - 1] * vector[c][i]
    return total


@pytest.mark.parametrize("limit", [4, 1 << 15])
def test_bundles_equal_the_plain_method(limit, monkeypatch):
    monkeypatch.setattr(lid, "VECTORS", limit)
    texts = ["ab, a", "", "ΑΒΓ  абв 日本語 abc abc", "x", "12", "".join(map(chr, range(0x4E00, 0x4F00)))]
    found, has = lid.bundles(texts, 64, 3)
    assert found.astype(int).tolist() == [plain_bundle(t, 64, 3) if h else [0] * 64 for t, h in zip(texts, has, strict=True)]
    assert has.tolist() == [True, False, True, True, False, True]


def test_letters_of_every_script_have_vectors_of_their_own():
    points = np.array([0, *map(ord, "abcdefghijklmnopqrstuvwxyzабвгдежзийклмнопрстуфхцчшщъыьэюяαβγδεζηθικλμνξοπρστυφχψω日本語")])
    vectors = lid.letter_vectors(points, 1024, 7).astype(int)
    cosines = vectors @ vectors.T / 1024
    assert set(np.unique(vectors)) == {-1, 1} and np.abs(cosines - np.eye(len(points))).max() < 0.2


def test_registered_language_id_against_the_plain_method(spark, sf):
    """Scores and languages of some rows of the registered query, from prototypes made by the plain method."""
    from zlib import crc32

    docs = [r for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if len(r.text or "") < 1500]
    small = spark.createDataFrame(docs).select("doc_id", "text", "lang")
    learned = lid.learn_prototypes(small.where(~lid.held_out(F.col("doc_id"), 3, 1)), dims=64)
    sums = {}
    for r in docs:
        if crc32(str(r.doc_id).encode()) % 3 != 1 and r.lang is not None and any(map(str.isalpha, r.text)):
            v = np.array(plain_bundle(r.text, 64, 7), dtype=float)
            sums[r.lang] = sums.get(r.lang, 0) + v / np.linalg.norm(v)
    assert learned.keys() == sums.keys()
    want = {k: v / np.linalg.norm(v) for k, v in sums.items()}
    assert all(np.allclose(learned[k], want[k], atol=1e-5) for k in want)
    got = {r.doc_id: r for r in lid.identify(small, learned, dims=64).collect()}
    for r in docs[:60]:
        if any(map(str.isalpha, r.text)):
            v = np.array(plain_bundle(r.text, 64, 7), dtype=float)
            cosines = {k: float(v @ p / np.linalg.norm(v)) for k, p in want.items()}
            best = max(cosines, key=cosines.get)
            assert abs(got[r.doc_id].score - max(0, cosines[best])) < 1e-4 and cosines[got[r.doc_id].lang_pred] > cosines[best] - 1e-4


def test_a_rare_language_is_learned(spark):
    rows = [(i, "der hund und die katze", "de", None, None) for i in range(400)] + [(1000, "the cat sat on the mat", "en", None, None)]
    assert lid.learn_prototypes(frame(spark, rows), sample=10).keys() == {"de", "en"}


def test_quality(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    from sievelog.llm.queries import op2_quality

    got = op2_quality(spark, sf).toPandas().merge(labels.toPandas(), on="doc_id")
    assert len(op2_quality(spark, sf).toPandas()) == docs.count()
    assert (got.predicted == got.quality).mean() > 0.9 and got.score.between(0, 1).all()
    model = quality.learn(docs, labels)
    odd = quality.score(frame(spark, [(1, None, None, None, None), (2, "", None, None, None), (2, "x " * 200_000, None, None, None)]), model).toPandas()
    assert len(odd) == 3 and odd.score.between(0, 1).all()
    assert quality.score(docs.limit(0), model).count() == 0
    assert set(quality.score(docs, quality.learn(docs, labels.limit(0))).toPandas().score) == {0.5}


def test_additive_model_finds_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x, y)
    assert ((model.score(x) > 0.5) == y).mean() > 0.9 and {(0, 1)} <= {p[:2] for p in model.pairs}


def plain_fit(x, y, rounds, pairs, pair_rounds, grid, bins):
    """The boosting of the additive model with loops over rows and cuts."""
    import math

    n, width = len(y), len(x[0])
    edges = [sorted({float(q) for q in np.quantile([r[i] for r in x], [k / bins for k in range(1, bins)])}) for i in range(width)]
    at = [[sum(r[i] >= e for e in edges[i]) for i in range(width)] for r in x]
    share = sum(y) / n
    total, tables = [math.log(share / (1 - share))] * n, [[0.0] * (len(e) + 1) for e in edges]
    chance = lambda: [1 / (1 + math.exp(-t)) for t in total]
    sums = lambda cell, cells: ({c: sum(y[k] - p[k] for k in range(n) if cell(k) == c) for c in cells}, {c: sum(p[k] * (1 - p[k]) for k in range(n) if cell(k) == c) for c in cells})

    def tree(g, h, cells, depth):
        gains = []
        part = lambda own: sum(g[c] for c in own) ** 2 / (sum(h[c] for c in own) + 1)
        for k in range(1, len(cells)) if depth else ():
            gains.append((part(cells[:k]) + part(cells[k:]) - part(cells), -k))
        if not gains or max(gains)[0] <= 1e-6:
            return {c: sum(g[d] for d in cells) / (sum(h[d] for d in cells) + 1) for c in cells}
        k = -max(gains, key=lambda q: (round(q[0], 9), q[1]))[1]
        return tree(g, h, cells[:k], depth - 1) | tree(g, h, cells[k:], depth - 1)

    for _ in range(rounds):
        for i in range(width):
            p, cells = chance(), list(range(len(tables[i])))
            step = tree(*sums(lambda k, i=i: at[k][i], cells), cells, 2)
            for k in range(n):
                total[k] += 0.15 * step[at[k][i]]
            tables[i] = [t + 0.15 * step[c] for c, t in enumerate(tables[i])]
    return edges, tables, total


def test_fitted_tables_equal_the_plain_boosting():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 9, (80, 3)).astype(float)
    y = ((x[:, 0] + x[:, 1] * 0.7 + rng.normal(0, 1, 80)) > 7).astype(float)
    model = quality.fit(x, y, bins=6, rounds=5, pairs=0)
    edges, tables, total = plain_fit(x.tolist(), y.tolist(), 5, 0, 0, 0, 6)
    assert [e.tolist() for e in model.edges] == edges
    assert all(np.allclose(a, b, atol=1e-9) for a, b in zip(model.tables, tables, strict=True))
    assert np.allclose(model.score(x), 1 / (1 + np.exp(-np.array(total))))
    # a score is a sum of table entries
    model = quality.fit(x, y, bins=6)
    for row, score in zip(x[:20], model.score(x[:20]), strict=True):
        own = [int(sum(v >= e for e in edge)) for v, edge in zip(row, model.edges, strict=True)]
        logit = model.base + sum(t[b] for t, b in zip(model.tables, own, strict=True)) + sum(t[ci[own[i]], cj[own[j]]] for i, j, ci, cj, t in model.pairs)
        assert abs(score - 1 / (1 + np.exp(-logit))) < 1e-12


@pytest.mark.parametrize("seed", range(8))
def test_pair_trees_cut_where_all_cuts_are_tried(seed):
    rng = np.random.default_rng(seed)
    g, h = rng.normal(0, 1, (4, 5)), rng.random((4, 5))
    part = lambda a, b: g[a, b].sum() ** 2 / (h[a, b].sum() + 1)
    cuts = [(i, j) for i in range(4) for j in range(5)]
    gain = {(i, j): sum(part(a, b) for a in (slice(0, i), slice(i, None)) for b in (slice(0, j), slice(j, None))) for i, j in cuts}
    i, j = max(gain, key=gain.get)
    found = quality._quadrants(g, h)
    for a in (slice(0, i), slice(i, None)):
        for b in (slice(0, j), slice(j, None)):
            assert np.allclose(found[a, b], g[a, b].sum() / (h[a, b].sum() + 1))


def test_features_equal_plain_counts():
    texts = ["Ab, cd!! cd cd 12 é|x\nLongerThanFifteenLetters #", "", "a", "   "]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    found = quality.features(np.frombuffer(b"".join(raw), dtype=np.uint8), offsets)
    for row, text, data in zip(found, texts, raw, strict=True):
        words = text.split()
        got = dict(zip(quality.FEATURES, row, strict=True))
        share = lambda ok: sum(ok(chr(b)) for b in data) / max(1, len(data))  # noqa: E731,B023
        assert np.isclose(got["log_words"], np.log1p(len(words)))
        assert np.isclose(got["mean_word"], sum(len(w.encode()) for w in words) / max(1, len(words)))
        assert np.isclose(got["upper"], share(lambda c: "A" <= c <= "Z")) and np.isclose(got["digits"], share(lambda c: c in "0123456789"))
        assert np.isclose(got["high_bytes"], sum(b > 127 for b in data) / max(1, len(data))) and np.isclose(got["shouts"], share(lambda c: c == "!"))
        assert np.isclose(got["distinct_words"], len(set(words)) / max(1, len(words))) and np.isclose(got["same_as_last"], sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(1, len(words)))
        assert np.isclose(got["long_words"], sum(len(w.encode()) > 15 for w in words) / max(1, len(words)))


def test_contradictory_labels_and_repeated_ids(spark):
    text = lambda i: "good clean words here " * 5 if i % 2 else "## !! %% @@ " * 5
    docs = frame(spark, [(i, text(i), None, None, None) for i in range(40)] + [(1, "good clean again", None, None, None)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    model = quality.learn(docs, labels)
    both = labels.unionByName(spark.createDataFrame([(1000, 0), (1000, 1), (2000, None), (None, 1), (3000, 7)], labels.schema))
    again = quality.learn(docs, both)
    assert again.base == model.base and all((a == b).all() for a, b in zip(model.tables, again.tables, strict=True))
    flipped = labels.unionByName(labels.select("doc_id", (1 - F.col("quality")).alias("quality")))
    assert quality.learn(docs, flipped).edges == []


def plain_alignment(a, b):
    best, rows = 0, [[0] * (len(b) + 1)]
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(max(0, rows[-1][j] + (2 if x == y else -1), rows[-1][j + 1] - 1, row[j] - 1))
        best = max(best, *row)
        rows.append(row)
    return best


@pytest.mark.parametrize("seed", range(20))
def test_alignment_equals_the_plain_table(seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 5, rng.integers(1, 25)).astype(np.uint64), rng.integers(0, 5, rng.integers(1, 40)).astype(np.uint64)
    score, begin, end = leaks.align(a, b)
    assert score == plain_alignment(a, b)
    if score:
        assert leaks.align(a, b[begin:end])[0] == score


def test_decontamination(spark):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 6))
    item = [word() for _ in range(40)]
    edited = [w if i % 5 else "edited" for i, w in enumerate(item)]
    dropped = [w for i, w in enumerate(item) if i % 6]
    filler = lambda: " ".join(word() for _ in range(60))
    rows = [(1, f"{filler()} {' '.join(item)} {filler()}", None, None, None), (2, f"{filler()} {' '.join(edited).upper()}", None, None, None), (3, " ".join(dropped), None, None, None)]
    rows += [(4, filler(), None, None, None), (5, None, None, None, None), (6, "", None, None, None), (7, " ".join(item[:6]) + " " + filler(), None, None, None), (1, "x", None, None, None)]
    bench = spark.createDataFrame([(10, " ".join(item)), (11, None), (12, ""), (13, filler())], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in leaks.find_leaks(frame(spark, rows), bench).collect()}
    assert got.keys() == {(1, 10), (2, 10), (3, 10)}
    assert (got[1, 10].word_from, got[1, 10].word_to, got[1, 10].score) == (60, 100, 1.0)
    many = {(r.doc_id, r.item_id) for r in leaks.find_leaks(frame(spark, rows), bench, block_bytes=200).collect()}
    assert many == got.keys()
    assert sorted((r.doc_id, r.text == "x") for r in leaks.decontaminate(frame(spark, rows), bench).collect()) == [(1, True), (4, False), (5, False), (6, False), (7, False)]
    assert leaks.find_leaks(frame(spark, rows), bench.limit(0)).count() == leaks.find_leaks(frame(spark, []), bench).count() == 0


def test_leaks_of_repeated_and_null_ids(spark):
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 6))
    item = " ".join(word() for _ in range(30))
    clean = " ".join(word() for _ in range(30))
    rows = [(1, item, None, None, None), (1, clean, None, None, None), (None, item, None, None, None), (None, clean, None, None, None), (2, clean + " " + item, None, None, None), (2, None, None, None, None)]
    bench = spark.createDataFrame([(5, item)], "item_id long, text string")
    got = leaks.decontaminate(frame(spark, rows), bench)
    assert sorted(map(str, got.select("doc_id", "text").collect())) == sorted([f"Row(doc_id=1, text={clean!r})", f"Row(doc_id=None, text={clean!r})", "Row(doc_id=2, text=None)"])


def brute_leaks(docs, items, least=0.5, excerpt=13):
    """Every document against every item, whole texts, no seeds."""
    word = {}
    number = lambda t: np.array([word.setdefault(w, len(word)) for w in (t or "").lower().split()], dtype=np.uint64)
    found = set()
    for item_id, text in items:
        item = number(text)
        for doc_id, doc in docs:
            if not len(item) or not doc:
                continue
            score = leaks.align(item, number(doc))[0]
            if score >= least * 2 * len(item) or (score >= 2 * excerpt and leaks.align(item, number(doc), leaks.STRICT)[0] >= 2 * excerpt):
                found.add((doc_id, item_id))
    return found


def test_registered_decontamination_against_brute_force(spark, sf):
    from sievelog.llm.queries import op7_decontaminate

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id) for r in op7_decontaminate(spark, sf).collect()}
    assert got == brute_leaks(docs, items) and got


@pytest.mark.parametrize("edit", ["substitute", "delete", "insert"])
@pytest.mark.parametrize("rate", [0.1, 0.2, 0.3])
def test_recall_of_edited_copies(spark, edit, rate):
    """Seeds find at least nine of ten pairs that alignment of everything with everything finds."""
    import random

    pick = random.Random(int(rate * 100) + len(edit))
    common = [f"c{i}" for i in range(60)]
    rare = lambda: f"r{pick.randint(0, 4000)}"
    text = lambda n: [pick.choice(common) if pick.random() < 0.5 else rare() for _ in range(n)]
    items = [(k, text(pick.randint(25, 60))) for k in range(40)]
    docs = []
    for k, item in items:
        copy = []
        for w in item:
            if pick.random() < rate:
                copy += {"substitute": [rare()], "delete": [], "insert": [w, rare()]}[edit]
            else:
                copy.append(w)
        docs.append((k, " ".join(text(30) + copy + text(30))))
    docs += [(1000 + k, " ".join(text(120))) for k in range(150)]
    plain = [(k, " ".join(t)) for k, t in items]
    want = brute_leaks(docs, plain)
    bench = spark.createDataFrame(plain, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leaks.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got <= want and len(want) >= 25 and len(got) >= 0.9 * len(want), (len(got), len(want))


def test_excerpts_of_long_items_are_leaks(spark):
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 6))
    item = [word() for _ in range(200)]
    filler = lambda n=40: " ".join(word() for _ in range(n))
    edited = [w if i % 9 else "edited" for i, w in enumerate(item[20:90])]
    sparse = [w if i % 3 else "edited" for i, w in enumerate(item[20:90])]  # two words of three: no excerpt
    texts = [
        f"{filler()} {' '.join(item[50:140])} {filler()}", f"{filler()} {' '.join(item[:80])}", f"{' '.join(item[150:])} {filler()}", f"{filler()} {' '.join(item[70:83])} {filler()}",
        f"{filler()} {' '.join(edited)} {filler()}", f"{' '.join(item[:30])} {filler(30)} {' '.join(item[60:75])}", f"{filler()} {' '.join(item[70:82])} {filler()}", f"{filler()} {' '.join(sparse)} {filler()}", filler(300),
    ]
    docs = frame(spark, [(i, t, None, None, None) for i, t in enumerate(texts)])
    bench = spark.createDataFrame([(10, " ".join(item))], "item_id long, text string")
    got = {r.doc_id: r for r in leaks.find_leaks(docs, bench).collect()}
    assert got.keys() == {0, 1, 2, 3, 4, 5}
    assert (got[0].word_from, got[0].word_to, got[0].score) == (40, 130, 0.45)
    assert {r.doc_id for r in leaks.decontaminate(docs, bench).collect()} == {6, 7, 8}


@pytest.mark.parametrize("seed", range(5))
def test_strict_alignment_equals_the_plain_table(seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 3, 20).astype(np.uint64), rng.integers(0, 3, 30).astype(np.uint64)
    rows, best = [[0] * 31], 0
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(max(0, rows[-1][j] + (2 if x == y else -4), rows[-1][j + 1] - 4, row[j] - 4))
        best = max(best, *row)
        rows.append(row)
    assert leaks.align(a, b, leaks.STRICT)[0] == best


def test_texts_stay_when_no_language_was_learned(spark):
    rows = [(1, "that cat", None, None, None), (2, None, None, None, None), (3, " 12 !", None, None, None)]
    assert [r.doc_id for r in lid.identified(frame(spark, rows), {}).collect()] == [1]
