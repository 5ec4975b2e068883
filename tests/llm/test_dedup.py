import numpy as np
import pytest
from brute import components, documents, frame, repeated_lines, repeated_windows, sha, words

from sievelog.llm import near_dedup as nd
from sievelog.llm.exact_dedup import exact_dedup
from sievelog.llm.line_dedup import dedup_lines
from sievelog.llm.near_dedup import clusters, connected, near_dedup, shingle_sets, sketches
from sievelog.llm.substring_dedup import dedup_substrings
from sievelog.llm.textscan import Words, ngrams

ROWS = documents()


def normal(text):
    return (text or "").translate({c: None for c in (32, 9, 10, 11, 12, 13)})


@pytest.mark.parametrize("digest", [True, False])
def test_exact_dedup(spark, digest):
    groups = {}
    for r in ROWS:
        groups.setdefault(normal(r[1]), []).append(r)
    want = {}
    for text, rows in groups.items():
        keep = min(rows, key=lambda r: (-len(r[1] or ""), r[0]))[0]
        want |= {r[0]: (keep, len(rows), r[0] == keep, sha(text)) for r in rows}
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256 if digest else sha(normal(dict((x[0], x[1]) for x in ROWS)[r.doc_id]))) for r in exact_dedup(frame(spark, ROWS), digest=digest).collect()}
    assert got == want


def test_exact_dedup_of_repeated_rows_null_ids_and_nothing(spark):
    rows = [(1, "a", None, None, None)] * 3 + [(None, "b", None, None, None), (2, "b ", None, None, None)]
    for digest in (True, False):
        got = sorted((str(r.doc_id), r.keep_id, r.group_size, r.kept) for r in exact_dedup(frame(spark, rows), digest=digest).collect())
        assert got == [("1", 1, 3, False), ("1", 1, 3, False), ("1", 1, 3, True), ("2", 2, 2, True), ("None", 2, 2, False)]
    other = [(1, "a", None, None, None), (0, "a", None, None, None), (1, "alone", None, None, None), (None, "z", None, None, None), (None, "z", None, None, None)]
    got = sorted((str(r.doc_id), str(r.keep_id), r.kept) for r in exact_dedup(frame(spark, other)).collect())
    assert got == [("0", "0", True), ("1", "0", False), ("1", "1", True), ("None", "None", False), ("None", "None", True)]
    assert exact_dedup(frame(spark, []), digest=True).count() == exact_dedup(frame(spark, [])).count() == 0


@pytest.mark.parametrize(("gram", "window", "passage"), [(1, 2, 8), (2, 3, None), (1, 1, None), (3, 2, 4), (1, 4, 1)])
def test_line_dedup(spark, gram, window, passage):
    gone = repeated_lines(ROWS, gram + window - 1, passage)
    want = {}
    for at, (doc, text, *_) in enumerate(ROWS):
        lines = [] if text is None else text.split("\n")
        left = [x for i, x in enumerate(lines) if i not in gone.get(at, ())]
        want[doc] = (len(lines), len(gone.get(at, ())), None if text is None else "\n".join(left))
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in dedup_lines(frame(spark, ROWS), gram=gram, window=window, passage=passage).collect()}
    assert got == want and any(gone.values())


def test_line_dedup_of_repeated_rows_and_nothing(spark):
    rows = [(1, "a\nb\nc\nd\ne", None, None, None)] * 2 + [(2, "a\nb\nc\nd\nz", None, None, None), (None, "q", None, None, None)]
    got = sorted((str(r.doc_id), r.n_removed, r.text) for r in dedup_lines(frame(spark, rows)).collect())
    assert got == [("1", 0, "a\nb\nc\nd\ne"), ("1", 5, ""), ("2", 4, "z"), ("None", 0, "q")]
    # rows of one id have lines of their own
    rows = [(1, "a\nb\nc\nd\nUNIQUE", None, None, None), (1, "q\na\nb\nc\nd", None, None, None)]
    got = sorted((r.n_removed, r.text) for r in dedup_lines(frame(spark, rows).coalesce(1)).collect())
    assert sum(n for n, _ in got) == 4 and sorted("\n".join(t for _, t in got).split("\n")) == ["UNIQUE", "a", "b", "c", "d", "q"]
    # blank runs stay, null ids come last
    rows = [(None, "x y\n\n\nz", None, None, None), (3, "\n\n\nx y\n", None, None, None), (4, "x y\n\n", None, None, None), (None, "x y\n\n\nz", None, None, None)]
    got = sorted((str(r.doc_id), r.n_removed, r.text) for r in dedup_lines(frame(spark, rows)).collect())
    assert got == [("3", 0, "\n\n\nx y\n"), ("4", 2, ""), ("None", 2, "\nz"), ("None", 4, "")]
    assert dedup_lines(frame(spark, [])).count() == 0


@pytest.mark.parametrize(("window", "block"), [(20, 10), (7, 4), (9, 3)])
def test_substring_dedup(spark, window, block):
    gone = repeated_windows(ROWS, words, window)
    got = {r.doc_id: r for r in dedup_substrings(frame(spark, ROWS), window=window, block=block).collect()}
    assert any(gone.values()) and len(got) == len(ROWS)
    for doc, text, *_ in ROWS:
        w, own = words(text), gone.get(doc, set())
        r = got[doc]
        assert (r.n_words, r.n_removed) == (len(w), len(own))
        assert r.text == " ".join(x for i, x in enumerate(w) if i not in own)
        assert {i for s in r.removed for i in range(s.start, s.end)} == own


def test_substring_dedup_of_repeated_rows_and_nothing(spark):
    text = " ".join(f"w{i}" for i in range(25))
    rows = [(1, text, None, None, None)] * 2 + [(None, text, None, None, None), (3, text + " end", None, None, None)]
    got = sorted((str(r.doc_id), r.n_removed) for r in dedup_substrings(frame(spark, rows)).collect())
    assert got == [("1", 0), ("1", 25), ("3", 25), ("None", 25)]
    # rows of one id have words of their own
    own = " ".join(f"w{i}" for i in range(20))
    rows = [(1, own + " UNIQUE", None, None, None), (1, "zz " + own, None, None, None)]
    got = sorted((r.n_removed, r.text) for r in dedup_substrings(frame(spark, rows)).collect())
    assert sum(n for n, _ in got) == 20 and sorted(" ".join(t for _, t in got).split()) == sorted(["UNIQUE", "zz", *own.split()])
    assert dedup_substrings(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        dedup_substrings(frame(spark, []), window=18)


def test_substring_dedup_at_every_shift(spark):
    """One passage at all offsets from the reference blocks, in pairs that meet nowhere else."""
    rows = []
    for shift in range(12):
        for other in range(12):
            body = [f"p{shift}x{other}w{i}" for i in range(21)]
            n = 2 * len(rows)
            rows += [(n, " ".join([*[f"a{n}b{i}" for i in range(shift)], *body, "end"]), None, None, None), (n + 1, " ".join([*[f"c{n}d{i}" for i in range(other)], *body]), None, None, None)]
    got = {r.doc_id: r.n_removed for r in dedup_substrings(frame(spark, rows)).collect()}
    assert got == {r[0]: 21 * (r[0] % 2) for r in rows}


@pytest.mark.parametrize(("n", "above"), [(3, 85), (5, 80), (1, 60)])
def test_near_dedup(spark, n, above):
    want = components(ROWS, n, above)
    bands = {"bands": 60, "rows": 3} if above < 80 else {}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup(frame(spark, ROWS), words=n, similarity=(above, 100), **bands).collect()}
    assert got == want


def test_near_dedup_in_blocks(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(60) if j != i % 30), None, None, None) for i in range(60)]
    want = components(rows, 1, 90)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup(frame(spark, rows), words=1, similarity=(90, 100), block=8).collect()}
    assert got == want
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup(frame(spark, rows), words=1, similarity=(90, 100), small_block=7, copies=5).collect()}
    assert got == want


def test_near_dedup_of_repeated_rows_and_nothing(spark):
    rows = [(4, "a b c d", None, None, None)] * 2 + [(None, "a b c d", None, None, None), (7, "A b c d", None, None, None), (8, None, None, None, None), (9, "", None, None, None)]
    got = sorted((str(r.doc_id), r.component_id, r.kept, r.n_shingles) for r in near_dedup(frame(spark, rows), words=3).collect())
    assert got == [("4", 4, False, 2), ("4", 4, True, 2), ("7", 4, False, 2), ("8", 8, True, 0), ("9", 9, True, 0), ("None", 4, False, 2)]
    near = " ".join(f"w{i}" for i in range(80))
    rows = [(None, near + " x", None, None, None), (5, near, None, None, None), (5, near + " y z", None, None, None), (None, "other words here", None, None, None), (None, "other words here", None, None, None)]
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in near_dedup(frame(spark, rows), words=3).collect())
    assert got == [("5", "5", False), ("5", "5", True), ("None", "5", False), ("None", "None", False), ("None", "None", True)]
    assert near_dedup(frame(spark, []), words=3).count() == 0


def test_clusters_find_chains():
    sets = [np.arange(i, i + 20, dtype=np.uint64) for i in range(30)] + [np.arange(500, 520, dtype=np.uint64)]
    assert clusters(sets, 90, 100) == [0] * 30 + [30]
    assert clusters(sets, 100, 100) == list(range(31))


@pytest.mark.parametrize("fits", [0, 20, 400_000])
def test_connected(spark, fits):
    links = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 101), (103, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in connected(links, fits).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100, 103: 100}
    assert connected(links.limit(0), fits).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_union_of_random_links(seed):
    import pyarrow as pa

    rng = np.random.default_rng(seed)
    links = rng.integers(0, 300, (170, 2)) * 7 - 500
    parent = {int(x): int(x) for x in links.ravel()}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links.tolist():
        p, q = sorted((root(a), root(b)))
        parent[q] = p
    batch = pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], names=["u", "v"])
    got = next(nd._union(iter([batch])))
    assert dict(zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True)) == {x: root(x) for x in parent if root(x) != x}


def test_sketches_fill_and_agree_with_similarity():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 62, 400, dtype=np.uint64)
    other = np.concatenate([base[:360], rng.integers(0, 1 << 62, 40, dtype=np.uint64)])
    small = base[:1]
    sets = [np.unique(base), np.unique(other), small, small[:0]]
    begins = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    found = sketches(np.concatenate(sets), begins, 512)
    assert (found[:3] != nd.EMPTY).all() and (found[3] == nd.EMPTY).all()
    assert abs((found[0] == found[1]).mean() - 360 / 440) < 0.06


def test_words_and_hashes():
    texts = ["a bb c", "", " x\x1cy ", "a bb"]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    w = Words(np.frombuffer(b"".join(raw), dtype=np.uint8), offsets)
    assert np.diff(w.first).tolist() == [len(words(t)) for t in texts]
    h = w.hashes()
    assert h[0] == h[3] and len(set(h.tolist())) == 4
    assert ngrams(h, 2)[0] != ngrams(h, 2)[1] and len(ngrams(h, 9)) == 0
    grams, begins = shingle_sets(np.frombuffer(b"A a A a", dtype=np.uint8), np.array([0, 7]), 2)
    assert len(grams) == 1 and begins.tolist() == [0, 1]


def test_very_long_texts_and_words(spark):
    """Texts of a megabyte, near copies of them, and single words of two megabytes."""
    rng = np.random.default_rng(4)
    body = [f"w{x}" for x in rng.integers(0, 10**9, 90_000)]
    other = [*body[:45_000], "changed", *body[45_001:]]
    rows = [(0, " ".join(body), None, None, None), (1, " ".join(other), None, None, None), (2, " ".join(body), None, None, None), (3, "x" * 2_000_000, None, None, None), (4, "x" * 2_000_000, None, None, None), (5, "short", None, None, None)]
    docs = frame(spark, rows)
    assert {r.doc_id: r.keep_id for r in exact_dedup(docs).collect()} == {0: 0, 1: 1, 2: 0, 3: 3, 4: 3, 5: 5}
    found = {r.doc_id: (r.n_words, r.n_removed) for r in dedup_substrings(docs).collect()}
    assert found == {0: (90_000, 0), 1: (90_000, 89_999), 2: (90_000, 90_000), 3: (1, 0), 4: (1, 0), 5: (1, 0)}
    assert {r.doc_id: r.component_id for r in near_dedup(docs).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5}
    assert {r.doc_id: r.n_removed for r in dedup_lines(docs).collect()} == {0: 0, 1: 0, 2: 1, 3: 0, 4: 0, 5: 0}


@pytest.mark.parametrize("edits", [1, 3, 6])
def test_near_dedup_recall_of_edited_copies(spark, edits):
    """All links of the brute force are found for copies just above and below the threshold."""
    rng = np.random.default_rng(edits)
    rows = []
    for k in range(60):
        words_ = [f"v{x}" for x in rng.integers(0, 5000, 90)]
        rows.append((2 * k, " ".join(words_), None, None, None))
        for i in rng.integers(0, 90, edits):
            words_[i] = f"e{rng.integers(0, 10**6)}"
        rows.append((2 * k + 1, " ".join(words_), None, None, None))
    want = components(rows, 3, 85)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup(frame(spark, rows), words=3).collect()}
    linked = [d for d, (_, root) in want.items() if d != root]
    assert sum(got[d] == want[d] for d in linked) >= 0.99 * len(linked) and all(got[d][1] in (d, want[d][1]) for d in got)
    assert linked or edits > 3
