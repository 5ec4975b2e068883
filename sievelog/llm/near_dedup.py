"""MinHash near-dedup by fast similarity sketching, banding and exact verification.

Sketch of a shingle set, with t coordinates: in rounds 0 to t - 1 every shingle
is hashed to a coordinate and a value, and the round number is added to the
value; in rounds t to 2t - 1 every shingle goes to coordinate round - t, so
every coordinate is filled at the latest then; a coordinate keeps its minimum,
and sketching stops after the first round that leaves none empty.  Bands of
``rows`` coordinates are grouped; a pair of similarity 0.85 shares none of the
24 bands with chance 1e-5.

Texts with equal shingle sets (one 128-bit BLAKE2 digest of all their shingles)
are one class from the start.  Each band's bucket proposes a star to its
smallest class, not all pairs.  The connected parts of the proposals are
verified apart from each other, in memory, on full shingle sets: a text joins a
cluster when it is similar enough to any member, and members are tested against
the texts that have no cluster yet.  A large part is dealt in blocks, every two
of which meet in one task, so no group has to fit a task: blocks of
``small_block`` classes while that takes no more than ``copies`` of them, larger
ones beyond, but never of more than ``block`` classes or ``block_shingles``
shingles.  The links found are then connected.

Defined cases: null, empty and wordless texts have no shingles and link with
nothing; texts of fewer than ``words`` words are one shingle; rows that repeat
a doc_id are rows of their own, of which one is kept if they are linked; a null
doc_id sorts last, so a group is named by it only if no other is in it; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ORD, checkpoint, with_order
from .textscan import U64, Words, mix, pieces, text_arrays, trimmed

EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, and where each text's begin."""
    words = Words(data, offsets, lower=True)
    hashes, docs, first = words.hashes(), words.docs(), words.first
    if not len(hashes):
        return hashes, np.zeros(len(offsets), dtype=np.int64)
    count = np.diff(first)
    grams = np.zeros(len(hashes), dtype=U64)
    for i in range(n):  # a text of fewer words has its first place only, hashed as far as it goes
        inside = np.flatnonzero(np.arange(len(hashes)) + i < first[docs + 1])
        grams[inside] = mix(grams[inside] * U64(0xD1342543DE82EF95) + hashes[inside + i] + U64(i + 1))
    place = np.arange(len(hashes)) - first[docs]
    valid = (place + n <= count[docs]) | (place == 0)
    grams, docs = grams[valid], docs[valid]
    order = np.lexsort((grams, docs))
    grams, docs = grams[order], docs[order]
    new = np.ones(len(grams), dtype=bool)
    new[1:] = (grams[1:] != grams[:-1]) | (docs[1:] != docs[:-1])
    grams, docs = grams[new], docs[new]
    return grams, np.searchsorted(docs, np.arange(len(offsets)))


def sketches(grams: np.ndarray, begins: np.ndarray, size: int) -> np.ndarray:
    """Fast similarity sketch of each set: a row of ``size`` values (rows of empty sets stay ``EMPTY``)."""
    n = len(begins) - 1
    out = np.full(n * size, EMPTY, dtype=U64)
    owner = np.repeat(np.arange(n), np.diff(begins))
    values = grams
    for round_ in range(2 * size):
        if not len(values):
            break
        h = mix(values + U64((round_ + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        bins = (h % U64(size)).astype(np.int64) if round_ < size else np.full(len(h), round_ - size)
        np.minimum.at(out, owner * size + bins, (h >> U64(9)) + (U64(round_) << U64(55)))
        open_sets = (out.reshape(n, size) == EMPTY).any(axis=1)
        going = open_sets[owner]
        owner, values = owner[going], values[going]
    return out.reshape(n, size)


def _fold(rows: np.ndarray, seed: int) -> np.ndarray:
    out = np.full(rows.shape[0], seed, dtype=U64)
    for column in rows.T:
        out = mix(out * U64(0xD1342543DE82EF95) + column)
    return out


def _sketcher(words: int, bands: int, rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_arrays(batch.column(1))
            for at, to, some, some_offsets in pieces(data, offsets, 2 << 20):
                grams, begins = shingle_sets(some, some_offsets, words)
                count = np.diff(begins)
                sketch = sketches(grams, begins, bands * rows)
                band = np.stack([_fold(sketch[:, i * rows : (i + 1) * rows], i + 1) for i in range(bands)], axis=1)
                raw, cuts = memoryview(grams).cast("B"), (begins * 8).tolist()
                digests = pa.array([blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(to - at + 1, dtype=np.int32) * bands), pa.array(band.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array(count), digests, lists], names=[ORD, "n_shingles", "digest", "bands"])

    return run


def _setter(words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Full shingle sets as binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_arrays(batch.column(2))
            for at, to, some, some_offsets in pieces(data, offsets, 2 << 20):
                grams, begins = shingle_sets(some, some_offsets, words)
                raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), to - at, [None, pa.py_buffer(begins.astype(np.int64) * 8), pa.py_buffer(grams)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), batch.column(1).slice(at, to - at), raw.cast(pa.binary())], names=[ORD, "part", "shingles"])

    return run


def clusters(sets: list[np.ndarray], above: int, below: int) -> list[int]:
    """Cluster number of each set: linked when below * shared >= above * union; a cluster is named by its first member.

    Each member in turn is tested against all sets without a cluster; numbers
    of the elements make that one gather and one segmented sum.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    every, numbers = np.unique(np.concatenate(sets), return_inverse=True)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    label, open_ = [-1] * n, np.arange(n)
    mark = np.zeros(len(every), dtype=np.int32)
    for k in range(n):
        if label[k] >= 0:
            continue
        label[k] = k
        queue = [k]
        open_ = open_[open_ != k]
        while queue and len(open_):
            q = queue.pop()
            near = open_[(below * np.minimum(sizes[open_], sizes[q]) >= above * np.maximum(sizes[open_], sizes[q]))]
            if not len(near):
                continue
            mark[numbers[begins[q] : begins[q + 1]]] = 1
            lengths = sizes[near]
            at = np.repeat(begins[near] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
            shared = np.add.reduceat(mark[numbers[at]], np.concatenate([[0], np.cumsum(lengths)[:-1]]))
            mark[numbers[begins[q] : begins[q + 1]]] = 0
            linked = near[below * shared >= above * (sizes[near] + sizes[q] - shared)]
            for x in linked:
                label[x] = k
                queue.append(int(x))
            open_ = open_[~np.isin(open_, linked)]
    return label


def _verifier(above: int, below: int) -> Callable[[pa.Table], pa.Table]:
    def verify(table: pa.Table) -> pa.Table:
        ids = table.column(ORD).to_numpy()
        order = np.argsort(ids, kind="stable")
        raw = table.column("shingles").combine_chunks()
        sets = [np.frombuffer(raw[int(i)].as_buffer(), dtype=U64) for i in order]
        ids = ids[order]
        return pa.table({"a": ids, "b": ids[clusters(sets, above, below)]})

    return verify


def _star(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step, each a grouped minimum."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = checkpoint(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    large = checkpoint(large)
    low = checkpoint(large.groupBy("u").agg(F.min("v").alias("m")))
    small = large.join(low, "u").select(F.col("v").alias("x"), "u", "m")
    return small.where("x <> m").select(F.col("x").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).distinct()


def _union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Roots of the nodes of all links of a task."""
    links = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], axis=1) for b in batches]
    if not links:
        return
    nodes, ends = np.unique(np.concatenate(links), return_inverse=True)
    ends = ends.reshape(-1, 2)
    label, old = np.arange(len(nodes)), None
    while old is None or (label != old).any():
        old = label.copy()
        low = np.minimum(label[ends[:, 0]], label[ends[:, 1]])
        for side in (0, 1):  # the labels of both ends fall to the smaller, and so do the nodes they point to
            np.minimum.at(label, old[ends[:, side]], low)
            np.minimum.at(label, ends[:, side], low)
        while (label[label] != label).any():
            label = label[label]
    own = np.flatnonzero(label != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[label[own]])], names=["node", "root"])


def connected(links: DataFrame, fits: int = 400_000) -> DataFrame:
    """(node, root) for the nodes of (a, b) links but the roots: root is the smallest node reachable.

    Alternating large-star and small-star steps over checkpoints until nothing
    changes; the edges stay as many as the nodes and links.  Once at most
    ``fits`` edges of 16 bytes are left, one task ends the work in memory.
    """
    edges = checkpoint(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    total = (F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    old = edges.agg(*total).first()
    while old[0] > fits:
        edges = checkpoint(_star(edges))
        new = edges.agg(*total).first()
        if tuple(new) == tuple(old):
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        old = new
    return checkpoint(edges.repartition(1).mapInArrow(trimmed(_union), "node long, root long"))


def near_dedup(
    docs: DataFrame, *, words: int = 5, similarity: tuple[int, int] = (85, 100), bands: int = 24, rows: int = 6, block: int = 4000, block_shingles: int = 2_000_000, small_block: int = 250, copies: int = 24,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest id reachable over links), kept."""
    above, below = similarity
    base, same_id = with_order(docs, id_col, F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sketched = checkpoint(base.select(ORD, "text").mapInArrow(trimmed(_sketcher(words, bands, rows)), f"{ORD} long, n_shingles long, digest binary, bands array<long>"))

    # classes of equal sets; small sides are checkpoints, so that each join deals both sides itself and Spark can split a hot key
    full = sketched.where("n_shingles > 0")
    classes = full.groupBy("digest").agg(F.min(ORD).alias("rep"), F.count("*").alias("size"))
    repeated = checkpoint(classes.where("size > 1").select("digest", "rep"))
    heads = full.join(repeated, "digest", "left").where(F.col("rep").isNull() | (F.col("rep") == F.col(ORD)))
    heads = checkpoint(heads.select(ORD, "n_shingles", "bands"))

    # stars of the band buckets
    buckets = heads.select(ORD, F.explode("bands").alias("bucket"))
    hubs = checkpoint(buckets.groupBy("bucket").agg(F.min(ORD).alias("hub"), F.count("*").alias("n")).where("n > 1").select("bucket", "hub"))
    proposed = buckets.join(hubs, "bucket").where(F.col(ORD) != F.col("hub")).select(F.col(ORD).alias("a"), F.col("hub").alias("b"))
    parts = connected(proposed)
    members = parts.unionByName(parts.select(F.col("root").alias("node"), "root").distinct())
    members = checkpoint(members.join(heads.select(F.col(ORD).alias("node"), "n_shingles"), "node"))

    # blocks of large parts: every two blocks meet once
    sizes = members.groupBy("root").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    must = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("s") / block_shingles))
    blocks = F.greatest(must, F.least(F.ceil(F.col("n") / small_block), F.lit(copies)))  # a set is sent to as many tasks, less one
    sizes = checkpoint(sizes.select("root", blocks.cast("int").alias("blocks")))
    dealt = members.join(sizes, "root").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    meets = F.expr("CASE WHEN blocks <= 2 THEN array(0) ELSE transform(filter(sequence(0, blocks - 1), j -> j <> own), j -> least(own, j) * blocks + greatest(own, j)) END")
    dealt = dealt.select(F.col("node").alias(ORD), F.struct("root", meets.alias("meets")).alias("part"))

    sets = base.select(ORD, "text").join(dealt, ORD).select(ORD, "part", "text").mapInArrow(trimmed(_setter(words)), f"{ORD} long, part struct<root: long, meets: array<int>>, shingles binary")
    spread = sets.select(ORD, F.col("part.root").alias("root"), F.explode("part.meets").alias("meet"), "shingles")
    links = spread.groupBy("root", "meet").applyInArrow(_verifier(above, below), "a long, b long").where("a <> b")

    # links between representatives, plus membership
    roots = connected(links)
    joined = sketched.select(ORD, "n_shingles", "digest").join(repeated, "digest", "left").withColumn("head", F.coalesce("rep", ORD))
    found = joined.join(roots.withColumnRenamed("node", "head"), "head", "left").select(ORD, "n_shingles", F.coalesce("root", "head").alias("to"))
    kept = (F.col("to") == F.col(ORD)).alias("kept")
    if same_id:
        return found.select(F.col(ORD).alias("doc_id"), "n_shingles", F.col("to").alias("component_id"), kept)
    names = checkpoint(base.select(ORD, "doc_id"))
    named = found.join(names, ORD).join(names.select(F.col(ORD).alias("to"), F.col("doc_id").alias("component_id")), "to")
    return named.select("doc_id", "n_shingles", "component_id", kept)
