"""Training: the result of one sequential tree, built length by length, or of the trees of chunks, merged.

Candidates of a message have its number of tokens, so lengths never interact.
Rows are dealt by length and sorted by ``ord`` there; each task streams its
rows through a tree and sums statistics in place, so memory holds the tree and
never a group.  A shape seen since its leaf last changed is answered from a memo,
and runs of such rows are answered as a whole.  The cap on templates (``pool``)
is found from the births of all clusters and replayed; ``evict`` depends on
every record, so it uses one task.

``chunks`` trades exactness for parallel work inside a length: stretches of the
order have trees of their own, whose clusters, in the order of the stretches and
of their creation, are then learned like messages by one more training.  With a
tree to go on from, every stretch starts from a copy of it and its clusters are
merged by their numbers.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EXAMPLE_BYTES, LEVELS, WILDCARD, MiningConfig
from ..functions.masking import mask
from ..functions.tokens import cut_bytes, delimiter_class, tokenise
from .spread import spread
from .stats import LEVEL_COLUMNS
from .tree import Node, Tree

NONE = np.iinfo(np.int64).min
LATE = np.iinfo(np.int64).max
OUT = (
    "chunk int, n_tokens int, birth long, cluster int, tokens array<string>, pooled boolean, run int, count long, first long, last long, "
    + ", ".join(f"{c} long" for c in LEVEL_COLUMNS)
    + ", first_ord long, example string, evicted long, state string"
)
_KINDS = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "array<string>": pa.list_(pa.string())}
_NAMES, _TYPES = zip(*[(x.split()[0], _KINDS[x.split()[1]]) for x in OUT.split(", ")], strict=True)
#: Rows answered from the memo in a row before whole stretches are tried.
CALM = 64


def prepare(records: DataFrame, config: MiningConfig) -> DataFrame:
    """Add the masked message, its tokens and their number."""
    masked = spread(records).withColumn("masked", mask(F.col("message"), config.masks))
    tokens = masked.withColumn("tokens", tokenise(F.col("masked"), config.delimiters))
    return tokens.withColumn("n_tokens", F.size("tokens"))


class Sums:
    """Statistics of (cluster, run), grown as needed."""

    def __init__(self) -> None:
        self.rows: dict[tuple[int, int], list] = {}

    def add(self, cluster: np.ndarray, run: np.ndarray, ts: np.ndarray, level: np.ndarray, ord_: np.ndarray, example: Callable[[int], str | None]) -> None:
        """``example`` gives the text of a row that is the first of its cluster and run."""
        if not len(cluster):
            return
        keys = cluster.astype(np.int64) * 4096 + run
        found, first, at = np.unique(keys, return_index=True, return_inverse=True)
        n = len(found)
        count = np.bincount(at, minlength=n)
        levels = np.bincount(at[level >= 0] * 6 + level[level >= 0], minlength=6 * n).reshape(n, 6)
        low, high = np.full(n, LATE), np.full(n, NONE)
        timed = ts != NONE
        np.minimum.at(low, at[timed], ts[timed])
        np.maximum.at(high, at[timed], ts[timed])
        for key, i, c, a, b, own in zip(found.tolist(), first.tolist(), count.tolist(), low.tolist(), high.tolist(), levels.tolist(), strict=True):
            row = self.rows.get(k := divmod(key, 4096))
            if row is None:
                self.rows[k] = [c, a, b, *own, int(ord_[i]), example(i)]
            else:
                row[:9] = [row[0] + c, min(row[1], a), max(row[2], b), *(x + y for x, y in zip(row[3:9], own, strict=True))]

    def one(self, cluster: int, run: int, ts: int, level: int, ord_: int, example: Callable[[], str | None]) -> None:
        """``add`` for a single record."""
        row = self.rows.get((cluster, run))
        if row is None:
            row = self.rows[cluster, run] = [0, LATE, NONE, 0, 0, 0, 0, 0, 0, ord_, example()]
        row[0] += 1
        if ts != NONE:
            row[1], row[2] = min(row[1], ts), max(row[2], ts)
        if level >= 0:
            row[3 + level] += 1

    def move(self, cluster: int, to: int) -> None:
        for (c, run), row in list(self.rows.items()):
            if c == cluster:
                del self.rows[c, run]
                old = self.rows.setdefault((to, run), [0, LATE, NONE, 0, 0, 0, 0, 0, 0, row[9], row[10]])
                early = min(old[9:11], row[9:11], key=lambda x: x[0])
                self.rows[to, run] = [old[0] + row[0], min(old[1], row[1]), max(old[2], row[2]), *(a + b for a, b in zip(old[3:9], row[3:9], strict=True)), *early]

    def renumber(self, number: dict[int, int]) -> None:
        self.rows = {(number.get(c, c), run): row for (c, run), row in self.rows.items()}


@dataclass
class Miner:
    """A tree with its statistics and the rule for a full tree.  Pooled clusters are -1 - length."""

    config: MiningConfig
    last_birth: int | None = None  # no cluster is born later than this (replay of the cap)
    limit: int | None = None  # clusters at most, for the rules that count as they go

    def __post_init__(self) -> None:
        self.tree, self.sums = Tree(self.config), Sums()
        self.memo: dict[str, tuple[Node, int, int, int]] = {}
        self.last_used: list[int] = []
        self.tick, self.evicted = 0, {}
        self.tokens_of = re.compile(f"[^{delimiter_class(self.config.delimiters)[1:-2]}]+").findall

    def load(self, tree: Tree, length: int | None) -> None:
        """Go on from a loaded tree, or from its part for one length."""
        self.tree = tree.part(length) if length is not None else Tree.from_rows(self.config, tree.to_rows())
        self.last_used = [-len(tree.clusters) + r for r in getattr(tree, "recency", [])] or [0] * len(self.tree.clusters)

    def known(self, masked: str) -> int | None:
        """The answer to a shape whose leaf has not changed since it was last seen."""
        seen = self.memo.get(masked)
        return seen[3] if seen is not None and seen[0].version == seen[1] and self.tree.shape == seen[2] else None

    def cluster(self, masked: str, ord_: int, run: int) -> int:
        self.tick += 1
        c = self.known(masked)
        if c is None:
            tokens = self.tokens_of(masked)
            full = self.limit is not None and len(self.tree.clusters) >= self.limit
            if full and self.config.on_full == "evict" and self.tree.find(tokens) is None:
                self._evict(run)
                full = False
            late = self.last_birth is not None and ord_ > self.last_birth
            before = len(self.tree.clusters)
            c = self.tree.learn(tokens, ord_, may_create=not (late or full))
            if c is None:
                return -1 - len(tokens)
            if len(self.memo) > 200_000:
                self.memo.clear()
            if c < before or WILDCARD not in tokens:  # a literal wildcard need not match its own cluster
                leaf = self.tree.leaf_of[c]
                self.memo[masked] = (leaf, leaf.version, self.tree.shape, c)
        if self.config.on_full == "evict":
            if c == len(self.last_used):
                self.last_used.append(self.tick)
            self.last_used[c] = self.tick
        return c

    def stretch(self, masked: pa.Array, ord_: np.ndarray, run: np.ndarray) -> np.ndarray:
        """Clusters of rows that come one after the other."""
        coded = masked.dictionary_encode()
        texts, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        out, at, calm, n = np.empty(len(codes), dtype=np.int64), 0, 0, len(codes)
        known, cluster, ords, runs = self.known, self.cluster, ord_.tolist(), run.tolist()
        while at < n:
            if calm >= CALM:
                answers = np.array([-1 << 62 if (c := known(t)) is None else c for t in texts], dtype=np.int64)
                unknown = np.flatnonzero(answers[codes[at:]] == -1 << 62)
                to = at + int(unknown[0]) if len(unknown) else n
                out[at:to] = answers[codes[at:to]]
                at, calm = to, 0
                continue
            text = texts[codes[at]]
            c = known(text)
            if c is None:
                c = cluster(text, ords[at], runs[at])
                calm = 0
            else:
                calm += 1
            out[at] = c
            at += 1
        return out

    def _evict(self, run: int) -> None:
        k = max(1, self.config.max_templates // 10)
        gone = sorted(range(len(self.last_used)), key=lambda c: (self.last_used[c], c))[:k]
        for c in gone:
            self.sums.move(c, -1 - len(self.tree.clusters[c]))
        number = self.tree.drop(set(gone))
        self.sums.renumber({**number})
        self.last_used = [self.last_used[c] for c in sorted(number)]
        self.evicted[run] = self.evicted.get(run, 0) + len(gone)
        self.memo.clear()

    def rows(self, n_tokens: int | None, chunk: int = 0, state: bool = True) -> Iterator[tuple]:
        for (c, run), row in sorted(self.sums.rows.items()):
            tokens = self.tree.clusters[c] if c >= 0 else [WILDCARD] * (-1 - c)
            first, last = (None, None) if row[2] == NONE else (row[1], row[2])
            yield (chunk, len(tokens), self.tree.births[c] if c >= 0 else None, c, tokens, c < 0, run, row[0], first, last, *row[3:9], row[9], row[10], self.evicted.get(run, 0), None)
        if state:
            data = json.dumps(self.tree.to_rows() | {"recency": self.last_used})
            yield (chunk, n_tokens, None, None, None, False, None, *([None] * 9), None, None, None, data)


def _batches(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), 20_000):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 20_000], strict=True), _TYPES, strict=True)], names=list(_NAMES))


def _trainer(
    config: MiningConfig, last_birth: int | None = None, known: Broadcast | None = None, *, whole: bool = False, chunked: bool = False, state: bool = True, examples: bool = True
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One tree per length, or with ``whole`` one for all rows of a task (a task is a chunk with ``chunked``)."""

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() if chunked else 0
        miner, length = None, None
        for batch in batches:
            number = lambda name, none: batch.column(name).fill_null(none).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            run, ts, level, ord_ = number("run", 0), number("ts_micros", int(NONE)), number("level_rank", -1), number("ord", 0)
            lengths, masked, shown = batch.column("n_tokens").to_numpy(), batch.column("masked"), batch.column("shown")
            cuts = [0, len(lengths)] if whole else [0, *(np.flatnonzero(np.diff(lengths)) + 1).tolist(), len(lengths)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if miner is None or (not whole and lengths[a] != length):
                    if miner is not None and miner.sums.rows:
                        yield from _batches(list(miner.rows(length, chunk, state)))
                    miner, length = Miner(config, last_birth, config.max_templates if whole else None), None if whole else int(lengths[a])
                    if known is not None:
                        miner.load(known.value, length)

                def example(i: int, a: int = a, masked: pa.Array = masked, shown: pa.Array = shown) -> str | None:
                    text = shown[a + i].as_py()
                    return cut_bytes(masked[a + i].as_py() if text is None else text, EXAMPLE_BYTES) if examples else None

                if whole and config.on_full == "evict":  # eviction renumbers, so statistics are added record by record
                    columns = (x[a:b].tolist() for x in (run, ts, level, ord_))
                    for i, (text, r, t, rank, o) in enumerate(zip(masked.slice(a, b - a).to_pylist(), *columns, strict=True)):
                        miner.sums.one(miner.cluster(text, o, r), r, t, rank, o, lambda i=i: example(i))  # noqa: B023
                    continue
                chosen = miner.stretch(masked.slice(a, b - a), ord_[a:b], run[a:b])
                miner.sums.add(chosen, run[a:b], ts[a:b], level[a:b], ord_[a:b], example)
        if miner is not None and miner.sums.rows:
            yield from _batches(list(miner.rows(length, chunk, state)))

    return train


MERGED = "chunk int, cluster int, n_tokens int, birth long, tokens array<string>, state string"


def _merger(config: MiningConfig, last_birth: int | None, known: Broadcast | None, old: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Learn the clusters of chunks like messages: a row for each with the birth of its cluster, a row for each cluster made, and the state."""
    names, types = zip(*[(x.split()[0], _KINDS[x.split()[1]]) for x in MERGED.split(", ")], strict=True)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=list(names))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, length, seeds = None, None, {}

        def made() -> pa.RecordBatch:
            rows = [(None, None, length, birth, tokens, None) for birth, tokens in zip(tree.births, tree.clusters, strict=True)]
            return batch([*rows, (None, None, length, None, None, json.dumps(tree.to_rows()))])

        for some in batches:
            out = []
            columns = (some.column(x).to_pylist() for x in ("n_tokens", "chunk", "cluster", "tokens"))
            for n, chunk, cluster, tokens in zip(*columns, strict=True):
                if n != length:
                    if tree is not None:
                        yield made()
                    tree, length = Tree(config) if known is None else known.value.part(n), n
                    own = [] if known is None else [c for c, t in enumerate(known.value.clusters) if len(t) == n]
                    seeds = {c: i for i, c in enumerate(own)}
                ord_ = (chunk << 32) + cluster
                if cluster < old:
                    c = seeds[cluster]
                    tree.generalise(c, tokens)
                else:
                    c = tree.learn(tokens, ord_, may_create=last_birth is None or ord_ <= last_birth)
                out.append((chunk, cluster, n, None if c is None else tree.births[c], None, None))
            if out:
                yield batch(out)
        if tree is not None:
            yield made()

    return merge


def settled(df: DataFrame) -> DataFrame:
    """Rows that are computed once: a checkpoint where the cluster names a folder for them, else kept in memory."""
    return df.checkpoint(eager=True) if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()


def stored(df: DataFrame) -> DataFrame:
    """``settled`` for much text: packed files in the shared folder instead of a checkpoint, which is as large as the rows are in memory."""
    base = df.sparkSession.sparkContext.getCheckpointDir()
    if not base:
        return df.persist()
    folder = f"{base}/rows-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def _shown(prepared: DataFrame, examples: str) -> Column:
    """What an example shows; null stands for the masked message."""
    if examples != "raw":
        return F.lit(None).cast("string")
    return F.when(F.col("message") != F.col("masked"), F.substring("message", 1, EXAMPLE_BYTES))


def train(
    prepared: DataFrame, config: MiningConfig, start: Tree | None = None, *, examples: str = "raw", chunks: int | None = None, keep_tree: bool = True
) -> tuple[DataFrame, Tree | None]:
    """Statistics of the clusters, and the finished tree (None without ``keep_tree``).

    The frame has a row per (cluster, run): tokens, birth, statistics and the
    example; ``pooled`` rows are records beyond the cap.  ``prepared`` has run,
    ord (a total order), ts_micros, level, message, masked and n_tokens.
    ``start`` is a tree to go on from.
    """
    spark = prepared.sparkSession
    rank = F.create_map(*[F.lit(x) for i, name in enumerate(LEVELS) for x in (name, i)])
    rows = prepared.select("run", "ord", "ts_micros", F.try_element_at(rank, F.col("level")).alias("level_rank"), "masked", "n_tokens", _shown(prepared, examples).alias("shown"))
    known, old, shows = None, 0, examples != "none"
    if start is not None:
        old = len(start.clusters)
        start.births = list(range(-old, 0))  # before every record
        known = spark.sparkContext.broadcast(start)  # bounded by max_templates
    room = config.max_templates - old

    def last_of(born: DataFrame) -> int | None:
        """Birth of the last cluster below the cap, if the cap is passed."""
        born = born.where("birth >= 0").select("birth").distinct()
        if born.count() <= room:
            return None
        return born.orderBy("birth").limit(room).agg(F.max("birth")).first()[0] if room else -1

    if chunks and config.on_full != "evict":
        dealt = rows.repartitionByRange(chunks, "ord").sortWithinPartitions("ord")
        own = settled(dealt.mapInArrow(_trainer(config, None, known, whole=True, chunked=True, state=False, examples=shows), OUT))
        messages = own.where("not pooled").select("n_tokens", "chunk", "cluster", "tokens").dropDuplicates(["chunk", "cluster"])
        messages = messages.repartition(2 * _tasks(spark), "n_tokens").sortWithinPartitions("n_tokens", "chunk", "cluster")
        merged = settled(messages.mapInArrow(_merger(config, None, known, old), MERGED))
        if (last := last_of(merged.where("tokens is not null"))) is not None:
            merged = settled(messages.mapInArrow(_merger(config, last, known, old), MERGED))
        answers = merged.where("chunk is not null").select("chunk", "cluster", "birth")
        named = own.join(answers, ["chunk", "cluster"], "left").select(*[c for c in own.columns if c not in ("birth", "pooled", "tokens")], answers["birth"])
        total = [F.sum(c).alias(c) for c in ("count", *LEVEL_COLUMNS)]
        summed = named.groupBy("n_tokens", "birth", "run").agg(*total, F.min("first").alias("first"), F.max("last").alias("last"), F.min_by("example", "first_ord").alias("example"), F.min("first_ord").alias("first_ord"))
        made = merged.where("tokens is not null").select("birth", "tokens")
        wild = F.array_repeat(F.lit(WILDCARD), F.col("n_tokens"))
        found = summed.join(made, "birth", "left").withColumn("pooled", F.col("birth").isNull()).withColumn("tokens", F.coalesce("tokens", wild)).withColumn("evicted", F.lit(0).cast("long"))
        states = merged.where("state is not null")
    else:
        if config.on_full == "evict":
            dealt = rows.repartition(1).sortWithinPartitions("ord")
            found = settled(dealt.mapInArrow(_trainer(config, None, known, whole=True, state=keep_tree, examples=shows), OUT))
        else:
            dealt = rows.repartition(2 * _tasks(spark), "n_tokens").sortWithinPartitions("n_tokens", "ord")
            found = settled(dealt.mapInArrow(_trainer(config, None, known, state=keep_tree, examples=shows), OUT))
            if (last := last_of(found.where("not pooled and state is null"))) is not None:
                found.unpersist()
                found = settled(dealt.mapInArrow(_trainer(config, last, known, state=keep_tree, examples=shows), OUT))
        states, found = found.where("state is not null"), found.where("state is null").drop("state", "chunk", "cluster")
    if not keep_tree:
        return found, None
    parts = [json.loads(r.state) for r in states.select("state").toLocalIterator()]
    if start is not None and config.on_full != "evict":  # lengths without a new record
        seen = {n for p in parts for n, _ in p["roots"]}
        parts += [start.part(n).to_rows() for n in start.roots if n not in seen]
    tree = Tree.joined(config, parts) if len(parts) != 1 else Tree.from_rows(config, parts[0])
    if config.on_full == "evict" and parts:
        tree.recency = parts[0]["recency"]  # type: ignore[attr-defined]
    return found, tree


def _tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
