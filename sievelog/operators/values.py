"""Values of the variable positions: distributions, quantiles, and values that are new or gone."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT_RULES, MaskRule
from ..functions.masking import ANY_RULE, Masker, rule_number
from ..functions.parameters import extract
from ..functions.tokens import DELIMITERS, cut_bytes

TRACKED, DISTINCT, VALUE_BYTES, TOP, GROWTH = 200, 1000, 64, 10, 1.05
#: Different values of a position and of a run that are kept apart.
PRESENCE_LIMIT, RUN_LIMIT = 1_000_000, 4_000_000
TINY, HUGE = 1e-9, 1e15
NUMBER = r"^-?[0-9]+(\.[0-9]+)?\z"
NAMES = frozenset({"*", *(r.name for r in DEFAULT_RULES)})
KEYS = ["text", "position", "name"]


#: Marks around hits, and what stands for a space inside one; messages that have them get the noncharacters instead.
_OPEN, _CLOSE, _BLANK = "\x01", "\x02", "\x03"
_MARKS, _SPARE = "\x01\x02\x03", "\ufdd0\ufdd1\ufdd2"


def _default_parameters(assigned: DataFrame) -> DataFrame:
    """``parameters`` for the default rules and delimiters, without Python.

    Every hit is put between marks, with the number of its rule and no space (only
    times have one), so splitting gives the tokens with their hits inside.
    """
    has = F.col("message").rlike(f"[{_MARKS}]")
    message = F.when(has, F.translate("message", _MARKS, _SPARE)).otherwise(F.col("message"))
    pieces = F.split(F.regexp_replace(message, f"({ANY_RULE})", f"{_OPEN}$1{_CLOSE}"), _OPEN, -1)
    hit, gap = lambda p: F.substring_index(p, _CLOSE, 1), lambda p: F.substring_index(p, _CLOSE, -1)
    coded = lambda p: F.concat(F.lit(_OPEN), rule_number(hit(p)).cast("string"), F.translate(hit(p), " ", _BLANK), F.lit(_CLOSE), gap(p))
    text = F.array_join(F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(coded(p))), "")
    split = assigned.select(
        "run", "ord", "text", has.alias("has"),
        F.when(F.col("text") == "", F.array().cast("array<string>")).otherwise(F.split("text", " ", -1)).alias("template"),
        F.filter(F.split(text, "[ \t\n\r]+", -1), lambda t: t != "").alias("tokens"),
    )
    names = F.array(*[F.lit(r.name) for r in DEFAULT_RULES])
    inner = lambda x: F.translate(x, _BLANK, " ")

    def of_token(token: Column, i: Column) -> Column:
        whole = F.struct(i.alias("position"), F.lit("*").alias("name"), inner(F.regexp_replace(token, f"{_OPEN}.|{_CLOSE}", "")).alias("value"))
        part = lambda s: F.struct(i.alias("position"), F.element_at(names, F.substring(s, 1, 1).cast("int") + 1).alias("name"), inner(hit(F.substring(s, 2, 1 << 30))).alias("value"))
        hits = F.transform(F.filter(F.split(token, _OPEN, -1), lambda _, k: k > 0), part)
        return F.when(F.element_at("template", i + 1) == "<*>", F.array(whole)).when(token.contains(_OPEN), hits)

    found = F.when(F.size("template") == F.size("tokens"), F.flatten(F.filter(F.transform("tokens", of_token), lambda x: x.isNotNull())))
    rows = split.select("run", "ord", "text", "has", F.explode(found).alias("x"))
    value = F.when(F.col("has"), F.translate("x.value", _SPARE, _MARKS)).otherwise(F.col("x.value"))
    return rows.select("run", "ord", "text", "x.position", "x.name", value.alias("value"))


def parameters(assigned: DataFrame, masks: Sequence[MaskRule] = DEFAULT_RULES, delimiters: str = DELIMITERS) -> DataFrame:
    """A row per value: run, ord, text, position, name, value.  ``assigned`` has run, ord, message and the template's text."""
    if tuple(masks) == DEFAULT_RULES and delimiters == DELIMITERS:
        return _default_parameters(assigned.select("run", "ord", "text", "message"))
    schema = "run int, ord long, text string, position int, name string, value string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        masker = Masker(masks)
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                found = extract(masker, row.text.split(" ") if row.text else [], row.message, delimiters, exact=False)
                rows += [(row.run, row.ord, row.text, p, n, v) for p, n, v in found or () if n in NAMES]
            yield pd.DataFrame(rows, columns=["run", "ord", *KEYS, "value"])

    return assigned.select("run", "ord", "text", "message").mapInPandas(run, schema)


@F.pandas_udf(T.StringType())
def _cut(values: pd.Series) -> pd.Series:
    return values.map(lambda v: cut_bytes(v, VALUE_BYTES))


def cut_value(value: Column) -> Column:
    """The first 64 bytes; ASCII-only short values need no Python."""
    return F.when(F.octet_length(value) <= VALUE_BYTES, value).otherwise(_cut(value))


def number_of(value: Column) -> Column:
    """The value as a number, or null."""
    return F.when((F.octet_length(value) <= 32) & value.rlike(NUMBER), value.try_cast("double"))


def tracked(templates: DataFrame, k: int = TRACKED) -> DataFrame:
    """The templates with the most records."""
    return templates.orderBy(F.desc("count"), F.asc("text")).limit(k)


#: Parts that the values of a position are ranked in before they meet.
SALTS = 64


def _salt() -> Column:
    return F.pmod(F.xxhash64("value"), F.lit(SALTS))


def distribution(values: DataFrame, top: int = TOP, limit: int | None = DISTINCT) -> DataFrame:
    """Per position: the most frequent values, the number of counted values, capped, and records beyond them.

    Counts are exact; of more than ``limit`` values the ones seen first are the
    counted ones, and all count where it is None.  A position's values are ranked
    in parts that keep their first ``limit`` (or their ``top``) each, so no task
    holds more than these.
    """
    counts = values.withColumn("value", cut_value(F.col("value"))).groupBy(*KEYS, "value").agg(F.count("*").alias("n"), F.min("ord").alias("o")).withColumn("salt", _salt())
    ranks = F.struct((-F.col("n")).alias("k"), "value")
    listed = lambda best: F.transform(best, lambda x: F.struct(x["value"].alias("value"), (-x["k"]).alias("count"))).alias("top")
    if limit is None:
        ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy(*KEYS, "salt").orderBy(F.desc("n"), "value")))
        parts = ranked.groupBy(*KEYS, "salt").agg(F.collect_list(F.when(F.col("rank") <= top, ranks)).alias("best"), F.count("*").alias("d"))
        whole = parts.groupBy(*KEYS).agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, top).alias("best"), F.sum("d").alias("distinct"))
        return whole.select(*KEYS, listed(F.col("best")), "distinct", F.lit(False).alias("capped"), F.lit(0).cast("long").alias("other"))
    seen = counts.withColumn("place", F.row_number().over(Window.partitionBy(*KEYS, "salt").orderBy("o", "value")))
    parts = seen.groupBy(*KEYS, "salt").agg(
        F.collect_list(F.when(F.col("place") <= limit, F.struct("o", "value", "n"))).alias("firsts"), F.count("*").alias("d"), F.sum("n").alias("t")
    )
    whole = parts.groupBy(*KEYS).agg(F.slice(F.array_sort(F.flatten(F.collect_list("firsts"))), 1, limit).alias("firsts"), F.sum("d").alias("d"), F.sum("t").alias("t"))
    best = F.slice(F.array_sort(F.transform("firsts", lambda x: F.struct((-x["n"]).alias("k"), x["value"].alias("value")))), 1, top)
    inside = F.aggregate("firsts", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    return whole.select(
        *KEYS, listed(best),
        F.least("d", F.lit(limit)).alias("distinct"), (F.col("d") > limit).alias("capped"), (F.col("t") - inside).alias("other"),
    )


def bucket_limits() -> tuple[list[float], list[float]]:
    """Limits 1.05 ** i for i >= 0 and i <= 0, each by repeated multiplication or division."""
    up, down = [1.0], [1.0]
    while up[-1] < HUGE:
        up.append(up[-1] * GROWTH)
    while down[-1] > TINY:
        down.append(down[-1] / GROWTH)
    return up, down


def bucket(number: Column) -> Column:
    """Signed log bucket: sign, then the smallest i with size <= 1.05 ** i; near zero and sign are kept apart."""
    up, down = bucket_limits()
    size = F.abs(number)
    offset = len(down) - 1
    limits = F.array(*[F.lit(x) for x in [*reversed(down), *up[1:]]])
    guess = F.ceil(F.ln(F.greatest(F.least(size, F.lit(HUGE)), F.lit(TINY))) / F.ln(F.lit(GROWTH))).cast("int")
    low, high = -offset, len(up) - 1
    at = F.greatest(F.least(guess, F.lit(high)), F.lit(low))
    limit = lambda i: F.element_at(limits, F.greatest(F.least(i, F.lit(high)), F.lit(low)) + offset + 1)
    # the logarithm can be off by one: compare with the limits themselves
    right = F.when((at > low) & (F.least(size, F.lit(HUGE)) <= limit(at - 1)), at - 1).when(F.least(size, F.lit(HUGE)) > limit(at), at + 1).otherwise(at)
    return F.when(size <= TINY, F.lit(0)).otherwise(F.signum(number).cast("int") * (right + 100_000))


def bucket_middle(code: Column) -> Column:
    """Middle of a bucket."""
    up, down = bucket_limits()
    offset = len(down) - 1
    limits = F.array(*[F.lit(x) for x in [*reversed(down), *up[1:]]])
    i = F.abs(code) - 100_000
    pick = lambda k: F.element_at(limits, F.greatest(F.least(k + offset + 1, F.lit(len(up) + offset)), F.lit(1)))
    return F.when(code == 0, F.lit(0.0)).otherwise(F.signum(code.cast("double")) * (pick(i - 1) + pick(i)) / 2)


def numeric_summary(values: DataFrame, quantiles: Sequence[float] = (0.5, 0.9, 0.99), keys: Sequence[str] = tuple(KEYS)) -> DataFrame:
    """Count, min, max, mean and quantiles of the numbers of each position, from mergeable log buckets."""
    keys = list(keys)
    numbers = values.withColumn("x", number_of(F.col("value"))).where("x is not null")
    buckets = numbers.groupBy(*keys, bucket(F.col("x")).alias("code")).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"), F.sum("x").alias("total"))
    rising = Window.partitionBy(*keys).orderBy("code").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(*keys)
    summed = buckets.withColumn("upto", F.sum("n").over(rising)).withColumn("all", F.sum("n").over(every))
    at = lambda q: F.min(F.when(F.col("upto") > F.floor(F.lit(q) * (F.col("all") - 1)), F.col("code")))
    out = summed.groupBy(*keys).agg(F.sum("n").alias("count"), F.min("low").alias("min"), F.max("high").alias("max"), (F.sum("total") / F.sum("n")).alias("mean"), *[at(q).alias(f"q{i}") for i, q in enumerate(quantiles)])
    clamp = lambda c: F.greatest(F.least(bucket_middle(c), F.col("max")), F.col("min"))
    return out.select(*keys, "count", "min", "max", "mean", *[clamp(F.col(f"q{i}")).alias(f"p{q * 100:g}".replace(".", "_")) for i, q in enumerate(quantiles)])


def value_changes(values: DataFrame, top: int = TOP, limit: int = PRESENCE_LIMIT, run_limit: int = RUN_LIMIT) -> DataFrame:
    """Per position of templates that both runs (0 and 1) have: values new in run 1, gone since run 0, and shared ones.

    A position with more than ``limit`` values in a run is ``capped`` and has no
    lists; so are the largest positions of a run, until its others have at most
    ``run_limit`` values in all.
    """
    counts = values.groupBy(*KEYS, "value").agg(F.count(F.when(F.col("run") == 0, 1)).alias("b"), F.count(F.when(F.col("run") == 1, 1)).alias("a"))
    new, gone = (F.col("b") == 0), (F.col("a") == 0)
    kind = F.when(new, "new").when(gone, "gone").otherwise("shared")
    marked = counts.withColumn("kind", kind).withColumn("n", F.col("a") + F.col("b"))
    # ranked in parts first, of which each keeps its ``top``
    ranked = marked.withColumn("salt", _salt()).withColumn("rank", F.row_number().over(Window.partitionBy(*KEYS, "kind", "salt").orderBy(F.desc("n"), F.asc("value"))))
    best = lambda which: F.collect_list(F.when((F.col("kind") == which) & (F.col("rank") <= top), F.struct((-F.col("n")).alias("k"), "value"))).alias(which)
    number = lambda which: F.count(F.when(F.col("kind") == which, 1)).alias(f"n_{which}")
    parts = ranked.groupBy(*KEYS, "salt").agg(best("new"), best("gone"), number("new"), number("gone"), number("shared"), F.sum("b").alias("in_b"), F.sum("a").alias("in_a"))

    def listed(which: str) -> Column:
        first = F.slice(F.array_sort(F.flatten(F.collect_list(which))), 1, top)
        return F.transform(first, lambda x: F.struct(F.substring(x["value"], 1, VALUE_BYTES).alias("value"), (-x["k"]).alias("count"))).alias(which)

    sums = [F.sum(c).alias(c) for c in ("n_new", "n_gone", "n_shared", "in_b", "in_a")]
    out = parts.groupBy(*KEYS).agg(listed("new"), listed("gone"), *sums)
    template = Window.partitionBy("text")  # of a row per position
    both = (F.max("in_b").over(template) > 0) & (F.max("in_a").over(template) > 0)
    out = out.withColumn("both", both).where("both").drop("both", "in_b", "in_a")
    own = {"after": F.col("n_new") + F.col("n_shared"), "before": F.col("n_gone") + F.col("n_shared")}
    capped = (own["after"] > limit) | (own["before"] > limit)
    for side, n in own.items():  # smallest first: what goes beyond the limit of the run are the largest
        rising = Window.orderBy(f"_{side}", *KEYS).rowsBetween(Window.unboundedPreceding, 0)  # a row per position of at most 200 templates
        out = out.withColumn(f"_{side}", F.when(n <= limit, n).otherwise(0)).withColumn(f"_{side}_sum", F.sum(f"_{side}").over(rising))
        capped |= F.col(f"_{side}_sum") > run_limit
    none = F.expr("cast(array() as array<struct<value:string,count:bigint>>)")
    return out.where("n_new > 0 or n_gone > 0").withColumn("capped", capped).withColumn("new", F.when(F.col("capped"), none).otherwise(F.col("new"))).withColumn("gone", F.when(F.col("capped"), none).otherwise(F.col("gone"))).drop("_after", "_before", "_after_sum", "_before_sum")
