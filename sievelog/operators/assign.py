"""Assignment of records to a finished tree, which it never changes.

The answer depends on the masked message alone.  Records stay where they are:
only the masked messages go to the workers, which number them batch by batch
and remember the answers, so neither a shuffle nor a common message matters.
The tree is broadcast; ``max_templates`` bounds it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import delimiter_class
from .tree import Tree

UNMATCHED = -1
#: Answers that a task remembers.
REMEMBERED = 500_000


def assign(prepared: DataFrame, tree: Tree, *, exact: bool = False) -> DataFrame:
    """Add ``cluster``: the number of each record's cluster, or -1 if none matches."""
    shared = prepared.sparkSession.sparkContext.broadcast(tree)

    @F.arrow_udf("int")
    def cluster(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        choose = own.fits if exact else own.assign
        tokens_of = re.compile(f"[^{delimiter_class(own.config.delimiters)[1:-2]}]+").findall
        known: dict[str, int] = {}
        for batch in batches:
            coded = batch.dictionary_encode()
            texts = coded.dictionary.to_pylist()
            for text in texts:
                if text not in known:
                    found = choose(tokens_of(text))
                    known[text] = UNMATCHED if found is None else found
            answers = np.fromiter(map(known.__getitem__, texts), dtype=np.int32, count=len(texts))
            yield pa.array(answers[coded.indices.to_numpy(zero_copy_only=False)])
            if len(known) > REMEMBERED:
                known.clear()

    return prepared.withColumn("cluster", cluster("masked"))
