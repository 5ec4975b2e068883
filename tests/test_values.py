import random

import pytest

from sievelog.functions.masking import Masker
from sievelog.functions.parameters import extract
from sievelog.functions.tokens import tokens_of
from sievelog.operators import values

WORDS = [
    "user", "12", "10.0.0.1:80", "2024-01-02 03:04:05Z", "/a/b.c/d", "x=7,8", "0xFF", "<NUM>", "a\x01b", "é1", "deadbeef-0000-1111-2222-333344445555", "q/r", "\x02", "5.5.", "-3", "﷐",
]


@pytest.mark.parametrize("seed", range(2))
def test_column_expression_equals_the_python_rules(spark, seed):
    pick, masker, rows = random.Random(seed), Masker(), []
    for i in range(1500):
        message = pick.choice(["", " "]) + pick.choice([" ", "  ", "\t"]).join(pick.choice(WORDS) for _ in range(pick.randint(0, 6)))
        if "﷐" in message and any(c in message for c in "\x01\x02\x03"):
            continue
        template = [pick.choice([x, x, "<*>", "zz"]) for x in tokens_of(masker.mask(message))]
        if pick.random() < 0.1:
            template.append("more")
        rows.append((0, i, " ".join(template), message))
    got: dict[int, list] = {}
    for r in values.parameters(spark.createDataFrame(rows, "run int, ord long, text string, message string")).collect():
        got.setdefault(r.ord, []).append((r.position, r.name, r.value))
    for _, i, template, message in rows:
        want = extract(masker, template.split(" ") if template else [], message, exact=False)
        assert sorted(want or []) == sorted(got.get(i, [])), message
