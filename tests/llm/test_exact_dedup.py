import hashlib

import pytest
from pyspark.sql import functions as F

from flowlens.llm.exact_dedup import exact_dedup

SCHEMA = "doc_id long, text string, h string, rid long, n int"
ROWS = [
    (1, "Some Text", "x", 5, 1), (2, "some text", "y", 5, 2), (3, None, None, None, None), (4, "", "", 0, 0), (5, "É", "z", 1, 1), (6, "é", "z", 1, 1),
    (None, "some TEXT", "n", 1, 1), (7, "lone", "q", 1, 1), (7, "lone", "q", 1, 1), (None, "nameless", "q", 1, 1), (8, "x" * 200_000, "l", 1, 1), (9, "X" * 200_000, "l", 1, 1),
]


def brute(rows, keep):
    groups = {}
    for i, t, *_ in rows:
        norm = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        groups.setdefault(norm, []).append(i)
    out = {}
    for norm, ids in groups.items():
        real = [i for i in ids if i is not None]
        out[norm] = ((max if keep == "largest" else min)(real) if real else None, len(ids))
    return out


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("weak", [False, True])
def test_groups_by_bytes(spark, keep, weak):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    options = {"digest": lambda t: F.unhex(F.md5(F.substring(t, 1, 1)))} if weak else {}  # a weak digest makes collisions
    got = exact_dedup(docs, keep=keep, **options).collect()
    assert len(got) == len(ROWS)
    expected = brute(ROWS, keep)
    by_sha = {hashlib.sha256(n.encode()).hexdigest(): v for n, v in expected.items()}
    for r in got:
        assert (r.keep_id, r.group_size) == by_sha[r.text_sha256]
    kept = [r for r in got if r.kept]
    assert len(kept) == len(expected)  # one a group, also of repeated rows
    assert all(r.doc_id == r.keep_id for r in kept)


def test_empty_table(spark):
    assert exact_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_bad_keep(spark):
    with pytest.raises(ValueError):
        exact_dedup(spark.createDataFrame([], SCHEMA), keep="any")


def test_native_plan(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    plan = exact_dedup(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))
