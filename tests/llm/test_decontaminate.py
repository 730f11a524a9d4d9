import hashlib
import random
import re

import pytest

import flowlens.llm.decontaminate as module
from flowlens.llm.decontaminate import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, size):
    wins = {}
    for i, t in items:
        w = words(t)
        if w:
            for k in range(max(1, len(w) - size + 1)):
                wins.setdefault(tuple(w[k : k + size]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for win, ids in wins.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    found |= {str(i) for i in ids if i is not None}
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def table(spark, docs, items):
    d = spark.createDataFrame([(*x, "w", 1) for x in docs], "doc_id long, text string, word string, pos int")
    return d, spark.createDataFrame([(*x, 3) for x in items], "item_id long, text string, id int")


@pytest.mark.parametrize("broadcast", [True, False])
def test_against_brute_force(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(module, "BROADCAST_BYTES", 0)
    r = random.Random(3)
    vocabulary = ["a", "b", "c", "D", "é", "the", "x1"]
    items = [(k, " ".join(r.choices(vocabulary, k=n))) for k, n in enumerate([1, 2, 3, 3, 5, 6, 4, 9])] + [(50, None), (51, "--"), (52, ""), (None, "q r s t"), (53, "unseen words only here")]
    docs = [(k, "".join(x + r.choice([" ", ", ", "-", "\n"]) for x in r.choices(vocabulary, k=r.randint(0, 40)))) for k in range(60)]
    docs += [(100, None), (101, ""), (102, "q R s, t"), (None, "a b c"), (103, "q r s t"), (103, "q r s t"), (104, "z " * 30_000)]
    d, i = table(spark, docs, items)
    got = sorted((tuple(x) for x in decontaminate(d, i, size=3).collect()), key=repr)
    assert got == brute(docs, items, 3)


def test_empty_tables(spark):
    d, i = table(spark, [(1, "some words")], [(1, "some words")])
    assert decontaminate(d.limit(0), i).count() == 0
    only = decontaminate(d, i.where("false")).collect()
    assert [(x.n_words, x.n_hit, x.contaminated) for x in only] == [(2, 0, False)]


def test_native_plan(spark):
    d, i = table(spark, [(1, "some words")], [(1, "some words")])
    plan = decontaminate(d, i)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))
