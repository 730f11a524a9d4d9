import numpy as np
import pytest

import corpus_pipeline
from flowlens.llm.exact_dedup import exact_dedup
from flowlens.llm.queries import QUERIES, SQL

from .test_decontaminate import words
from .test_quality import corpus
from .test_simhash import forest, slow_fingerprint


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    f = str(tmp_path_factory.mktemp("corpus"))
    rows = [(i, t, y) for i, t, y in corpus(400, seed=3)]
    item = rows[next(k for k, r in enumerate(rows) if r[2])][1].split()[:12]
    n = len(rows)
    good = [r for r in rows if r[2]]
    rows += [(n + k, good[k][1], 1) for k in range(20)]
    rows += [(n + 50 + k, good[k + 30][1] + " " + " ".join(item), 1) for k in range(5)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t, _ in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{f}/documents.parquet")
    spark.createDataFrame([(i, y, 0) for i, _, y in rows[:300]], "doc_id long, quality int, toxic int").write.parquet(f"{f}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{f}/benchmark.parquet")
    return f


def test_each_stage_against_brute_force(spark, folder, tmp_path):
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    item = tuple(words(spark.read.parquet(f"{folder}/benchmark.parquet").first().text))
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        stage(spark, docs, folder).write.parquet(path := f"{tmp_path}/{name.split()[0]}")
        after = spark.read.parquet(path)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == docs.columns
        kept[name] = {r.doc_id for r in after.collect()}
        if name == "exact dedup":
            least = {}
            for i, t in before.items():
                least[t.lower()] = min(i, least.get(t.lower(), i))
            assert kept[name] == set(least.values())
        elif name == "SimHash near-dedup":
            ids = sorted(before)
            roots = forest(np.array([slow_fingerprint(before[i]) for i in ids], np.uint64), 3)
            assert kept[name] == {min(i for i, r in zip(ids, roots) if r == root) for root in set(roots)}
        elif name == "benchmark decontamination":
            size = 10
            wins = {item[k : k + size] for k in range(len(item) - size + 1)}
            clean = {i for i, t in before.items() if not any(tuple(w[k : k + size]) in wins for w in [words(t)] for k in range(len(w)))}
            assert kept[name] == clean and len(clean) < len(before)
        docs = after
    encoded = docs.collect()
    assert all(r.restored and len(r.ids) == r.n_pieces for r in encoded) and any(r.ids for r in encoded)


def test_run_equals_the_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(corpus_pipeline.run(spark, folder)) == key(docs)


def test_empty_documents(spark, folder, tmp_path):
    import shutil

    for t in ("labels", "benchmark"):
        shutil.copytree(f"{folder}/{t}.parquet", f"{tmp_path}/{t}.parquet")
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_repeated_rows_and_nulls(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(30)
    more = spark.createDataFrame([(900, "some lone text", "en", None, 3), (900, "some lone text", "en", None, 3), (901, None, None, None, None), (902, "", None, None, None), (None, "text without id", None, None, None), (None, "text without id", None, None, None)], docs.schema)
    both = docs.unionByName(more)
    kept = corpus_pipeline.exact(spark, both, folder).collect()
    assert sorted(str(r.doc_id) for r in kept if r.doc_id is None or r.doc_id >= 900) == ["900", "901", "None"]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, both, folder).count() <= both.count()


def test_clashing_columns_and_long_texts(spark, folder, tmp_path):
    from pyspark.sql import functions as F

    names = ["kept_id", "again_id", "rows_of_id", "again", "kept", "id", "ids", "text_", "predicted", "score", "contaminated", "component_id", "count"]
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(60)
    long = spark.createDataFrame([(5_000, "calm words here. " * 30_000, "en", "s", 1), (5_000, "other text of the same id, calm words here.", "en", "s", 1)], docs.schema)
    docs = docs.unionByName(long).withColumns({n: F.lit(n) for n in names})
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(path := f"{tmp_path}/{name.split()[0]}")
        after = spark.read.parquet(path)
        assert name == corpus_pipeline.STAGES[-1][0] or after.columns == docs.columns
        docs = after if name != corpus_pipeline.STAGES[-1][0] else docs
    assert docs.where("kept_id != 'kept_id'").isEmpty()


def test_every_operator_is_registered():
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 11))
    assert set(SQL) <= set(QUERIES)
    assert len(corpus_pipeline.STAGES) == 5 and exact_dedup
