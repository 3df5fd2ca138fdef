"""The pipeline and the queries over the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
import brute

import corpus_pipeline
from floorspan.llm import decontaminate, language_id, ngram_join, toxicity
from floorspan.llm.registry import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"op12_spelling_groups"}))  # that has a row for each word
def test_query_covers_its_table(spark, name):
    table = {"op3": "conversations", "op13": "pages"}.get(name.split("_")[0], "documents")
    whole = spark.read.parquet(f"{SF}/{table}.parquet").count()
    assert QUERIES[name](spark, SF).count() == whole


def test_names():
    assert [n.split("_")[0] for n in sorted(QUERIES, key=lambda x: int(x[2:].split("_")[0]))] == [f"op{i}" for i in range(1, 14)]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language_id", "ngram_join", "decontamination", "mixing"]


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept[-1], SF).write.parquet(str(tmp_path / str(k)))
        kept.append(spark.read.parquet(str(tmp_path / str(k))))
        if name != "mixing":
            assert kept[-1].columns == columns
    ids = [{r.doc_id: r.text for r in d.select("doc_id", "text").collect()} for d in kept]
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert set(ids[1]) == {r.doc_id for r in toxicity.score(docs, model).collect() if r.score < 0.5}
    known = language_id.predict(kept[1], language_id.train(kept[1].filter(language_id.not_held_out("doc_id")))).collect()
    assert set(ids[2]) == {r.doc_id for r in known if r.lang_pred != "und" and r.score >= 0.4}
    groups = brute.components(sorted(ids[2].items()), 5, 80)
    assert set(ids[3]) == set(groups.values())
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert set(ids[4]) == {i for i, t in ids[3].items() if not brute.hits(t, items)[1]}
    assert set(ids[5]) <= set(ids[4])
    sizes = {}
    for r in kept[4].collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(brute.words(r.text))
    taken = {}
    for r in kept[5].collect():
        taken[r.source] = taken.get(r.source, 0) + r.copies * len(brute.words(r.text))
    longest = max(len(brute.words(t)) for t in ids[4].values())
    for s, target in brute.water_fill(sizes).items():
        assert abs(taken.get(s, 0) - target) <= longest


def test_empty_documents(spark, tmp_path):
    import shutil

    for t in ("labels", "benchmark"):
        shutil.copy(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_operators_are_exported():
    assert callable(decontaminate.remove_spans) and callable(ngram_join.join)
