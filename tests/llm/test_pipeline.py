"""The corpus pipeline, stage by stage, against plain Python."""

import re

import corpus_pipeline
from pagewright.llm import simhash
from tests.llm.conftest import BAD, sentence
from tests.llm.test_classifiers import brute_counts


def test_stages(spark, documents, tmp_path):
    texts = [sentence(k, 80) for k in range(30)] + [sentence(3, 80), None, "12 34", "short text", BAD * 30]
    documents(texts).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(i < 34), 0) for i in range(len(texts))]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, columns = spark.read.parquet(f"{tmp_path}/documents.parquet"), documents([]).columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == columns
        ids = sorted(r["doc_id"] for r in docs.collect())
        assert ids == [[i for i in range(35) if i not in (31, 32, 34)], list(range(31)), list(range(30))][k]
    assert len({simhash.fingerprint_text(t.encode()) for t in texts[:30]}) == 30
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in rows} == set(range(30))
    assert all(r["doc_tokens"] == sum(x["length"] for x in rows if x["doc_id"] == r["doc_id"]) for r in rows)


def stages_of(spark, docs, labels, at):
    docs.write.parquet(f"{at}/documents.parquet")
    labels.write.parquet(f"{at}/labels.parquet")
    return corpus_pipeline.run(spark, str(at))


def test_pipeline_of_odd_tables(spark, documents, tmp_path, odd_texts):
    """Empty tables, null and repeated ids, no labels, one language: whole results, and no document twice."""
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert stages_of(spark, documents([]), none, tmp_path / "empty").count() == 0
    texts = [*odd_texts, sentence(40, 80), sentence(41, 80), sentence(42, 80)]
    ids = [*range(len(odd_texts)), None, 7, 7]
    rows = stages_of(spark, documents(texts, ids), none, tmp_path / "odd").collect()
    # without labels the rules keep whatever passes the counts; of equal fingerprints the least id stays, a null one last
    good = [(i, simhash.fingerprint_text(t.encode())) for i, t in zip(ids, texts) if t and re.search(r"[^\W\d_]", t) and not brute_counts(t)[-1]]
    first = {}
    for i, fp in sorted(good, key=lambda g: (g[0] is None, g[0] or 0)):
        near = [x for x in first if (x ^ fp).bit_count() <= 3]
        first.setdefault(near[0] if near else fp, i)
    assert sorted(map(str, first.values())) == sorted(str(r["doc_id"]) for r in rows if r["start"] == 0) and len(first) >= 4
    assert {r["sequence_id"] for r in rows} == set(range(len({r["sequence_id"] for r in rows})))
