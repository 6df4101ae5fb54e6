import numpy as np

import corpus_pipeline
from factloom.llm import decontaminate, quality
from tests.llm.test_decontaminate import words
from tests.llm.test_lines import brute, kept_texts
from tests.llm.test_simhash import brute_components


def number(texts):
    known = {}
    return [np.array([known.setdefault(w, len(known)) for w in words(t)], np.int64) for t in texts]


def test_pipeline_matches_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) < 4000")
    verdict = {r.doc_id: r.kept for r in quality.judge(docs).collect()}
    rows = sorted((r.doc_id, r.text) for r in docs.collect() if verdict[r.doc_id])
    kept = kept_texts(rows, brute(rows), rows)
    rows = [(d, kept[d, t]) for d, t in rows if kept[d, t] == t or kept[d, t].strip()]
    first = {d for d, _, c in brute_components(rows, 6, 5) if d == c}
    rows = [(d, t) for d, t in rows if d in first]
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    coded = number(items + [t for _, t in rows])
    clean = [(d, t) for (d, t), x in zip(rows, coded[len(items) :], strict=True) if all(decontaminate.align(i, x)[0] < len(i) for i in coded[: len(items)])]
    out = docs
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, sf_dir)
    got = sorted((r.doc_id, r.decoded) for r in out.collect())
    assert len(got) > 30 and got == clean


def test_stages_keep_columns_and_odd_rows(spark, sf_dir):
    long = " ".join(f"w{i}" for i in range(120))
    rows = [(1, long, "en", "a", 5), (1, long, "en", "a", 5), (2, None, None, None, None), (None, long + " x", None, "b", 0), (3, "", "en", "a", 0), (4, "word " * 20_000, "en", "a", 1)]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{sf_dir}/documents.parquet").schema)
    for table in (docs, docs.limit(0)):
        out = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, out, sf_dir)
            assert out.columns == docs.columns
        result = corpus_pipeline.STAGES[-1][1](spark, out, sf_dir).collect()
    assert result == []
