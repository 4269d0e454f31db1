"""The corpus pipeline against a brute-force run over the smallest tables, and its edge cases."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
sys.path.insert(0, os.path.dirname(__file__))

import corpus_pipeline  # noqa: E402
from marketgrid.llm import decontaminate, packing, pii, queries, toxicity  # noqa: E402
from test_llm_resemblance import brute_least  # noqa: E402
from test_llm_text_operators import brute_base, plain_ids  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    docs = documents
    for name, step in corpus_pipeline.STAGES[:-1]:
        before = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
        after = step(spark, docs, SF)
        assert after.columns == documents.columns and after.schema["text"].dataType == documents.schema["text"].dataType
        rows = {r.doc_id: r for r in after.collect()}
        if name == "toxicity":
            marks = spark.read.parquet(f"{SF}/labels.parquet")
            model = toxicity.fit(docs, marks)
            assert set(rows) == {i for i, t in before if model.score(t) < 0.5}
        elif name == "near_dedup":
            assert set(rows) == set(brute_least(before)[0].values())
        elif name == "decontamination":
            items = [decontaminate.words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            def holds(text):
                found = f" {' '.join(decontaminate.words(text))} "
                return any(f" {' '.join(w)} " in found for w in items)
            assert {i for i, t in before if holds(t)} == {i for i, _ in before} - set(rows)
        else:
            for i, t in before:
                assert rows[i].text == pii.redact_text(t, brute_base(t)) and rows[i].n_chars == len(rows[i].text)
        assert all(rows[i].lang is not None for i in rows)
        docs = spark.createDataFrame(list(rows.values()), documents.schema)
    got = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    want = {(r.doc_id, k, *p) for r in docs.collect() for k, p in enumerate(packing.cut(plain_ids([r.text])[0] + packing.END))}
    assert {tuple(r)[:5] for r in got} == want
    key = lambda r: tuple(r)[:5]
    assert {key(r) for r in corpus_pipeline.run(spark, SF).collect()} == want


@pytest.mark.parametrize("rows", [[], [(1, None), (2, ""), (None, "one text"), (None, None), (2, "")]])
def test_hard_documents(spark, rows):
    docs = spark.createDataFrame([(i, t, None, None, None, "x") for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, component string")
    for _, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "component"]
    assert docs.count() == (2 if rows else 0)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == (2 if rows else 0)


def test_queries_are_registered():
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13
    assert "pipeline" in names and set(queries.ORACLES) <= set(queries.QUERIES)
