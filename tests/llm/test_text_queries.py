"""Registered text queries, and the pipeline against its stages one by one."""

import re

import corpus_pipeline
import pytest

import __spark_entry__ as entry_module
from tablelift.llm import pii, queries, simhash
from tools.compare import connect, difference

SF = "/root/testdata/sf0.001"


def test_all_are_registered():
    assert set(queries.QUERIES) <= set(entry_module.queries()) and len(queries.QUERIES) == 14
    assert [name.split("_")[0] for name in queries.QUERIES][:-1] == [f"op{n}" for n in range(1, 14)]
    assert queries.ORACLES.items() <= entry_module.oracle_sql().items()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, name):
    assert difference(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLES[name]) is None


@pytest.mark.parametrize("name", [name for name in queries.QUERIES if name not in queries.ORACLES and name not in ("pipeline", "op6_decontamination")])
def test_one_row_per_document_or_more(spark, documents, name):
    found = queries.QUERIES[name](spark, SF)
    ids = [row["doc_id"] for row in found.select("doc_id").collect()]
    assert set(ids) == {row["doc_id"] for row in documents.collect()}
    assert name == "op9_packing" or len(ids) == len(set(ids))


def test_pipeline_stages_take_effect(spark, documents, texts):
    docs, kept = documents, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.materialize(stage(spark, docs, SF), f"test-{name}")
        kept[name] = {row["doc_id"] for row in docs.select("doc_id").collect()}
        if name != "packing":
            assert docs.columns == documents.columns
        if name == "near_duplicates":
            marks = simhash.brute_force({row["doc_id"]: (row["text"] or "").encode() for row in before.collect()})
            assert kept[name] == {component for _, component in marks.values()}
        if name == "personal_data":
            text = " ".join(row["text"] or "" for row in docs.collect())
            assert not re.search(pii.BASE["email"].replace(r"(?:\G|", "(?:"), text) and "<email>" in text
            assert all(row["n_chars"] == len(row["text"]) for row in docs.collect() if row["text"] is not None)
    order = [set(texts), *kept.values()]
    assert all(after <= before for before, after in zip(order, order[1:], strict=False))
    leaked = {row["doc_id"] for row in queries.QUERIES["op6_decontamination"](spark, SF).collect()}
    assert leaked & kept["near_duplicates"] and not leaked & kept["decontamination"]
    rows = corpus_pipeline.run(spark, SF)
    assert {row["doc_id"] for row in rows.select("doc_id").collect()} == kept["packing"] and corpus_pipeline.ORACLE_SQL is None
