"""The pipeline against its operators, stage by stage, on tables with cases whose fate is known."""
import numpy as np
import pytest

import corpus_pipeline
from tests.llm.conftest import SF
from tests.llm.test_corpus_operators import plain_join
from turnwise.llm import packing, secret_scan, toxicity


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """What each stage returned, written and read again."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("pipeline") / name)
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_stages_in_order(spark, steps):
    docs, calm, single, masked, mixed, packed = steps
    assert [len(x.columns) for x in steps[:-1]] == [len(docs.columns)] * 5 and all(x.columns == docs.columns for x in steps[:-1])

    scored = toxicity.toxicity_scores(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert {r["doc_id"] for r in calm.collect()} == {r["doc_id"] for r in scored.where("predicted = 0").collect()}

    rows = [(r["doc_id"], r["text"]) for r in calm.collect()]
    assert {r["doc_id"] for r in single.collect()} == {d for d, (_, c) in plain_join(rows, corpus_pipeline.WIDTH, corpus_pipeline.ALIKE).items() if d == c}

    before = {r["doc_id"]: r["text"] for r in single.collect()}
    after = {r["doc_id"]: r for r in masked.collect()}
    assert before.keys() == after.keys() and all(len(r["text"]) == r["n_chars"] for r in after.values())
    spans = {r["doc_id"]: r["spans"] for r in secret_scan.find_secrets(single).collect()}
    assert all((before[d] == after[d]["text"]) == (not spans[d]) for d in before)

    assert {r["doc_id"] for r in mixed.collect()} <= set(after) and mixed.groupBy("doc_id").count().where("count > 2").count() == 0

    from tokenizers import Tokenizer
    made = Tokenizer.from_file(packing.tokenizer_file())
    tokens = sum(len(made.encode(r["text"], add_special_tokens=False).ids) + 1 for r in mixed.collect())
    assert packed.agg({"length": "sum"}).first()[0] == tokens
    first = packed.first()
    ids = np.frombuffer(first["ids"], "<u2")
    assert len(ids) == first["length"]


def written(docs, spark, folder):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_run_over_odd_rows(spark, docs, tmp_path):
    """Nulls, repeated rows and columns that operators also name go through every stage."""
    packed = corpus_pipeline.run(spark, written(docs, spark, tmp_path)).collect()
    assert {r["sequence_id"] for r in packed} == set(range(len({r["sequence_id"] for r in packed}))) and packed


def test_run_over_an_empty_table(spark, nothing, tmp_path):
    assert corpus_pipeline.run(spark, written(nothing, spark, tmp_path)).count() == 0
