"""The stages of the pipeline one by one against brute force over what the stage before kept."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from postweir.llm import buffers, leaks, pii, toxicity
from postweir.llm.catalog import CATEGORIES
from tests.llm import cases
from tests.llm.test_copies import expected_components
from tests.llm.test_formats import check_packing
from tests.llm.test_texts import plain_spans


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output of each stage, by name."""
    root = tmp_path_factory.mktemp("stages")
    docs, seen = cases.documents(spark), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, cases.SF).write.parquet(str(root / name))
        after = spark.read.parquet(str(root / name))
        seen[name] = (docs.select("doc_id", "text").collect(), after)
        docs = after
    return seen


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_columns_stay(stages, spark):
    for name, (_, after) in list(stages.items())[:-1]:
        assert after.columns == cases.documents(spark).columns, name


def test_toxicity(stages, spark):
    before, after = stages["toxicity"]
    docs = cases.documents(spark)
    model = toxicity.fit(docs, spark.read.parquet(f"{cases.SF}/labels.parquet"), CATEGORIES)
    bad = {r.doc_id for r in toxicity.score(docs, model, CATEGORIES).where(F.col("p_toxic") > 0.5).collect()}
    assert bad and set(texts(after)) == {r.doc_id for r in before} - bad


def test_near_copies(stages):
    before, after = stages["near_copies"]
    components = expected_components([(r.doc_id, r.text) for r in before])
    assert set(texts(after)) == {d for d, (_, c) in components.items() if d == c}


def test_decontamination(stages, spark):
    before, after = stages["decontamination"]
    items = [r.text for r in spark.read.parquet(f"{cases.SF}/benchmark.parquet").collect()]
    flat = lambda t: re.sub(r"[\x20\x09-\x0d]+", " ", (t or "").lower())
    bad = {r.doc_id for r in before if any(flat(i) in flat(r.text) for i in items)}
    assert bad and set(texts(after)) == {r.doc_id for r in before} - bad


def test_masking(stages):
    before, after = stages["personal_data"]
    masked = texts(after)
    assert set(masked) == {r.doc_id for r in before}
    hit = 0
    for r in before:
        spans = plain_spans(r.text or "")
        hit += bool(spans)
        if not spans:
            assert masked[r.doc_id] == r.text
        else:
            assert not plain_spans(masked[r.doc_id]) and f"[{spans[0][3].upper()}]" in masked[r.doc_id]
    assert hit


def test_packing(stages):
    before, after = stages["packing"]
    pieces = after.collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in before}
    made, least = check_packing(pieces, 4096)
    assert made <= least + 1


def test_repeated_rows_and_empty_tables(spark):
    rows = [(1, "a b c d e f", 1), (1, "a b c d e f", 1), (2, "a b c d e f", 2), (None, "a b c d e f", 3), (None, None, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id long")
    kept = corpus_pipeline.drop_near_copies(spark, docs, cases.SF).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in kept) == [(0, 3), (0, 4), (1, 1)]
    rows = [(1, "a b c d e f", "x"), (3, "a b c d e f", "x"), (3, "g h i j k l m", "x"), (5, "g h i j k l m", "y"), (7, "", "x"), (7, "", "y"), (7, "n o p q r s", "x"), (7, "n o p q r s", "y"), (7, "N o p q r s", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _stays string")
    kept = corpus_pipeline.drop_near_copies(spark, docs.withColumnRenamed("_stays", "label"), cases.SF).collect()
    assert sorted((r.doc_id, (r.text or "").lower()) for r in kept) == [(1, "a b c d e f"), (3, "g h i j k l m"), (7, ""), (7, ""), (7, "n o p q r s")]
    clashing = ["_text", "leaks", "p_toxic", "p_quality", "_spans", "_code", "base", "spans", "row", "kept", "_id", "_hash", "_stays", "_place", "masked", "hit", "a.b", "text_hash", "piece"]
    named = cases.documents(spark).select("doc_id", "text", "n_chars", *[F.lit(i).alias(c) for i, c in enumerate(clashing)])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        named = spark.createDataFrame(stage(spark, named, cases.SF).collect(), named.schema)
        assert named.columns == ["doc_id", "text", "n_chars", *clashing] and tuple(named.first()[3:]) == tuple(range(len(clashing)))
    assert corpus_pipeline.STAGES[-1][1](spark, named, cases.SF).count() >= named.count() > 50
    model = toxicity.fit(named, spark.read.parquet(f"{cases.SF}/labels.parquet"), CATEGORIES)
    assert "p_toxic" in toxicity.score(named, model, CATEGORIES).columns and leaks.find_leaks(named, named.select(F.col("doc_id").alias("item_id"), "text").limit(0)).count() == named.count()
    assert pii.find_personal_data(named).columns.count("spans") == 1
    empty = cases.empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, cases.SF).count() == 0


def test_entry_has_the_queries():
    names = contract.queries()
    assert "pipeline" in names and sum(n.startswith("op") and n[2].isdigit() for n in names) == 13


def test_texts_reach_python_once_in_small_batches(spark):
    rows = [(i, None if i == 7 else f"{i} " + "plain words of a text " * 200, "x") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `text ` string").coalesce(1)
    items = spark.createDataFrame([(1, "something that no text holds, long enough to be looked for")], "item_id long, text string")
    found = leaks.find_leaks(docs, items)
    assert found.columns == [*docs.columns, "leaks"] and found.drop("leaks").exceptAll(docs).isEmpty() and found.count() == 3000
    scored = toxicity.score(docs, (np.zeros(0, np.uint64), []), CATEGORIES)
    assert scored.columns[:3] == docs.columns and scored.select(docs.columns).exceptAll(docs).isEmpty() and scored.count() == 3000
    assert leaks.find_leaks(docs, items, keep=["text"]).columns == ["text", "leaks"]

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    assert docs.mapInArrow(sizes, "n long").agg({"n": "max"}).first()[0] < 5 << 20
    assert "text" not in docs.select(buffers.kept_columns(docs.columns)).schema["kept"].dataType.names
    assert "text" not in corpus_pipeline._packed(docs).schema["row"].dataType.names
