"""The pipeline, stage by stage, against what each stage must leave."""

import glob
import os
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
import __spark_entry__ as entry  # noqa: E402
import corpus_pipeline  # noqa: E402
from sensorframe.llm import queries  # noqa: E402

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(entry.__file__)), "tools"))
from check_oracles import rows_of  # noqa: E402

from test_operators import SCHEMA, bag, corpus, prose, slow_base, slow_base_spans, slow_components  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


def test_stages_keep_clean_documents_and_drop_the_rest(spark):
    rows = [(i, prose(i, 50 + i), "en", "s", 0, "x", 1, 2) for i in range(30)]
    rows += [(100, rows[3][1], "en", "s", 0, "x", 1, 2), (101, rows[4][1] + " end", "en", "s", 0, "x", 1, 2), (102, "too short", "en", "s", 0, "x", 1, 2)]
    rows += [(103, prose(500, 60) + " token = abcdefgh1234", "en", "s", 0, "x", 1, 2), (104, None, None, None, None, None, None, None), (None, prose(700, 40), "en", "s", 0, "x", 1, 2)]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.pin(stage(spark, docs, SF_DIR), "stage")
        assert docs.schema == spark.createDataFrame([], SCHEMA).schema
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    clean = set(range(30))
    assert set(kept["quality rules"]) == clean | {100, 101, 103, None}
    assert set(kept["exact dedup"]) == clean | {101, 103, None}
    assert set(kept["near duplicates"]) == clean | {103, None}
    assert kept["secret scan"][103].endswith("[SECRET]") and all(kept["secret scan"][i] == rows[i][1] for i in clean)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    assert {r.doc_id for r in packed.collect()} == clean | {103, None}


def test_stages_take_odd_and_empty_tables(spark):
    for rows in (corpus(), []):
        docs = spark.createDataFrame(rows, SCHEMA)
        for _, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.pin(stage(spark, docs, SF_DIR), "stage")
        assert (docs.count() > 0) == bool(rows)


def test_pipeline_over_the_table_against_brute_force(spark):
    """Every stage on what its predecessor kept, over the whole smallest table."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = corpus_pipeline.pin(stage(spark, docs, SF_DIR), "stage")
        assert docs.columns == columns
        after = {r.doc_id: r.text for r in docs.collect()}
        assert set(after) <= set(before)
        if name == "quality rules":
            assert not any(slow_base(t)[-1] for t in after.values())
        elif name == "exact dedup":
            first = {}
            for i in sorted(before):
                first.setdefault(before[i], i)
            assert set(after) == set(first.values())
        elif name == "near duplicates":
            assert set(after) == {i for i, _, least in slow_components(sorted(before.items())) if i == least}
        else:
            assert set(after) == set(before)
            assert all((after[i] == t) or slow_base_spans(t) for i, t in before.items())
            assert not any(slow_base_spans(t) for t in after.values())
    packed = corpus_pipeline.run(spark, SF_DIR)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(after)


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_query_equals_oracle(spark, name):
    duck = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        duck.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    result = duck.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    df = entry.queries()[name](spark, SF_DIR)
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, result.fetchall())


def test_quality_model_predicts_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = entry.queries()["op2_quality_model"](spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    held = got.where("held_out").join(labels, "doc_id")
    assert held.where(F.col("predicted") == F.col("quality")).count() >= 0.95 * held.count() > 0


def test_every_query_returns_every_row(spark):
    """Queries over documents return each of them, queries over pages each page; op7 returns pieces and op13 words."""
    for name, query in queries.queries().items():
        table, key = ("pages", "page_id") if name.startswith("op9_") else ("documents", "doc_id")
        got = query(spark, SF_DIR)
        want = bag(spark.read.parquet(f"{SF_DIR}/{table}.parquet").select(key).collect())
        if name == "op7_best_fit_packing":
            assert set(bag(got.select(key).collect())) == set(want)
        elif name != "op13_spelling_variants":
            assert bag(got.select(key).collect()) == want, name
