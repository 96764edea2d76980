import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.compare import compare
from tests.llm import brute
from tests.llm.conftest import SCHEMA
from vigil.llm import mixing, pieces, queries
from vigil.llm.common import materialise


def test_stages_match_brute_force(spark, clean_rows, tmp_path):
    """run() over a fixture whose groups are too small for estimates, so that
    the quality stage is its base rule, against plain versions of each stage."""
    spark.createDataFrame(clean_rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    rows = {r[0]: r for r in clean_rows if not brute.base_failed(r[1])}
    groups: dict = {}
    for i, r in rows.items():
        groups.setdefault(brute.stripped(r[1]), []).append((-len(r[1]), i))
    rows = {i: rows[i] for i in (min(m)[1] for m in groups.values())}
    near = brute.components({i: r[1] for i, r in rows.items()}, 5, 80)
    rows = {i: r for i, r in rows.items() if near[i] == i}
    cells: dict = {}
    for r in rows.values():
        k = (r[3], r[2], brute.topic(r[1]))
        cells[k] = cells.get(k, 0) + len(brute.words(r[1]))
    p = brute.probabilities(cells, mixing.TEMPER, mixing.DIMS, mixing.BUDGET)
    rows = {i: r for i, r in rows.items() if brute.draw(i) < p[(r[3], r[2], brute.topic(r[1]))]}
    assert rows and set(got) == set(rows)
    with open(pieces.default_vocabulary(), "rb") as f:
        made = pieces.Pieces.from_model(f.read())
    for i, r in got.items():
        assert r["piece_ids"] == made.best_path(b" " + r["text"].encode())[0] and r["round_trip"]


def test_stages_keep_columns_and_take_odd_rows(spark, documents, none):
    docs = documents.withColumn("kept", F.lit(1)).withColumn("topic", F.lit("t"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = materialise(stage(spark, docs, ""), name)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count()
        docs = out
        assert stage(spark, none, "").isEmpty()


@pytest.mark.parametrize("name", [n for n, (_, sql) in queries.REGISTRY.items() if sql])
def test_queries_match_sql(spark, name):
    found = compare(spark, name, "/root/testdata/sf0.001")
    assert found["cols_match"] and found["mismatch"] == 0 and found["spark_rows"] == found["duck_rows"] > 0


def test_one_query_per_operator_over_whole_tables(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names
    for n in range(1, 14):
        assert sum(bool(re.match(rf"op{n}_", x)) for x in names) == 1
    for name in ("op2_html_blocks", "op7_licences", "op8_repeats", "op10_sentencepiece", "op4_quality_rules"):
        table = "pages" if name.startswith("op2") else "documents"
        rows = spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet").count()
        assert names[name](spark, "/root/testdata/sf0.001").count() == rows
