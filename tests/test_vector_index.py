"""The approximate index against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmill import catalog
from quillmill.operators import vector_index


def recall(approximate, exact):
    got, want = ({(r["query_id"], r["id"]) for r in f.collect()} for f in (approximate, exact))
    return len(got & want) / len(want)


def test_recall_of_the_query(spark, data):
    approximate, exact = (catalog.QUERIES[name](spark, data) for name in ("top2_approximate_top_k", "top1_top6_dns1_cosine_top_k"))
    assert recall(approximate, exact) >= 0.95
    both = approximate.join(exact.select("query_id", "id", F.col("score").alias("exact")), ["query_id", "id"])
    assert both.filter(F.abs(F.col("score") - F.col("exact")) > 1e-5).count() == 0  # scores are exact


@pytest.fixture(scope="module")
def clustered(spark):
    rnd = np.random.default_rng(0)
    centers = rnd.normal(size=(8, 16))
    rows = [(i, [float(x) for x in centers[i % 8] + 0.3 * rnd.normal(size=16)]) for i in range(1600)]
    rows += [(2000 + i, rows[0][1]) for i in range(400)]  # one vector very often
    return spark.createDataFrame([*rows, (5000, None)], "id long, embedding array<double>").repartition(3)


def exact_of(questions, vectors, k):
    from quillmill.operators.retrieval import dense_top_k

    return dense_top_k(questions, vectors, k)


def test_few_cells_and_few_exact_scores_are_enough_where_vectors_have_clusters(spark, clustered, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "SLICE", 150)  # hot cells are cut
    index = vector_index.build(clustered, str(tmp_path / "i"), cells=24, parts=8, words=64)
    assert index.rows.count() == 2000 and max(index.slices.values()) > 1
    questions = clustered.filter("id % 37 = 0 AND id < 1600 AND id % 8 <> 0").withColumnRenamed("id", "query_id")
    got = vector_index.search(questions, index, 10, probe=8, rerank=100)
    assert recall(got, exact_of(questions, clustered.filter("embedding IS NOT NULL"), 10)) >= 0.95
    assert vector_index.search(questions, index, 10, probe=24, rerank=5000).count() == 10 * questions.count()
    assert recall(vector_index.search(questions, index, 10, probe=24, rerank=5000), exact_of(questions, clustered.filter("embedding IS NOT NULL"), 10)) == 1.0


def test_small_and_empty_tables(spark, tmp_path):
    two = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, embedding array<double>")
    index = vector_index.build(two, str(tmp_path / "a"), parts=2)
    got = vector_index.search(two.withColumnRenamed("id", "query_id"), index, 5, probe=3, rerank=9).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["id"], r["rank"]) for r in got] == [(1, 1, 1), (1, 2, 2), (2, 2, 1), (2, 1, 2)]


def test_more_words_than_a_byte_are_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        vector_index.build(spark.createDataFrame([(1, [1.0])], "id long, embedding array<double>"), str(tmp_path / "a"), words=300)
