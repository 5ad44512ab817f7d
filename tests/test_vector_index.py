"""The coded vector index against exact neighbours: recall, the share of pairs that are compared, and its edges."""

import numpy as np
import pytest

from lumenforge.operators import retrieval, vector_index


def frame(spark, m):
    return spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(m)], "id long, v array<double>")


def recall(index, queries, df, k, n):
    want = {(r["query"], r["doc"]) for r in retrieval.vector_top_k(queries, df, "id", "v", k).collect()}
    got = {(r["query"], r["doc"]) for r in index.search(queries, "id", "v", n).collect()}
    return len(got & want) / len(want)


@pytest.mark.parametrize("kind", ["clustered", "independent"])
def test_recall_and_share_of_pairs(spark, kind):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(4000, 32)) * (0.5 if kind == "clustered" else 1.0)
    if kind == "clustered":
        m += 3 * rng.normal(size=(30, 32))[rng.integers(0, 30, 4000)]
    df = frame(spark, m)
    queries = df.where("id % 50 = 0")
    index = vector_index.VectorIndex(df, "id", "v", 10, sample=1500)
    assert index.codes.count() == 4000
    assert index.candidates(queries, "id", "v", 100).count() <= 0.03 * 4000 * 80
    assert recall(index, queries, df, 10, 100) >= 0.9
    if kind == "clustered":
        assert index.model.probes < 16  # of 64 lists


def test_given_vectors(spark, sf_dir):
    """Recall of 0.9 from under a fifth of all pairs, on vectors that are nearly independent."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").selectExpr("vec_id AS id", "embedding AS v")
    queries = df.where("id % 50 = 0")
    index = vector_index.VectorIndex(df, "id", "v", 10)
    assert index.candidates(queries, "id", "v", 80).count() < 0.2 * df.count() * queries.count()
    assert recall(index, queries, df, 10, 80) >= 0.9


def test_edges(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [1.0, 0.1, 0.0]), (3, [0.0, 0.0, 0.0]), (4, None), (None, [1.0, 0.0, 0.0]), (5, [0.0, 1.0, 0.0])], "id long, v array<double>")
    index = vector_index.VectorIndex(df, "id", "v", 2)
    got = sorted((r["query"], r["rank"], r["doc"]) for r in index.search(df, "id", "v", 4).collect() if r["query"] in (1, 5))
    assert got == [(1, 1, 2), (1, 2, 3), (5, 1, 2), (5, 2, 1)]
    none = vector_index.VectorIndex(df.where("false"), "id", "v", 2)
    assert none.search(df, "id", "v", 4).count() == 0


def test_tasks_of_the_exact_search_grow_with_the_pairs_of_blocks():
    from lumenforge.operators import retrieval

    assert retrieval.pair_tasks(10, 100, 2048, 8) == 8
    assert retrieval.pair_tasks(12_300, 615_000, 2048, 12) * retrieval.TASK_PAIRS >= 7 * 301
