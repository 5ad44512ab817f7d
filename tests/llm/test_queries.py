"""The registered queries of the operators: their SQL where there is one, whole results otherwise; and the pipeline."""

import pytest

import corpus_pipeline
from lumenforge.llm import jaccard_join, queries
from tests.llm import test_operators as brute
from tests.oracle import compare, connect


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, sf_dir, name):
    assert compare(queries.QUERIES[name](spark, sf_dir), connect(sf_dir), queries.ORACLE_SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - {"op6_chat", "op3_html_text", "op11_ranked_search", "op13_conversation_trie"}))
def test_row_for_each_document(spark, sf_dir, name):
    assert queries.QUERIES[name](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_substring_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    want = brute.brute_repeats([r.text for r in rows], 35)
    got = {r.doc_id: (r.n_words, r.n_removed) for r in queries.QUERIES["op7_substring_dedup"](spark, sf_dir).collect()}
    assert [got[r.doc_id] for r in rows] == [w[:2] for w in want]


def test_pipeline_is_its_stages(spark, sf_dir):
    """Each stage against what its operator's own definition gives on the stage's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:2]:
        after = stage(spark, docs, sf_dir).cache()
        assert after.columns == columns and 0 < after.count() < docs.count(), name
        docs = after
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, sf_dir).cache()
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    _, components = brute.brute_components([r.text for r in rows[:250]])
    small = docs.where(docs.doc_id <= rows[min(249, len(rows) - 1)].doc_id)
    assert {r.doc_id for r in jaccard_join.representatives(small).collect()} == {rows[c].doc_id for c in components}
    cut = corpus_pipeline.substring_stage(spark, kept, sf_dir).orderBy("doc_id").collect()
    before = kept.orderBy("doc_id").collect()
    assert [r.text for r in cut] == [w[2] for w in brute.brute_repeats([r.text for r in before], 35)]
    packed = corpus_pipeline.run(spark, sf_dir)
    assert packed.count() == kept.count() and set(columns) <= set(packed.columns)


def edge_documents(spark):
    """Rows of documents with nulls, repeats, one id with two texts, a very long text, and a column of another kind."""
    base = " ".join(f"word{k}" for k in range(80))
    other = " ".join(f"other{k} thing{k % 7}" for k in range(60))
    rows = [(1, base, "en", "s", 10, {"a": 1}), (1, base, "en", "s", 10, {"a": 1}), (2, base + " more", "en", None, None, None), (1, other, None, "s", 3, {}), (None, other + " x", "de", "s", 1, None), (None, None, None, None, None, None), (3, "", "en", "s", 0, None), (4, "long text " * 30_000, "en", "s", 1, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _key map<string,int>")


def test_pipeline_stages_on_edge_rows(spark, tmp_path):
    """Each stage on its own: the columns stay, an empty table gives an empty one, and every row has its defined fate."""
    docs = edge_documents(spark)
    spark.createDataFrame([(1, 1, 0), (3, 0, 1), (4, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    told = {}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0, name
        out = stage(spark, docs, str(tmp_path))
        assert out.columns[: len(docs.columns)] == docs.columns, name
        told[name] = sorted((r.doc_id or 0, (r.text or "")[:6], len((r.text or "").split())) for r in out.collect())
    every = sorted((r.doc_id or 0, (r.text or "")[:6], len((r.text or "").split())) for r in docs.collect())
    assert {k[0] for k in told["quality"]} <= {0, 1, 2} and (3, "", 0) not in told["quality"]
    assert told["toxicity"] == every  # too few labels for a model
    assert told["near_duplicates"] == [(0, "", 0), (1, "other0", 120), (1, "word0 ", 80), (3, "", 0), (4, "long t", 60_000)]
    assert told["substring_dedup"] == [(0, "", 0), (0, "x", 1), (1, "", 0), (1, "", 0), (1, "", 0), (2, "more", 1), (3, "", 0), (4, "", 0)]
    assert told["packing"] == every
