"""Claims cut on bytes against the rule by expressions; what clusters of claims leave on disk."""

import random
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenforge.operators import clusters, sentence_cut, text_tables
from lumenforge.sources.storage import shared_dir

BITS = ["Dr. ", "Mrs. ", "éDr. ", "_vs. ", "2St. ", "(i.e. ", "e.g.  ", "etc.\n", "… ", "NOT ", "never ", "isn’t ", "12 km ", "3,5 % ", "1.2.3 kg ", "7 billion ", "\n", "\n \n", "\t", "  ", ". ", "! ", ".\t\n", "aaaaaa ", "éééééé", "abababababab ", "––––––", "privacy Policy ", "A", "Éa ", "x²³ ", "the harbour bridge of the northern town ", "opened its gates, ", "größer als ", "Ünder ", "5 tb", "\r\r\r", "ŒUVRE ", "  . "]
OTHERS = ["。日本語の文です。これは長い文章であり、二十文字以上あります。", "İstanbul is a big city that lies on two continents, 5 km apart. Right.", "Ⱥ wide river runs below the harbour bridge of the town.", "The π of the northern harbour town is about 3 and a bit more."]


def test_claims_on_bytes_follow_the_rule(spark):
    rng = random.Random(4)
    rows = [(k, "".join(rng.choice(BITS) for _ in range(rng.randint(0, 60)))) for k in range(800)] + [(9000 + k, t) for k, t in enumerate([*OTHERS, "", None])]
    df = spark.createDataFrame(rows, "doc_id long, text string").where("text IS NOT NULL")
    told = lambda d: sorted((r.doc_id, r.n, r.claim, round(100 * r.score), r.negated, [tuple(q) for q in r.quantities]) for r in d.collect())
    want = text_tables._claims_by_rule(df, "doc_id", "text", ()).withColumn("score", F.col("score") / 100)
    got = text_tables.claims(df, "doc_id", "text", None)
    assert told(got) == told(want) and got.count() > 800
    assert sentence_cut.plain(pa.array([*OTHERS, "", "aé–ſ"])).tolist() == [False] * len(OTHERS) + [True, True]
    # sets of words are the same whether they are cut with the claims or from their texts
    sets = lambda d: {(r.doc_id, r.n): (bytes(r.s), list(r.w)) for r in d.collect()}
    assert sets(text_tables.claims(df, "doc_id", "text", None, sets=True)) == sets(clusters.hashed_sets(got, "claim"))


def test_rows_with_one_key_count_as_one_text(spark):
    line = "The harbour bridge of the northern town opened its gates."
    df = spark.createDataFrame([(1, f"{line} {line}"), (1, f"Well. {line}"), (2, line)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n) for r in text_tables.claims(df, "doc_id", "text").collect()) == [(1, 0), (2, 0)]
    assert sorted((r.doc_id, r.n) for r in text_tables.claims(df, "doc_id", "text", None, sets=True).collect()) == [(1, 0), (2, 0)]


def test_clusters_of_claims_leave_no_texts_or_sets_on_disk(spark):
    texts = [f"The harbour bridge number{k % 40} of town{k % 7} opened its {k % 3} gates to carts and boats." for k in range(300)]
    df = spark.createDataFrame([(k, t, "s") for k, t in enumerate(texts)], "doc_id long, text string, source string")
    there = lambda: {p.name for p in Path(shared_dir(spark).removeprefix("file:")).iterdir() if p.is_dir()}
    before = there()
    c = text_tables.claims(df, "doc_id", "text", None, ("source",), sets=True).withColumn("claim_id", F.concat_ws("-", "doc_id", "n"))
    assert text_tables.claim_clusters(c, "claim_id").count() == 300
    left = {name.rsplit("-", 1)[0] for name in there() - before}
    assert "claim-clusters" in left and not left & {"claims", "claim-words", "claim-classes", "word-sets", "word-classes", "numbered-sets", "near-candidates", "near-pairs", "near-halves"}


@pytest.mark.parametrize("turns", [1, 3])
def test_turns_lose_no_pair(spark, monkeypatch, turns):
    monkeypatch.setattr(clusters, "TURNS", turns)
    monkeypatch.setattr(clusters, "TURN_SETS", 1)
    monkeypatch.setattr(clusters, "PACKED_ROWS", 50)
    monkeypatch.setattr(clusters, "SET_PAIRS", 1 if turns == 1 else 100)
    rng = random.Random(6)
    sets = sorted({tuple(sorted({f"w{rng.randint(0, 60)}" for _ in range(rng.randint(1, 9))})) for _ in range(250)})
    rows = [(f"k{n:04d}", list(w)) for n, w in enumerate(sets)]
    wanted = {(a, b) for a, v in rows for b, w in rows if a < b and len({*v} & {*w}) / len({*v} | {*w}) >= 0.38}
    got = clusters.class_pairs(spark.createDataFrame(rows, "c string, w array<string>"), 0.38).collect()
    assert {(r.a, r.b) for r in got} == wanted and len(got) == len(wanted)
