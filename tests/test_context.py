"""Context packs: how sentences are packed, which packs are taken, and where the choice ends."""

from lumenforge.operators import ranking


def words(tag, n):
    return " ".join(f"{tag}{k}" for k in range(n)) + "."


def test_sentence_packs():
    assert ranking.sentence_packs(["aaaa", "bbbb", "cc", "d" * 20, "e"], 8) == ["aaaa bbbb", "cc", "d" * 20, "e"]
    assert ranking.sentence_packs([], 8) == []


def chosen(spark, rows, **options):
    df = spark.createDataFrame(rows, "q long, rank int, title string, text string")
    return sorted((r.q, r.n, r["rank"], r["pack"]) for r in ranking.context_packs(df, "q", "rank", "title", "text", **options).collect())


def test_choice_by_score_difference_and_budget(spark):
    near = words("a", 30)
    rows = [(1, 1, "t", near), (1, 2, "t", near.replace("a29", "zz")), (1, 3, "b0 b1", words("b", 40)), (1, 4, None, "Too short."), (1, 5, "t", words("c", 15)), (2, 1, "t", words("d", 50)), (3, 1, "t", None)]
    # the near copy is passed over, the short one does not count
    assert chosen(spark, rows) == [(1, 1, 1, near), (1, 2, 3, words("b", 40)), (1, 3, 5, words("c", 15)), (2, 1, 1, words("d", 50))]
    # the title inside lifts the third result above the second rank's score
    assert [r[2] for r in chosen(spark, rows[:3], limit=1.0, packs=2)] == [1, 3]
    assert [r[2] for r in chosen(spark, rows, packs=1)] == [1, 1]
    assert [r[:3] for r in chosen(spark, rows, total_chars=len(near) + len(words("b", 40)))][:2] == [(1, 1, 1), (1, 2, 3)]
    assert chosen(spark, rows, total_chars=60) == []


def test_long_texts_give_several_packs(spark):
    text = " ".join(words(f"s{k}w", 60) for k in range(9))
    got = chosen(spark, [(1, 1, "t", text)], packs=3)
    assert [r[1] for r in got] == [1, 2, 3] and all(len(r[3]) <= 800 for r in got) and text.startswith(got[0][3])
