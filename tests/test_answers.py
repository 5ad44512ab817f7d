"""Extractive answers against a plain loop over all sentences."""

import random

from lumenforge.operators import ranking


def test_sentences_behind_many_near_equal_ones_are_taken(spark):
    same = "The harbour bridge opened its gates in the spring morning. "
    results = spark.createDataFrame([(1, 1, same * 30 + "The harbour rates rose. Gates of the bridge closed."), (1, 2, "A bridge is near.")], "query long, rank int, text string")
    queries = spark.createDataFrame([(1, ["bridge", "gates", "harbour"])], "query long, terms array<string>")
    row = ranking.extractive_answer(results, queries, "query", "rank", "text").first()
    assert (row.sentences, row.answer) == (4, same.strip() + " [1] The harbour rates rose. [1] Gates of the bridge closed. [1] A bridge is near. [2]")


def test_answers_against_a_loop(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(14)]
    made = {(q, r): [" ".join(rng.sample(words, rng.randint(1, 6))) + "." for _ in range(40)] for q in range(4) for r in range(1, 4)}
    results = spark.createDataFrame([(q, r, " ".join(s)) for (q, r), s in made.items()], "query long, rank int, text string")
    terms = {q: sorted(rng.sample(words, 4)) for q in range(4)}
    got = {r.query: (r.sentences, r.answer) for r in ranking.extractive_answer(results, spark.createDataFrame(list(terms.items()), "query long, terms array<string>"), "query", "rank", "text").collect()}
    for q in range(4):
        told = sorted((-len({*s[:-1].split()} & {*terms[q]}), r, p, s) for (o, r), listed in made.items() if o == q for p, s in enumerate(listed))
        taken, sets = [], []
        for hit, r, p, s in told:
            own = {*s[:-1].split()}
            if hit and len(taken) < 5 and all(len(own & w) / len(own | w) <= 0.7 for w in sets):
                taken.append((r, p, s))
            sets.append(own)
        assert got[q] == (len(taken), " ".join(f"{s} [{r}]" for r, _, s in sorted(taken)))
