"""Entity mentions against plain searches: every place of every entry, what hides what, and the whole documents table."""

import collections
import random

import pytest

from lumenforge.operators import dictionary as D


def plain_matches(text, entries):
    low, found = D.lowered(text), []
    for kind, entry in sorted({(k, D.lowered(e)) for k, e in entries if e}):
        at = low.find(entry)
        while at >= 0:
            end = at + len(entry)
            free = (at == 0 or low[at - 1] in D.BORDER) and (end == len(low) or low[end] in D.BORDER)
            if free or len(entry) > 3:
                found.append((at, end, kind, entry))
            at = low.find(entry, at + 1)
    found.sort(key=lambda m: (m[0], -m[1], m[2], m[3]))
    return [m for i, m in enumerate(found) if not any(o[2] == m[2] and o[0] <= m[0] and o[1] >= m[1] for o in found[:i])]


def test_matches_against_plain_search():
    rng = random.Random(7)
    for _ in range(400):
        letters = "aAbİ é.-"
        entries = [(rng.choice("xy"), "".join(rng.choice(letters) for _ in range(rng.randint(1, 6)))) for _ in range(rng.randint(1, 8))]
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))
        assert D.matches(text, D.automaton_of(entries)) == plain_matches(text, entries)
    assert D.automaton_of([]) is None and D.automaton_of([("x", "")]) is None


def test_entities_of_a_text():
    automaton = D.automaton_of([("product", "Galaxy"), ("product", "Galaxy S24"), ("organization", "Galaxy"), ("product", "AI")])
    text = "Ask ai@b.org in 2024: the Galaxy S24 has AI, said Jane Doe of Galaxy Fans; fair, 5 km."
    got = [(k, m, e) for k, m, e, *_ in D.entities_of(text, automaton)]
    assert got == [("email", "ai@b.org", "ai@b.org"), ("year", "2024", "2024"), ("product", "Galaxy S24", "galaxy s24"), ("organization", "Galaxy", "galaxy"), ("product", "AI", "ai"), ("concept", "Jane Doe", "Jane Doe"), ("product", "Galaxy", "galaxy"), ("quantity", "5 km", "5 km")]


def test_mentions_and_summary(spark):
    rows = [(1, "MIT and GNU General Public License"), (2, None), (3, ""), (4, "nothing here"), (1, "mail a@b.cd"), (5, "in 1999, Mary Ann Evans")]
    names = spark.createDataFrame([("body", "GNU"), ("body", "MIT"), ("text", "GNU General Public License"), ("text", "Public"), ("text", None)], "kind string, entry string")
    df = spark.createDataFrame(rows, "doc_id long, t string")
    told = {(r.doc_id, r.kind, r.mention, r.start) for r in D.mentions(df, "doc_id", "t", names).collect()}
    assert told == {(1, "body", "MIT", 0), (1, "body", "GNU", 8), (1, "text", "GNU General Public License", 8), (1, "concept", "General Public License", 12), (1, "email", "a@b.cd", 5), (5, "year", "1999", 3), (5, "concept", "Mary Ann Evans", 9)}
    got = {r.doc_id: (r.entities, r.kinds, r.primary_kind, r.primary) for r in D.summary(D.mentions(df, "doc_id", "t", names), "doc_id").collect()}
    assert got == {1: (5, "body=2,concept=1,email=1,text=1", "email", "a@b.cd"), 5: (2, "concept=1,year=1", "year", "1999")}
    assert {r.kind for r in D.mentions(df, "doc_id", "t", names.where("false")).collect()} == {"concept", "email", "year"}
    with pytest.raises(ValueError):
        D.ENTRIES, kept = 2, D.ENTRIES
        try:
            D.mentions(df, "doc_id", "t", names)
        finally:
            D.ENTRIES = kept


def test_whole_table(spark, sf_dir):
    from lumenforge.plans import text_queries as TQ

    names = [(r.kind, r.entry) for r in TQ.names(spark, sf_dir).collect()]
    automaton, want = D.automaton_of(names), {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        found = D.entities_of(r.text or "", automaton)
        assert [m for m in D.matches(r.text or "", automaton)] == plain_matches(r.text or "", names)
        if found:
            best = min(found, key=lambda e: (-e[4], e[3], e[0]))
            counts = collections.Counter(e[0] for e in found)
            want[r.doc_id] = (len(found), ",".join(f"{k}={n}" for k, n in sorted(counts.items())), best[4])
    got = {r.doc_id: (r.entities, r.kinds, D.PATTERNS[r.primary_kind][1] if r.primary_kind in D.PATTERNS else D.CONCEPT if r.primary_kind == "concept" else D.KNOWN) for r in TQ.t16_entities(spark, sf_dir).collect()}
    assert got == want and any("passage=" in v[1] for v in got.values())
