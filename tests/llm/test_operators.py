"""The ten operators against brute-force versions, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import collections
import hashlib
import random
import re
import time
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenforge.llm import chat, flat, html_text, jaccard_join, licenses, ogg, packing, quality, queries, sentencepiece_bpe, shared, substring_dedup, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def edge_texts():
    rng = random.Random(5)
    base = [" ".join(rng.choice(["alpha", "beta", "Gamma", "delta.", "é", "日本"]) + str(rng.randint(0, 400)) for _ in range(120)) for _ in range(12)]
    near = [b.replace("alpha", "omega", 1) for b in base[:5]]
    passage = base[0][200:700]
    return base + near + [base[1], base[1], None, "", " \n\t ", "one", "one two", "One TWO", "a b c d e", "x " * 400, "y" * 50_000, passage + " tail", "head " + passage, "a\x00b c\x85d \x0b e"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "keep", 1) for k, t in enumerate(edge_texts())]
    rows += [rows[2], (None, "null id text " * 30, None, None), (None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, `Extra Col` string, n_words long").cache()


def empty(docs):
    return docs.where("false")


# packing


def best_padding(lengths, buckets):
    levels = sorted(set(lengths))
    n = collections.Counter(lengths)
    best = {(-1, 0): 0}
    for b in range(1, buckets + 1):
        for j in range(len(levels)):
            best[j, b] = min(best.get((i, b - 1), 1e18) + sum((levels[j] - levels[k]) * n[levels[k]] for k in range(i + 1, j + 1)) for i in range(-1, j))
    return min(v for (j, b), v in best.items() if j == len(levels) - 1)


def test_packing_is_optimal_and_within_budget(docs):
    out = packing.pack(docs.drop("n_words"), buckets=4, token_budget=300, shard_rows=3).toPandas()
    lengths = [len(WORD.findall(t or "")) for t in out["text"]]
    assert out["n_tokens"].tolist() == lengths
    assert int(out["padding"].sum()) == best_padding(lengths, 4)
    for _, batch in out.groupby("batch_id"):
        assert len(batch) == 1 or batch["bucket_length"].iloc[0] * len(batch) <= 300
        assert sorted(batch["slot"]) == list(range(len(batch)))


def test_packing_boundaries_random():
    rng = random.Random(1)
    for _ in range(60):
        lengths = [rng.randint(0, 40) for _ in range(rng.randint(1, 30))]
        c = sorted(collections.Counter(lengths).items())
        x, n = np.array([a for a, _ in c]), np.array([b for _, b in c])
        k = rng.randint(1, 6)
        ends = packing.boundaries(x, n, x * n, k)
        padding = sum(n[i] * (x[min(e for e in ends if e >= i)] - x[i]) for i in range(len(x)))
        assert padding == best_padding(lengths, k)


def test_packing_of_long_and_repeated_rows(spark):
    rng = random.Random(3)
    lengths = [rng.choice([rng.randint(0, 90), rng.randint(2000, 60_000)]) for _ in range(70)] + [5] * 300
    df = spark.createDataFrame([(1, n, {"k": n}, [(n, {"x": 1})]) for n in lengths], "doc_id long, n long, tags map<string,int>, more array<struct<a:int,b:map<string,int>>>")
    out = packing.pack(df.withColumn("text", F.lit("x")), F.col("n"), buckets=5, token_budget=100_000, shard_rows=20).toPandas()
    assert sorted(out["n_tokens"]) == sorted(lengths) and int(out["padding"].sum()) == best_padding(lengths, 5)
    assert all(len(b) == 1 or b["bucket_length"].iloc[0] * len(b) <= 100_000 for _, b in out.groupby("batch_id"))


def test_packing_of_nothing_and_clashing_names(docs):
    assert packing.pack(empty(docs)).count() == 0
    assert packing.pack(docs.withColumnRenamed("Extra Col", "bucket")).select("bucket").dropna().count() == docs.count()


# SentencePiece


def test_sentencepiece_is_the_library(spark, docs):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    out = sentencepiece_bpe.digests(docs, path).collect()
    assert len(out) == docs.count()
    want = collections.Counter()
    for r in docs.collect():
        ids = library.encode(r.text or "", add_bos=True, add_eos=True)
        want[r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()] += 1
    assert collections.Counter(tuple(r) for r in out) == want
    both = sentencepiece_bpe.decode(sentencepiece_bpe.encode(docs.withColumnRenamed("n_words", "ids"), path), path)
    assert all(r.decoded == library.decode(r.ids) for r in both.collect())
    assert sentencepiece_bpe.encode(empty(docs), path).count() == 0


def test_sentencepiece_random_strings():
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library, encoder = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_bpe.Encoder(path)
    rng = random.Random(9)
    parts = ["a", "b", "ab", " ", "  ", "▁", "\n", "\t", "the", "ing", "é", "日", "𝔘", "\x00", "aaaa", "==", "--", "</s>", "er", "in", "　", "\r", "ﬁ", "🙂"]
    for _ in range(1500):
        s = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        if rng.random() < 0.2:
            s = rng.choice(["a", "=", "-", " ", "ab", "the"]) * rng.randint(1, 200)
        ids = library.encode(s, add_bos=True, add_eos=True)
        assert encoder([s])[0].tolist() == ids
        assert encoder.vocabulary.decode(np.array(ids)) == library.decode(ids)
    for _ in range(500):
        ids = [rng.randint(0, 400) if rng.random() < 0.7 else rng.randint(0, 31999) for _ in range(rng.randint(0, 12))]
        assert encoder.vocabulary.decode(np.array(ids, np.int64)) == library.decode(ids)


# HTML


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var x="</p>";</script></head><body>
<div class="site-header"><a href="/">Home</a></div><nav><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></nav>
<div id="cookie-notice">We use cookies, please accept, thanks.</div>
<div class="wrap"><div class="post"><h1>Title &amp; more</h1><p>First  paragraph, with <b>bold</b>, commas, and &eacute;.<br>Next line.<p>Second one, long enough, to count as text.
<ul><li>item one<li>item <i>two</i></ul><table><tr><td>cell 1<td>cell 2</table><form><input>Subscribe, now</form><div class="ad">Buy, buy, buy</div></div>
<aside>Related, things</aside></div><section id="comments"><p>A reader, says, many, many, words, here, again and again.</p></section><footer>&copy; 2024</footer></body></html>"""


def test_html_keeps_the_article(spark):
    want = "Title & more\nFirst paragraph, with bold, commas, and é. Next line.\nSecond one, long enough, to count as text.\nitem one\nitem two\ncell 1\ncell 2"
    rows = [(1, "u", PAGE, "x"), (2, "u", None, "x"), (3, "u", "", "x"), (4, "u", "<p>just text", "x"), (5, "u", "plain, text", "x"), (6, "u", "<nav>menu</nav>", "x"), (1, "u", PAGE, "x"), (7, None, "<div>" * 3000 + "deep" + "</div>" * 10, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = html_text.extract(df, out_col="text").collect()
    assert [r.text for r in out] == [want, "", "", "just text", "plain, text", "", want, "deep"]
    assert html_text.extract(df.where("false")).count() == 0


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<article><header><h1>Head</h1><p>By Ann.</p></header><p>Text, long enough, to win here.</p></article>", "Head\nBy Ann.\nText, long enough, to win here."),
        ("<header><h1>Site</h1></header><article><p>Text, with commas, of the article.</p></article>", "Text, with commas, of the article."),
        ("<article><p>Before, the picture.</p><figure><img src=x><figcaption>A caption, too.</figcaption></figure><p>After it, more.</p></article>", "Before, the picture.\nA caption, too.\nAfter it, more."),
        ("<article><p>One, two, three.</p><p class='related'>This paragraph, which reads like text, is related to it.</p><div class='social-history'><p>A section, on history.</p></div></article>", "One, two, three.\nThis paragraph, which reads like text, is related to it.\nA section, on history."),
        ("<div class='page-header'>Top</div><div class=content><p>Body, of text, here.</p><div class='share-buttons'>Share, it, now</div><p class='advert'>Buy</p></div><div id=comments><p>Reader, says, a, lot, of, things, here.</p></div>", "Body, of text, here."),
        ("<div class='sidebarWrapper'><article><p>An article, inside, of it.</p></article></div>", "An article, inside, of it."),
        ("<p>a <b>bold<p>next</b> one &lt;x&gt; &#233;&nbsp;é", "a bold\nnext one <x> é é"),
        ("<p>2 < 3, and 4 > 3</p>", "2 < 3, and 4 > 3"),
        ("<p title='a>b'>quoted, end</p><p data-x=\"'>\">other</p>", "quoted, end\nother"),
        ("<p>text</p><!-- open <p>gone</p>", "text"),
        ("<article><p>甲，乙，丙。</p><table><caption>Cap</caption><tr><td>1<td>2</table></article>", "甲，乙，丙。\nCap\n1\n2"),
        ("<article><h1>T</h1><p>Body, text, here.</p><section class='comments'><article class='comment'><p>Nice, post, indeed, I, like, it.</p></article><article><p>Me, too, and, more, so.</p></article></section></article>", "T\nBody, text, here."),
        ("<main><article><p>Body, text, here, of it.</p></article><section id=comments><h2>Comments</h2><article class=comment><p>I, say, many, things, here, about, it, at, length.</p></article></section></main>", "Body, text, here, of it."),
        ("<article><p>Body, text.</p><article class='comment'><p>A, reader, says, so.</p></article><p>The end.</p></article>", "Body, text.\nThe end."),
        ("<article class='sidebar'><p>The only, article, of this page.</p></article>", "The only, article, of this page."),
        ("<article><p>One, two.</p><p class='advert'>Buy our wonderful thing today, it only costs you nine dollars, and more later.</p><p class='cookie-notice'>We use cookies on this site, so please accept them all, and read on.</p><p>Three.</p></article>", "One, two.\nThree."),
        ("<div><p>A short lead.</p><div class=content><p>The text, of it, with commas.</p><p>And more, of it, as well.</p></div><p>The end</p><blockquote>A quote, said so.</blockquote></div>", "A short lead.\nThe text, of it, with commas.\nAnd more, of it, as well.\nThe end\nA quote, said so."),
        ("<div><div class=content><p>The text, of it, with commas.</p><p>And more, of it, as well.</p></div><p><a href=x>Next page</a></p><p>Far, but a sentence.</p></div>", "The text, of it, with commas.\nAnd more, of it, as well.\nFar, but a sentence."),
        ("<article><p>Text, of it.</p></article><div class='sponsored'><article><p>A card, of a sponsor, to buy, and, to, have.</p></article></div>", "Text, of it."),
        ("<p>math <math><mi>x</mi></math>, and <svg><text>no</text></svg> more</p>", "math x, and more"),
    ],
)
def test_html_pages(page, want):
    assert html_text.main_text(page) == want


def test_html_is_linear_on_malformed_pages():
    n = 20_000
    for page in ("<a \"" * n, "<a =\"" * n, "<a =\"" * n + ">", "<svg>" * n, "<b>" + "<div></b>" * n, "<b>" * n + "<li>x" * n, "<!--" * n, "<" * n, "<p>" * n + "</q>" * n, "<ul><li>" * n, "<script>" * n, "<div class='ad'>" * n + "x"):
        began = time.time()
        assert isinstance(html_text.main_text(page), str) and time.time() - began < 4, page[:20]


# Jaccard join


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(texts):
    sets = [shingles(t) for t in texts]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and 100 * common >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return sets, [find(i) for i in range(len(sets))]


def near_copies(seed=3, groups=12, size=9):
    rng = random.Random(seed)
    texts, common = [], [f"c{rng.randint(0, 99)}" for _ in range(60)]
    for g in range(groups):
        words = [f"w{rng.randint(0, 3000)}" for _ in range(rng.randint(20, 200))] + (common if g % 3 == 0 else [])
        for _ in range(size):
            w = list(words)
            for _ in range(rng.randint(0, 14)):
                w[rng.randrange(len(w))] = f"e{rng.randint(0, 9999)}"
            texts.append(" ".join(w))
    return texts


def test_jaccard_components(spark):
    texts = edge_texts() + near_copies()
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, component_id int")
    sets, want = brute_components(texts)
    got = {r.doc_id: r for r in jaccard_join.components(df).collect()}
    assert [(got[k].n_shingles, got[k].component_id) for k in range(len(texts))] == [(len(s), c) for s, c in zip(sets, want)]
    kept = {r.doc_id for r in jaccard_join.representatives(df).collect()}
    assert kept == set(want)


def thue_morse(n, swapped=False):
    """The first n letters of the sequence over a and b: two complementary ones meet in every polynomial hash modulo 2^64."""
    return "".join("ab"[(bin(i).count("1") + swapped) % 2] for i in range(n))


def test_word_hashes_tell_words_apart():
    rng = random.Random(8)
    texts = [thue_morse(n, x) for n in (64, 1024, 2048, 4096) for x in (False, True)] + ["".join(rng.choice("abé") for _ in range(rng.randint(1, 40))) for _ in range(400)]
    column = " ".join(texts).encode()
    words = flat.Words(np.frombuffer(column, np.uint8), np.array([0, len(column)]))
    groups = collections.defaultdict(set)
    for text, h, k in zip(texts, words.hashes.tolist(), words.exact_ids().tolist(), strict=True):
        groups[text].add((h, k))
    assert all(len(x) == 1 for x in groups.values()) and len({h for x in groups.values() for h, _ in x}) == len(groups) == len({k for x in groups.values() for _, k in x})
    words.hashes[:] = 7  # numbers of words hold if hashes do not
    assert len(set(words.exact_ids().tolist())) == len(groups)
    ids = np.array([rng.randint(0, 2) for _ in range(200)])
    grams = flat.exact_grams(ids, 5).tolist()
    assert len(set(zip(grams, (tuple(ids[i : i + 5]) for i in range(196))))) == len(set(grams)) == len({tuple(ids[i : i + 5]) for i in range(196)})


def test_jaccard_null_ids_repeats_and_nothing(spark, docs):
    out = jaccard_join.components(docs)
    assert out.count() == docs.count()
    assert jaccard_join.components(empty(docs)).count() == 0
    # one id with two texts: two documents; equal rows: one; null ids and texts
    rows = [(1, "a b c d e f"), (1, "other words than those there"), (1, "A b c  d e f"), (None, "a b c d e f"), (None, "only null ids here"), (None, "only null ids here"), (2, None), (2, None), (3, "")]
    kept = jaccard_join.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, " ".join((r.text or "").lower().split())) for r in kept) == [(0, "only null ids here"), (1, "a b c d e f"), (1, "other words than those there"), (2, ""), (2, ""), (3, "")]


def test_jaccard_hot_shingles_blocks_and_like_words(spark, monkeypatch):
    """Every shingle that two documents hold is hot, runs are dealt over blocks, joins are salted: the result is the same."""
    for module, name, value in ((jaccard_join, "HEAVY_IN_PART", 1), (jaccard_join, "HOT_ROWS", 2), (jaccard_join, "SMALL_RUN", 2), (shared, "HOT_ROWS", 2), (shared, "BLOCK_ROWS", 3)):
        monkeypatch.setattr(module, name, value)
    texts = near_copies(7) + [thue_morse(1024), thue_morse(1024, True)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    _, want = brute_components(texts)
    assert sorted((r.doc_id, r.component_id) for r in jaccard_join.components(df).collect()) == list(enumerate(want))


def test_jaccard_group_work_is_linear():
    """100,000 near copies that share a shingle and a component make no pair, in well under a second a batch."""
    n = 100_000
    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int64)), pa.array(np.arange(n)), pa.array(np.full(n, 300 << jaccard_join.SIZE_BITS)), pa.array([b"one label"] * n, pa.binary()), pa.array(np.arange(n))], names=["shingle", "group", "place", "label", "before"])

    class Frame:  # only what small_runs asks of its table
        def __getattr__(self, name):
            return lambda *a: a[0] if name == "mapInArrow" else self

    began = time.time()
    assert list(jaccard_join.small_runs(Frame())(iter([batch]))) == [] and time.time() - began < 5


# licences


def test_license_headers_and_inheritance(spark):
    rows = [("a", "x/LICENSE", "Released under the MIT License.", "p"), ("b", "x/y/f.py", "code", "p"), ("c", "x/y/z/COPYING", "This work is licensed under the GNU General Public License, version 3.", "p"), ("d", "x/y/z/g.py", "print", "p"), ("e", "x/h.py", "# Licensed under the Apache License, Version 2.0.\ncode", "p"), ("f", "other/i.py", None, "p"), ("g", None, "", "p"), ("h", "x/y/k.py", "licence to fish and drive", "p")]
    df = spark.createDataFrame(rows, "id string, path string, text string, license string")
    out = {r.id: (r.license, r.license_source, r.license_directory) for r in licenses.scan(df).collect()}
    assert out["a"][:2] == ("MIT", "header") and out["e"][:2] == ("Apache-2.0", "header")
    assert out["b"] == ("MIT", "directory", "x") and out["d"] == ("GPL-3.0", "directory", "x/y/z")
    assert out["f"][1] == out["g"][1] == "none" and out["h"] == ("MIT", "directory", "x")
    assert licenses.scan(df.where("false")).count() == 0


def test_license_texts_are_found_as_a_whole(spark):
    folder = Path(licenses.__file__).parent / "license_texts"
    mit, gpl = (folder / "MIT.txt").read_text(), (folder / "GPL-3.0.txt").read_text()
    prose = " ".join(f"word{k}" for k in range(30))
    rows = [(1, "MIT License\n\nCopyright (c) 2020 Ann Example\n\n" + mit, "s", "en"), (2, gpl.replace("\n", " "), "s", "de"), (3, "Released under the MIT License.\n" + prose, "s", "fr"), (4, prose, "s", "fr"), (5, prose + ".", "s", "de"), (6, None, "t", None)]
    assert all(len(rows[k][1]) > 400 for k in (0, 1))
    out = {r.doc_id: (r.path, r.license, r.license_source, r.license_directory) for r in licenses.report(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")).collect()}
    assert out[1] == ("s/LICENSE-1", "MIT", "header", None) and out[2] == ("s/de/LICENSE-2", "GPL-3.0", "header", None)
    assert out[3] == ("s/fr/0/3.txt", "MIT", "header", None)  # a licence line first, but no licence text
    assert out[4][1:] == ("MIT", "directory", "s") and out[5][1:] == ("GPL-3.0", "directory", "s/de")
    assert out[6] == ("t/und/0/6.txt", None, "none", None)


def brute_license(texts):
    """(license, cosine, whole) of each text by plain loops over its units."""
    tokens = lambda t: collections.Counter(x for x in re.split("[^a-z0-9]+", t.lower()) if x)
    folder = Path(licenses.__file__).parent / "license_texts"
    known = [(n, tokens(t)) for n, t in [*licenses.TEMPLATES, *[(f.stem, f.read_text()) for f in sorted(folder.glob("*.txt"))]]]
    word, parts = re.compile(licenses.LICENSE_WORD), {}
    for t in set(texts) - {None}:
        if word.search(t):
            lines = re.split("\r?\n", t)
            parts[t] = [(" ".join(lines[i : i + k]), False) for i, x in enumerate(lines) if word.search(x) for k in licenses.BLOCK_LINES] + [(t, True)]
    vectors = {u: tokens(u) for own in parts.values() for u, _ in own}
    df = collections.Counter(x for v in [*vectors.values(), *[v for _, v in known]] for x in v)
    total = len(vectors) + len(known)
    weigh = lambda v: {x: (1 + np.log(n)) * (np.log((total + 1) / (df[x] + 1)) + 1) for x, n in v.items()}
    norm = lambda v: np.sqrt(sum(x * x for x in v.values()))
    told = [(n, v, weigh(v)) for n, v in known]
    out = []
    for t in texts:
        best = []
        for unit, whole in parts.get(t, []):
            w = weigh(vectors[unit])
            for name, v, x in told:
                cosine = sum(w[k] * x[k] for k in w.keys() & x.keys()) / (norm(w) * norm(x))
                share = sum(n for k, n in vectors[unit].items() if k in v) / sum(vectors[unit].values())
                if cosine >= licenses.MIN_COSINE and (not whole or share >= licenses.MIN_SHARE):
                    best.append((not whole, -round(cosine, 9), name))
        out.append((min(best)[2], -min(best)[1], not min(best)[0]) if best else None)
    return out


NOTICE = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version."""


def test_license_cosines_against_loops(spark):
    folder = Path(licenses.__file__).parent / "license_texts"
    rng = random.Random(6)
    prose = lambda n: " ".join(f"p{rng.randint(0, 99)}" for _ in range(n))
    texts = [NOTICE + "\n" + prose(80), (folder / "ISC.txt").read_text(), "Copyright 2001 A\n" + prose(9), None, "", "licence", "Licensed under the BSD License\r\n" + prose(30), prose(40), NOTICE, NOTICE]
    texts += [name_text[1].lower() + "\n" + prose(rng.randint(0, 50)) for name_text in licenses.TEMPLATES] + ["x " * 200_000 + "\nReleased under the MIT License.\n" + "y " * 1000]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    rows = df.select("id", licenses.digest_of(df.text).alias("digest")).join(licenses.own_licenses(df), "digest", "left").collect()
    got = {r.id: (r.license, pytest.approx(r.cosine, abs=2e-9), r.whole) if r.license else None for r in rows}
    want = brute_license(texts)
    assert len(rows) == len(texts) and [got[k] for k in range(len(texts))] == want
    assert want[0][0] == want[8][0] == "GPL-3.0" and want[1][0] == "ISC" and want[-1][0] == "MIT"


def test_license_rows_stay_rows(spark):
    """Repeated ids and rows, null ids and paths, clashing names, an empty table."""
    mit = "Released under the MIT License."
    rows = [(1, mit, "s", "en"), (1, "other text", "s", "en"), (1, mit, "s", "en"), (None, mit, None, None), (None, None, None, None), (2, "", "s", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    out = licenses.report(df).collect()
    assert collections.Counter((r.doc_id, r.license, r.license_source) for r in out) == collections.Counter([(1, "MIT", "header"), (1, "MIT", "directory"), (1, "MIT", "header"), (None, "MIT", "header"), (None, "MIT", "directory"), (2, "MIT", "directory")])
    assert licenses.report(df.where("false")).count() == 0
    clash = df.selectExpr("*", "source AS path", "1 AS cosine", "map(1, 2) AS whole", "'x' AS _own", "2 AS license")
    found = licenses.scan(clash)
    assert found.columns == [*[c for c in clash.columns if c != "license"], "license", "license_source", "license_cosine", "license_directory"]
    assert sorted((r.doc_id or 0, r.license or "", r.cosine, r._own) for r in found.collect()) == sorted([(1, "MIT", 1, "x"), (1, "", 1, "x"), (1, "MIT", 1, "x"), (0, "MIT", 1, "x"), (0, "", 1, "x"), (2, "", 1, "x")])


def test_license_query_inherits(spark, sf_dir):
    """Inherited rows of the registered query against a walk up each path."""
    rows = queries.QUERIES["op5_licenses"](spark, sf_dir).collect()
    stated = {}
    for r in sorted((r for r in rows if r.path.split("/")[-1].startswith("LICENSE") and r.license_source == "header"), key=lambda r: (-r.license_cosine, r.license)):
        stated.setdefault(r.path.rpartition("/")[0], r.license)
    inherited = 0
    for r in rows:
        if r.license_source == "header":
            continue
        at = r.path.rpartition("/")[0]
        while at and at not in stated:
            at = at.rpartition("/")[0]
        assert (r.license, r.license_source, r.license_directory) == ((stated[at], "directory", at) if at in stated else (None, "none", None))
        inherited += at in stated
    assert stated and inherited > 0


# chat


def test_chat_round_trip(spark):
    rng = random.Random(4)
    bits = ["<", ">", "[", "]", "\\", "</turn>", "<turn:user>", "</s>", "ok", " ", "\n", "é"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "us>\\er", "", None]), rng.choice([None, "", "".join(rng.choice(bits) for _ in range(rng.randint(0, 30)))])) for c in range(60) for t in range(rng.randint(1, 6))]
    rows += [rows[0], (None, None, None, None), (None, 1, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    made = chat.format_chat(df.selectExpr("*", "1 AS segments"))
    for r in made.select("conv_id", "valid", chat.read_turns(F.col("formatted")).alias("t"), chat.loss_text(F.col("segments")).alias("l")).collect():
        own = sorted((x for x in rows if x[0] == r.conv_id), key=order)
        assert [(x.role, x.text) for x in r.t] == [(x[2] or "", x[3] or "") for x in own]
        assert r.l == "".join(x[3] or "" for x in own if x[2] == "assistant")
        assert r.valid == bool(re.fullmatch("s?u(au)*a?", "".join({"user": "u", "assistant": "a", "system": "s"}.get(x[2], "x") for x in own)))
    assert chat.digests(df.where("false")).count() == 0


# substring dedup


def brute_repeats(texts, window):
    words = [WORD.findall(t or "") for t in texts]
    count = collections.Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


@pytest.mark.parametrize(("window", "rounds"), [(3, 1), (3, 4), (35, 5)])
def test_substring_dedup(spark, window, rounds, monkeypatch):
    monkeypatch.setattr(shared, "HOT_ROWS", 5)  # hot names are dealt over parts
    rng = random.Random(window)
    small = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(60)]
    long = [" ".join(f"w{rng.randint(0, 40)}" for _ in range(rng.randint(1, 9))) for _ in range(40)]
    mixed = [" ".join(rng.choice(long) for _ in range(rng.randint(1, 80))) for _ in range(30)]
    one = thue_morse(1024) + " " + " ".join(f"t{k}" for k in range(40))
    texts = (edge_texts() + near_copies() + mixed + [one, one.replace(thue_morse(1024), thue_morse(1024, True))]) if window == 35 else small + ["a " * 50, "a a a a", "a b a b a b a b"]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, kept_text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.remove_repeats(df, window=window, rounds=rounds).collect()}
    assert [got[k] for k in range(len(texts))] == brute_repeats(texts, window)


def test_substring_rounds_reveal_long_repeats(spark):
    """With more rounds of naming, fewer windows of a group of copies have to be told; one copy tells them."""
    words = [f"w{k}" for k in range(900)]
    texts = [" ".join([f"x{k}", *words, f"y{k}"]) for k in range(6)]
    rows = spark.createDataFrame([(b"%d" % k, t) for k, t in enumerate(texts)], "key binary, text string")
    told = [sum(b - a for r in substring_dedup.judged_windows(rows, 35, n).collect() for a, b in zip(r.alive[::2], r.alive[1::2])) for n in (1, 3, 5)]
    assert told[0] >= 6 * 850 > told[1] > told[2] >= 866


def test_substring_repeated_rows_and_nothing(docs):
    out = substring_dedup.digests(docs).where("doc_id = 2").collect()
    assert len(out) == 2 and all(r.n_removed == r.n_words for r in out)
    # a column of any type and names that the operator uses inside; copies with other white space
    words = " ".join(f"w{k}" for k in range(50))
    rows = [(k, t, {"a": 1}, b"k", "x") for k, t in enumerate([words, words.replace(" ", "\n"), words, None, " ".join(["z"] * 34), "u " * 36])]
    found = substring_dedup.remove_repeats(docs.sparkSession.createDataFrame(rows, "doc_id long, text string, tags map<string,int>, _key binary, _word string"))
    assert sorted((r.doc_id, r.n_words, r.n_removed, bytes(r._key), r._word) for r in found.collect()) == [(k, n, m, b"k", "x") for k, (n, m) in enumerate([(50, 50), (50, 50), (50, 50), (0, 0), (34, 0), (36, 36)])]
    assert substring_dedup.digests(empty(docs)).count() == 0


# toxicity


def brute_segments(s):
    sums, best = np.append(0, np.cumsum(s)), None
    for i in range(len(s)):
        for j in range(i + 1, len(s) + 1):
            x = sums[j] - sums[i]
            if x > 1e-12 and (best is None or x > best[2] + 1e-12):
                best = (i, j, x)
    return [] if best is None else brute_segments(s[: best[0]]) + [best] + [(a + best[1], b + best[1], x) for a, b, x in brute_segments(s[best[1] :])]


def test_segments_are_maximal():
    rng = random.Random(3)
    for _ in range(300):
        s = np.array([rng.choice([-0.25, -0.25, 1 + rng.random(), 0.1 + rng.random() / 9]) for _ in range(rng.randint(0, 14))])
        at = np.flatnonzero(s > 0)
        assert [(a, b) for a, b, _ in toxicity.segments(at, s[at], -0.25)] == [(a, b - 1) for a, b, _ in brute_segments(s)]


def test_toxicity_held_out(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.digests(spark, docs, labels).join(labels, "doc_id").toPandas()
    test = out[out.held_out]
    assert ((out.score >= 0) & (out.score <= 1)).all() and (out.predicted == (out.score >= 0.3)).all()
    assert (test.predicted == test.toxic).mean() >= 0.95
    assert test[test.toxic == 1].predicted.mean() >= 0.8 and out[(out.toxic == 1) & ~out.held_out].predicted.mean() >= 0.9
    assert test[test.predicted == 1].toxic.mean() >= 0.9
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out.itertuples())


def test_toxicity_score_against_plain_loops(spark):
    """Damped counts, shrunk log-odds, maximal segments, expected numbers and the logistic score, each by its formula."""
    rng = random.Random(21)
    words = ["alpha", "beta", "gamma", "réeuxvi", "réeuxou", "é", "wretched", "wretch", "ox"]
    rows = [(k, k % 3 == 0, " ".join(rng.choice(words[:3] if k % 3 or rng.random() < 0.8 else words[3:]) for _ in range(rng.randint(1, 40))) + f" own{k}") for k in range(90)]
    df = spark.createDataFrame([(k, t) for k, _, t in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(y)) for k, y, _ in rows], "doc_id long, toxic int")
    model = toxicity.fit(df, labels)
    sample = toxicity.distinct_sample(toxicity._sampled(df, labels, "text", "doc_id", "toxic", 1000)).collect()  # a group of copies counts once

    def tokens(word):
        raw = word.encode()
        return [(raw, 0)] + [(raw[:6], 1)] * (len(raw) > 6)

    def key(token):
        raw, stem = token
        found = toxicity.words_of(np.frombuffer(raw + b"x" * stem, np.uint8), np.array([0, len(raw) + stem]))
        return int(toxicity.pieces(found)[0, stem])

    sums = collections.defaultdict(lambda: [0.0, 0.0])
    for t, y in sample:
        for token, n in collections.Counter(x for w in t.split() for x in tokens(w)).items():
            sums[token][0 if y else 1] += np.rint(1024 * np.log2(1 + n)) / 1024
    total = [sum(v[k] for v in sums.values()) for k in (0, 1)]
    gain = {}
    for token, (t, c) in sums.items():
        prior, mass = toxicity.PRIOR_SHARE * (t + c), toxicity.PRIOR_SHARE * sum(total)
        a, b = t + prior, c + prior
        odds = np.log(a / (total[0] + mass - a)) - np.log(b / (total[1] + mass - b))
        g = odds - toxicity.SHRINK * np.sqrt(1 / a + 1 / b)
        if g > 0:
            gain[token] = g
    assert len(gain) > 3 and dict(zip(model.keys.tolist(), model.scores.tolist())) == pytest.approx({key(x): g for x, g in gain.items()})
    got = {r.doc_id: (r.score, r.n_passages) for r in toxicity.score(df, model).collect()}
    for k, _, t in rows:
        own = [max([gain.get(x, 0.0) for x in tokens(w)]) or toxicity.DRIFT for w in t.split()]
        logs = [np.log(model.scale * len(own)) - model.rate * s for *_, s in brute_segments(np.array(own))]
        found = [-x for x in logs if x < np.log(toxicity.MAX_EXPECTED)]
        want = 1 / (1 + np.exp(-(model.slope * np.log1p(sum(found)) + model.offset)))
        assert got[k] == (pytest.approx(want), len(found))


def test_toxicity_ties_and_repeats(spark):
    """Repeated ids and rows, labels that disagree, very long texts: the model is the same in every run, equal texts score alike."""
    rng = random.Random(12)
    words = [f"w{k}" for k in range(60)]
    rows = [(k % 100, " ".join(rng.choice(words) for _ in range(60)) + (" badword foulword" if k % 4 == 0 else "")) for k in range(200)]
    rows += [rows[0], rows[0], (None, "badword " * 50_000), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(100)] + [(3, 1), (3, 0), (None, 1)], "doc_id long, toxic int")
    models = [toxicity.fit(df.repartition(n), labels, sample_docs=120) for n in (1, 7)]
    assert np.array_equal(models[0].keys, models[1].keys) and (models[0].rate, models[0].scale, models[0].slope) == (models[1].rate, models[1].scale, models[1].slope)
    found = {}
    for r in toxicity.score(df, models[0]).collect():
        assert found.setdefault(r.text, (r.score, r.n_passages)) == (r.score, r.n_passages)
    assert found["badword " * 50_000][0] > found[None][0]


def test_toxicity_edges(spark, docs):
    rows = [(k, int(k % 3 == 0)) for k in range(12)]
    labels = spark.createDataFrame(rows, "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    out = toxicity.score(docs.withColumnRenamed("n_words", "score"), model).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    nothing = toxicity.fit(docs, labels.where("false"))
    assert len({r.score for r in toxicity.score(docs, nothing).collect()}) == 1
    assert toxicity.score(empty(docs), nothing).count() == 0


# Ogg


def slow_crc(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def test_ogg_format():
    for x in (b"", b"a", b"OggS123", bytes(range(256))):
        assert ogg.page_crc(x) == slow_crc(x)
    packets = [(b"h", 0), (bytes(70000), 1), (b"", 2), (bytes(255), 3), (bytes(65025), 4)]
    streams, status = ogg.read_streams(b"".join(ogg.paged(packets, 7)))
    assert status == "ok" and [p for p, _ in streams[7]] == [p for p, _ in packets]
    for n in (0, 1, 191, 192, 193, 4080, 65025, 200_000):
        payload = ogg.payload_of("x" * n)
        read = ogg.read_media(ogg.write_media(payload))
        assert (read["payload"], read["status"], read["streams"]) == (payload, "ok", 2)
        assert read["seconds"] == pytest.approx(len(payload) / 8000)
    broken = bytearray(ogg.write_media(ogg.payload_of("y" * 200_000)))
    broken[100_000] ^= 1
    assert ogg.read_media(bytes(broken))["status"] != "ok"
    for junk in (None, b"", b"OggS", b"junk", bytes(broken[:3000])):
        assert ogg.read_media(junk)["status"] != "ok"


def test_ogg_columns(docs):
    want = collections.Counter()
    for r in docs.collect():
        own = (r.text or "").encode()
        payload = own + b" " * (-len(own) % 192 if own else 192)
        media = ogg.write_media(payload)
        assert ogg.read_media(media)["payload"] == payload
        want[r.doc_id, len(own), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest()] += 1
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256"]
    got = ogg.digests(docs).collect()
    assert collections.Counter(tuple(r[n] for n in names) for r in got) == want
    assert len({(r.payload_sha256, r.media_sha256, r.feature) for r in got}) == len({r.payload_sha256 for r in got})  # equal texts, equal values
    back = ogg.decode(ogg.encode(docs.withColumnRenamed("n_words", "media"))).collect()
    assert all(bytes(r.payload) == ogg.payload_of(r.text) and r.media_status == "ok" for r in back)
    assert ogg.digests(empty(docs)).count() == 0


# quality


def brute_base(text):
    text = text or ""
    w, seen, dup = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    three = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    mark = [False] * len(w)
    for i in range(len(w) - 2):
        if three[tuple(w[i : i + 3])] > 1:
            mark[i : i + 3] = [True] * 3
    n = sum(mark)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, n, len(w) < 50 or 100 * n > 50 * len(w))


def test_quality_counts(spark):
    rng = random.Random(2)
    texts = edge_texts() + ["\n", "a\n", "\n\na\n a\na\r\na", "\n"] + ["".join(rng.choice(["a", "b", "\n", " ", "é", "\t", "#", "a b c\n"]) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    df = spark.createDataFrame([(k, t, True) for k, t in enumerate(texts)], "doc_id long, text string, kept boolean")
    got = {r.doc_id: tuple(r[n] for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for r in quality.judge(df, quality.Field.neutral()).collect()}
    assert [got[k] for k in range(len(texts))] == [brute_base(t) for t in texts]
    assert quality.judge(df.where("false"), quality.Field.neutral()).count() == 0


def test_quality_fit_does_not_depend_on_order(spark):
    rows = [(k % 6, f"line {k}\n" + " ".join(f"word{(k * j) % 17}" for j in range(60))) for k in range(24)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(6)], "doc_id long, quality int")
    one, two = (quality.fit(df.repartition(n), labels, sample_docs=5) for n in (1, 6))
    assert np.allclose(one.emission, two.emission) and np.allclose(one.transition, two.transition)


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    for _ in range(40):
        n = int(rng.integers(1, 8))
        field = quality.Field(np.zeros((2, 1)), rng.normal(size=(2, 2)), rng.normal(size=2))
        scores = rng.normal(size=(n, 2))
        value = lambda p: field.start[p[0]] + sum(scores[i, x] for i, x in enumerate(p)) + sum(field.transition[a, b] for a, b in zip(p, p[1:]))  # noqa: B023, E731
        best = max(([m >> i & 1 for i in range(n)] for m in range(1 << n)), key=value)
        assert quality.viterbi(scores, np.array([0, n]), field).tolist() == best


def test_quality_verdict(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    train = labels.where("doc_id % 2 = 1")
    out = quality.judge(docs, quality.fit(docs, train)).join(labels.where("doc_id % 2 = 0"), "doc_id").where("NOT base_failed").toPandas()
    assert (out.kept == (out.quality == 1)).mean() >= 0.95
    assert quality.judge(docs, quality.fit(docs, labels.where("false"))).where("kept = base_failed").count() == 0


def test_quality_is_fitted_on_all_lines(spark, monkeypatch):
    rows = [(k, "\n".join(f"line{k}x{i} word{k}y{i}" for i in range(n)), k % 2) for k, n in enumerate([450, 60, 201])]
    seen = []
    monkeypatch.setattr(quality, "fit_field", lambda x, y, first: seen.append((x, y, first)) or quality.Field.neutral())
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    quality.fit(df.select("doc_id", "text"), df.select("doc_id", "quality"))
    (x, y, first), = seen
    assert len(x) == len(y) == first[-1] == 711 and sorted(np.diff(first)) == [60, 201, 450]
    assert x[:, -1].sum() == x[:, -2].sum() == 3  # each document shows its first and its last line
