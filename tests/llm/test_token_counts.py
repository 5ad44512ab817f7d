"""Token counts by transducers against the library, on the whole table and on random texts."""

import random
import time

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lumenforge.llm import queries, token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")
PARTS = ["a", "b", "ab", " ", "  ", "\n", "the", "ing", "é", "é", "日", "𝔘", "\x00", "aaaa", "==", "--", "'s", "'", "'re", "'l", "'ll", "'t", "<|endoftext|>", "<|startoftext|>", "<|", "̇", "İ", "Σ", "ς", "1", "٣", "½", "Ⅷ", "Ⓐ", "Ᲊ", "Ɤ", "͸", "가", "ᄀ", "ᅡ", "ᆨ", "🙂", "\x85", "\xa0", "ﬁ", "Å", "_", "!!", "Q", "'M", "'D", "'LL", "̸", "<", "ে", "া"]


@pytest.fixture(scope="module")
def library():
    import tokenizers

    return tokenizers.Tokenizer.from_file(PATH)


def wanted(library, texts):
    return [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def random_texts(seed, n):
    rng = random.Random(seed)
    for _ in range(n):
        kind = rng.random()
        if kind < 0.1:
            yield rng.choice(["a", "=", "-", "ab", "the", "é", "'", "日本"]) * rng.randint(1, 400)
        elif kind < 0.2:
            yield "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(1, 500)))
        else:
            yield "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40)))


def test_random_texts_alone_and_together(library):
    counter, texts = token_counts.Counter(PATH), list(random_texts(4, 3000))
    want = wanted(library, texts)
    assert [int(counter([t])[0]) for t in texts] == want
    assert counter(texts).tolist() == want


def test_a_table_started_anew_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(token_counts, "TABLE_ENTRIES", 1000)
    counter, texts = token_counts.Counter(PATH), list(random_texts(5, 300))
    assert [int(counter([t])[0]) for t in texts] == wanted(library, texts)


def test_state_maps_compose_as_one_scan():
    """Chunks of any classes give the word starts of one sequential walk."""
    rng = np.random.default_rng(1)
    for n in (0, 1, 63, 64, 65, 1000):
        classes = rng.integers(0, 4, n).astype(np.uint8)
        for k in np.flatnonzero(rng.random(n) < 0.2).tolist():
            if k + 2 < n:
                classes[k : k + 3] = rng.choice([token_counts.SHORT, token_counts.LONG]), token_counts.LETTER, token_counts.LETTER
        state, want = token_counts.BETWEEN, []
        for c in classes:
            want.append(bool(token_counts.WORD_STARTS[state, c]))
            state = token_counts.WORD_STEP[state, c]
        assert token_counts.word_starts(classes).tolist() == want
    maps = rng.integers(0, 5, (77, 5)).astype(np.uint8)
    state = token_counts.BETWEEN
    for entry, m in zip(token_counts.scanned(maps).tolist(), maps, strict=True):
        assert entry == state
        state = int(m[state])


def test_very_long_words(library):
    rng, counter = random.Random(2), token_counts.Counter(PATH)
    for text in ["y" * 100_000, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(30_000)), "ab" * 50_000 + "c", "'" * 70_000, "é" * 40_000]:
        began = time.time()
        assert int(counter([text])[0]) == wanted(library, [text])[0]
        assert time.time() - began < 20


def test_whole_table(spark, sf_dir, library):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: (len((r.text or "").encode()), n, n > 2048) for r, n in zip(rows, wanted(library, [r.text or "" for r in rows]), strict=True)}
    out = queries.QUERIES["op12_token_counts"](spark, sf_dir).collect()
    assert len(out) == len(rows) and {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in out} == want


def test_edges(spark):
    rows = [(1, None, 5), (1, None, 5), (None, "", 5), (2, " \n", None), (3, "one 'two'", 7), (3, "word " * 3000, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    out = token_counts.counted(df, PATH)
    assert out.columns == ["doc_id", "text", "n_bytes", "n_tokens", "over_limit"]
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in out.collect()) == [(0, 0, 0, False), (1, 0, 0, False), (1, 0, 0, False), (2, 2, 0, False), (3, 9, 4, False), (3, 15_000, 3000, True)]
    assert token_counts.counted(df.where(F.lit(False)), PATH).count() == 0


def test_another_kind_of_file_is_refused():
    with pytest.raises(ValueError):
        token_counts.Counter(public_tokenizers.path("byte_bpe_50k.json"))
