"""The conversation trie against a plain trie of dictionaries, and its radix tree against sorted byte strings."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from lumenforge.llm import conversation_trie as C

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    """Rows (conv_id, turn, role, text) of a table to the nodes of the trie of rebuilt conversations."""
    turns = {}
    for c, t, r, x in rows:
        if c is not None:
            turns.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    told = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in turns.items()}
    built = {}
    for c, own in told.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = told.get(c - c % 20, [])[:h] + own[h:]
    return brute_nodes({c: tuple(b) for c, b in built.items()}, lambda turn: len(re.findall(r"[^\x20\x09-\x0D]+", turn[1])))


def brute_nodes(built, n_words):
    members = {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    out = []
    for path, convs in members.items():
        below = [p for p in members if p[: len(path)] == path]
        leaf = {p for p in below if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below)}
        saved = sum((len(members[p]) - 1) * n_words(p[-1]) for p in below if p)
        ends = ",".join(str(c) for c in sorted(c for c in convs if len(built[c]) == len(path)))
        out.append((min(convs), len(path), min(members[path[:-1]]) if path else None, len(convs), sum(len(p) == len(path) + 1 for p in below), len(leaf), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def random_turns(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.choice([0, 1, 2, 3, 6])):
            rows.append((c, rng.choice([t, t, None]), rng.choice(["user", "assistant", None]), rng.choice(["a", "b c", "d\te f", "", None, "é x"])))
    rows += [(500 + k, t, "user", f"same {t}") for k in range(60) for t in range(4)]
    return rows + rows[:5] + [(None, 1, "user", "no id")]


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = random_turns(seed, 80)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("key", F.lit("clash")).withColumn("words", F.lit(3))
    assert got(C.nodes(df)) == brute(rows)


def test_small_blocks_merge_to_the_same_trie(spark):
    """Sequences in blocks of two and runs of three: nearly all nodes are open."""
    rows = random_turns(3, 120)
    listed = C.rebuilt(C.sequences(spark.createDataFrame(rows, SCHEMA))).repartition(5)
    assert got(C.trie(listed, run=3, block=2)) == brute(rows)
    assert got(C.trie(listed, run=1, block=1)) == brute(rows)


def test_long_conversation_and_many_first_turns(spark):
    rows = [(0, t, "user", f"turn {t}") for t in range(400)] + [(20, t, "user", f"turn {t}" if t < 350 else "other") for t in range(360)] + [(c, 0, "user", f"hello {c}") for c in range(100, 500)]
    assert got(C.nodes(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_nothing(spark):
    assert C.nodes(spark.createDataFrame([], SCHEMA)).count() == 0
    assert got(C.nodes(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA))) == []


def test_radix_nodes_grow_and_keep_order():
    rng = random.Random(4)
    for n in (1, 4, 5, 16, 17, 48, 49, 256):
        tree, firsts = C.RadixTree(), rng.sample(range(256), n)
        keys = {bytes([b, *rng.choices(range(3), k=15)][:16]) for b in firsts} | {bytes([b, 0, 0, 0, 0, 0, 0, 1]) for b in firsts}
        for k, key in enumerate(sorted(keys, key=lambda _: rng.random())):
            tree.insert(key, k)
        assert tree.root.places == next(p for p in (4, 16, 48, 256) if p >= n)
        found, stack = [], [(tree.root, b"")]
        while stack:
            node, above = stack.pop()
            if node.end >= 0:
                found.append(above + node.path)
            stack.extend((kid, above + node.path) for kid in reversed(node.children()))
        assert found == sorted(keys)


def test_paths_are_compressed():
    tree = C.RadixTree()
    tree.insert(b"\0" * 80, 0)
    tree.insert(b"\0" * 40 + b"\1" * 40, 1)
    upper = tree.root.child(0)
    assert upper.path == b"\0" * 40 and sorted(len(k.path) for k in upper.children()) == [40, 40]
    rows = C.block_nodes(0, [b"\0" * 40, b"\0" * 80], [1, 2], [9, 4], ["a", "b"], [[1] * 5, [1] * 10])
    assert sorted(r[2] for r in rows) == list(range(11)) and {r[3] for r in rows} == {4}
