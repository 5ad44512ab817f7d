"""Near-equal sets and the clusters that they form."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenforge.functions import text as X
from lumenforge.operators.joins import salted_join
from lumenforge.sources.storage import dropped, kept


#: Sets of a signature that one task compares with each other at most, as far as words are independent; tokens of a longest signature.
GROUP_ROWS, DEPTH = 256, 4
#: Pairs of sets that a task compares in one step.
CHUNK_PAIRS = 1 << 20
#: Pairs for each set that are compared by their words at once.
SET_PAIRS = 2
#: Words of 64 bits by which sets are compared where they meet.
BITS = 4
#: Columns of sets_of().
SETS = "s binary, w array<long>"
#: Signatures are shuffled in so many turns, of at least so many sets; signatures that a task packs, or compares, at once.
TURNS, TURN_SETS, PACKED_ROWS = 8, 1 << 16, 1 << 20
#: Words whose frequency is known to all tasks, and sets by which it is estimated: they only order the words, any order gives the same pairs.
FREQUENT_WORDS, ORDER_SETS = 1 << 16, 1 << 18


def set_classes(df: DataFrame, key: str, words: Column) -> DataFrame:
    """(k, c, w): each key with a word, the least key of those with the same word set, and the sorted set; kept, as it is read several times."""
    listed = df.select(F.col(key).alias("k"), F.array_sort(F.array_distinct(words)).alias("w")).where(F.size("w") > 0)
    listed = listed.withColumn("_s", F.unhex(F.sha2(F.array_join("w", "\n"), 256)))
    least = kept(listed.groupBy("_s").agg(F.min("k").alias("c"), F.count("*").alias("n")), "word-sets")
    return kept(salted_join(listed, least.select("_s", "c"), ["_s"], least.select("_s", "n"), F.col("k")).select("k", "c", "w"), "word-classes")


def sets_of(words: pa.DictionaryArray, owner: np.ndarray, rows: int) -> list[pa.Array]:
    """s and w of each row: 128 bits that are equal for the same set of words, and the sorted 64-bit hashes of the words; owner: the row of each of the words,
    in order. Stop words and single characters are left out, as in X.tokens()."""
    named = words.dictionary
    good = pc.and_(pc.greater(pc.utf8_length(named), 1), pc.invert(pc.is_in(named, pa.array(X.STOP_WORDS)))).to_numpy(zero_copy_only=False)
    every = words.indices.to_numpy()
    own = good[every]
    code = pd.util.hash_array(np.append(named.to_numpy(zero_copy_only=False), "").astype(object), categorize=False).view(np.int64)[every[own]]
    owner = owner[own]
    order = np.lexsort((code, owner))
    code, owner = code[order], owner[order]
    once = np.append(True, (code[1:] != code[:-1]) | (owner[1:] != owner[:-1]))[: len(code)]
    code, owner = code[once], owner[once]
    ends = np.searchsorted(owner, np.arange(rows + 1))
    held = memoryview(code.tobytes())
    names = [hashlib.blake2b(held[8 * a : 8 * b], digest_size=16).digest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    return [pa.array(names, pa.binary()), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(code))]


def hashed_sets(df: DataFrame, text: str) -> DataFrame:
    """df without the text, with its set of words as sets_of() tells it."""
    rest = [f for f in df.schema.fields if f.name != text]

    def run(batches):
        for batch in batches:
            tokens = batch.column(0)
            owner = np.repeat(np.arange(len(batch)), tokens.value_lengths().to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *sets_of(tokens.flatten().dictionary_encode(), owner, len(batch))], names=[*batch.schema.names[1:], "s", "w"])

    listed = F.coalesce(X.tokens(F.col(text)), F.array().cast("array<string>"))
    return df.select(listed.alias("_tokens"), *[f.name for f in rest]).mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), SETS]))


def _signatures(least: float, total: int, words: np.ndarray, counts: np.ndarray, batches, turn: int = 0, turns: int = 1) -> Iterator[pa.RecordBatch]:
    """(i, h) with the hashes h of a set's words: a row (sig, i, size, b0 to b3) for each of its signatures, with the set as 256 bits.

    Words are ordered seldom first. Two sets that must share m words share the first l <= m common ones, which stand among the first
    size - m + l words of each. The signature of one word is enough if it is seldom; a frequent one is extended by every later word,
    until the number of sets that have all of its words is small. That depends on the words alone, so two similar sets always take the same
    signature. Sets of which l common words may be all end there as well. A turn has the signatures of a share of first words.
    """
    mix = np.uint64(0x9E3779B97F4A7C15)

    def mixed(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    for batch in batches:
        for start in range(0, batch.num_rows, 2048):
            part = batch.slice(start, 2048)
            size = part.column(1).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = part.column(1).flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(size)), size)
            at = np.minimum(np.searchsorted(words, flat), max(len(words) - 1, 0))
            n = np.where(words[at] == flat, counts[at], 1.0) if len(words) else np.ones(len(flat))
            order = np.lexsort((flat, n, row))
            flat, n = flat[order], n[order]
            code = mixed(flat.astype(np.int64).view(np.uint64) * mix + mix)
            first = np.cumsum(size) - size
            bits = [np.zeros(len(size), np.uint64) for _ in range(BITS)]
            place = ((code >> np.uint64(48)) % np.uint64(64 * BITS)).astype(np.int64)
            for part_of in range(BITS):
                mine = place >> 6 == part_of
                np.bitwise_or.at(bits[part_of], row[mine], np.uint64(1) << (place[mine] & 63).astype(np.uint64))
            need = np.maximum(np.ceil(least * size - 1e-9).astype(np.int64), 1)
            # the open signatures: set, place of the last word, code, sets expected to have it
            who = np.repeat(np.arange(len(size)), size - need + 1)
            last = np.arange(len(who)) - np.repeat(np.cumsum(size - need + 1) - (size - need + 1), size - need + 1)
            if turns > 1:
                mine = (code[first[who] + last] >> np.uint64(24)) % np.uint64(turns) == turn
                who, last = who[mine], last[mine]
            sig, expected = code[first[who] + last], n[first[who] + last]
            found = []
            for depth in range(1, DEPTH + 1):
                done = (expected <= GROUP_ROWS) | (depth == DEPTH)
                found.append((who[done], sig[done]))
                ends = ~done & (need[who] <= depth)
                found.append((who[ends], mixed(sig[ends] + np.uint64(1))))
                who, last, sig, expected = (x[~done] for x in (who, last, sig, expected))
                more = np.maximum(np.minimum(size[who] - need[who] + depth, size[who] - 1) - last, 0)
                last = np.repeat(last + 1 - (np.cumsum(more) - more), more) + np.arange(more.sum())
                who, sig, expected = np.repeat(who, more), np.repeat(sig, more), np.repeat(expected, more)
                word = first[who] + last
                sig, expected = mixed(sig * mix + code[word]), expected * n[word] / total
            who, sig = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
            if len(who):
                columns = [pa.array(sig.view(np.int64)), part.column(0).take(pa.array(who)), pa.array(size[who].astype(np.int32)), *(pa.array(b[who].view(np.int64)) for b in bits)]
                yield pa.RecordBatch.from_arrays(columns, names=["sig", "i", "size", *(f"b{k}" for k in range(BITS))])


def _group_pairs(least: float, batches) -> Iterator[pa.RecordBatch]:
    """(i_a, i_b), a < b, of the rows of one signature whose sizes and bits allow a Jaccard of `least`; rows come sorted by signature."""

    def compared(sig, i, size, *bits):
        end = np.searchsorted(sig, sig, "right")
        more = end - np.arange(len(sig)) - 1
        done = np.concatenate([[0], np.cumsum(more)])
        at = 0
        while at < len(sig):
            to = max(at + 1, int(np.searchsorted(done, done[at] + CHUNK_PAIRS, "right")) - 1)
            part = more[at:to]
            x = np.repeat(np.arange(at, to), part)
            y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(part) - part, part)
            near = np.minimum(size[x], size[y]) >= least * np.maximum(size[x], size[y]) - 1e-9
            x, y = x[near], y[near]
            only_x, only_y = (sum(np.bitwise_count(b[p] & ~b[q]).astype(np.int64) for b in bits) for p, q in ((x, y), (y, x)))
            most = np.minimum(size[x] - only_x, size[y] - only_y)
            near = most * (1 + least) >= least * (size[x].astype(np.int64) + size[y]) - 1e-9
            x, y = i[x[near]], i[y[near]]
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["i_a", "i_b"])
            at = to

    held = None
    for batch in batches:
        now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        now[3:] = [b.view(np.uint64) for b in now[3:]]
        held = now if held is None else [np.concatenate(pair) for pair in zip(held, now, strict=True)]
        cut = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0  # the last signature may go on
        if cut:
            yield from compared(*(c[:cut] for c in held))
            held = [c[cut:] for c in held]
    if held is not None:
        yield from compared(*held)


def _packed(parts: int, batches) -> Iterator[pa.RecordBatch]:
    """(part, columns): the rows of many batches of signatures as one row for each part, a range of signatures, with the bytes of each column."""

    def rows(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        columns = [np.concatenate([b.column(k).to_numpy() for b in held]) for k in range(3 + BITS)]
        sig = columns[0].view(np.uint64)
        order = np.argsort(sig)
        width = -(-(1 << 64) // parts)
        cuts = np.append(np.searchsorted(sig[order], np.array([k * width for k in range(parts)], np.uint64)), len(sig))
        full = np.flatnonzero(np.diff(cuts))
        packed = [[c[order[cuts[k] : cuts[k + 1]]].tobytes() for k in full] for c in columns]
        return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), *(pa.array(c, pa.binary()) for c in packed)], names=["part", "sig", "i", "size", *(f"b{k}" for k in range(BITS))])

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= PACKED_ROWS:
            yield rows(held)
            held, n = [], 0
    if n:
        yield rows(held)


def _unpacked_pairs(least: float, batches) -> Iterator[pa.RecordBatch]:
    """(i_a, i_b) of the packed signatures of one part; a pair is told once for each of its chunks."""
    held: list[list] = [[] for _ in range(3 + BITS)]
    for batch in batches:
        for k, kind in enumerate((np.int64, np.int64, np.int32, *[np.int64] * BITS)):
            held[k] += [np.frombuffer(x.as_buffer(), kind) for x in batch.column(k + 1)]
    if not held[0]:
        return
    columns = [np.concatenate(c) for c in held]
    held.clear()
    order = np.argsort(columns[0])
    sig = columns[0][order]
    alone = np.append(True, sig[1:] != sig[:-1]) & np.append(sig[1:] != sig[:-1], True)
    order = order[~alone]
    one = pa.RecordBatch.from_arrays([pa.array(c[order]) for c in columns], names=["sig", "i", "size", *(f"b{k}" for k in range(BITS))])
    del columns, sig, alone, order
    pairs, n = [], 0

    def once():
        x = np.concatenate(pairs, axis=1)
        x = x[:, np.lexsort(x)]
        x = x[:, np.append(True, (x[:, 1:] != x[:, :-1]).any(axis=0))]
        return pa.RecordBatch.from_arrays([pa.array(x[0]), pa.array(x[1])], names=["i_a", "i_b"])

    for found in _group_pairs(least, [one]):
        pairs.append(np.stack([c.to_numpy() for c in found.columns]))
        n += found.num_rows
        if n >= PACKED_ROWS:
            yield once()
            pairs, n = [], 0
    if n:
        yield once()


def linked(named: DataFrame, least: float) -> DataFrame:
    """(a, b, similarity): the names a < b of different sets with a Jaccard of at least `least`; named: a kept table of i (a number), c (its name) and w (the set).

    Candidates share a signature, which no similar pair lacks; a bound on the common words from 256 bits of each set drops most of them
    where they meet, and only the others are shuffled and compared by their words. The number of candidates grows with the sets, not with
    their square, where words are independent. Signatures are shuffled in turns, packed as bytes, and a turn's are gone before the next.
    """
    spark = named.sparkSession
    total = named.count()
    share = max(1, -(-total // ORDER_SETS))
    hashed = named.select("i", F.transform("w", lambda t: F.hash(t)).alias("h"))
    seen = hashed.where(F.pmod(F.xxhash64("i"), F.lit(share)) == 0).select(F.explode("h").alias("t")).groupBy("t").agg((F.count("*") * share).alias("n"))
    frequent = sorted((r.t, r.n) for r in seen.where(F.col("n") > GROUP_ROWS).orderBy(F.desc("n"), "t").limit(FREQUENT_WORDS).collect())
    known = np.array([t for t, _ in frequent], np.int32), np.array([n for _, n in frequent], np.float64)
    sent = spark.sparkContext.broadcast(known)
    turns = max(1, min(TURNS, -(-total // TURN_SETS)))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total * 16 // (turns * PACKED_ROWS)))
    packed = "part int, sig binary, i binary, size binary, " + ", ".join(f"b{k} binary" for k in range(BITS))
    met = []
    for turn in range(turns):
        rows = hashed.mapInArrow(lambda batches, turn=turn: _packed(parts, _signatures(least, total, *sent.value, batches, turn, turns)), packed)
        met.append(kept(rows.repartitionById(parts, "part").mapInArrow(lambda batches: _unpacked_pairs(least, batches), "i_a long, i_b long"), "near-candidates", bare=True))
    pairs = kept(reduce(DataFrame.unionByName, met).distinct(), "near-pairs", bare=True)
    for x in met:
        dropped(x)
    words = lambda x: named.select(*[F.col(n).alias(n + x) for n in ("i", "c", "w")])
    shares = max(1, -(-pairs.count() // max(SET_PAIRS * total, 1)))
    found = []
    for k in range(shares):
        mine = lambda i: F.pmod(F.xxhash64(i), F.lit(shares)) == k  # noqa: E731, B023
        half = kept(pairs.where(mine("i_a")).join(words("_x").where(mine("i_x")), F.col("i_a") == F.col("i_x")).select("i_b", "c_x", "w_x"), "near-halves", bare=True)
        near = half.join(words("_y"), F.col("i_b") == F.col("i_y")).withColumn("similarity", X.jaccard(F.col("w_x"), F.col("w_y"))).where(F.col("similarity") >= least - 1e-9)
        found.append(kept(near.select(F.least("c_x", "c_y").alias("a"), F.greatest("c_x", "c_y").alias("b"), F.round("similarity", 6).alias("similarity")), "near-sets", bare=True))
        dropped(half)
    dropped(pairs)
    return reduce(DataFrame.unionByName, found)


def class_pairs(classes: DataFrame, least: float) -> DataFrame:
    """linked() of the different sets (c, w)."""
    return linked(kept(classes.select(F.monotonically_increasing_id().alias("i"), "c", "w"), "numbered-sets"), least)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the least node that each node of an edge reaches.

    Large-star and small-star steps in turn: each step hangs a node's larger neighbours, then its smaller ones, to the least of
    them; the number of rounds grows with the logarithm of the size of a component. Rounds are kept tables; a hub's neighbours are
    dealt over many tasks. It ends when no edge changes.
    """
    now = kept(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")

    def star(sides: DataFrame, emitted: Column) -> DataFrame:
        least = sides.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        placed = salted_join(sides, least.select("u", F.least("u", "m").alias("m")), ["u"], least.select("u", "n"), F.col("v"))
        return placed.select(emitted.alias("u"), F.col("m").alias("v"))

    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = star(both, F.when(F.col("v") > F.col("u"), F.col("v"))).where("u IS NOT NULL AND u <> v").distinct()
        large = kept(large, "edges")
        down = star(large, F.col("v"))  # smaller neighbours of u hang to the least of them, and u itself does
        own = large.groupBy("u").agg(F.min("v").alias("v"))
        after = kept(down.where("u <> v").unionByName(own).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        same = after.count() == now.count() and after.join(now, ["u", "v"], "left_anti").limit(1).count() == 0
        dropped(large)
        dropped(now)
        now = after
        if same:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def clusters(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(k, cluster): each key of set_classes() with the least key of its cluster, where pairs (a, b) link classes."""
    found = components(pairs, "a", "b").select(F.col("node").alias("c"), F.col("component").alias("cluster"))
    counts = classes.groupBy("c").agg(F.count("*").alias("n"))
    told = counts.join(found, "c", "left").select("c", F.coalesce("cluster", "c").alias("cluster"))
    return salted_join(classes.select("k", "c"), told, ["c"], counts, F.col("k")).select("k", "cluster")
