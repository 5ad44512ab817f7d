"""Prefix trie of conversations, by adaptive radix trees over fixed-width big-endian turn ids.

Spark names each distinct turn (role, text) by a number of `WIDTH` bytes; two turns are one if the SHA-256 of role length, role and
text is equal. A conversation becomes one byte string, the ids of its turns in big-endian order, so that byte order is the order of
the sequences and a trie node is a prefix that ends at a multiple of `WIDTH`.

The work is dealt by ranges of that order, so no turn, prefix or conversation can be hot: equal sequences are folded first (rows
sorted by sequence and conv_id are spread over all tasks, each run of one sequence becomes rows of `RUN` ids), then a task folds
the runs of a sequence into its count, least id and digest, and inserts the sequences of a block (`BLOCK` sequences or
`BLOCK_BYTES` bytes at most) into one `RadixTree`: nodes of 4, 16, 48 and 256 places that grow when they are full, with compressed
paths. A walk emits the nodes at turn-aligned byte depths. A node is final unless it lies on the path of the block's first or last
sequence, where the neighbours may hold more of it. Such open nodes, two paths a block, are merged by the digest of their path:
counts add up, and sums over their subtrees are made of what each block knows about its closed nodes and of running sums along
the two paths of a block, each open node being counted in one block only.

Defined results: turns are ordered by turn (nulls first), then role, then text; null role and text are empty; repeated rows are turns
of their own; rows without conv_id belong to no conversation; an empty table has no nodes, not even a root. Further columns are ignored.

Bounds: the ids of one conversation (8 bytes a turn) lie in one row. The digest of the members that end at one node is that of one
string, so it is read through in one task, in pieces, in bounded memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenforge.llm.shared import dropped, kept, salted_join

#: Bytes of a turn id; ids of one sequence in a row; sequences and bytes of a tree.
WIDTH, RUN, BLOCK, BLOCK_BYTES = 8, 4096, 1 << 16, 1 << 23
WORD = r"[^\x20\x09-\x0D]+"
#: Position of an open node: on both paths of its block, on the first one only, on the last one only; closed nodes have CLOSED.
CLOSED, BOTH, FIRST, LAST = -1, 0, 1, 2
NODE = "block long, place int, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, words long, ends string, path binary, parent_path binary"


class RadixNode:
    """An inner or end node: a compressed path and 4, 16, 48 or 256 places for children.

    4 and 16 places: sorted bytes beside their children; 48: a table of 256 slots; 256: a child for each byte."""

    __slots__ = ("bytes", "end", "kids", "path", "places")

    def __init__(self, path: bytes, end: int = -1):
        self.path, self.end, self.places = path, end, 4
        self.bytes, self.kids = bytearray(), []

    def child(self, b: int) -> RadixNode | None:
        if self.places == 256:
            return self.kids[b]
        if self.places == 48:
            return self.kids[self.bytes[b] - 1] if self.bytes[b] else None
        at = self.bytes.find(b)
        return self.kids[at] if at >= 0 else None

    def put(self, b: int, node: RadixNode) -> None:
        """Sets the child of a byte; a full layout grows first."""
        if self.places <= 16:
            at = self.bytes.find(b)
            if at >= 0:
                self.kids[at] = node
                return
            if len(self.kids) < self.places:
                at = sum(x < b for x in self.bytes)
                self.bytes.insert(at, b)
                self.kids.insert(at, node)
                return
        elif self.places == 256:
            self.kids[b] = node
            return
        elif self.bytes[b]:
            self.kids[self.bytes[b] - 1] = node
            return
        elif len(self.kids) < 48:
            self.kids.append(node)
            self.bytes[b] = len(self.kids)
            return
        self._grow()
        self.put(b, node)

    def _grow(self) -> None:
        if self.places == 4:
            self.places = 16
        elif self.places == 16:
            slots = bytearray(256)
            for k, b in enumerate(self.bytes):
                slots[b] = k + 1
            self.places, self.bytes = 48, slots
        else:
            self.places, self.kids = 256, [self.kids[k - 1] if k else None for k in self.bytes]
            self.bytes = bytearray()

    def children(self) -> list[RadixNode]:
        """In the order of their bytes."""
        if self.places <= 16:
            return self.kids
        if self.places == 48:
            return [self.kids[k - 1] for k in self.bytes if k]
        return [k for k in self.kids if k is not None]


class RadixTree:
    """Byte strings, each with a number."""

    def __init__(self):
        self.root = RadixNode(b"")

    def insert(self, key: bytes, number: int) -> None:
        above, node, at = None, self.root, 0
        while True:
            path = node.path
            n, most = 0, min(len(path), len(key) - at)
            if path[:most] == key[at : at + most]:
                n = most
            else:
                while path[n] == key[at + n]:
                    n += 1
            if n < len(path):  # the paths part here: a new node takes what they share
                upper = RadixNode(path[:n])
                node.path = path[n:]
                upper.put(node.path[0], node)
                above.put(key[at], upper)  # the root's path is empty, so it never parts
                node = upper
            at += n
            if at == len(key):
                node.end = number
                return
            below = node.child(key[at])
            if below is None:
                node.put(key[at], RadixNode(key[at:], number))
                return
            above, node = node, below


class _Forest:
    """What is known of the part of the tree below a byte depth: the turn nodes on top, and sums over all of them."""

    __slots__ = ("children", "convs", "first", "last", "leaves", "least", "saved", "tops")

    def __init__(self):
        self.convs = self.children = self.leaves = self.saved = 0
        self.least, self.first, self.last, self.tops = None, None, None, []

    def add(self, other: _Forest) -> None:
        self.convs += other.convs
        self.children += other.children
        self.leaves += other.leaves
        self.saved += other.saved
        self.least = other.least if self.least is None else min(self.least, other.least)
        self.first = other.first if self.first is None else min(self.first, other.first)
        self.last = other.last if self.last is None else max(self.last, other.last)
        self.tops.extend(other.tops)


def block_nodes(block: int, keys: list[bytes], counts: list[int], least: list[int], ends: list[str], words: list[np.ndarray]) -> list[list]:
    """Rows of NODE of the trie over distinct sequences in ascending order.

    An open node's n_children, n_leaves and saved_tokens tell of its closed children and closed nodes below only."""
    tree = RadixTree()
    for k, key in enumerate(keys):
        tree.insert(key, k)
    paths = {}
    for k in {0, len(keys) - 1}:
        told, chain = hashlib.sha256(), []
        for d in range(0, len(keys[k]) + 1, WIDTH):
            chain.append(told.digest())
            told.update(keys[k][d : d + WIDTH])
        paths[k] = chain
    rows: list[list] = []
    parents: list[int] = []
    last = len(keys) - 1
    # depth first, children before their node; done: the forests below the nodes of the stack
    stack, done = [(tree.root, 0, False)], [_Forest()]
    while stack:
        node, start, ready = stack.pop()
        stop = start + len(node.path)
        if not ready:
            stack.append((node, start, True))
            done.append(_Forest())
            stack.extend((kid, stop, False) for kid in node.children())
            continue
        forest = done.pop()
        ended = node.end
        if ended >= 0:
            own = _Forest()
            own.convs, own.least, own.first, own.last = counts[ended], least[ended], ended, ended
            forest.add(own)
        depth = stop // WIDTH
        while depth * WIDTH > start or (start == stop == 0 and depth == 0):
            extra = int(words[forest.first][depth - 1]) if depth else 0
            place = (BOTH if forest.first == 0 and forest.last == last else FIRST if forest.first == 0 else LAST if forest.last == last else CLOSED)
            own_end = ends[ended] if ended >= 0 and depth * WIDTH == stop else None
            path = paths[0 if forest.first == 0 else last][depth] if place != CLOSED else None
            up = paths[0 if forest.first == 0 else last][depth - 1] if depth and place != CLOSED else None
            if place == CLOSED:
                forest.leaves += forest.children == 0
                forest.saved += (forest.convs - 1) * extra
            for top in forest.tops:
                parents[top] = len(rows)
            rows.append([block, place, depth, forest.least, None, forest.convs, forest.children, forest.leaves, forest.saved, extra, own_end, path, up])
            parents.append(-1)
            forest.tops, forest.children = [len(rows) - 1], int(place == CLOSED)
            depth -= 1
            if depth < 0:
                break
        done[-1].add(forest)
    for row, parent in zip(rows, parents, strict=True):
        if row[1] == CLOSED:
            if rows[parent][1] == CLOSED:
                row[4] = rows[parent][3]
            else:
                row[12] = rows[parent][11]
    return rows


def sequences(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, key, words): the conversations as hexadecimal strings of their turn ids, with the words of each turn."""
    rows = turns.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    placed = kept(rows.select("conv_id", place.alias("place"), digest.alias("digest"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words")), "turns")
    # kept, because the numbers must not change when a task runs again
    names = kept(placed.groupBy("digest").agg(F.count("*").alias("n")).withColumn("id", F.monotonically_increasing_id()), "turn-names")
    named = salted_join(placed, names.select("digest", F.lpad(F.hex("id"), 2 * WIDTH, "0").alias("id")), ["digest"], names.select("digest", "n"), F.col("conv_id"))
    listed = named.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "id", "words"))).alias("turns"))
    out = kept(listed.select("conv_id", F.array_join("turns.id", "").alias("key"), F.col("turns.words").alias("words")), "sequences")
    dropped(placed)
    dropped(names)
    return out


def rebuilt(listed: DataFrame, group: int = 20, heads: int = 4) -> DataFrame:
    """(conv_id, key, words): each conversation c with the first h turns of conversation c - c % group in place of its own, h = crc32(c) % heads."""
    size = 2 * WIDTH
    h = F.expr(f"cast(crc32(cast(cast(conv_id as string) as binary)) % {heads} as int)")
    own = listed.select("*", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
    base = listed.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.substring("key", 1, size * (heads - 1)).alias("head"), F.slice("words", 1, heads - 1).alias("head_words"))
    key = F.concat(F.coalesce(F.expr(f"substring(head, 1, {size} * h)"), F.lit("")), F.expr(f"substring(key, {size} * h + 1)"))
    words = F.concat(F.coalesce(F.expr("slice(head_words, 1, h)"), F.array().cast("array<bigint>")), F.expr("slice(words, h + 1, greatest(size(words), 1))"))
    return own.join(base, "base", "left").select("conv_id", F.unhex(key).alias("key"), words.alias("words"))


def _runs(batches, most: int) -> Iterator[pa.RecordBatch]:
    """Sorted (key, conv_id, words): each run of one key as rows (key, first, n, told, words) of `most` ids, told as text."""

    def row(key, ids, words):
        return {"key": key, "first": ids[0], "n": len(ids), "told": ",".join(map(str, ids)), "words": words}

    schema = pa.schema([("key", pa.binary()), ("first", pa.int64()), ("n", pa.int64()), ("told", pa.string()), ("words", pa.list_(pa.int64()))])
    key, ids, words, out = None, [], None, []
    for batch in batches:
        for k, c, w in zip(*[column.to_pylist() for column in batch.columns], strict=True):
            if k != key or len(ids) == most:
                if ids:
                    out.append(row(key, ids, words))
                key, ids, words = k, [], w
            ids.append(c)
        yield pa.RecordBatch.from_pylist(out, schema)
        out = []
    if ids:
        yield pa.RecordBatch.from_pylist([row(key, ids, words)], schema)


def _blocks(batches, most: int) -> Iterator[pa.RecordBatch]:
    """Sorted runs: the nodes of one tree for each block of at most `most` sequences."""
    schema = pa.schema([("block", pa.int64()), ("place", pa.int32()), *[(n, pa.int64()) for n in ("depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "words")], ("ends", pa.string()), ("path", pa.binary()), ("parent_path", pa.binary())])
    number, block = TaskContext.get().partitionId() << 32, []
    size, now, told = 0, None, None

    def flushed():
        rows = block_nodes(number, *map(list, zip(*block, strict=True)))
        for k in range(0, len(rows), 10_000):
            columns = zip(*rows[k : k + 10_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    for batch in batches:
        for key, first, n, text, words in zip(*[column.to_pylist() for column in batch.columns], strict=True):
            if now is not None and key == now[0]:
                told.update(b"," + text.encode())
                now[1] += n
                continue
            if now is not None:
                block.append((now[0], now[1], now[2], told.hexdigest(), now[3]))
                size += len(now[0])
                if len(block) >= most or size >= BLOCK_BYTES:
                    yield from flushed()
                    number, size, block = number + 1, 0, []
            now, told = [key, n, first, words], hashlib.sha256(text.encode())
    if now is not None:
        block.append((now[0], now[1], now[2], told.hexdigest(), now[3]))
        yield from flushed()


def trie(listed: DataFrame, run: int = RUN, block: int = BLOCK) -> DataFrame:
    """The nodes of the trie over (conv_id, key, words): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    listed = kept(listed, "rebuilt")
    runs = listed.select("key", "conv_id", "words").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    runs = kept(runs.mapInArrow(partial(_runs, most=run), "key binary, first long, n long, told string, words array<long>"), "runs")
    nodes = kept(runs.repartitionByRange("key").sortWithinPartitions("key", "first").mapInArrow(partial(_blocks, most=block), NODE), "nodes")
    dropped(listed)
    dropped(runs)

    opened = nodes.where(F.col("place") != CLOSED)
    merged = opened.groupBy("path").agg(
        F.first("parent_path").alias("parent_path"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"),
        F.max("words").alias("words"), F.max("ends").alias("ends"), F.min("block").alias("owner"),
    )
    inner = merged.where(F.col("parent_path").isNotNull()).groupBy(F.col("parent_path").alias("path")).agg(F.count("*").alias("open_children"))
    merged = kept(merged.join(inner, "path", "left").withColumn("n_children", F.col("n_children") + F.coalesce("open_children", F.lit(0))).drop("open_children"), "open-nodes")
    own = merged.select("path", F.col("owner").alias("block"), F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("saves"))
    placed = opened.select("block", "place", "depth", "path").join(own, ["path", "block"], "left").na.fill(0, ["leaf", "saves"])
    below = Window.partitionBy("block").orderBy(F.desc("depth")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    beside = Window.partitionBy("block", "place").orderBy(F.desc("depth")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    summed = lambda c: F.when(F.col("place") == BOTH, F.sum(c).over(below)).otherwise(F.sum(c).over(beside))
    sums = placed.select("path", summed("leaf").alias("leaf"), summed("saves").alias("saves")).groupBy("path").agg(F.sum("leaf").alias("leaf"), F.sum("saves").alias("saves"))
    up = merged.select(F.col("path").alias("parent_path"), F.col("conv_id").alias("parent_conv_id"))
    final = merged.join(sums, "path").join(up, "parent_path", "left")
    ends = F.coalesce("ends", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256")
    head = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children"]
    final = final.select(*head, (F.col("n_leaves") + F.col("leaf")).alias("n_leaves"), (F.col("saved_tokens") + F.col("saves")).alias("saved_tokens"), ends)
    # closed children of an open node: their block's open nodes tell the parent's least member
    known = opened.select("block", "path").join(merged.select("path", F.col("conv_id").alias("_parent")), "path").withColumnRenamed("path", "parent_path")
    closed = nodes.where(F.col("place") == CLOSED).join(known, ["block", "parent_path"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_parent"))
    return final.unionByName(closed.select(*head, "n_leaves", "saved_tokens", ends))


def nodes(turns: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations of a table of turns."""
    listed = sequences(turns)
    out = trie(rebuilt(listed))
    dropped(listed)
    return out

