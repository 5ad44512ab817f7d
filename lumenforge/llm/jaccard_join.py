"""Operator 4: n-gram Jaccard join by grouped prefixes.

A document's set holds its distinct 5-word shingles (lower-case A-Z). Two documents link when 100 * |A & B| >= 75 * |A | B|.

1. Documents with one word sequence are one class (by a 128-bit BLAKE2 digest of the words). Shingles have one global order:
   seldom ones first, by counts over all documents, then by hash. Linked sets share a shingle among their first
   |A| - ceil(0.75 |A|) + 1, the prefix.
2. Classes with the same size and the same prefix collapse into one group; only groups are joined, and a group's prefix is
   shuffled once, whatever the number of its classes.
3. Group pairs that share a prefix shingle are filtered by size, position and the number of prefix shingles in common. First
   every group is paired with the most central group of each of its shingles (a star), and every class with the head of its
   group; these pairs are expanded to classes and verified, and what links becomes a component. Then the other group pairs are
   formed, but only between groups of different components: a pair inside one component can't change the result.
4. Group pairs are expanded to their members of different components, and every pair is verified on the words themselves.

A shingle that very many groups hold is never gathered: its most central group is a maximum (with partial maxima in each task),
its star is a join with a broadcast list, and pairs across its components come from a join of blocks of groups. Joins on
classes, groups or labels that may hold any share of the rows are salted.

Shingles are ordered and counted by 64-bit hashes (see flat.Words), groups are known by one: a collision can add a pair to be
verified. A link counts only after the words of both documents were compared.

Defined results: null, empty and blank texts have empty sets, link with nothing and are their own component; a text with one to
four words has its whole word sequence as its one shingle; repeated rows and equal texts are one class; rows with a null id take
the smallest known id of their component (null if there is none); rows of one id with different texts are different documents;
further columns pass unchanged.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenforge.llm import flat
from lumenforge.llm.shared import block_join, dropped, free_name, kept, salted_join

WORDS, PERCENT = 5, 75
#: Frequent shingles that the order knows (a bound on what is broadcast); it changes only how many pairs are checked.
HEAVY_SHINGLES = 1 << 20
#: Shingles are counted in parts of this many; a part reports those that HEAVY_IN_PART of its classes hold.
PART_SHINGLES, HEAVY_IN_PART = 1 << 21, 3
#: Groups of a shingle that one task may hold at once; a shingle with more is dealt over blocks of groups.
HOT_ROWS = 4096
#: Groups of a shingle whose pairs across components are formed in one task; a shingle with more is dealt over blocks.
SMALL_RUN = 64
#: Bits of the filter for the texts that are needed (a bound on what is broadcast; once it is full, more texts are shuffled).
FILTER_BITS = 1 << 23
#: Bits of the first look-up into the frequent shingles.
GATE_BITS = 22
#: Classes that a task remembers as told; it only saves repetitions.
REMEMBERED = 1_000_000


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document of a part."""
    words = flat.Words(data, offsets, fold=True)
    every = flat.chained(words.hashes, width, 7)
    out = []
    for a, n in zip(words.first[:-1].tolist(), words.count.tolist(), strict=True):
        if n >= width:
            out.append(np.unique(every[a : a + n - width + 1]))
        elif n:
            out.append(flat.chained(words.hashes[a : a + n], n, 100 + n))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def class_of(words: bytes) -> bytes | None:
    """Digest of a word sequence, None without words."""
    return hashlib.blake2b(words, digest_size=16).digest() if words else None


def group_of(n: int, prefix: np.ndarray) -> int:
    """64-bit name of the documents with n shingles and this prefix."""
    return int.from_bytes(hashlib.blake2b(prefix.tobytes() + n.to_bytes(8, "little"), digest_size=8).digest(), "little", signed=True)


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - (percent * n + 99) // 100 + 1


class Order:
    """Global order of shingles: level of frequency (0 for all that are not known as frequent), then hash."""

    def __init__(self, keys: np.ndarray, levels: np.ndarray):
        self.keys, self.levels = keys, levels
        self.gate = np.zeros(1 << GATE_BITS, bool)
        self.gate[(keys >> np.uint64(64 - GATE_BITS)).astype(np.int64)] = True
        self.hot_level = int(np.log2(HOT_ROWS))

    def prefix(self, found: np.ndarray, length: int) -> tuple[np.ndarray, int, int]:
        """(first shingles in the order, how many of them are not hot, centrality: four times the mean level)."""
        level = np.zeros(len(found), np.uint8)
        if len(self.keys):
            maybe = np.flatnonzero(self.gate[(found >> np.uint64(64 - GATE_BITS)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.keys, found[maybe]), len(self.keys) - 1)
            hit = self.keys[at] == found[maybe]
            level[maybe[hit]] = self.levels[at[hit]]
        order = np.argsort(level, kind="stable")[:length]
        return found[order], int((level[order] < self.hot_level).sum()), min(127, 4 * int(level.sum(dtype=np.int64)) // len(found))


#: A posting's place packs centrality, set size and position.
SIZE_BITS = 28


def packed(central, n, position):
    return F.shiftleft(central.cast("long"), 2 * SIZE_BITS) + F.shiftleft(n.cast("long"), SIZE_BITS) + position


def unpacked(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mask = (1 << SIZE_BITS) - 1
    return place >> (2 * SIZE_BITS), (place >> SIZE_BITS) & mask, place & mask


def size_of(place):
    return F.shiftright(place, SIZE_BITS).bitwiseAND(F.lit((1 << SIZE_BITS) - 1).cast("long"))


def survey(df: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """Rows of two kinds: id, class and set size n of each document; and frequent shingles with their count n in a part."""
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("class", T.BinaryType()), T.StructField("shingle", T.LongType()), T.StructField("n", T.LongType())])

    def run(batches):
        seen: set[bytes] = set()
        fresh: list[np.ndarray] = []

        def counts():
            held = np.sort(np.concatenate(fresh)) if fresh else np.zeros(0, np.uint64)
            starts = np.flatnonzero(np.append(True, held[1:] != held[:-1])) if len(held) else np.zeros(0, np.int64)
            n = np.diff(np.append(starts, len(held)))
            heavy = n >= HEAVY_IN_PART
            k = int(heavy.sum())
            fresh.clear()
            return pa.RecordBatch.from_arrays([pa.nulls(k, kind), pa.nulls(k, pa.binary()), pa.array(held[starts[heavy]].view(np.int64)), pa.array(n[heavy].astype(np.int64))], names=schema.names)

        kind, size = None, 0
        for batch in batches:
            kind = batch.column(0).type
            classes, sizes = [], []
            for _, data, offsets in flat.text_parts(batch.column(1)):
                for found, words in zip(shingle_sets(data, offsets), flat.joined_words(data, offsets, fold=True), strict=True):
                    own = class_of(words)
                    classes.append(own)
                    sizes.append(len(found))
                    if own is not None and own not in seen:
                        seen.add(own)
                        fresh.append(found)
                        size += len(found)
                if len(seen) > REMEMBERED:
                    seen.clear()
                if size > PART_SHINGLES:
                    yield counts()
                    size = 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(classes, pa.binary()), pa.nulls(len(sizes), pa.int64()), pa.array(sizes, pa.int64())], names=schema.names)
        if kind is not None:
            yield counts()

    return df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)


def frequent(surveyed: DataFrame, limit: int = HEAVY_SHINGLES) -> Order:
    """The order from summed counts; the least count is raised until at most `limit` shingles are known."""
    summed = kept(surveyed.where("shingle IS NOT NULL").groupBy("shingle").agg(F.sum("n").alias("n")), "shingle-counts")
    level = F.floor(F.log2("n")).cast("byte")
    sizes = sorted(((r.level, r.rows) for r in summed.groupBy(level.alias("level")).agg(F.count("*").alias("rows")).collect()), reverse=True)
    total, least = 0, None
    for at, rows in sizes:
        if total + rows > limit:
            break
        total, least = total + rows, at
    if least is None:
        dropped(summed)
        return Order(np.zeros(0, np.uint64), np.zeros(0, np.uint8))
    found = summed.where(level >= least).select("shingle", level.alias("level")).toArrow()
    dropped(summed)
    keys = found["shingle"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return Order(keys[order], found["level"].to_numpy().astype(np.uint8)[order])


def grouped(df: DataFrame, order: Order, text_col: str) -> DataFrame:
    """class, group, n, central, cold (prefix shingles that are not hot) and prefix of each class; the prefix comes with the
    first class of a group in a task and is null for the others."""
    shared = df.sparkSession.sparkContext.broadcast(order)

    def run(batches):
        order, seen, told = shared.value, set(), set()
        for batch in batches:
            for _, data, offsets in flat.text_parts(batch.column(0)):
                rows = []
                for found, words in zip(shingle_sets(data, offsets), flat.joined_words(data, offsets, fold=True), strict=True):
                    own = class_of(words)
                    if own is None or own in seen:
                        continue
                    seen.add(own)
                    prefix, cold, central = order.prefix(found, prefix_length(len(found)))
                    group = group_of(len(found), prefix)
                    rows.append((own, group, len(found), central, cold, None if group in told else prefix.view(np.int64)))
                    told.add(group)
                if len(seen) > REMEMBERED:
                    seen.clear()
                    told.clear()
                if rows:
                    columns = list(zip(*rows, strict=True))
                    types = [pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64())]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["class", "group", "n", "central", "cold", "prefix"])

    return df.select(F.col(text_col).cast("string")).mapInArrow(run, "class binary, group long, n long, central int, cold int, prefix array<long>")


def postings(groups: DataFrame, hot: bool) -> DataFrame:
    """(shingle, group, place) of the prefix shingles that are hot or that are not."""
    rows = groups.where("prefix IS NOT NULL AND cold < size(prefix)" if hot else "prefix IS NOT NULL AND cold > 0")
    part = F.slice("prefix", F.col("cold") + 1, F.size("prefix")) if hot else F.slice("prefix", F.lit(1), F.col("cold"))
    at = F.col("pos") + F.col("cold") if hot else F.col("pos")
    return rows.select("group", "n", "central", "cold", F.posexplode(part).alias("pos", "shingle")).select("shingle", "group", packed(F.col("central"), F.col("n"), at).alias("place"))


def may_link(n1, p1, n2, p2):
    """Size and position filters: whether sets of these sizes can link if their first common shingle is here. Arrays or columns."""
    smaller, larger = (np.minimum, np.maximum) if isinstance(n1, np.ndarray) else (F.least, F.greatest)
    most = smaller(n1 - p1, n2 - p2)  # this one and what follows
    return (100 * smaller(n1, n2) >= PERCENT * larger(n1, n2)) & ((100 + PERCENT) * most >= PERCENT * (n1 + n2))


def _runs(batches, columns: int):
    """Rows of sorted batches regrouped so that no run of one shingle (column 0) is split; arrays of each column."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(columns)]
        if held is not None:
            now = [np.concatenate([a, b]) for a, b in zip(held, now, strict=True)]
        cut = int(np.searchsorted(now[0], now[0][-1], "left"))
        held = [x[cut:] for x in now]
        if cut:
            yield [x[:cut] for x in now]
    if held is not None:
        yield held


def star_pairs(rows: DataFrame) -> DataFrame:
    """Of shingles that are not hot. kind 0: pairs (a, b) of each group with the most central one of a shingle, x shingles in
    common so far, y both sizes; kind 1: groups (a = shingle, b = group, x = place) of shingles that two or more hold."""

    def run(batches):
        for token, owner, place in _runs(batches, 3):
            order = np.lexsort((owner, -(place >> (2 * SIZE_BITS)), token))
            token, owner, place = token[order], owner[order], place[order]
            again = np.append(False, (token[1:] == token[:-1]) & (owner[1:] == owner[:-1]))  # told by several tasks
            token, owner, place = token[~again], owner[~again], place[~again]
            starts = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
            length = np.diff(np.append(starts, len(token)))
            shared = np.repeat(length > 1, length)
            pivot = np.repeat(starts, length)
            _, n, _ = unpacked(place)
            member = np.flatnonzero(shared & (np.arange(len(token)) != pivot))
            member = member[100 * np.minimum(n[member], n[pivot[member]]) >= PERCENT * np.maximum(n[member], n[pivot[member]])]
            a, b, sizes = owner[pivot[member]], owner[member], (n[pivot[member]] << SIZE_BITS) | n[member]
            order = np.lexsort((b, a))
            a, b, sizes = a[order], b[order], sizes[order]
            first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, np.int64)
            counts = np.diff(np.append(first, len(a)))
            kinds = np.append(np.zeros(len(first), np.int32), np.ones(int(shared.sum()), np.int32))
            columns = [kinds, np.append(a[first], token[shared]), np.append(b[first], owner[shared]), np.append(counts, place[shared]), np.append(sizes[first], np.zeros(int(shared.sum()), np.int64))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["kind", "a", "b", "x", "y"])

    return rows.repartition("shingle").sortWithinPartitions("shingle").mapInArrow(run, "kind int, a long, b long, x long, y long")


def hot_star_pairs(rows: DataFrame) -> DataFrame:
    """(a, b, x, y) like kind 0 of star_pairs, of hot shingles: at most HEAVY_SHINGLES of them, so the list of their most
    central groups is broadcast."""
    rank = F.shiftleft(F.shiftright("place", 2 * SIZE_BITS), 56) + F.shiftrightunsigned("group", 8)
    heads = rows.withColumn("rank", rank).groupBy("shingle").agg(F.max_by("group", "rank").alias("head"), F.max_by(size_of("place"), "rank").alias("head_n"))
    n = size_of("place")
    paired = rows.join(F.broadcast(heads), "shingle").where((F.col("group") != F.col("head")) & (100 * F.least(n, F.col("head_n")) >= PERCENT * F.greatest(n, F.col("head_n"))))
    return paired.select(F.col("head").alias("a"), F.col("group").alias("b"), F.lit(1).cast("long").alias("x"), (F.shiftleft("head_n", SIZE_BITS) + n).alias("y"))


def _needed(n1, n2):
    """Prefix shingles that linked sets of these sizes have in common at least: overlap <= common + the longer rest."""
    rest = lambda n: F.floor((PERCENT * n + 99) / 100) - 1
    return F.ceil(PERCENT * (n1 + n2) / (100.0 + PERCENT)) - F.greatest(rest(n1), rest(n2))


def promising(stars: DataFrame) -> DataFrame:
    """Star pairs that share enough of their prefixes. A star counts only the shingles of its own centre, so a pair that fails
    here may still link; the pairs across components have it."""
    n1, n2 = F.shiftright("y", SIZE_BITS), F.col("y").bitwiseAND(F.lit((1 << SIZE_BITS) - 1).cast("long"))
    return stars.groupBy("a", "b").agg(F.sum("x").alias("x"), F.min("y").alias("y")).where(F.col("x") >= _needed(n1, n2)).select("a", "b")


def small_runs(members: DataFrame) -> DataFrame:
    """members: shingle, group, place, label, before; of shingles that are not hot. kind 0: pairs (a, b) of groups with different
    labels that may link, of shingles that at most SMALL_RUN groups hold; kind 1: the groups of the other shingles (a = shingle,
    b = group, place, label, before), if they have several labels. before: the shingle in front of this one in the group's
    prefix. Two groups with the same one there are a pair of that shingle already, and are not told again here."""

    def run(batches):
        held = None
        for batch in chain(batches, [None]):  # the rows of a task's last shingle wait for the next batch
            now = held if batch is None else pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if now is None or not now.num_rows:
                continue
            token = now.column(0).to_numpy()
            cut = len(token) if batch is None else int(np.searchsorted(token, token[-1], "left"))
            held = now.slice(cut).combine_chunks()
            now = now.slice(0, cut)
            if not cut:
                continue
            label = now.column(3).combine_chunks().dictionary_encode().indices.to_numpy()
            token, owner, place = token[:cut], now.column(1).to_numpy(), now.column(2).to_numpy()
            starts = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
            length = np.diff(np.append(starts, len(token)))
            several = np.minimum.reduceat(label, starts) != np.maximum.reduceat(label, starts)
            large = np.flatnonzero(np.repeat(several & (length > SMALL_RUN), length))
            if len(large):
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(large), np.int32)), pa.array(token[large]), pa.array(owner[large]), pa.array(place[large]), now.column(3).take(pa.array(large)).combine_chunks(), pa.array(now.column(4).to_numpy()[large])], names=names)
            small = np.flatnonzero(np.repeat(several & (length <= SMALL_RUN), length))
            token, owner, place, label, before = token[small], owner[small], place[small], label[small], now.column(4).to_numpy()[small]
            _, n, position = unpacked(place)
            low, high = [], []
            for step in range(1, SMALL_RUN):
                one = np.flatnonzero(token[step:] == token[:-step]) if len(token) > step else np.zeros(0, np.int64)
                if not len(one):
                    break
                two = one + step
                good = (label[one] != label[two]) & (before[one] != before[two]) & may_link(n[one], position[one], n[two], position[two])
                low.append(np.minimum(owner[one[good]], owner[two[good]]))
                high.append(np.maximum(owner[one[good]], owner[two[good]]))
            if low:
                x, y = np.concatenate(low), np.concatenate(high)
                order = np.lexsort((y, x))
                x, y = x[order], y[order]
                new = np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))[: len(x)]
                x, y = x[new], y[new]
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(x), np.int32)), pa.array(x), pa.array(y), pa.nulls(len(x), pa.int64()), pa.nulls(len(x), pa.binary()), pa.nulls(len(x), pa.int64())], names=names)

    names = ["kind", "a", "b", "place", "label", "before"]
    return members.select("shingle", "group", "place", "label", "before").repartition("shingle").sortWithinPartitions("shingle").mapInArrow(run, "kind int, a long, b long, place long, label binary, before long")


def block_pairs(members: DataFrame) -> DataFrame:
    """Pairs (a, b) like kind 0 of small_runs, for shingles that any number of groups hold: of a shingle, every group outside
    its largest component meets the others, block by block."""
    counts = members.groupBy("shingle", "label").agg(F.count("*").alias("n"))
    main = counts.groupBy("shingle").agg(F.max(F.struct("n", "label")).alias("m"), F.sum("n").alias("n"), F.count("*").alias("labels")).where("labels > 1")
    main = kept(main.select("shingle", F.col("m.label").alias("main"), "n"), "main")
    own = salted_join(members, main.select("shingle", "main"), ["shingle"], main.select("shingle", "n"), F.col("group"))
    n, position = size_of("place"), F.col("place").bitwiseAND(F.lit((1 << SIZE_BITS) - 1).cast("long"))
    own = kept(own.select("shingle", "group", "label", "before", n.alias("n"), position.alias("p"), (F.col("label") == F.col("main")).alias("largest")), "large")
    side = lambda k: own.select("shingle", F.col("largest").alias(f"largest{k}"), *[F.col(c).alias(f"{c}{k}") for c in ("group", "label", "before", "n", "p")])
    met = block_join(side(1).where("NOT largest1"), side(2), "shingle", F.col("group1"), F.col("group2"))
    met = met.where((F.col("label1") != F.col("label2")) & (F.col("before1") != F.col("before2")) & (F.col("largest2") | (F.col("group1") < F.col("group2"))) & may_link(F.col("n1"), F.col("p1"), F.col("n2"), F.col("p2")))
    return met.select(F.least("group1", "group2").alias("a"), F.greatest("group1", "group2").alias("b"))


def attached(rows: DataFrame, pairs: DataFrame, table: DataFrame, side: str, key: str, columns: list[str]) -> DataFrame:
    """rows (a, b, ...) with table's columns for one side, named column_side; a key may be in any share of the rows. pairs: the
    (a, b) of rows, kept."""
    named = table.select(F.col(key).alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns])
    return salted_join(rows, named, [side], pairs.groupBy(side).agg(F.count("*").alias("n")), F.col("b" if side == "a" else "a"))


def prefixes(groups: DataFrame) -> DataFrame:
    """group, prefix, n of each group."""
    return groups.where("prefix IS NOT NULL").groupBy("group").agg(F.max("prefix").alias("prefix"), F.max("n").alias("n"))


def sharing(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """The group pairs (a, b) that share enough of their prefixes."""
    parts = prefixes(groups)
    both = attached(attached(pairs, pairs, parts, "a", "group", ["prefix", "n"]), pairs, parts, "b", "group", ["prefix", "n"])
    return both.where(F.size(F.array_intersect("prefix_a", "prefix_b")) >= _needed(F.col("n_a"), F.col("n_b"))).select("a", "b")


def needed_texts(df: DataFrame, pairs: DataFrame, text_col: str) -> DataFrame:
    """(class, text: its words joined by one space) of the classes in pairs (a, b); a filter of fixed size may let others through."""
    slot = F.pmod(F.xxhash64("class"), F.lit(FILTER_BITS))
    bits = pairs.select(F.explode(F.array("a", "b")).alias("class")).groupBy(F.shiftright(slot, 6).cast("int").alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(xxhash64(class), {FILTER_BITS}L) & 63 as int))")).alias("bits"))
    found = bits.toArrow()
    held = np.zeros(FILTER_BITS // 64, np.int64)
    held[found["w"].to_numpy()] = found["bits"].to_numpy()
    shared = df.sparkSession.sparkContext.broadcast(held.view(np.uint64))

    def run(batches):
        import xxhash

        bits, seen = shared.value, set()
        for batch in batches:
            for _, data, offsets in flat.text_parts(batch.column(0)):
                rows = []
                for words in flat.joined_words(data, offsets, fold=True):
                    own = class_of(words)
                    if own is None or own in seen:
                        continue
                    at = xxhash.xxh64_intdigest(own, 42) % FILTER_BITS
                    if int(bits[at >> 6]) >> (at & 63) & 1:
                        seen.add(own)
                        rows.append((own, words))
                if len(seen) > REMEMBERED:
                    seen.clear()
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.binary()) for k in (0, 1)], names=["class", "text"])

    # the same class may come from several tasks
    return df.select(F.col(text_col).cast("string")).mapInArrow(run, "class binary, text binary").dropDuplicates(["class"])


def links(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Whether the texts a[i] and b[i], words joined by spaces and not equal, link: their words are compared, not hashes of them."""
    data = np.frombuffer(b"".join(a + b), np.uint8)
    words = flat.Words(data, np.append(0, np.cumsum([len(t) for t in a + b])))
    grams = flat.exact_grams(words.exact_ids(), WORDS)
    sets = [np.unique(grams[x : x + n - WORDS + 1]) if n >= WORDS else grams[:0] for x, n in zip(words.first[:-1].tolist(), words.count.tolist(), strict=True)]
    out = np.zeros(len(a), bool)
    for k, (u, v) in enumerate(zip(sets[: len(a)], sets[len(a) :], strict=True)):
        common = len(np.intersect1d(u, v, True))
        out[k] = common > 0 and 100 * common >= PERCENT * (len(u) + len(v) - common)
    return out


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The class pairs (a, b) that link."""

    def run(batches):
        for batch in batches:
            size = pc.add(pc.binary_length(batch.column(2)), pc.binary_length(batch.column(3))).to_numpy(zero_copy_only=False)
            part = np.cumsum(size.astype(np.int64)) // flat.CHUNK_BYTES
            edges = np.append(np.flatnonzero(np.diff(part, prepend=-1)), batch.num_rows).tolist()
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                rows = batch.slice(lo, hi - lo)
                good = pa.array(links(rows.column(2).to_pylist(), rows.column(3).to_pylist()))
                yield pa.RecordBatch.from_arrays([rows.column(0).filter(good), rows.column(1).filter(good)], names=["a", "b"])

    both = attached(attached(pairs, pairs, texts, "b", "class", ["text"]), pairs, texts, "a", "class", ["text"])
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary")


def connected(edges: DataFrame) -> DataFrame:
    """(node, label) of all nodes of edges (a, b): the least node of each component.

    Each round takes the least label among the neighbours and then the label's own label; every round is written to the shared
    folder. Minima have partial forms in each task and the joins are salted, so nodes with very many edges, or labels of very
    many nodes, are no burden.
    """
    both = kept(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b"), "edges")
    degrees = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"), F.count("*").alias("degree"))
    labels = kept(degrees.select("node", F.least("node", "m").alias("label"), "degree"), "labels")
    while True:
        near = labels.select(F.col("node").alias("b"), "label")
        told = salted_join(both, near, ["b"], labels.select(F.col("node").alias("b"), F.col("degree").alias("n")), F.col("a")).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        lower = kept(labels.join(told, "node").select("node", F.least("label", "m").alias("label"), F.col("label").alias("old"), "degree"), "labels")
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        after = kept(salted_join(lower, jump, ["label"], lower.groupBy("label").agg(F.count("*").alias("n")), F.col("node")).select("node", F.least("label", "further").alias("label"), "old", "degree"), "labels")
        changed = after.where("label <> old").limit(1).count()
        dropped(labels)
        dropped(lower)
        labels = after.select("node", "label", "degree")
        labels.kept_path = after.kept_path
        if not changed:
            dropped(both)
            return labels.select("node", "label")


def classes_joined(df: DataFrame, text_col: str, id_col: str) -> tuple[DataFrame, DataFrame]:
    """(documents: id, class, n; labels: node, label of the classes that link with another class)."""
    surveyed = kept(survey(df, text_col, id_col), "survey")
    groups = kept(grouped(df, frequent(surveyed), text_col), "groups")
    hot = postings(groups, True)
    stars = kept(star_pairs(postings(groups, False)), "stars")
    classes = groups.select("class", "group").distinct()
    heads = kept(classes.groupBy("group").agg(F.min("class").alias("head"), F.count("*").alias("rows")), "heads")
    # expanded: the heads of two groups, and every class of a group with its head
    ahead = heads.select("group", "head")
    told = kept(promising(stars.where("kind = 0").select("a", "b", "x", "y").unionByName(hot_star_pairs(hot))), "stars")
    across = attached(attached(told, told, ahead, "a", "group", ["head"]), told, ahead, "b", "group", ["head"]).select(F.col("head_a").alias("a"), F.col("head_b").alias("b"))
    several = heads.where("rows > 1")
    within = salted_join(classes, several.select("group", "head"), ["group"], several.select("group", F.col("rows").alias("n")), F.col("class")).where("class <> head").select(F.col("head").alias("a"), F.col("class").alias("b"))
    pairs = kept(across.union(within).distinct(), "pairs")
    edges = kept(verified(pairs, needed_texts(df, pairs, text_col)), "links")
    labels = connected(edges)
    # group pairs across components: a group of several components has a label of its own
    labelled = kept(classes.join(labels.withColumnRenamed("node", "class"), "class", "left").select("class", "group", F.coalesce("label", "class").alias("label")), "labelled")
    bounds = kept(labelled.groupBy("group").agg(F.min("label").alias("low"), F.max("label").alias("high")), "bounds")
    group_labels = bounds.join(prefixes(groups), "group").select("group", "prefix", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.encode(F.col("group").cast("string"), "utf-8")).alias("label"))
    position = F.col("place").bitwiseAND(F.lit((1 << SIZE_BITS) - 1).cast("long")).cast("int")
    before = F.when(position > 0, F.element_at("prefix", F.greatest(position, F.lit(1)))).otherwise(F.col("group")).alias("before")
    marked = lambda rows: rows.join(group_labels, "group").select("shingle", "group", "place", "label", before)
    met = kept(small_runs(marked(stars.where("kind = 1").select(F.col("a").alias("shingle"), F.col("b").alias("group"), F.col("x").alias("place")))), "runs")
    large = met.where("kind = 1").select(F.col("a").alias("shingle"), F.col("b").alias("group"), "place", "label", "before").unionByName(marked(hot.distinct()))
    candidates = kept(met.where("kind = 0").select("a", "b").unionByName(block_pairs(kept(large, "large"))).distinct(), "candidates")
    mixed = bounds.where("low <> high").select(F.col("group").alias("a"), F.col("group").alias("b"))
    matched = kept(sharing(candidates, groups).union(mixed), "matched")
    # expanded to members of different components; a group may have any number of members and of partners
    left, right = (labelled.select(F.col("group").alias(g), F.col("class").alias(f"class{k}"), F.col("label").alias(f"label{k}")) for k, g in ((1, "a"), (2, "b")))
    half = kept(block_join(matched, left, "a", F.col("b"), F.col("class1")), "half")
    members = block_join(half, right, "b", F.col("class1"), F.col("class2")).where("label1 <> label2").select(F.least("class1", "class2").alias("a"), F.greatest("class1", "class2").alias("b")).distinct()
    done = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    crossing = kept(members.join(done, ["a", "b"], "left_anti"), "crossing")
    more = kept(verified(crossing, needed_texts(df, crossing, text_col)), "links")
    if more.limit(1).count():
        labels = connected(edges.union(more))
    for table in (groups, stars, told, heads, pairs, labelled, bounds, met, candidates, matched, half, crossing):
        dropped(table)
    return surveyed.where("shingle IS NULL").select("id", "class", "n"), labels


def components(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id_col, n_shingles and component_id of each row."""
    docs, labels = classes_joined(df, text_col, id_col)
    named, heads = _named(docs, labels)
    of_class = salted_join(named, heads.select("label", F.col("head.id").alias("component_id")), ["label"], heads.select("label", F.col("classes").alias("n")), F.col("class")).select("class", "component_id")
    worded = salted_join(docs.where("class IS NOT NULL"), of_class, ["class"], named.select("class", F.col("rows").alias("n")), F.col("id"))
    out = worded.select("id", "n", "component_id").unionByName(docs.where("class IS NULL").select("id", "n", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def _named(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(class, label, rows of each class; label, head: least known id of the component and its class, classes)."""
    least = docs.where("class IS NOT NULL").groupBy("class").agg(F.min("id").alias("id"), F.count("*").alias("rows"))
    named = kept(least.join(labels.withColumnRenamed("node", "class"), "class", "left").select("class", "id", "rows", F.coalesce("label", "class").alias("label")), "named")
    heads = named.groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("unknown"), "id", "class")).alias("head"), F.count("*").alias("classes"))
    return named.select("class", "label", "rows"), heads


def representatives(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row of df for each group of linked documents, that with the least id (null only if no id of the group is known);
    ties go to the least class. Rows without words link with nothing and all stay."""
    docs, labels = classes_joined(df, text_col, id_col)
    own, key = free_name(df, "_class"), free_name(df, "_key")
    schema = T.StructType([*df.schema.fields, T.StructField(own, T.BinaryType())])

    def classed(batches):
        seen: set[tuple] = set()
        for batch in batches:
            at_id, at_text = batch.schema.get_field_index(id_col), batch.schema.get_field_index(text_col)
            ids = batch.column(at_id).to_pylist()
            column = batch.column(at_text)
            classes = [class_of(w) for _, data, offsets in flat.text_parts(column.cast(pa.string())) for w in flat.joined_words(data, offsets, fold=True)]
            fresh = []
            for pair in zip(ids, classes, strict=True):  # of equal rows in a task, one goes on
                fresh.append(pair[1] is None or pair not in seen)
                seen.add(pair)
            if len(seen) > REMEMBERED:
                seen.clear()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(classes, pa.binary())], names=schema.names).filter(pa.array(fresh))

    named = df.mapInArrow(classed, schema)
    named_key = lambda c, i: F.concat(c, F.when(i.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), i.cast("string"))).cast("binary"))
    heads = _named(docs, labels)[1].select(named_key(F.col("head.class"), F.col("head.id")).alias(key))
    one = named.where(F.col(own).isNotNull()).withColumn(key, named_key(F.col(own), F.col(id_col))).join(heads, key, "left_semi").dropDuplicates([key])
    return one.select(*df.columns).unionByName(named.where(F.col(own).isNull()).select(*df.columns))
