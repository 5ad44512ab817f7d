"""Operator 7: exact substring dedup by recompression.

Recompression renames maximal runs of equal symbols and then adjacent pairs (left kind, right kind by a bit of the name), so
that equal substrings get the same symbols inside, whatever surrounds them. Here a task forms several levels of runs and pairs
at once, a phrase, and every Spark round gives the phrases of the whole corpus their global names:

1. Round 1 forms phrases of words. The naming table counts equal phrases of all documents (by a 96-bit BLAKE2 digest of their
   words) and numbers those that occur twice or more; the numbers go back by a join. A phrase without a number is unique, and so
   is every window that holds all words which its forming depended on. Whole documents are phrases, too.
2. Later rounds form phrases of names, as long as the symbols go on without a gap, and name them in the same way (a digest of
   names, so equal names mean equal words). A named phrase of `WINDOW` words or more reveals a long repeat: all its windows are
   repeated, and only its first copy has to tell them to others. So a group of copies costs one copy.
3. The windows that are still told are verified on their words: Spark counts 96-bit BLAKE2 digests of the words of each, and
   those that are told once go.
4. Words covered by a repeated window are removed.

"First" is the least (document number, place): a copy that leaves a window to an earlier one never depends on a later one, so
of equal windows one is always told.

Counts are sums with partial sums in each task, and the join that brings names back deals hot names over many tasks, so a
phrase in a third of all documents is no burden: no group is ever gathered.

Defined results: words are [^\\x20\\x09-\\x0D]+; null and empty texts have no words; a text below WINDOW words loses nothing;
all copies of a repeated window go, the first included, and repeats may overlap inside one text; windows are judged on the
input; repeated rows are copies of each other; rows with a null id are ordinary documents; further columns pass unchanged, but an
output replaces an old column of its name.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenforge.llm import flat
from lumenforge.llm.shared import cleared, dropped, free_name, kept, salted_join

#: Words of a window, Spark rounds of naming, levels of runs and pairs in a phrase of words and in a phrase of names.
WINDOW, ROUNDS, WORD_LEVELS, NAME_LEVELS = 35, 5, 6, 4
FAR = np.int64(1) << 30
#: Bits of the filter for the texts that have windows to judge (a bound on what is broadcast; once it is full, more texts are shuffled).
FILTER_BITS = 1 << 23
#: Texts that a task remembers as told; it only saves repetitions.
REMEMBERED = 1_000_000


def phrases(hashes: np.ndarray, doc: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first symbol, first and last symbol that its forming depended on) of each phrase of the symbols of some documents.

    A symbol's hash decides its kind; symbol positions count through all documents. A dependency on a document's edge gives a
    place beyond that edge.
    """
    name, at = hashes.copy(), np.arange(len(hashes), dtype=np.int64)
    low, high = at.copy(), at.copy()
    for level in range(levels):
        if len(name) < 2:
            break
        salt = np.uint64(level * 2 + 1)
        inner = doc[1:] == doc[:-1]
        if level == 0:  # maximal runs, with what ends them on both sides
            starts = np.flatnonzero(np.append(True, ~inner | (name[1:] != name[:-1])))
            length = np.diff(np.append(starts, len(name)))
            own_low, own_high = np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)
            named, run = name[starts], length > 1
            named[run] = flat.mix(named[run] * flat.MIX_A + length[run].astype(np.uint64) + salt)
            ends = starts + length - 1
            before = np.where((starts > 0) & (doc[starts - 1] == doc[starts]), low[starts - 1], -FAR)
            after_at = np.minimum(ends + 1, len(name) - 1)
            after = np.where((ends + 1 < len(name)) & (doc[after_at] == doc[ends]), high[after_at], FAR)
            name, doc, at, low, high = named, doc[starts], at[starts], np.minimum(own_low, before), np.maximum(own_high, after)
            inner = doc[1:] == doc[:-1]
        kind = (flat.mix(name ^ np.uint64((level * 2 + 1) * int(flat.MIX_B) % (1 << 64))) >> np.uint64(63)).astype(bool)
        joins = np.append(inner & ~kind[:-1] & kind[1:], False)
        second = np.append(False, joins[:-1])
        left, right = np.flatnonzero(joins), np.flatnonzero(joins) + 1
        new_low, new_high = low.copy(), high.copy()
        new_high[left] = np.maximum(high[left], high[right])
        new_low[left] = np.minimum(low[left], low[right])
        alone = ~joins & ~second
        reach = np.flatnonzero(alone & ~kind)  # a left kind stays alone because of what follows
        nxt = np.minimum(reach + 1, len(name) - 1)
        new_high[reach] = np.maximum(high[reach], np.where((reach + 1 < len(name)) & (doc[nxt] == doc[reach]), high[nxt], FAR))
        reach = np.flatnonzero(alone & kind)  # a right kind because of what precedes
        prv = np.maximum(reach - 1, 0)
        new_low[reach] = np.minimum(low[reach], np.where((reach > 0) & (doc[prv] == doc[reach]), low[prv], -FAR))
        new_name = name.copy()
        new_name[left] = flat.joined(name[left] + salt, name[right])
        keep = ~second
        name, doc, at, low, high = new_name[keep], doc[keep], at[keep], new_low[keep], new_high[keep]
    return at, low, high


def digest(content: bytes) -> bytes:
    return hashlib.blake2b(content, digest_size=12).digest()


def halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The first eight and the last four bytes of each digest."""
    both = np.frombuffer(b"".join(digests), [("one", "<i8"), ("two", "<i4")])
    return both["one"].copy(), both["two"].copy()


def word_bounds(words: flat.Words) -> np.ndarray:
    """Where each word starts in its document's words joined by one space."""
    step = words.ends - words.starts + 1
    at = np.cumsum(step) - step
    return at - np.repeat(at[np.minimum(words.first[:-1], max(len(at) - 1, 0))], words.count) if len(at) else at


def covered(low: np.ndarray, high: np.ndarray, size: int) -> np.ndarray:
    """True for the places in any [low, high)."""
    return np.cumsum(np.bincount(low, minlength=size + 1) - np.bincount(high, minlength=size + 1))[:size] > 0


def listed(values: np.ndarray, doc: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    """Lists of a column, one for each of n documents; values ordered by document."""
    ends = np.append(0, np.cumsum(np.bincount(doc, minlength=n)))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))


def owners(column: pa.Array) -> np.ndarray:
    """The document of each value of a column of lists; null lists are empty."""
    sizes = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    return np.repeat(np.arange(len(column)), sizes)


def unlisted(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, document of each) of a column of lists of numbers."""
    return column.flatten().to_numpy(zero_copy_only=False), owners(column)


def ranges(flags: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(low, high of each maximal range of True one after the other, relative to its document; document). base: where documents start."""
    edge = np.zeros(len(flags) + 1, bool)
    edge[base] = True
    before = np.append(False, flags[:-1]) & ~edge[:-1] if len(flags) else flags
    after = np.append(flags[1:], False) & ~edge[1:] if len(flags) else flags
    low, high = np.flatnonzero(flags & ~before), np.flatnonzero(flags & ~after) + 1
    doc = np.searchsorted(base, low, "right") - 1
    return np.stack([low - base[doc], high - base[doc]], 1).ravel(), np.repeat(doc, 2)


def flags_of(column: pa.Array, base: np.ndarray) -> np.ndarray:
    """The inverse of ranges."""
    values, doc = unlisted(column)
    at = values + base[doc]
    return covered(at[0::2], at[1::2], int(base[-1]))


def parts_of(batches, words: int = 1 << 18):
    """Slices of the batches of documents with about `words` words each (column 2), so that a task's arrays stay small."""
    for batch in batches:
        total = np.cumsum(batch.column(2).to_numpy().astype(np.int64)) // words
        edges = np.append(np.flatnonzero(np.diff(total, prepend=-1)), batch.num_rows).tolist()
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if hi > lo:
                yield batch.slice(lo, hi - lo)


STATE = "id long, key binary, n int, alive array<int>, known array<int>, name array<long>, left array<long>, right array<int>, start array<int>, size array<int>, open boolean"


def first_phrases(texts: DataFrame, window: int) -> DataFrame:
    """key, n words, and the phrases of words of each text (key, text) of `window` words or more: halves of the digest, start, and
    the words before and behind the start that its forming depended on. The last phrase is the whole document."""

    def run(batches):
        for batch in batches:
            keys = batch.column(0)
            for row, data, offsets in flat.text_parts(batch.column(1)):
                words = flat.Words(data, offsets)
                texts = flat.joined_words(data, offsets)
                at_word = word_bounds(words)
                start, low, high = phrases(words.hashes, np.repeat(np.arange(len(texts)), words.count), WORD_LEVELS)
                first = np.searchsorted(start, words.first)
                long = np.flatnonzero(words.count >= window).tolist()
                out = []
                for k in long:
                    a, b, base, text = first[k], first[k + 1], words.first[k], texts[k]
                    cuts = [*at_word[start[a:b]].tolist(), len(text) + 1]
                    one, two = halves([*[digest(text[x : y - 1]) for x, y in zip(cuts[:-1], cuts[1:], strict=True)], digest(b"whole " + text)])
                    own = start[a:b]
                    out.append((int(words.count[k]), one, two, np.append(own - base, 0), np.append(np.minimum(own - low[a:b], FAR), 0), np.append(np.minimum(high[a:b] - own, FAR), 0)))
                if out:
                    columns = list(zip(*out, strict=True))
                    doc = np.repeat(np.arange(len(out)), [len(x) for x in columns[1]])
                    lists = [listed(np.concatenate(c), doc, len(out), t) for c, t in zip(columns[1:], (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()), strict=True)]
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array([row + k for k in long])), pa.array(columns[0], pa.int32()), *lists], names=["key", "n", "left", "right", "start", "before", "behind"])

    return texts.mapInArrow(run, "key binary, n int, left array<long>, right array<int>, start array<int>, before array<int>, behind array<int>")


def named(state: DataFrame, number: int) -> DataFrame:
    """id, names: (place in the list, name, first document) of the phrases (left, right) that occur twice or more: one Spark
    round. The naming table is kept, so a name stays what it is if a task is run again."""
    told = state.select("id", F.posexplode(F.arrays_zip("left", "right")).alias("at", "p")).select("id", "at", "p.left", "p.right").where("right IS NOT NULL")
    table = told.groupBy("left", "right").agg(F.count("*").alias("n"), F.min("id").alias("first")).where("n > 1")
    table = kept(table.select("left", "right", "n", "first", (F.monotonically_increasing_id() + (number << 56) + 1).alias("name")), "names")
    back = salted_join(told, table.drop("n"), ["left", "right"], table.select("left", "right", "n"), F.col("id"))
    return back.groupBy("id").agg(F.collect_list(F.struct("at", "name", "first")).alias("names"))


def _given(column: pa.Array) -> tuple[np.ndarray, ...]:
    """(document, place, name, first) of the names that came back."""
    values, doc = column.flatten(), owners(column)
    return (doc, *[values.field(k).to_numpy(zero_copy_only=False) for k in range(3)])


def _next_state(batch, n, base, alive, known, name, doc, start, size, window: int) -> pa.RecordBatch:
    """The state with the next phrases of names; symbols that touch no told window are left out."""
    words = np.append(0, np.cumsum(n))
    at = np.flatnonzero(alive)
    owner = np.searchsorted(base, at, "right") - 1
    place = at - base[owner] + words[owner]
    reach = np.append(0, np.cumsum(covered(place, place + window, int(words[-1]))))
    low = start + words[doc]
    stays = np.flatnonzero((name != 0) & (reach[low + size] > reach[low]))
    name, doc, start, size, low = name[stays], doc[stays], start[stays], size[stays], low[stays]
    part = np.cumsum(np.append(0, (doc[1:] != doc[:-1]) | (low[1:] != low[:-1] + size[:-1])).astype(np.int64))[: len(name)]
    first = phrases(flat.mix(name.view(np.uint64)), part, NAME_LEVELS)[0]
    ends = np.append(first[1:], len(name))
    several = np.flatnonzero(ends - first > 1)
    one, two = halves([digest(name[a:b].tobytes()) for a, b in zip(first[several].tolist(), ends[several].tolist(), strict=True)])
    left, right, open_ = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64), np.ones(len(first), bool)
    left[several], right[several], open_[several] = one, two, False
    total = np.append(0, np.cumsum(size))
    own, k = doc[first], len(n)
    right_list = pa.ListArray.from_arrays(listed(right, own, k, pa.int64()).offsets, pa.array(right.astype(np.int32), mask=open_))
    kept_name = np.where(open_, name[first] if len(first) else left, 0)
    columns = [batch.column(0), batch.column(1), pa.array(n, pa.int32()), *[listed(*ranges(f, base), k, pa.int32()) for f in (alive, known)], listed(kept_name, own, k, pa.int64()), listed(left, own, k, pa.int64()), right_list, listed(start[first], own, k, pa.int32()), listed(total[ends] - total[first], own, k, pa.int32())]
    undecided = np.bincount(np.searchsorted(base, np.flatnonzero(alive & ~known), "right") - 1, minlength=k) > 0
    columns.append(pa.array(undecided))
    rest = pa.RecordBatch.from_arrays(columns, names=["id", "key", "n", "alive", "known", "name", "left", "right", "start", "size", "open"])
    some = (np.bincount(owner, minlength=k) + np.bincount(np.searchsorted(base, np.flatnonzero(known), "right") - 1, minlength=k)) > 0
    return rest.filter(pa.array(some))


def first_state(joined: DataFrame, window: int) -> DataFrame:
    """State after round 1. joined: first_phrases with their names. alive: windows that are told; known: repeated ones."""

    def run(batches):
        for batch in parts_of(batches):
            n = batch.column(2).to_numpy().astype(np.int64)
            base = np.append(0, np.cumsum(n - window + 1))
            ids = batch.column(0).to_numpy()
            start, doc = unlisted(batch.column(3))
            before, behind = (unlisted(batch.column(c))[0].astype(np.int64) for c in (4, 5))
            start = start.astype(np.int64)
            begin = np.append(0, np.cumsum(np.bincount(doc, minlength=len(n))))
            name = np.zeros(len(start), np.int64)
            whole = begin[1:] - 1  # the last phrase of a document is all of it
            owner, at, given, first = _given(batch.column(6))
            name[begin[owner] + at] = given
            ends = np.append(start[1:], 0)
            ends[np.maximum(whole - 1, 0)] = n
            part = np.ones(len(start), bool)
            part[whole] = False
            copied = name[whole] != 0
            later = np.zeros(len(n), bool)
            of_whole = begin[owner] + at == whole[owner]
            later[owner[of_whole]] = first[of_whole] != ids[owner[of_whole]]
            # a unique phrase rules out the windows that hold what its forming depended on
            lone = np.flatnonzero(part & (name == 0))
            lo = np.maximum(start[lone] + behind[lone] + 1 - window, 0)
            hi = np.minimum(start[lone] - before[lone], n[doc[lone]] - window)
            fits = (start[lone] >= before[lone]) & (start[lone] + behind[lone] < n[doc[lone]]) & (lo <= hi)
            lo, hi, at_doc = lo[fits], hi[fits], base[doc[lone[fits]]]
            known = np.repeat(copied, n - window + 1)
            alive = ~np.repeat(later, n - window + 1) & ~(covered(lo + at_doc, hi + at_doc + 1, int(base[-1])) & ~known)
            own = np.flatnonzero(part)
            yield _next_state(batch, n, base, alive, known, name[own], doc[own], start[own], ends[own] - start[own], window)

    return joined.select("id", "key", "n", "start", "before", "behind", "names").mapInArrow(run, STATE)


def next_state(joined: DataFrame, window: int) -> DataFrame:
    """State after a later round. joined: the state before with the names of its phrases."""

    def run(batches):
        for batch in parts_of(batches):
            n = batch.column(2).to_numpy().astype(np.int64)
            base = np.append(0, np.cumsum(n - window + 1))
            ids = batch.column(0).to_numpy()
            alive, known = flags_of(batch.column(3), base), flags_of(batch.column(4), base)
            name, doc = unlisted(batch.column(5))
            name = name.copy()
            start, size = (unlisted(batch.column(c))[0].astype(np.int64) for c in (6, 7))
            begin = np.append(0, np.cumsum(np.bincount(doc, minlength=len(n))))
            owner, at, given, first = _given(batch.column(8))
            place = begin[owner] + at
            name[place] = given
            long = size[place] >= window
            place, owner, first = place[long], owner[long], first[long]
            lo = base[owner] + start[place]
            hi = lo + size[place] - window + 1
            known |= covered(lo, hi, int(base[-1]))
            # its windows are told by the first copy: the first document's first one
            order = np.lexsort((start[place], name[place], owner))
            again = np.zeros(len(place), bool)
            again[order[1:]] = (owner[order[1:]] == owner[order[:-1]]) & (name[place][order[1:]] == name[place][order[:-1]])
            later = again | (first != ids[owner])
            alive &= ~covered(lo[later], hi[later], int(base[-1]))
            yield _next_state(batch, n, base, alive, known, name, doc, start, size, window)

    return joined.select("id", "key", "n", "alive", "known", "name", "start", "size", "names").mapInArrow(run, STATE)


def judged_windows(texts: DataFrame, window: int, rounds: int) -> DataFrame:
    """key, alive, known, id (of the text that tells) and open (some windows are not decided) after the rounds, of the texts (key,
    text) that have such windows. Equal texts have one row."""
    parsed = kept(first_phrases(texts, window).withColumn("id", F.monotonically_increasing_id()), "phrases")
    state = kept(first_state(parsed.join(named(parsed, 0), "id", "left"), window), "state")
    dropped(parsed)
    for number in range(1, rounds):
        after = kept(next_state(state.join(named(state, number), "id", "left"), window), "state")
        dropped(state)
        state = after
    # of copies, all are known to be repeated and one has windows to tell
    one = kept(state.groupBy("key").agg(F.max(F.struct("alive", "known", "id", "open")).alias("s")).select("key", "s.*"), "windows")
    dropped(state)
    return one


def remove_repeats(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """df with n_words, n_removed, kept_text (kept words joined by one space)."""
    return _remove(df, text_col, id_col, window, rounds, "kept_text")


def digests(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """id_col, n_words, n_removed and kept_sha256 of each row."""
    return _remove(df.select(id_col, text_col), text_col, id_col, window, rounds, "kept_sha256").select(id_col, "n_words", "n_removed", "kept_sha256")


def _remove(df: DataFrame, text_col: str, id_col: str, window: int, rounds: int, out: str) -> DataFrame:
    if window < 2 or rounds < 1:
        raise ValueError("a window has two words or more, and there is one round or more")
    df = cleared(df, ["n_words", "n_removed", out], [text_col, id_col])
    key, alive, known, number, opened, single = (free_name(df, n) for n in ("_key", "_alive", "_known", "_id", "_open", "_single"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = df.withColumn(key, F.unhex(F.substring(F.sha2(text, 256), 1, 32)))
    told = judged_windows(keyed.select(F.col(key).alias("key"), text.alias("text")), window, rounds)
    # rows of other texts stay where they are; a filter of fixed size may let some through
    slot = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    bits = told.select(F.col("key").alias(key)).groupBy(F.shiftright(slot, 6).alias("_word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(xxhash64(`{key}`), {FILTER_BITS}L) & 63 as int))")).alias("_bits"))
    bits = kept(bits, "filter")
    word, held = free_name(keyed, "_word"), free_name(keyed, "_bits")
    near = keyed.withColumn(word, F.shiftright(slot, 6)).join(F.broadcast(bits.withColumnsRenamed({"_word": word, "_bits": held})), word, "left")
    hit = F.coalesce(F.expr(f"(shiftright(`{held}`, cast(pmod(xxhash64(`{key}`), {FILTER_BITS}L) & 63 as int)) & 1L) = 1"), F.lit(False))
    none = F.lit(None).cast("array<int>")
    apart = near.where(~hit).drop(word, held).withColumn(alive, none).withColumn(known, none)
    copies = keyed.groupBy(key).agg(F.count("*").alias("n"))
    judged_texts = told.select(F.col("key").alias(key), F.col("alive").alias(alive), F.col("known").alias(known), F.col("id").alias(number), F.col("open").alias(opened))
    marked = salted_join(near.where(hit).drop(word, held), judged_texts, [key], copies, F.spark_partition_id(), "left")
    at_text, at_id, at_alive, at_known = (marked.columns.index(c) for c in (text_col, number, alive, known))

    def tell_windows(batches):
        seen: set[int] = set()
        for batch in batches:
            batch = batch.filter(pc.greater(pc.list_value_length(batch.column(at_alive)), 0))
            keys = batch.column(at_id).to_pylist()
            fresh = [x not in seen and not seen.add(x) for x in keys]  # of copies, one is enough
            batch, keys = batch.filter(pa.array(fresh, pa.bool_())), [x for x, f in zip(keys, fresh, strict=True) if f]
            if len(seen) > REMEMBERED:
                seen.clear()
            for row, data, offsets in flat.text_parts(batch.column(at_text).cast(pa.string())):
                words = flat.Words(data, offsets, hashed=False)
                base = np.append(0, np.cumsum(np.maximum(words.count - window + 1, 0)))
                part = batch.slice(row, len(offsets) - 1)
                open_, repeated = flags_of(part.column(at_alive), base), flags_of(part.column(at_known), base)
                at_word = word_bounds(words)
                for k, text in enumerate(flat.joined_words(data, offsets)):
                    at = np.flatnonzero(open_[base[k] : base[k + 1]])
                    if not len(at):
                        continue
                    own = np.append(at_word[words.first[k] : words.first[k + 1]], len(text) + 1)
                    one, two = halves([digest(text[x : y - 1]) for x, y in zip(own[at].tolist(), own[at + window].tolist(), strict=True)])
                    weight = np.where(repeated[base[k] + at], 2, 1)
                    yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two), pa.array(np.full(len(at), keys[row + k])), pa.array(at.astype(np.int32)), pa.array(weight.astype(np.int32))], names=["one", "two", "key", "place", "n"])

    windows = marked.mapInArrow(tell_windows, "one long, two int, key long, place int, n int")
    lone = windows.groupBy("one", "two").agg(F.sum("n").alias("n"), F.min("key").alias("key"), F.min("place").alias("place")).where("n = 1")
    # a window that is told once is of a text without copies, so its rows are few
    singles = lone.groupBy(F.col("key").alias(number)).agg(F.collect_list("place").alias(single))
    unsure = F.coalesce(F.col(opened), F.lit(False))
    judged = marked.where(unsure).join(singles, number, "left")
    for rest in (marked.where(~unsure), apart):
        judged = judged.unionByName(rest, allowMissingColumns=True)
    order = [judged.columns.index(c) for c in df.columns]
    at_text, at_alive, at_known, at_single = (judged.columns.index(c) for c in (text_col, alive, known, single))
    schema = T.StructType([*df.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField(out, T.StringType())])

    def cut(batches):
        for batch in batches:
            for row, data, offsets in flat.text_parts(batch.column(at_text).cast(pa.string())):
                words = flat.Words(data, offsets, hashed=False)
                part = batch.slice(row, len(offsets) - 1)
                base = np.append(0, np.cumsum(np.maximum(words.count - window + 1, 0)))
                gone = flags_of(part.column(at_alive), base)
                places, owner = unlisted(part.column(at_single))
                gone[base[owner] + places.astype(np.int64)] = False
                gone |= flags_of(part.column(at_known), base)
                at = np.flatnonzero(gone)
                owner = np.searchsorted(base, at, "right") - 1
                place = at - base[owner] + words.first[owner]
                stays = ~covered(place, place + window, len(words.starts))
                left = np.append(0, np.cumsum(stays))[words.first]
                raw, texts = data.tobytes(), []
                starts, ends = words.starts[stays].tolist(), words.ends[stays].tolist()
                for a, b in zip(left[:-1].tolist(), left[1:].tolist(), strict=True):
                    text = b" ".join([raw[x:y] for x, y in zip(starts[a:b], ends[a:b], strict=True)])
                    texts.append(hashlib.sha256(text).hexdigest() if out == "kept_sha256" else text.decode())
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in order], pa.array(words.count, pa.int64()), pa.array(words.count - np.diff(left), pa.int64()), pa.array(texts, pa.string())], names=schema.names)

    return judged.mapInArrow(cut, schema)
