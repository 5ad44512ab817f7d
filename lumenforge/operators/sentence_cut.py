"""Claims of plain texts, cut on the bytes of many texts at once; operators/text_tables.py has the rules and takes all other texts by them."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenforge.operators.clusters import SETS, sets_of
from lumenforge.operators.text_index import block_cuts, words_of

#: Bytes of text that are cut at once.
PART_BYTES = 1 << 19
#: What ends no sentence, as the lookbehind of X.sentences() has it.
ABBREVIATIONS = [b"Mr", b"Mrs", b"Dr", b"St", b"vs", b"etc", b"e.g", b"i.e"]
KINDS = [unicodedata.category(chr(c)) for c in range(0x250)]
#: Whether a code point is a letter or a number; whether it stands inside a word for \b.
LETTER = np.array([k[0] in "LN" for k in KINDS])
INSIDE = np.array([k[0] == "L" or k == "Nd" or chr(c) == "_" for c, k in enumerate(KINDS)])
SPACE, STOP = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32]), np.isin(np.arange(256), [*b".!?"])
QUANTITIES = "array<struct<unit:string,value:double>>"
QUANTITY = pa.list_(pa.struct([("unit", pa.string()), ("value", pa.float64())]))


def _bytes_of(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """(data, ends): the bytes of the texts, and where each begins, with the end of the last."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)
    return data, ends - ends[0]


def _parts(texts: pa.StringArray) -> list[tuple[int, int]]:
    """Rows [a, b) of about PART_BYTES each: what is made from them bounds a worker's memory."""
    cuts = block_cuts(np.diff(_bytes_of(texts)[1]), len(texts), PART_BYTES)
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def plain(texts: pa.StringArray) -> np.ndarray:
    """Whether a text has only characters to U+024F, but three that lower case turns into others, and general punctuation (U+2000 to U+206F)."""
    found = np.ones(len(texts), bool)
    for start, end in _parts(texts):
        data, ends = _bytes_of(texts.slice(start, end - start))
        other = data >= 0xCA
        three = np.flatnonzero(data[:-2] == 0xE2)
        other[three[(data[three + 1] == 0x80) | (data[three + 1] == 0x81) & (data[three + 2] < 0xB0)]] = False
        lead = np.flatnonzero((data[:-1] == 0xC4) | (data[:-1] == 0xC8) | (data[:-1] == 0xC9))
        at, after = data[lead], data[lead + 1]
        other[lead[(at == 0xC4) & (after == 0xB0) | (at == 0xC8) & ((after == 0xBA) | (after == 0xBE)) | (at == 0xC9) & (after > 0x8F)]] = True
        found[start + np.searchsorted(ends, np.flatnonzero(other), "right") - 1] = False
    return found


def _strings(data: np.ndarray, ends: np.ndarray) -> pa.StringArray:
    return pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))


def _inside(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """Whether each of size bytes stands in one of the disjoint spans [a, b)."""
    step = np.zeros(size + 1, np.int8)
    step[a] += 1
    step[b] -= 1
    return np.cumsum(step[:-1], dtype=np.int8) > 0


def _any(held: np.ndarray, ends: np.ndarray) -> np.ndarray:
    done = np.concatenate([[0], np.cumsum(held)])[ends]
    return done[1:] > done[:-1]


def _abbreviated(data: np.ndarray, at: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Whether a whole-word abbreviation and a full stop stand before each place; begins: where its text begins."""
    found = np.zeros(len(at), bool)
    byte = lambda p: data[np.maximum(p, 0)]
    for word in ABBREVIATIONS:
        near = np.flatnonzero(~found & (at - begins > len(word)))
        for k, c in enumerate((word + b".")[::-1], 1):
            near = near[byte(at[near] - k) == c]
        p = at[near] - len(word) - 2  # the byte before the word; the letters of plain texts have one or two bytes
        alone, last = p < begins[near], byte(p)
        lead = byte(p - 1)
        two = (last >= 0x80) & (lead >= 0xC2) & (lead <= 0xC9)
        code = np.where(last < 0x80, last, np.where(two, (lead.astype(np.int64) & 0x1F) << 6 | last & 0x3F, 0))
        found[near[alone | ~INSIDE[code]]] = True
    return found


def sentence_spans(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, owner, n): the bytes [a, b) of the sentences of plain texts, the text of each and its number there, as X.sentences() cuts them."""
    whole = np.flatnonzero(np.diff(ends))
    starts, lasts = ends[whole], ends[whole + 1] - 1
    space = SPACE[data]
    opens, shuts = space.copy(), space.copy()
    opens[1:] &= ~space[:-1]
    shuts[:-1] &= ~space[1:]
    opens[starts], shuts[lasts] = space[starts], space[lasts]
    at, to = np.flatnonzero(opens), np.flatnonzero(shuts) + 1
    owner = np.searchsorted(ends, at, "right") - 1
    told = (at > ends[owner]) & STOP[data[np.maximum(at - 1, 0)]]
    at, to, owner = at[told], to[told], owner[told]
    told = ~_abbreviated(data, at, ends[owner])
    held = ~(_inside(at[told], to[told], len(data)) | (data == 10))
    opens, shuts = held.copy(), held.copy()
    opens[1:] &= ~held[:-1]
    shuts[:-1] &= ~held[1:]
    opens[starts], shuts[lasts] = held[starts], held[lasts]
    a, b = np.flatnonzero(opens), np.flatnonzero(shuts) + 1
    inked = np.flatnonzero(data != 32)
    first, last = np.searchsorted(inked, a), np.searchsorted(inked, b) - 1
    full = last >= first
    a, b = inked[first[full]], inked[last[full]] + 1
    owner = np.searchsorted(ends, a, "right") - 1
    return a, b, owner, np.arange(len(a)) - np.searchsorted(owner, owner)


def _repeats(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether each text has a character six times in a row."""
    found = np.zeros(len(ends) - 1, bool)
    for width, low, high in ((1, 0, 0x80), (2, 0xC0, 0xE0), (3, 0xE0, 0xF0)):
        same = data[width:] == data[:-width]
        at = np.flatnonzero(same & (data[: len(same)] >= low) & (data[: len(same)] < high))
        for k in range(1, 5 * width):
            at = at[at + k < len(same)]
            at = at[same[at + k]]
        owner = np.searchsorted(ends, at, "right") - 1
        found[owner[at + 6 * width <= ends[owner + 1]]] = True
    return found


def _keys(lower: pa.StringArray) -> pa.StringArray:
    """X.text_key() of plain texts in lower case."""
    data, ends = _bytes_of(lower)
    held = LETTER[:256][data] & (data < 0x80)
    lead = np.flatnonzero((data[:-1] >= 0xC2) & (data[:-1] <= 0xC9))
    lead = lead[LETTER[(data[lead].astype(np.int64) & 0x1F) << 6 | data[lead + 1] & 0x3F]]
    held[lead] = held[lead + 1] = True
    gap = ~held
    gap[1:] &= held[:-1]
    gap[ends[:-1]] = False
    taken = held | gap
    return pc.ascii_rtrim(_strings(np.where(held, data, 32).astype(np.uint8)[taken], np.concatenate([[0], np.cumsum(taken)])[ends]), " ")


def columns_of(sets: bool) -> list[str]:
    return ["n", "score", "negated", "quantities", *(["s", "w"] if sets else ["claim"])]


def types_of(sets: bool) -> str:
    return f"n long, score int, negated boolean, quantities {QUANTITIES}, " + (SETS if sets else "claim string")


def cut_claims(batches, kept_columns: int, sets: bool, lengths: tuple[int, int], furniture: str, negations: str, units: str) -> Iterator[pa.RecordBatch]:
    """Batches (kept columns, text): rows (kept columns, n, claim, score in hundredths, negated, quantities) of the plain texts, as claims() defines them for
    texts without CJK; sets: with the claims' sets of words in place of their texts."""
    amount = re.compile(r"(?i)(\d+(?:[.,]\d+)*)\s*" + units, re.ASCII)
    ending, number = re.compile(r"(?i)" + units + r"\Z", re.ASCII), re.compile(r"[\d.,]+", re.ASCII)

    def quantities(claim: str) -> list[dict]:
        found = set()
        for m in amount.finditer(claim):
            try:
                found.add((ending.search(m[0])[1].lower(), float(number.match(m[0])[0].replace(",", ""))))
            except ValueError:  # 1.2.3 is no number
                pass
        return [{"unit": u, "value": v} for u, v in sorted(found)]

    def cut(part: pa.RecordBatch) -> pa.RecordBatch:
        data, ends = _bytes_of(part.column(kept_columns))
        a, b, owner, n = sentence_spans(data, ends)
        chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        size = chars[b] - chars[a]
        own = (size >= lengths[0]) & (size <= lengths[1])
        a, b, owner, n, size = a[own], b[own], owner[own], n[own], size[own]
        data, ends = data[_inside(a, b, len(data))], np.concatenate([[0], np.cumsum(b - a)])
        claims = _strings(data, ends)
        upper = (data >= 65) & (data <= 90)
        named = upper.copy()
        if len(data):
            named[:-1] &= upper[1:] | (data[1:] >= 97) & (data[1:] <= 122)
            named[ends[1:] - 1] = False
        holds = lambda texts, pattern: pc.match_substring_regex(texts, pattern).to_numpy(zero_copy_only=False).astype(bool)
        score = np.where((size >= 60) & (size <= 220), 35, np.where(size >= 40, 15, 0))
        score += 30 * _any((data >= 48) & (data <= 57), ends) + 15 * _any(named, ends) - 60 * holds(claims, furniture) - 50 * _repeats(data, ends)
        own = np.flatnonzero(score > 0)
        claims = claims.take(pa.array(own))
        lower = pc.utf8_lower(claims)
        code = _keys(lower).dictionary_encode()
        _, first = np.unique(owner[own] * max(len(code.dictionary), 1) + code.indices.to_numpy(), return_index=True)
        first = pa.array(np.sort(first))
        own, claims, lower = own[first.to_numpy()], claims.take(first), lower.take(first)
        lists: list[list] = [[]] * len(own)
        for k in np.flatnonzero(holds(claims, r"(?i)[0-9]\s*" + units)):
            lists[k] = quantities(claims[k].as_py())
        rows = pa.array(owner[own])
        told = [pa.array(n[own].astype(np.int64)), pa.array(score[own].astype(np.int32)), pa.array(holds(claims, negations)), pa.array(lists, QUANTITY)]
        if sets:
            words, many = words_of(lower)
            told += sets_of(words.dictionary_encode(), np.repeat(np.arange(len(own)), many), len(own))
        else:
            told.append(claims)
        return pa.RecordBatch.from_arrays([*(c.take(rows) for c in part.columns[:kept_columns]), *told], names=[*part.schema.names[:kept_columns], *columns_of(sets)])

    for batch in batches:
        for start, end in _parts(batch.column(kept_columns)):
            part = batch.slice(start, end - start)
            yield cut(part.filter(pa.array(plain(part.column(kept_columns)))))


def claim_cutter(*given) -> Callable:
    return lambda batches: cut_claims(batches, *given)


def is_plain(text: Column) -> Column:
    """plain() as a column; null texts are plain."""

    @F.arrow_udf("boolean")
    def told(texts: pa.Array) -> pa.Array:
        return pa.array(plain(texts))

    return told(text)
